"""A compressed radix trie over byte strings that moves its heaviest subtree to a local spill file when it grows too large."""

from __future__ import annotations

import struct
import tempfile
from collections.abc import Iterator
from typing import BinaryIO

_HEAD = struct.Struct("<q?qqII")
#: Bytes that a node with its owner, and each row that asks an owner, are taken to need besides the label.
NODE_BYTES, ASKER_BYTES = 400, 100


def common_prefix(a: bytes, b: bytes, at: int) -> int:
    """How many bytes of ``a`` agree with ``b`` from ``at`` on, by halving."""
    n = min(len(a), len(b) - at)
    if a[:n] == b[at : at + n]:
        return n
    low = 0
    while n - low > 1:
        mid = (low + n) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            n = mid
    return low


class Owner:
    """What a terminal node stores: the identifier that stays, how many rows ended here, and who asked, each with its identifier."""

    __slots__ = ("key", "best", "rows", "askers")

    def __init__(self, key: bytes) -> None:
        self.key, self.best, self.rows, self.askers = key, None, 0, {}

    def add(self, identifier: int | None, rows: int, largest: bool, asker: int) -> bool:
        """Whether this asker asks for the first time; ``identifier`` is the best that it knows."""
        self.rows += rows
        new = asker not in self.askers
        known = self.askers.get(asker)
        self.askers[asker] = identifier if known is None or (identifier is not None and (identifier > known) == largest) else known
        if identifier is not None and (self.best is None or (identifier > self.best if largest else identifier < self.best)):
            self.best = identifier
        return new


class _Node:
    __slots__ = ("label", "below", "owner", "file")

    def __init__(self, label: bytes, owner: Owner | None = None) -> None:
        self.label, self.below, self.owner, self.file = label, {}, owner, None

    def size(self) -> int:
        """Bytes of this node alone."""
        return len(self.label) + NODE_BYTES + (ASKER_BYTES * len(self.owner.askers) if self.owner else 0)


class OwnerTrie:
    """Owners of equal byte strings. ``budget`` bounds the bytes in memory; what exceeds it goes to disk by subtree.

    A subtree's file holds what follows its whole common prefix, so that prefix is neither written nor walked again. Files
    have no name: they go with the task, however it ends.
    """

    def __init__(self, largest: bool = True, budget: int = 128 << 20) -> None:
        self.largest, self.budget = largest, budget
        self.root = _Node(b"")
        self.total = NODE_BYTES
        self.peak = 0
        self.files: list[BinaryIO] = []

    def insert(self, key: bytes, identifier: int | None, rows: int = 1, tag: bytes = b"", asker: int = 0) -> None:
        node, at = self.locate(key)
        if node.file is not None:
            _append(node.file, key[at:], identifier, rows, tag, asker)
            return
        if node.owner is None:
            node.owner = Owner(tag)
        if node.owner.add(identifier, rows, self.largest, asker):
            self.total += ASKER_BYTES
        self.peak = max(self.peak, self.total)
        while self.total > self.budget and self.root.below and self._spill():
            pass

    def owner(self, key: bytes) -> Owner:
        """The owner of ``key`` in a trie that has not spilled."""
        node, _ = self.locate(key)
        if node.owner is None:
            node.owner = Owner(b"")
        return node.owner

    def locate(self, key: bytes) -> tuple[_Node, int]:
        """The node where ``key`` ends, made if need be, or the spilled one above it; and how much of the key leads there."""
        node, at = self.root, 0
        while at < len(key) and node.file is None:
            child = node.below.get(key[at])
            if child is None:
                child = node.below[key[at]] = _Node(key[at:])
                self.total += NODE_BYTES + len(child.label)
                return child, len(key)
            same = common_prefix(child.label, key, at)
            if same < len(child.label):
                upper = _Node(child.label[:same])
                child.label = child.label[same:]
                upper.below[child.label[0]] = child
                node.below[key[at]] = child = upper
                self.total += NODE_BYTES
            node, at = child, at + same
        return node, at

    def _spill(self) -> bool:
        """Move what stands at and below the deepest node that holds half of the memory to a file; false if nothing can go."""
        sizes: dict[int, int] = {}
        for node, done in _both_ways(self.root):
            if done:
                sizes[id(node)] = node.size() + sum(sizes[id(c)] for c in node.below.values())
        node = self.root
        while node.below:
            heaviest = max(node.below.values(), key=lambda c: sizes[id(c)])
            if node is not self.root and 2 * sizes[id(heaviest)] < sizes[id(self.root)]:
                break
            node = heaviest
        if node.file is not None or node is self.root:
            return False
        out = tempfile.TemporaryFile(prefix="trie-")
        stack = [(child, child.label) for child in node.below.values()]
        ended = [(b"", node.owner)] if node.owner else []
        nested: list[tuple[bytes, BinaryIO]] = []
        while stack or ended:
            for key, owner in ended:
                share = owner.rows - (len(owner.askers) - 1)
                for k, (asker, identifier) in enumerate(owner.askers.items()):
                    _append(out, key, identifier, share if k == 0 else 1, owner.key, asker)
            ended = []
            if stack:
                below, key = stack.pop()
                if below.file is not None:
                    nested.append((key, below.file))
                elif below.owner is not None:
                    ended.append((key, below.owner))
                stack.extend((child, key + child.label) for child in below.below.values())
        for key, file in nested:  # subtrees that went earlier join this one's file
            for suffix, *told in _records(file):
                _append(out, key + suffix, *told)
            self.files.remove(file)
            file.close()
        self.total -= sizes[id(node)] - node.size()
        if node.owner:
            self.total -= ASKER_BYTES * len(node.owner.askers)
        node.below, node.owner, node.file = {}, None, out
        self.files.append(out)
        return True

    def owners(self) -> Iterator[Owner]:
        """Every owner once; spilled subtrees are rebuilt one after the other."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.owner is not None:
                yield node.owner
            stack.extend(node.below.values())
        self.root, self.total = _Node(b""), NODE_BYTES
        todo, self.files = self.files, []
        while todo:
            file = todo.pop()
            inner = OwnerTrie(self.largest, self.budget)
            for suffix, *told in _records(file):
                inner.insert(suffix, *told)
            file.close()
            later, inner.files = inner.files, []
            yield from inner.owners()
            self.peak = max(self.peak, inner.peak)
            todo.extend(later)


def _both_ways(root: _Node) -> Iterator[tuple[_Node, bool]]:
    """Every node on the way down, and again (true) when all below it are done."""
    stack = [(root, False)]
    while stack:
        node, done = stack.pop()
        yield node, done
        if not done:
            stack.append((node, True))
            stack.extend((child, False) for child in node.below.values())


def _append(out: BinaryIO, key: bytes, identifier: int | None, rows: int, tag: bytes, asker: int) -> None:
    out.write(_HEAD.pack(identifier or 0, identifier is not None, rows, asker, len(tag), len(key)) + tag + key)


def _records(file: BinaryIO) -> Iterator[tuple[bytes, int | None, int, bytes, int]]:
    file.seek(0)
    while head := file.read(_HEAD.size):
        identifier, known, rows, asker, n_tag, n_key = _HEAD.unpack(head)
        tag = file.read(n_tag)
        yield file.read(n_key), identifier if known else None, rows, tag, asker
