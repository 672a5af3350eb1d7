"""A Merkle manifest of a dataset: parents keep the hash state before each child, so a changed leaf is folded without its left siblings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import map_arrow
from ..similarity.common import write_once
from . import midstate as ms

ARITY = 2
#: A block of leaves, or of roots of blocks, has at most so many members, whatever the number of leaves.
BLOCK = 1024
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODES = "grp string, idx long, height int, digest binary"
_PATHS = "grp string, idx long, name string, subroot binary, root binary, path binary"
_PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def field(value: Column) -> Column:
    """A value in the bytes of a leaf: its size and itself, or a dash for a null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def levels_of(n: int, arity: int) -> int:
    """How often runs of ``arity`` become one node until one is left."""
    k = 0
    while n > 1:
        n, k = -(-n // arity), k + 1
    return k


def step_of(arity: int) -> int:
    """Levels that one block spans."""
    k = 1
    while arity ** (k + 1) <= BLOCK:
        k += 1
    return k


class Subtree:
    """The nodes of a block level by level, and the state before each child in its parent's hash."""

    def __init__(self, leaves: np.ndarray, levels: int, arity: int) -> None:
        self.arity, self.nodes, self.before = arity, [leaves], []
        for _ in range(levels):
            children = self.nodes[-1]
            n = children.shape[1]
            parents = -(-n // arity)
            state, kept = ms.begin(parents), np.empty((8, n), np.uint32)
            for slot in range(arity):
                mine = children[:, slot::arity]
                held = mine.shape[1]
                kept[:, slot::arity] = state[:, :held]
                state[:, :held] = ms.absorb(state[:, :held], mine)
            last = n - (parents - 1) * arity
            self.before.append(kept)
            self.nodes.append(np.concatenate((ms.finish(state[:, :-1], arity), ms.finish(state[:, -1:], last)), axis=1))

    def run(self, level: int, child: int) -> tuple[int, int]:
        """First member and size of the run that a child belongs to."""
        first = child // self.arity * self.arity
        return first, min(self.arity, self.nodes[level].shape[1] - first)

    def fold(self, changed: np.ndarray) -> np.ndarray:
        """The block's root as each leaf alone, replaced by its column of ``changed``, would make it."""
        at, current = np.arange(self.nodes[0].shape[1]), changed
        for level, kept in enumerate(self.before):
            nodes = self.nodes[level]
            slot = at % self.arity
            size = np.minimum(self.arity, nodes.shape[1] - (at - slot))
            state = ms.absorb(kept[:, at], current)  # the state before the slot, and the replacement
            for right in range(1, self.arity):
                more = np.flatnonzero(slot + right < size)
                if len(more):
                    state[:, more] = ms.absorb(state[:, more], nodes[:, at[more] + right])
            current = np.empty_like(state)
            for blocks in np.unique(size).tolist():
                mine = size == blocks
                current[:, mine] = ms.finish(state[:, mine], blocks)
            at = at // self.arity
        return current

    def path(self, child: int) -> bytes:
        """For each level on the way up: the child's slot, its run's size, the state before it and its siblings in order."""
        out = []
        for level, kept in enumerate(self.before):
            first, size = self.run(level, child)
            others = [k for k in range(first, first + size) if k != child]
            out.append(bytes((child - first, size)) + ms.to_bytes(kept[:, child : child + 1]) + ms.to_bytes(self.nodes[level][:, others]))
            child //= self.arity
        return b"".join(out)


def read_path(path: bytes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slot, size of the run, state before the slot, and siblings of each level."""
    at = 0
    while at < len(path):
        slot, size = path[at], path[at + 1]
        end = at + 34 + 32 * (size - 1)
        yield slot, size, ms.from_bytes(path[at + 2 : at + 34]), ms.from_bytes(path[at + 34 : end])
        at = end


def resume(path: bytes, current: np.ndarray) -> np.ndarray:
    """Roots above a node that is replaced by each column of ``current``."""
    n = current.shape[1]
    for slot, size, before, siblings in read_path(path):
        state = ms.absorb(np.repeat(before, n, axis=1), current)
        for right in range(slot, size - 1):
            state = ms.absorb(state, np.repeat(siblings[:, right : right + 1], n, axis=1))
        current = ms.finish(state, size)
    return current


def siblings_hex(path: bytes) -> bytes:
    return b"".join(ms.to_bytes(siblings) for *_, siblings in read_path(path)).hex().encode()


def _batch(rows: list[tuple], kinds: tuple, names: str) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names.split())


def _members(members: list[dict], key: str) -> np.ndarray:
    return ms.from_bytes(b"".join(m[key] for m in members))


def _raise(arity: int):
    """Blocks (grp, block, height, members) to their roots, a block one node of the next tier."""
    step = step_of(arity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for grp, block, height, members in zip(*(batch.column(k).to_pylist() for k in range(4))):
                tree = Subtree(_members(members, "digest"), min(step, height), arity)
                rows.append((grp, block, height - min(step, height), ms.to_bytes(tree.nodes[-1])))
            yield _batch(rows, (pa.string(), pa.int64(), pa.int32(), pa.binary()), "grp idx height digest")

    return run


def _descend(arity: int):
    """Blocks with the path of their root (grp, block, height, members, subroot, root, path) to the paths of their members."""
    step = step_of(arity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grp, block, height, members, subroot, root, above in zip(*(batch.column(k).to_pylist() for k in range(7))):
                tree = Subtree(_members(members, "digest"), min(step, height), arity)
                rows = [(grp, m["idx"], m["name"], subroot or m["digest"], root, tree.path(k) + above) for k, m in enumerate(members)]
                yield _batch(rows, (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary()), "grp idx name subroot root path")

    return run


def _prove(arity: int):
    """Blocks of leaves with the path of their root to a row a leaf: proof, and the root folded from the leaf or its replacement."""
    step = step_of(arity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, height, members, subroot, root, above in zip(*(batch.column(k).to_pylist() for k in range(7))):
                tree = Subtree(_members(members, "digest"), min(step, height), arity)
                changed = ms.from_bytes(b"".join(m["changed"] or m["digest"] for m in members))
                local = ms.to_bytes(tree.fold(changed))
                own = [local[32 * k : 32 * k + 32] for k in range(len(members))]
                apart = list(dict.fromkeys(own))  # leaves that leave the block's root as it is go on as one
                above_root = ms.to_bytes(resume(above, ms.from_bytes(b"".join(apart)))).hex()
                folded = {x: above_root[64 * k : 64 * k + 64] for k, x in enumerate(apart)}
                upper, rows = siblings_hex(above), []
                for k, m in enumerate(members):
                    mine = folded[own[k]]
                    rows.append((m["id"], m["digest"].hex(), subroot.hex(), root.hex(), hashlib.sha256(siblings_hex(tree.path(k)) + upper).hexdigest(), mine, mine == root.hex()))
                text = pa.string()
                yield _batch(rows, (pa.int64(), text, text, text, text, text, pa.bool_()), "doc_id leaf subroot root proof_sha256 folded_root verified")

    return run


def in_runs(nodes: DataFrame, group: str, *order: str) -> DataFrame:
    """Adds ``idx``, the place (from 0) of each row in its group, and ``total``, the group's rows. No task holds a group.

    Rows are dealt by ranges of group and order and counted by task; the tasks' running totals in a group, one row a task and
    group, are the offsets. Equal rows are spread by their place in the input.
    """
    spread = nodes.withColumn("__tie", F.monotonically_increasing_id())
    dealt = spread.repartitionByRange(group, *order, "__tie").sortWithinPartitions(group, *order, "__tie").drop("__tie")
    placed = write_once(dealt.withColumn("__at", F.monotonically_increasing_id()), "merkle-placed").withColumn("__task", F.shiftright("__at", 33))
    counts = placed.groupBy(group, "__task").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    upto = F.sum("__n").over(Window.partitionBy(group).orderBy("__task").rowsBetween(Window.unboundedPreceding, 0))
    offsets = counts.select(group, "__task", "__first", (upto - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy(group)).alias("total"))
    return placed.join(offsets, [group, "__task"]).withColumn("idx", F.col("__before") + F.col("__at") - F.col("__first")).drop("__task", "__at", "__n", "__first", "__before")


def _blocked(nodes: DataFrame, arity: int, *carried: str) -> DataFrame:
    """Blocks of consecutive nodes of a group, each at most ``BLOCK`` of them."""
    width = arity ** step_of(arity)
    members = F.array_sort(F.collect_list(F.struct("idx", "digest", *carried)))
    return nodes.groupBy("grp", F.floor(F.col("idx") / width).cast("long").alias("block")).agg(F.first("height").alias("height"), members.alias("members")).select("grp", "block", "height", "members")


def _tiers(leaves: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of leaves, blocks of their roots and so on, and the last roots, one a group."""
    tiers = [leaves]
    while True:
        roots = write_once(map_arrow(tiers[-1], _raise(arity), _NODES), "merkle-roots")
        if not roots.where("height > 0").limit(1).count():
            return tiers, roots
        tiers.append(_blocked(roots.withColumn("name", F.lit(None).cast("string")), arity, "name"))


def _below(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    known = paths.select("grp", F.col("idx").alias("block"), "subroot", "root", "path")
    return blocks.join(known, ["grp", "block"]).select("grp", "block", "height", "members", "subroot", "root", "path")


def _height(total: Column, arity: int) -> Column:
    """``levels_of`` as a column: the powers of the arity that the number exceeds."""
    powers = [arity**k for k in range(64) if arity**k < 1 << 62]
    return F.size(F.filter(F.array(*map(F.lit, powers)), lambda p: p < total)).cast("int")


def prove(leaves: DataFrame, arity: int = ARITY) -> DataFrame:
    """Build the tree over leaves (grp, id, digest, changed) and prove each leaf.

    Of each group, leaves in ascending order of id make runs of ``arity``, the last may be shorter, and every run becomes the hash of
    its members' hex digests, until one node remains: the subroot. Subroots, in the order of their groups, make the root alike.
    Every parent keeps the state of its hash before each child. A leaf, or ``changed`` in its place, is folded up from the state
    before it and the siblings to its right; what stands to its left is not hashed again.

    The tree is built in tiers of blocks of at most ``BLOCK`` nodes: block roots are the leaves of the next tier. Paths come down
    the same tiers. So a task holds a block, and a group of any size is the work of many tasks.
    """
    placed = in_runs(leaves, "grp", "id", "digest").withColumn("height", _height(F.col("total"), arity))
    blocks = write_once(_blocked(placed, arity, "id", "changed"), "merkle-blocks")
    tiers, subroots = _tiers(blocks, arity)
    named = in_runs(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"), "grp", "name")
    top, root = _tiers(_blocked(named.withColumn("height", _height(F.col("total"), arity)), arity, "name"), arity)
    nothing = F.lit(None).cast("binary")
    paths = root.select("grp", "idx", F.lit(None).cast("string").alias("name"), nothing.alias("subroot"), F.col("digest").alias("root"), F.encode(F.lit(""), "UTF-8").alias("path"))
    for k, tier in enumerate(reversed(top)):
        last = k == len(top) - 1
        found = map_arrow(_below(tier, paths), _descend(arity), _PATHS)
        paths = write_once(found if last else found.withColumn("subroot", nothing), "merkle-paths")
    paths = paths.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("idx"), "subroot", "root", "path")
    for tier in reversed(tiers[1:]):
        paths = write_once(map_arrow(_below(tier, paths), _descend(arity), _PATHS), "merkle-paths")
    return map_arrow(_below(blocks, paths), _prove(arity), _PROVED)


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of documents by language; where 7 divides the CRC-32 of the id, ``changed`` is the leaf with one more in n_chars."""
    more = {c: F.col(c) for c in FIELDS} | {"n_chars": (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")}
    leaf = lambda of: F.unhex(F.sha2(F.concat(*[field(of[c]) for c in FIELDS]), 256))
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    group = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    return docs.select(group.alias("grp"), F.col("doc_id").cast("long").alias("id"), leaf({c: F.col(c) for c in FIELDS}).alias("digest"), F.when(tampered & F.col("n_chars").isNotNull(), leaf(more)).alias("changed"))


def prove_documents(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """The manifest of documents: leaf, subroot of the language, root, digest of the proof, and the root that the tampered leaf gives.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, a row a row. A null field is a dash in its leaf, which
    an empty text is not. Documents without an id come first in their language, documents without a language are one of their
    own, first of all. Rows that share an id stand in the order of their leaves; equal rows have equal leaves, each with its own
    place and proof. An empty table gives an empty one. Other columns are not read.
    """
    return prove(document_leaves(docs), arity)


def brute_force(docs: list[tuple], arity: int = ARITY) -> list[tuple]:
    """The same rows from (doc_id, source, lang, n_chars, text) by hashing whole levels with hashlib, for tests on small tables."""
    import zlib

    def digest(values: list[str]) -> str:
        return hashlib.sha256("".join(values).encode()).hexdigest()

    def leaf(row: tuple) -> str:
        return digest(["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])

    def build(nodes: list[str]) -> list[list[str]]:
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest(out[-1][k : k + arity]) for k in range(0, len(out[-1]), arity)])
        return out

    def climb(tree: list[list[str]], k: int, value: str) -> tuple[list[str], str]:
        siblings = []
        for level in tree[:-1]:
            a = k // arity * arity
            run = level[a : a + arity]
            siblings += run[: k - a] + run[k - a + 1 :]
            value = digest(run[: k - a] + [value] + run[k - a + 1 :])
            k //= arity
        return siblings, value

    groups: dict = {}
    for row in docs:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [build([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order]
    top = build([t[-1][0] for t in trees])
    out = []
    for n, g in enumerate(order):
        for k, (_, _, mine, row) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None
            value = leaf((*row[:3], row[3] + 1, row[4])) if tampered else mine
            low, sub = climb(trees[n], k, value)
            high, folded = climb(top, n, sub)
            out.append((row[0], mine, trees[n][-1][0], top[-1][0], digest(low + high), folded, folded == top[-1][0]))
    return out


_F = "coalesce(strlen(({0})::varchar) || ':' || ({0})::varchar, '-')"
_LEAF = "sha256({})"
_CRC = """list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(0, 8)), lambda v, k: case when v % 2 = 1 then xor(v // 2, 3988292384::bigint) else v // 2 end))"""
_fields = lambda n_chars: _LEAF.format(" || ".join(_F.format(n_chars if c == "n_chars" else c) for c in FIELDS))

SQL = f"""
with recursive lf as (select doc_id, coalesce('=' || lang, '') as g, {_fields("n_chars")} as leaf,
  case when n_chars is not null and xor({_CRC}, 4294967295::bigint) % 7 = 0 then {_fields("n_chars + 1")} end as changed from documents),
l as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as idx, ceil(log2(count(*) over (partition by g)))::bigint as h from lf),
tr(g, h, lvl, idx, digest) as (select g, h, 0::bigint, idx, leaf from l
  union all select g, h, lvl + 1, idx // 2, sha256(string_agg(digest, '' order by idx)) from tr where lvl < h group by g, h, lvl, idx // 2),
s as (select g, digest, row_number() over (order by g) - 1 as idx, ceil(log2(count(*) over ()))::bigint as h from tr where lvl = h),
tp(h, lvl, idx, digest) as (select h, 0::bigint, idx, digest from s
  union all select h, lvl + 1, idx // 2, sha256(string_agg(digest, '' order by idx)) from tp where lvl < h group by h, lvl, idx // 2),
f(g, row, h, lvl, idx, cur, sib) as (select g, idx, h, 0::bigint, idx, coalesce(changed, leaf), '' from l
  union all select f.g, f.row, f.h, f.lvl + 1, f.idx // 2, sha256(case when f.idx % 2 = 0 then f.cur || coalesce(n.digest, '') else n.digest || f.cur end), f.sib || coalesce(n.digest, '')
  from f left join tr n on n.g = f.g and n.lvl = f.lvl and n.idx = xor(f.idx, 1) where f.lvl < f.h),
u(g, row, h, lvl, idx, cur, sib) as (select f.g, f.row, s.h, 0::bigint, s.idx, f.cur, f.sib from f join s on s.g = f.g where f.lvl = f.h
  union all select u.g, u.row, u.h, u.lvl + 1, u.idx // 2, sha256(case when u.idx % 2 = 0 then u.cur || coalesce(n.digest, '') else n.digest || u.cur end), u.sib || coalesce(n.digest, '')
  from u left join tp n on n.lvl = u.lvl and n.idx = xor(u.idx, 1) where u.lvl < u.h)
select l.doc_id, l.leaf, s.digest as subroot, r.digest as root, sha256(u.sib) as proof_sha256, u.cur as folded_root, u.cur = r.digest as verified
from l join s on s.g = l.g join u on u.g = l.g and u.row = l.idx and u.lvl = u.h cross join (select digest from tp where lvl = h) r
"""
