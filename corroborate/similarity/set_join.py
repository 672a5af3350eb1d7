"""Set-similarity join of documents on word shingles: rare-first prefixes with length, positional and suffix filters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .common import discard, exchange_width, salted_join, text_of, write_once
from .graph import components
from .packed import SCHEMA, batch_of, by_group, deal, narrow, pack_arrays, release, unpack_arrays
from .words import inside, mix, text_groups, window_hashes, word_hashes

#: Text that one map task gathers before it deals its shingles out.
FLUSH_BYTES = 24 << 20
#: Of a shingle that more sets of one gathering hold, the gathering sends their number alone, and keeps who they are.
DENSE = 32
#: Sets of one token that meet in a block when all its pairs are compared.
BLOCK = 2048
_DOC, _SET, _ENTRIES, _DENSE, _SHARED, _TOLD, _MEMBERS = range(7)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and their bounds. A text with fewer words has its whole sequence as one."""
    words, at = word_hashes(data, bounds, lower=True)
    shingles = window_hashes(words, size)
    ok = inside(at, size)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(shingles)][ok]
    shingles = shingles[ok]
    counts = np.bincount(owner, minlength=len(at) - 1)
    short = np.flatnonzero((counts == 0) & (np.diff(at) > 0))
    if len(short):
        extra = np.array([int(window_hashes(words[at[k] : at[k + 1]], int(at[k + 1] - at[k]))[0]) for k in short], np.uint64)
        places = np.searchsorted(owner, short)
        owner, shingles = np.insert(owner, places, short), np.insert(shingles, places, extra)
        counts[short] = 1
    edges = np.concatenate(([0], np.cumsum(counts)))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        shingles[a:b].sort()
    keep = np.ones(len(shingles), bool)
    keep[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    return shingles[keep], np.concatenate(([0], np.cumsum(np.bincount(owner[keep], minlength=len(at) - 1))))


def set_keys(shingles: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set; texts with equal sets form one class."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(shingles), dtype=np.uint64)))
    return mix(total[edges[1:]] - total[edges[:-1]] + np.diff(edges).astype(np.uint64))


def _part_of(keys: np.ndarray, width: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) % np.uint64(width)).astype(np.uint16 if width < 1 << 16 else np.uint32)


def _group_tag(keys: np.ndarray) -> np.ndarray:
    """A number of one gathering that depends on its sets alone, so that a task that is tried again gives the same."""
    return mix(np.array([keys.sum(dtype=np.uint64) + np.uint64(len(keys))], np.uint64))


def _dense(hashes: np.ndarray) -> np.ndarray:
    """Which entries belong to a hash that stands over DENSE times. Only cells of a coarse table that hold as many are sorted."""
    cell = (hashes >> np.uint64(42)).astype(np.int64)
    maybe = np.flatnonzero(np.bincount(cell, minlength=1)[cell] > DENSE)
    out = np.zeros(len(hashes), bool)
    order = maybe[np.argsort(hashes[maybe], kind="stable")]
    _, count = by_group(hashes[order])
    out[order] = np.repeat(count > DENSE, count)
    return out


def _shared_rows(key: np.ndarray, token: np.ndarray, df: np.ndarray, width: int) -> list[tuple[int, int, bytes]]:
    """Rows (one a part of sets) that tell sets of their shingles that others hold too, with the document frequency."""
    part = _part_of(key, width)
    order = np.lexsort((key, part))
    key, token, df, part = key[order], token[order], df[order], part[order]
    rows = []
    for a, c in zip(*(x.tolist() for x in by_group(part))):
        held, times = by_group(key[a : a + c])
        rows.append((int(part[a]), _SHARED, pack_arrays(key[a : a + c][held], narrow(times), token[a : a + c], narrow(df[a : a + c]))))
    return rows


def _deal_shingles(width: int, size: int):
    """Map side: the documents with their set's key, each distinct set's size, and its shingles packed by the part of their hash."""

    def emit(docs: list[np.ndarray], named: list[np.ndarray], keys: list[np.ndarray], sizes: list[np.ndarray], hashes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        doc, known, key, n, h = (np.concatenate(x) for x in (docs, named, keys, sizes, hashes))
        tag = _group_tag(key)
        own = int(tag[0] % np.uint64(width))
        rows: list[tuple[int, int, bytes]] = [(own, _DOC, pack_arrays(doc, known, key, narrow(n)))]
        # copies within these texts are sent once
        new = np.zeros(len(key), bool)
        new[np.unique(key, return_index=True)[1]] = True
        h = h[np.repeat(new, n)]
        owner = np.repeat(np.arange(int(new.sum()), dtype=np.uint32), n[new])
        key, n = key[new], n[new]
        part = _part_of(key, width)
        order = np.argsort(part, kind="stable")
        for a, c in zip(*(x.tolist() for x in by_group(part[order]))):
            at = order[a : a + c]
            rows.append((int(part[at[0]]), _SET, pack_arrays(key[at], narrow(n[at]))))
        dense = _dense(h)
        if dense.any():
            at = np.flatnonzero(dense)
            at = at[np.argsort(h[at], kind="stable")]
            first, count = by_group(h[at])
            heads = h[at[first]]
            rows.append((own, _MEMBERS, pack_arrays(tag, heads, count, key[owner[at]])))
            part = _part_of(heads, width)
            order = np.argsort(part, kind="stable")
            for a, c in zip(*(x.tolist() for x in by_group(part[order]))):
                some = order[a : a + c]
                rows.append((int(part[some[0]]), _DENSE, pack_arrays(tag, heads[some], narrow(count[some]))))
            h, owner = h[~dense], owner[~dense]
        yield batch_of(rows)
        part = _part_of(h, width)
        order = np.argsort(part, kind="stable")
        rows = []
        for a, c in zip(*(x.tolist() for x in by_group(part[order]))):
            at = order[a : a + c]
            held, times = by_group(owner[at])
            rows.append((int(part[at[0]]), _ENTRIES, pack_arrays(key[owner[at[held]]], narrow(times), h[at])))
            if len(rows) == 64:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, ...] = ([], [], [], [], [])
        gathered = 0
        for batch in batches:
            ids, known = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
            for first, end, data, bounds in text_groups(batch, 1):
                shingles, edges = shingle_sets(data, bounds, size)
                for x, y in zip(held, (ids[first:end], known[first:end], set_keys(shingles, edges), np.diff(edges), shingles)):
                    x.append(y)
                gathered += len(data)
                if gathered >= FLUSH_BYTES:
                    yield from emit(*held)
                    held, gathered = ([], [], [], [], []), 0
        if held[0]:
            yield from emit(*held)

    return run


def _count_shingles(width: int):
    """Reduce side: of each shingle that two sets or more hold, tell these sets, or the gatherings that keep them, its frequency.

    A set that several gatherings send is counted once, but once for each gathering that sends a number alone: frequencies
    only order the shingles, and every set is told the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, hashes, dense = [], [], []
        for batch in batches:
            rows = []
            for part, kind, payload in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if kind == _ENTRIES:
                    key, times, low = unpack_arrays(payload)
                    keys.append(np.repeat(key, times))
                    hashes.append(low)
                elif kind == _DENSE:
                    tag, heads, count = unpack_arrays(payload)
                    dense.append((np.repeat(tag, len(heads)), heads, count.astype(np.int64)))
                else:
                    rows.append((part, kind, payload))
            if rows:
                yield batch_of(rows)
        tags, heads, sums = (np.concatenate(x) for x in zip(*dense)) if dense else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        known, at = np.unique(heads, return_inverse=True)
        sums = np.bincount(at, weights=sums, minlength=len(known)).astype(np.int64)
        if keys:
            key, h = np.concatenate(keys), np.concatenate(hashes)
            keys.clear()
            hashes.clear()
            order = np.argsort(h)
            h = h[order]
            again = h[1:] == h[:-1]
            several = np.concatenate((again, [False])) | np.concatenate(([False], again))
            if len(known):
                several |= np.isin(h, known)
            key, h = key[order[several]], h[several]
            order = np.lexsort((key, h))
            key, h = key[order], h[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1])
            key, h = key[new], h[new]
            first, count = by_group(h)
            df = count.copy()
            if len(known):
                spot = np.minimum(np.searchsorted(known, h[first]), len(known) - 1)
                hit = known[spot] == h[first]
                df[hit] += sums[spot[hit]]
                sums[spot[hit]] += count[hit]
            df = np.repeat(df, count)
            yield batch_of(_shared_rows(key[df > 1], h[df > 1], df[df > 1], width))
        rows = []
        order = np.argsort(tags, kind="stable")
        for a, c in zip(*(x.tolist() for x in by_group(tags[order]))):
            some = order[a : a + c]
            rows.append((int(tags[some[0]] % np.uint64(width)), _TOLD, pack_arrays(tags[some[:1]], heads[some], sums[at[some]])))
        if rows:
            yield batch_of(rows)

    return run


def _tell_members(width: int):
    """Each gathering tells the sets that it keeps: its part gets the frequencies first, then the members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for kind, payload in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if kind == _TOLD:
                    tag, heads, df = unpack_arrays(payload)
                    told.setdefault(int(tag[0]), []).append((heads, df))
                    continue
                tag, heads, count, members = unpack_arrays(payload)
                known, df = (np.concatenate(x) for x in zip(*told[int(tag[0])]))
                order = np.argsort(known, kind="stable")
                at = order[np.searchsorted(known, heads, sorter=order)]
                yield batch_of(_shared_rows(members, np.repeat(heads, count), np.repeat(df[at], count), width))

    return run


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for payload in batch.column(2).to_pylist():
            doc, known, key, n = unpack_arrays(payload)
            for a in range(0, len(doc), 50_000):
                b = slice(a, a + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(doc[b], pa.int64(), mask=known[b] == 0), pa.array(key[b].view(np.int64)), pa.array(n[b].astype(np.int64))], names=["doc_id", "cls", "n"])


_SETS = "cls long, n long, lone long, tokens binary, prefix array<struct<token: long, pos: int>>"


def _prefixes(percent: int):
    """For each set: its shingles that other sets hold too, and those of them within its rare-first prefix with their places.

    Shingles that no other set holds are the rarest: they fill the first places, and need not be kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, shared = [], []
        for batch in batches:
            for kind, payload in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                (sets if kind == _SET else shared).append(unpack_arrays(payload))
        if not sets:
            return
        cls, n = (np.concatenate([s[k] for s in sets]) for k in range(2))
        key = np.concatenate([np.repeat(s[0], s[1]) for s in shared]) if shared else np.zeros(0, np.uint64)
        token = np.concatenate([s[2] for s in shared]) if shared else np.zeros(0, np.uint64)
        df = np.concatenate([s[3].astype(np.int64) for s in shared]) if shared else np.zeros(0, np.int64)
        order = np.lexsort((token, df, key))
        key, token = key[order], token[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (token[1:] != token[:-1])
        key, token = key[new], token[new]
        known, at = np.unique(cls, return_index=True)
        sizes = n[at].astype(np.int64)
        first, last = np.searchsorted(key, known, "left"), np.searchsorted(key, known, "right")
        lone = sizes - (last - first)
        inside_prefix = np.clip(sizes - -(-percent * sizes // 100) + 1 - lone, 0, last - first)
        out: list[tuple] = []
        for c, size, a, b, p, skip in zip(known.view(np.int64).tolist(), sizes.tolist(), first.tolist(), last.tolist(), inside_prefix.tolist(), lone.tolist()):
            if size and p:
                places = [{"token": t, "pos": skip + k} for k, t in enumerate(token[a : a + p].view(np.int64).tolist())]
                out.append((c, size, skip, np.sort(token[a:b]).tobytes(), places))
                if len(out) == 2000:
                    yield _sets_batch(out)
                    out = []
        if out:
            yield _sets_batch(out)

    return run


def _sets_batch(rows: list[tuple]) -> pa.RecordBatch:
    place = pa.list_(pa.struct([("token", pa.int64()), ("pos", pa.int32())]))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), place)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["cls", "n", "lone", "tokens", "prefix"])


def overlap_needed(n_a, n_b, percent: int):
    """Least intersection of sets of these sizes with 100 * intersection >= percent * union."""
    return -(-percent * (n_a + n_b) // (100 + percent))


def suffix_bound(a: np.ndarray, b: np.ndarray, depth: int = 3) -> int:
    """An upper bound of the intersection of two sorted arrays, by halving one and splitting the other there."""
    if depth == 0 or not len(a) or not len(b):
        return min(len(a), len(b))
    mid = len(b) // 2
    left = int(np.searchsorted(a, b[mid]))
    hit = int(left < len(a) and a[left] == b[mid])
    return suffix_bound(a[:left], b[:mid], depth - 1) + hit + suffix_bound(a[left + hit :], b[mid + 1 :], depth - 1)


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(0), batch.column(1)
            linked = []
            for n_x, n_y, s_x, s_y in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
                a, b = np.frombuffer(s_x, np.uint64), np.frombuffer(s_y, np.uint64)
                need = overlap_needed(n_x, n_y, percent)
                ok = min(len(a), len(b)) >= need and suffix_bound(a, b) >= need
                linked.append(ok and len(np.intersect1d(a, b, assume_unique=True)) >= need)
            yield pa.RecordBatch.from_arrays([x, y, pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return run


class _Join:
    """The candidate rounds over the written prefix entries."""

    def __init__(self, sets: DataFrame, percent: int) -> None:
        self.percent = percent
        self.sets = sets.select("cls", "n", "tokens")
        entries = sets.select("cls", "n", "lone", F.explode("prefix").alias("p"))
        self.entries = write_once(entries.select(F.col("p.token").alias("token"), F.col("p.pos").alias("pos"), "cls", "n", "lone"), "ngram-prefixes")
        self.written = self.entries
        self.tested: DataFrame | None = None
        self.links: DataFrame | None = None

    def may_link(self, n_a: Column, n_b: Column, pos_a: Column, pos_b: Column) -> Column:
        """Length filter, and positional filter at this token.

        At the first common token of a pair, what follows bounds the whole intersection; later tokens give smaller bounds.
        So a pair is lost at all its tokens only if it is lost at the first, and then it cannot link.
        """
        need = F.ceil(self.percent * (n_a + n_b) / F.lit(100 + self.percent))
        return (F.lit(100) * F.least(n_a, n_b) >= self.percent * F.greatest(n_a, n_b)) & (F.least(n_a - pos_a, n_b - pos_b) >= need)

    def verify(self, pairs: DataFrame) -> None:
        """Count the common shingles of each new pair once. A set in very many pairs meets them in several tasks."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = write_once(pairs, "ngram-pairs")
        one, two = (self.sets.select(F.col("cls").alias(c), F.col("n").alias(f"{c}_n"), F.col("tokens").alias(f"{c}_tokens")) for c in "ab")
        total, times = pairs.count(), pairs.groupBy("b").agg(F.count("*").alias("rows"))
        both = salted_join(salted_join(pairs, one, "a", "b", total=total), two, "b", "a", counts=times, total=total)
        both = both.select("a", "b", "a_n", "b_n", "a_tokens", "b_tokens")
        found = write_once(map_arrow(both, _verify(self.percent), "a long, b long, linked boolean"), "ngram-verified")
        discard(pairs)
        links = found.where("linked").select("a", "b")
        self.tested = found.select("a", "b") if self.tested is None else self.tested.unionByName(found.select("a", "b"))
        self.links = links if self.links is None else self.links.unionByName(links)

    def meet(self, labels: DataFrame | None, central: bool) -> DataFrame:
        """Entries of tokens that sets of several components share, with their component and with the token's leader (and its rows).

        The central leader has the least share of shingles that stand in no other set: of a group of near copies, the
        one that the others were most likely made from, and that most of them link with.
        """
        if labels is None:
            labelled = self.entries.withColumn("comp", F.col("cls"))
        else:
            named = labels.select(F.col("node").alias("cls"), F.col("root"))
            labelled = write_once(self.entries.join(named, "cls", "left").withColumn("comp", F.coalesce("root", "cls")).drop("root"), "ngram-labelled")
        rank = [(F.col("lone") * 1000 / F.col("n")).cast("int").alias("share")] if central else []
        leader = F.min(F.struct(*rank, "cls", "n", "pos", "comp"))
        tokens = labelled.groupBy("token").agg(F.count("*").alias("rows"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), leader.alias("l"))
        torn = write_once(tokens.where("lo <> hi").select("token", "rows", F.col("rows").alias("met"), "l"), "ngram-tokens")
        met = write_once(salted_join(labelled, torn.drop("rows"), "token", "cls", counts=torn), "ngram-met")
        discard(self.written, torn, *([labelled] if labels is not None else []))
        self.written, self.entries = met, met.select("token", "pos", "cls", "n", "lone")
        return met

    def to_leaders(self, met: DataFrame) -> DataFrame:
        """Each set with the leader of each of its tokens: linear in the entries, however many sets share a token."""
        ok = (F.col("comp") != F.col("l.comp")) & self.may_link(F.col("n"), F.col("l.n"), F.col("pos"), F.col("l.pos"))
        return met.where(ok).select(F.col("cls").alias("a"), F.col("l.cls").alias("b"))

    def across(self, met: DataFrame) -> DataFrame:
        """What is left: the pairs of sets that share a token, pass its filters and are not connected yet.

        Sets that link differ in size by less than a band, so a token's sets meet within a band and its neighbour only. The
        smaller set's place must leave room for its own share of the overlap. A token of many sets is cut into blocks,
        and each pair of blocks is a task's work of its own.
        """
        width = max(-math.log(self.percent / 100), 1e-6) * (1 + 1e-9)
        size = F.floor(F.log(F.col("n").cast("double")) / F.lit(width)).cast("int")
        blocks = F.ceil(F.col("met") / BLOCK).cast("int")
        base = met.select("token", "cls", "n", "pos", "comp", size.alias("band"), blocks.alias("blocks"), F.pmod(F.xxhash64("cls"), blocks).cast("int").alias("block"))
        others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        large = base.select("token", "band", F.col("block").alias("i"), others.alias("j"), *[F.col(x).alias(f"a_{x}") for x in ("cls", "n", "pos", "comp")])
        room = F.col("n") - F.col("pos") >= F.ceil(2 * self.percent * F.col("n") / F.lit(100 + self.percent))
        small = base.where(room).select("token", F.explode(F.array("band", F.col("band") + 1)).alias("band"), F.col("block").alias("j"), "blocks", *[F.col(x).alias(f"b_{x}") for x in ("cls", "n", "pos", "comp")])
        small = small.withColumn("i", others).drop("blocks")
        ordered = (F.col("b_n") < F.col("a_n")) | ((F.col("b_n") == F.col("a_n")) & (F.col("b_cls") < F.col("a_cls")))
        left = ordered & (F.col("a_comp") != F.col("b_comp")) & self.may_link(*[F.col(x) for x in ("a_n", "b_n", "a_pos", "b_pos")])
        return large.join(small, ["token", "band", "i", "j"]).where(left).select(F.col("a_cls").alias("a"), F.col("b_cls").alias("b"))

    def labels(self) -> DataFrame:
        """(node, root) of all sets that the links so far connect."""
        return components(self.links)


def linked_classes(docs: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, cls, n) of every row, and (cls, root) of the classes of equal sets: classes with one root are connected by links.

    Equal sets form a class and are joined once. Shingles are ordered by document frequency over all classes, rare first;
    two sets that link share a shingle in their prefixes. Sets are first compared with the leader of each prefix shingle,
    twice; then all pairs that share a prefix shingle and are not connected yet are compared. Links between sets that
    earlier rounds connected cannot change a component, so no pair that could is left out, and a large group of near
    copies costs its size, not its square. No pair is verified twice.

    Frequencies are counted in two levels, so that a shingle in a large part of all sets brings a task one number a
    gathering of texts and not one entry a set.
    """
    spark = docs.sparkSession
    width = exchange_width(spark, parts)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    dealt = map_arrow(slim, _deal_shingles(width, words), SCHEMA)
    counted = write_once(deal(dealt, _count_shingles(width), width), "ngram-counted")
    release(docs)
    told = deal(counted.where(F.col("kind").isin(_TOLD, _MEMBERS)), _tell_members(width), width)
    held = counted.where(F.col("kind").isin(_SET, _SHARED)).unionByName(told)
    sets = write_once(deal(held, _prefixes(percent), width, _SETS), "ngram-sets")
    rows = write_once(map_arrow(counted.where(F.col("kind") == _DOC), _documents, "doc_id long, cls long, n long"), "ngram-documents")
    release(docs)
    discard(counted)
    join = _Join(sets, percent)
    join.verify(join.to_leaders(join.meet(None, central=True)))
    join.verify(join.to_leaders(join.meet(join.labels(), central=False)))
    join.verify(join.across(join.meet(join.labels(), central=False)))
    discard(sets, join.written)
    labels = join.labels()
    release(docs)
    return rows, labels.select(F.col("node").alias("cls"), "root")


def named_components(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, n, component) of every row of ``linked_classes``: component is the least id that links reach; null ids name none.

    A row without shingles is its own component. A class of very many rows, and a component of very many classes, meets its
    name in several tasks.
    """
    owners = write_once(rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "ngram-owners")
    rooted = write_once(owners.join(roots, "cls", "left").select("cls", F.coalesce("root", "cls").alias("root"), "least"), "ngram-rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    by_class = salted_join(rooted.select("cls", "root"), named, "root", "cls").select("cls", "component")
    full = salted_join(rows.where("n > 0"), by_class, "cls", "doc_id", counts=owners).select("doc_id", "n", "component")
    return full.unionByName(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component")))
