"""Approximate nearest neighbours: one hierarchical navigable small-world graph a shard, kept as flat arrays, results merged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import map_arrow
from ..similarity.common import write_once
from ..similarity.packed import narrow, pack_arrays, unpack_arrays

#: Distinct vectors of one shard, about: the same for every table, so recall and the cost of a vector do not change with size.
SHARD_ROWS = 4096
#: Neighbours a node keeps on the upper layers and on the lowest one.
LINKS, LOW_LINKS = 12, 32
#: Candidates followed while building and while searching.
BUILD_WIDTH, SEARCH_WIDTH = 64, 96
#: Vectors inserted at once: they find their neighbours in the graph so far and among each other.
BLOCK = 128
#: Queries searched at once.
QUERY_BLOCK = 1024
#: Blocks of queries that meet one copy of a shard in a task; more blocks take more copies, so a task stays bounded.
SLICE_BLOCKS = 16
#: Most tasks that the cells of shards and slices are dealt over.
MOST_TASKS = 20_000


class Graph:
    """Layers of flat neighbour arrays (-1: none) over the rows of ``unit``."""

    def __init__(self, unit: np.ndarray, layers: list[np.ndarray], entry: int) -> None:
        self.unit, self.layers, self.entry = unit, layers, entry

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query, up to ``width`` near rows (-1: none) and their cosines, nearest first; all queries step together."""
        at = np.full(len(queries), self.entry)
        for layer in self.layers[:0:-1]:
            at = self._descend(layer, queries, at)
        return self._beam(self.layers[0], queries, at, width)

    def _descend(self, layer: np.ndarray, queries: np.ndarray, at: np.ndarray) -> np.ndarray:
        score = np.einsum("ij,ij->i", self.unit[at], queries)
        while True:
            near = layer[at]
            s = np.where(near >= 0, np.einsum("ikj,ij->ik", self.unit[near], queries), -np.inf)
            best = s.argmax(1)
            better = s[np.arange(len(at)), best] > score
            if not better.any():
                return at
            at = np.where(better, near[np.arange(len(at)), best], at)
            score = np.where(better, s[np.arange(len(score)), best], score)

    def _beam(self, layer: np.ndarray, queries: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        n, rows = len(queries), np.arange(len(queries))
        seen = np.zeros((n, len(self.unit) + 1), bool)
        found = np.full((n, width), -1)
        score = np.full((n, width), -np.inf)
        done = np.ones((n, width), bool)
        found[:, 0], done[:, 0] = start, False
        score[:, 0] = np.einsum("ij,ij->i", self.unit[start], queries)
        seen[rows, start] = True
        while True:
            open_score = np.where(done, -np.inf, score)
            pick = open_score.argmax(1)
            alive = np.flatnonzero(open_score[rows, pick] > -np.inf)
            if not len(alive):
                return found, score
            done[alive, pick[alive]] = True
            near = layer[found[alive, pick[alive]]]
            fresh = (near >= 0) & ~seen[alive[:, None], near]
            seen[alive[:, None], np.where(fresh, near, len(self.unit))] = True
            s = np.where(fresh, np.einsum("ikj,ij->ik", self.unit[near], queries[alive]), -np.inf)
            score2 = np.concatenate((score[alive], s), 1)
            order = np.argsort(-score2, axis=1, kind="stable")[:, :width]
            found[alive] = np.take_along_axis(np.concatenate((found[alive], near), 1), order, 1)
            score[alive] = np.take_along_axis(score2, order, 1)
            done[alive] = np.take_along_axis(np.concatenate((done[alive], ~fresh), 1), order, 1)

    def to_bytes(self) -> bytes:
        flat = [x for layer in self.layers for x in (narrow(layer.ravel() + 1), np.array([layer.shape[1]]))]
        return pack_arrays(np.array([self.entry, len(self.layers), self.unit.shape[1]]), self.unit.ravel(), *flat)

    @staticmethod
    def from_bytes(body: bytes) -> Graph:
        (entry, layers, width), unit, *flat = unpack_arrays(body)
        shaped = [flat[2 * k].astype(np.int64).reshape(-1, int(flat[2 * k + 1][0])) - 1 for k in range(int(layers))]
        return Graph(unit.reshape(-1, int(width)), shaped, int(entry))


def _diverse(unit: np.ndarray, candidates: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (-1: none), sorted nearest first, those nearer to the row's node than to any chosen one; then the nearest of the rest.

    All rows step through their candidates together.
    """
    n, width = candidates.shape
    if width <= most:
        return np.concatenate((candidates, np.full((n, most - width), -1)), 1)
    vectors = unit[candidates]
    near = vectors @ vectors.transpose(0, 2, 1)
    there = candidates >= 0
    chosen = np.zeros((n, width), bool)
    closest = np.full((n, width), -np.inf, np.float32)  # of each candidate, its cosine to the nearest chosen one
    count = np.zeros(n, np.int64)
    for j in range(width):
        take = there[:, j] & (count < most) & (closest[:, j] < scores[:, j])
        chosen[:, j] = take
        count += take
        closest = np.where(take[:, None], np.maximum(closest, near[:, j]), closest)
    # chosen ones first, then the rest, each in order; what there is not comes last
    rank = np.where(chosen, 0, np.where(there, 1, 2)) * width + np.arange(width)
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(candidates, order, 1)


def build(unit: np.ndarray, levels: np.ndarray) -> Graph:
    """Insert the rows block by block, each on its layers from the top, with links both ways."""
    order = np.argsort(-levels, kind="stable")
    top = int(levels.max())
    layers = [np.full((len(unit), LOW_LINKS if k == 0 else LINKS), -1) for k in range(top + 1)]
    graph = Graph(unit, layers, int(order[0]))
    at = 1
    while at < len(order):
        block = order[at : at + min(BLOCK, at)]
        for k in range(top, -1, -1):
            mine = block[levels[block] >= k]
            if not len(mine):
                continue
            start = np.full(len(mine), graph.entry)
            for layer in layers[:k:-1]:
                start = graph._descend(layer, unit[mine], start)
            found, score = graph._beam(layers[k], unit[mine], start, BUILD_WIDTH)
            inner = unit[mine] @ unit[mine].T
            np.fill_diagonal(inner, -np.inf)
            found = np.concatenate((found, np.where(np.isfinite(inner), mine[None, :], -1)), 1)
            score = np.concatenate((score, inner), 1)
            by = np.argsort(-score, axis=1, kind="stable")[:, :BUILD_WIDTH]
            found, score = np.take_along_axis(found, by, 1), np.take_along_axis(score, by, 1)
            most = layers[k].shape[1]
            layers[k][mine] = _diverse(unit, found, score, most)
            _link_back(unit, layers[k], mine)
        at += len(block)
    return graph


def _link_back(unit: np.ndarray, layer: np.ndarray, mine: np.ndarray) -> None:
    """Links from the neighbours to the new rows; a full list is chosen anew."""
    near = layer[mine]
    source, target = np.repeat(mine, (near >= 0).sum(1)), near[near >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, times = np.unique(target, return_index=True, return_counts=True)
    place = np.arange(len(source)) - np.repeat(first, times)
    most = layer.shape[1]
    # nodes with few new links share a narrow table, the few hubs of a block a wide one
    for few in (times <= 8, times > 8):
        if not few.any():
            continue
        row = np.cumsum(few) - 1
        new = np.full((int(few.sum()), int(times[few].max())), -1)
        mine_too = np.repeat(few, times)
        new[np.repeat(row, times)[mine_too], place[mine_too]] = source[mine_too]
        held = layer[nodes[few]]
        new[(new[:, :, None] == held[:, None, :]).any(2)] = -1
        both = np.concatenate((held, new), 1)
        score = np.where(both >= 0, np.einsum("ikj,ij->ik", unit[both], unit[nodes[few]]), -np.inf)
        by = np.argsort(-score, axis=1, kind="stable")
        both, score = np.take_along_axis(both, by, 1), np.take_along_axis(score, by, 1)
        full = (both >= 0).sum(1) > most
        chosen = both[:, :most].copy()
        if full.any():
            chosen[full] = _diverse(unit, both[full], score[full], most)
        layer[nodes[few]] = chosen


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row by the power of two that brings its largest component near 1: exact, and products neither over- nor underflow."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, keepdims=True))[1])


def cosines(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosine of each row and the query, all of them ``scaled``, in double precision."""
    return (rows @ query) / (np.linalg.norm(rows, axis=1) * np.linalg.norm(query))


def _vectors(batch: pa.RecordBatch, column: int) -> list[np.ndarray | None]:
    """Each row's vector in double precision, or None for one that takes no part."""
    out: list[np.ndarray | None] = []
    for v in batch.column(column).to_pylist():
        x = None if v is None or None in v else np.array(v, np.float64)
        out.append(x if x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
    return out


_DISTINCT = "vector binary, width int, ids array<long>"


def _distinct(keep: int):
    """One row a distinct vector of these rows, with its least ids: more than ``keep`` can never be among the nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        for batch in batches:
            if batch.num_columns == 2:
                rows = ((i, None if v is None else v.tobytes()) for i, v in zip(batch.column(0).to_pylist(), _vectors(batch, 1)))
                for identifier, vector in rows:
                    if vector is not None and identifier is not None:
                        _add(held, vector, [identifier], keep)
            else:
                for vector, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                    _add(held, vector, ids, keep)
            if len(held) > 20_000 and batch.num_columns == 2:
                yield _distinct_batch(held)
                held = {}
        yield _distinct_batch(held)

    return run


def _add(held: dict[bytes, list[int]], vector: bytes, ids: list[int], keep: int) -> None:
    old = held.get(vector)
    held[vector] = ids if old is None else sorted({*old, *ids})[:keep]


def _distinct_batch(held: dict[bytes, list[int]]) -> pa.RecordBatch:
    columns = [pa.array(list(held), pa.binary()), pa.array([len(v) // 8 for v in held], pa.int32()), pa.array(list(held.values()), pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=["vector", "width", "ids"])


_SHARD = "shard int, width int, graph binary, vectors binary, counts binary, ids binary"


def _build_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One graph for each width of vectors in this shard."""
    by_width: dict[int, list[tuple[bytes, list[int]]]] = {}
    shard = 0
    for batch in batches:
        for vector, width, ids, shard in zip(*(batch.column(k).to_pylist() for k in range(4))):
            by_width.setdefault(width, []).append((vector, ids))
    for width, rows in by_width.items():
        rows.sort()
        vectors = np.frombuffer(b"".join(v for v, _ in rows), np.float64).reshape(-1, width)
        unit = scaled(vectors)
        unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)
        random = np.random.default_rng(7).random(len(rows))
        levels = np.minimum((-np.log(np.maximum(random, 1e-12)) / np.log(LINKS)).astype(int), 6)
        body = build(unit, levels).to_bytes()
        counts = np.array([len(i) for _, i in rows], np.int32)
        ids = np.array([x for _, i in rows for x in i], np.int64)
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        row = (shard, width, body, vectors.tobytes(), counts.tobytes(), ids.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[x.split()[0] for x in _SHARD.split(", ")])


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                width, graph, vectors, counts, ids, q_ids, q_vectors = (batch.column(c)[r].as_py() for c in range(7))
                shard = Graph.from_bytes(graph)
                whole = scaled(np.frombuffer(vectors, np.float64).reshape(-1, width))
                edges = np.concatenate(([0], np.cumsum(np.frombuffer(counts, np.int32))))
                members = np.frombuffer(ids, np.int64)
                query = scaled(np.frombuffer(b"".join(q_vectors), np.float64).reshape(-1, width))
                unit = (query / np.linalg.norm(query, axis=1, keepdims=True)).astype(np.float32)
                found, _ = shard.search(unit, min(SEARCH_WIDTH, len(whole)))
                rows: list[tuple[int, int, float]] = []
                for q, (q_id, near) in enumerate(zip(q_ids, found)):
                    near = near[near >= 0]
                    exact = cosines(whole[near], query[q])
                    best = sorted(((-s, int(i)) for s, node in zip(exact.tolist(), near.tolist()) for i in members[edges[node] : edges[node + 1]]))
                    rows.extend((q_id, i, -s) for s, i in [b for b in best if b[1] != q_id][:k])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 3, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    return run


def build_index(vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row a shard (and width of vectors) with its graph, its original distinct vectors and their ids; written to the shared folder."""
    slim = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    local = write_once(map_arrow(slim, _distinct(k + 1), _DISTINCT), "ann-vectors")
    rows = local.count()
    shards = max(1, -(-rows // shard_rows))
    dealt = local.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int")).repartitionById(shards, F.col("shard"))
    merged = map_arrow(dealt.select("vector", "width", "ids"), _distinct(k + 1), _DISTINCT)
    merged = merged.select("vector", "width", "ids", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int").alias("shard"))
    return write_once(map_arrow(merged, _build_shard, _SHARD), "ann-graphs")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The ``k`` rows of ``vectors`` nearest to each query by cosine, without the query's own id.

    Returns query_id, rank (from 1), vec_id and score: nearest first, ties to the smaller vec_id. Vectors are dealt over
    shards by content, equal ones become one node that keeps its least k + 1 ids, and each shard holds one graph over its
    nodes. Queries go to every shard in blocks, so a search costs the queries times the shards; scores are computed on the
    original vectors in double precision, scaled by powers of two so that no magnitude over- or underflows.

    Vectors that are null, empty, all zero or hold null or non-finite components take no part, neither do null ids;
    vectors of another width than the query are no candidates. Of rows that share an id and a vector one counts. Empty
    tables give an empty one. Other columns are not read.
    """
    index = build_index(vectors, k, id_col, vector_col, shard_rows)
    asked = queries.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, v.tobytes(), len(v)) for i, v in zip(batch.column(0).to_pylist(), _vectors(batch, 1)) if v is not None and i is not None]
            kinds = (pa.int64(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 3, kinds)], names=["q_id", "q_vector", "width"])

    clean = write_once(map_arrow(asked, parse, "q_id long, q_vector binary, width int").distinct(), "ann-queries")
    blocks = -(-max(clean.count(), 1) // QUERY_BLOCK)
    blocked = clean.withColumn("block", F.pmod(F.xxhash64("q_id"), F.lit(blocks))).groupBy("width", "block")
    blocked = blocked.agg(F.collect_list(F.struct("q_id", "q_vector")).alias("q")).select("width", "block", F.col("q.q_id").alias("q_ids"), F.col("q.q_vector").alias("q_vectors"))
    # a grid of cells (shard, slice of blocks): graphs are copied to each slice and blocks to each shard, so no key gathers all rows
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    slices = -(-blocks // SLICE_BLOCKS)
    cell, tasks = ["shard", "slice", "width"], min(shards * slices, MOST_TASKS)
    graphs = index.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).repartition(tasks, *cell)
    spread = blocked.withColumn("slice", F.pmod("block", F.lit(slices)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    pairs = graphs.join(spread.repartition(tasks, *cell), cell).select("width", "graph", "vectors", "counts", "ids", "q_ids", "q_vectors")
    found = map_arrow(pairs, _search(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest_exactly(rows: list[tuple[int, list[float] | None]], query_ids: set[int], k: int) -> dict[int, list[tuple[int, float]]]:
    """Brute force over all rows, for measuring recall in tests."""
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out: dict[int, list[tuple[int, float]]] = {}
    for q, x in good:
        if q in query_ids:
            small = scaled(np.array([x]))[0]
            scored = sorted((-float(cosines(scaled(np.array([v])), small)[0]), i) for i, v in good if i != q and len(v) == len(x))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out
