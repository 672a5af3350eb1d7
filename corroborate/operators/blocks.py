"""Scores of every query with every library row as matrix products: both sides are cut into blocks, and each pair of blocks is one group of a cogroup."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship_package
from ..similarity.common import write_once

#: Rows of a block of the library and of a block of queries; a group holds one of each. Queries whose scores are held at once.
LIBRARY_BLOCK, QUERY_BLOCK, QUERIES_AT_ONCE = 4_096, 1_024, 256
#: Rows of a block where every row is a query.
NEAREST_BLOCK = 4_096
#: Equal ranges of [-1, 1] by which cosines are counted.
RANGES = 8_192


def meet(queries: DataFrame, library: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str, group: list[str] | None = None, sizes: tuple[int, int] | None = None) -> DataFrame:
    """``work(queries, library)`` over every pair of blocks; of the same ``group``, if columns are named. Rows without an id take no part.

    A task holds one block of each side, whatever their sizes; each side is repeated once a block of the other. ``sizes`` are the rows of a
    block of the library and of one of queries.
    """
    group, (library_block, query_block) = group or [], sizes or (LIBRARY_BLOCK, QUERY_BLOCK)
    queries, library = queries.where("id is not null"), library.where("id is not null")
    ship_package(queries.sparkSession)
    n_queries, n_library = (_largest(df, group) for df in (queries, library))
    rows, columns = max(1, -(-n_library // library_block)), max(1, -(-n_queries // query_block))
    other = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    one = queries.withColumn("__column", place(columns)).withColumn("__row", other(rows))
    two = library.withColumn("__row", place(rows)).withColumn("__column", other(columns))
    one, two = (df.toDF(*df.columns) for df in (one, two))  # both may stem from one table
    keys = [*group, "__row", "__column"]
    out = pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in schema.split(", "))])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return work(left, right).cast(out) if left.num_rows and right.num_rows else out.empty_table()

    return one.groupBy(*keys).cogroup(two.groupBy(*keys)).applyInArrow(run, schema)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


def _largest(df: DataFrame, group: list[str]) -> int:
    if not group:
        return df.count()
    return df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0


def vectors_of(column: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) by width. Null vectors, and those that hold a null, are in none."""
    values = column.combine_chunks()
    values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
    flat, ends = values.flatten(), np.concatenate(([0], np.cumsum(np.where(values.is_null(), 0, values.value_lengths().fill_null(0)))))
    good = ~np.asarray(values.is_null())
    if flat.null_count:
        held = np.asarray(flat.is_null())
        good &= np.concatenate(([0], np.cumsum(held)))[ends[1:]] == np.concatenate(([0], np.cumsum(held)))[ends[:-1]]
    x, widths, out = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64), np.diff(ends), []
    for width in np.unique(widths[good]).tolist():
        rows = np.flatnonzero(good & (widths == width))
        one = x[ends[rows][:, None] + np.arange(width)]
        with np.errstate(all="ignore"):
            size = np.sqrt(np.einsum("ij,ij->i", one, one))
            out.append((rows, one / np.where(size < 1e-9, 1e-9, size)[:, None]))
    return out


def cosines(left: pa.Table, right: pa.Table):
    """(places of queries, cosines with all library rows, which of them are null), some queries at a time."""
    q, x = vectors_of(left["vector"]), dict((u.shape[1], (rows, u)) for rows, u in vectors_of(right["vector"]))
    of = {int(r): (u.shape[1], k) for rows, u in q for k, r in enumerate(rows)}
    by_width = {u.shape[1]: u for _, u in q}
    for start in range(0, left.num_rows, QUERIES_AT_ONCE):
        at = np.arange(start, min(start + QUERIES_AT_ONCE, left.num_rows))
        score, null = np.zeros((len(at), right.num_rows)), np.ones((len(at), right.num_rows), bool)
        for width, (rows, u) in x.items():
            mine = [(k, of[r][1]) for k, r in enumerate(at.tolist()) if r in of and of[r][0] == width]
            if mine:
                k, places = (np.array(v) for v in zip(*mine))
                with np.errstate(all="ignore"):
                    score[np.ix_(k, rows)] = by_width[width][places] @ u.T
                null[np.ix_(k, rows)] = False
        yield at, score, null


def rounded(score: np.ndarray, scale: float = 1.0, offset: float = 0.0) -> np.ndarray:
    return scale * (np.rint(score * 1e9) / 1e9) + offset


def scores(queries: DataFrame, library: DataFrame, scale: float, offset: float, best: int | None = None, sizes: tuple[int, int] | None = None) -> DataFrame:
    """(query_id, id, score) of each query with every row but its own; with ``best``, of each pair of blocks only so many, which hold the first of all."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, ids, out = left["id"].to_numpy(), right["id"].to_numpy(), []
        for at, score, null in cosines(left, right):
            score, others = rounded(score, scale, offset), asked[at][:, None] != ids
            if best is None:
                k, j = np.nonzero(others)
            else:  # greatest first, NaN above all and null below; of equal ones the least id
                key = np.where(null | ~others, -np.inf, np.where(np.isnan(score), np.inf, score))
                least = key.max(axis=1) if best == 1 else np.partition(key, -best, axis=1)[:, -best] if best < key.shape[1] else np.full(len(at), -np.inf)
                found = [np.flatnonzero((key[i] >= least[i]) & others[i]) for i in range(len(at))]
                found = [c[np.lexsort((ids[c], null[i, c], -key[i, c]))[:best]] for i, c in enumerate(found)]
                k, j = np.repeat(np.arange(len(at)), [len(c) for c in found]), np.concatenate(found)
            out.append(pa.table({"query_id": asked[at][k], "id": ids[j], "score": pa.array(score[k, j], mask=null[k, j], from_pandas=False)}))
        return pa.concat_tables(out)

    return meet(queries.select("id", "vector"), library.select("id", "vector"), work, "query_id long, id long, score double", sizes=sizes)


def nearest(rows: DataFrame) -> DataFrame:
    """(query_id, id, score): of every row (id, vector) the row of another id with the greatest cosine, of equal ones the least id.

    Both sides are the whole table, so blocks are square: that moves the fewest rows for the same products.
    """
    first = scores(rows, rows, 1.0, 0.0, 1, (NEAREST_BLOCK, NEAREST_BLOCK))
    best = first.groupBy("query_id").agg(F.max(F.struct("score", (-F.col("id")).alias("t"))).alias("b"))
    return best.select("query_id", (-F.col("b.t")).alias("id"), "b.score")


def moments(queries: DataFrame, library: DataFrame, over: float | None = None) -> DataFrame:
    """Of each query's scores with all other rows: query_id, n, lo, hi, mean, sd (of the population) and the share of at least ``over``."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, ids, out = left["id"].to_numpy(), right["id"].to_numpy(), []
        for at, score, null in cosines(left, right):
            score = rounded(score)
            use = ~null & (asked[at][:, None] != ids)
            n = use.sum(axis=1)
            mean = np.where(use, score, 0.0).sum(axis=1) / np.maximum(n, 1)
            spread = np.where(use, (score - mean[:, None]) ** 2, 0.0).sum(axis=1)
            above = (use & ((score >= (np.inf if over is None else over)) | np.isnan(score))).sum(axis=1)
            one = {"query_id": asked[at], "n": n, "lo": np.where(use, score, np.inf).min(axis=1), "hi": np.where(use, score, -np.inf).max(axis=1), "mean": mean, "spread": spread, "above": above}
            out.append(pa.table(one).filter(pa.array(n > 0)))
        return pa.concat_tables(out)

    each = meet(queries.select("id", "vector"), library.select("id", "vector"), work, "query_id long, n long, lo double, hi double, mean double, spread double, above long")
    both = F.aggregate(F.collect_list(F.struct("n", "mean", "spread")), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("spread")), _join)
    found = each.groupBy("query_id").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), both.alias("b"), F.sum("above").alias("above"))
    return found.select("query_id", "n", "lo", "hi", "b.mean", F.sqrt(F.col("b.spread") / F.col("n")).alias("sd"), (F.col("above") / F.col("n")).alias("over"))


def _join(a: Column, b: Column) -> Column:
    """Size, mean and squared distance from it of two parts together."""
    n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
    return F.struct(n.alias("n"), (a["mean"] + apart * b["n"] / n).alias("mean"), (a["spread"] + b["spread"] + apart * apart * a["n"] * b["n"] / n).alias("spread"))


def bin_counts(queries: DataFrame, library: DataFrame, ends: DataFrame, bins: int) -> DataFrame:
    """(query_id, bin, n): scores by equal ranges between each query's ``lo`` and ``hi``; the last is closed on the right."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, ids, out = left["id"].to_numpy(), right["id"].to_numpy(), []
        lo, hi = left["lo"].to_numpy(), left["hi"].to_numpy()
        for at, score, null in cosines(left, right):
            low, high = lo[at][:, None], hi[at][:, None]
            with np.errstate(all="ignore"):
                place = np.where(high == low, 0, np.minimum(bins - 1, np.floor((rounded(score) - low) / (high - low) * bins)))
            use = ~null & (asked[at][:, None] != ids) & ~np.isnan(place)
            out.append(_counted(asked[at], place, use, bins, "bin"))
        return pa.concat_tables(out)

    each = meet(queries.select("id", "vector").join(ends.select(F.col("query_id").alias("id"), "lo", "hi"), "id"), library.select("id", "vector"), work, "query_id long, bin int, n long")
    return each.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))


def _counted(asked: np.ndarray, place: np.ndarray, use: np.ndarray, bins: int, name: str) -> pa.Table:
    k, _ = np.nonzero(use)
    n = np.bincount(k * bins + place[use].astype(np.int64), minlength=len(asked) * bins)
    held = np.flatnonzero(n)
    return pa.table({"query_id": asked[held // bins], name: held % bins, "n": n[held]})


def _range_of(score: np.ndarray) -> np.ndarray:
    """The range of a cosine; a NaN, greater than all, has the last."""
    return np.where(np.isnan(score), RANGES, np.clip(np.floor((score + 1) * (RANGES / 2)), 0, RANGES - 1)).astype(np.int64)


def at_ranks(queries: DataFrame, library: DataFrame, ranks: DataFrame) -> DataFrame:
    """(query_id, rank, score) at ``ranks`` (query_id, rank from 0, ascending) of each query's scores, exactly.

    Scores are counted by ``RANGES`` ranges; only values in a range that holds a wanted rank are met again, each with its count.
    """
    asked, held = queries.select("id", "vector"), library.select("id", "vector")

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        names, ids, out = left["id"].to_numpy(), right["id"].to_numpy(), []
        for at, score, null in cosines(left, right):
            out.append(_counted(names[at], _range_of(rounded(score)), ~null & (names[at][:, None] != ids), RANGES + 1, "place"))
        return pa.concat_tables(out)

    def values(left: pa.Table, right: pa.Table) -> pa.Table:
        names, ids, wanted, out = left["id"].to_numpy(), right["id"].to_numpy(), left["places"].to_pylist(), []
        for at, score, null in cosines(left, right):
            score, use = rounded(score), ~null & (names[at][:, None] != ids)
            place = _range_of(score)
            for i, r in enumerate(at.tolist()):
                mine = score[i, use[i] & np.isin(place[i], wanted[r])]
                value, n = np.unique(mine, return_counts=True)
                out.append(pa.table({"query_id": np.full(len(value), names[r]), "score": value, "n": n}))
        return pa.concat_tables(out)

    before = lambda *order: F.sum("n").over(Window.partitionBy("query_id").orderBy(*order)) - F.col("n")
    ranges = meet(asked, held, count, "query_id long, place long, n long").groupBy("query_id", "place").agg(F.sum("n").alias("n"))
    ranges = ranges.withColumn("before", before("place"))
    due = ranks.select("query_id", F.col("rank").cast("long").alias("rank")).distinct()
    inside = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))
    hit = write_once(ranges.join(due, "query_id").where(inside).select("query_id", "rank", "place", "before"), "score-ranges")
    places = hit.groupBy("query_id").agg(F.collect_set("place").alias("places"))
    again = meet(asked.join(places.withColumnRenamed("query_id", "id"), "id"), held, values, "query_id long, score double, n long")
    each = again.groupBy("query_id", "score").agg(F.sum("n").alias("n"))
    where = F.when(F.isnan("score"), RANGES).otherwise(F.least(F.lit(RANGES - 1), F.greatest(F.lit(0), F.floor((F.col("score") + 1) * (RANGES / 2))))).cast("long")
    inner = Window.partitionBy("query_id", "place").orderBy("score")
    each = each.withColumn("place", where).withColumn("upto", F.sum("n").over(inner))
    found = hit.join(each, ["query_id", "place"]).withColumn("left", F.col("rank") - F.col("before")).where("left < upto and left >= upto - n")
    return found.select("query_id", "rank", "score")


#: Rows of a task in which unit vectors are summed by id and by label.
SUM_ROWS = 65_536
_SUMS = "kind string, label string, width int, n long, own long, square double, total array<double>"


def _sums(rows: pa.Table) -> pa.Table:
    """Of each kind, label and width: rows, squares of the rows of each id, squared lengths of each id's sum of unit vectors, and the sum of all.

    Kinds are ``all``, ``known`` (with a label) and ``same`` (by label). Rows of width -1 count every row, whatever its vector.
    """
    ids = np.unique(rows["id"].to_numpy(), return_inverse=True)[1]
    names = rows["label"].combine_chunks().dictionary_encode()
    names = names.chunk(0) if isinstance(names, pa.ChunkedArray) else names
    label, out = np.asarray(names.indices.fill_null(-1)), []
    for width, at, u in [(-1, np.arange(rows.num_rows), np.zeros((rows.num_rows, 0)))] + [(u.shape[1], at, u) for at, u in vectors_of(rows["vector"])]:
        for kind, use, part in (("all", np.ones(len(at), bool), np.zeros(len(at), np.int64)), ("known", label[at] >= 0, np.zeros(len(at), np.int64)), ("same", label[at] >= 0, label[at])):
            if not use.any():
                continue
            keys, n = np.unique(np.stack([part[use], ids[at][use]]), axis=1, return_counts=True)
            order = np.lexsort((ids[at][use], part[use]))
            each = np.add.reduceat(u[use][order], np.concatenate(([0], np.cumsum(n)[:-1])), axis=0)
            held, first = np.unique(keys[0], return_index=True)
            add = lambda v: np.add.reduceat(v, first, axis=0)
            for k, *found in zip(held.tolist(), add(n).tolist(), add(n * n).tolist(), add((each**2).sum(axis=1)).tolist(), add(each).tolist()):
                out.append((kind, names.dictionary[k].as_py() if kind == "same" else "", width, *found))
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()))
    return pa.Table.from_arrays([pa.array(v, kind) for v, kind in zip(list(zip(*out)) or [()] * 7, kinds)], names=[c.split()[0] for c in _SUMS.split(", ")])


def same_label_sums(rows: DataFrame) -> DataFrame:
    """(same, n, mean) of the cosines of all pairs of rows (id, vector, label) with different ids, by whether both have one label.

    No pair is made. The sum over the pairs of a set is half of what the squared length of the sum of its unit vectors exceeds the squared
    lengths of each id's own sums by, so work grows with the rows. ``n`` counts every pair; ``mean`` is of those with a cosine.
    """
    ship_package(rows.sparkSession)
    rows = rows.where("id is not null").select("id", "vector", F.col("label").cast("string").alias("label"))
    blocks = max(1, -(-rows.count() // SUM_ROWS))
    each = write_once(rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("__block")).applyInArrow(_sums, _SUMS), "label-sums")
    keys = ["kind", "label", "width"]
    numbers = each.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("own").alias("own"), F.sum("square").alias("square"))
    whole = each.select(*keys, F.posexplode("total").alias("place", "x")).groupBy(*keys, "place").agg(F.sum("x").alias("x")).groupBy(*keys).agg(F.sum(F.col("x") * F.col("x")).alias("whole"))
    pairs = ((F.col("n") * F.col("n") - F.col("own")) / 2).cast("long")
    summed = numbers.join(whole, keys, "left").select("kind", "width", pairs.alias("pairs"), ((F.coalesce("whole", F.lit(0.0)) - F.col("square")) / 2).alias("s")).where("pairs > 0")
    of = lambda kind, value: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(value))), F.lit(0))
    by_width = summed.groupBy("width").agg(*[of(kind, value).alias(f"{kind}_{value}") for kind in ("all", "known", "same") for value in ("pairs", "s")])
    less = lambda a, b, value: F.col(f"{a}_{value}") - (F.col(f"{b}_{value}") if b else 0)
    parts = [F.struct(F.lit(same).cast("boolean").alias("same"), less(a, b, "pairs").alias("pairs"), less(a, b, "s").alias("s")) for same, a, b in ((True, "same", None), (False, "known", "same"), (None, "all", "known"))]
    long = by_width.select("width", F.explode(F.array(*parts)).alias("p")).select("width", "p.*").where("pairs > 0")
    found = long.groupBy("same").agg(F.sum(F.when(F.col("width") < 0, F.col("pairs"))).alias("n"), F.sum(F.when(F.col("width") >= 0, F.col("pairs"))).alias("m"), F.sum(F.when(F.col("width") >= 0, F.col("s"))).alias("s"))
    return found.select("same", "n", (F.col("s") / F.col("m")).alias("mean"))


def _signs(column: pa.ChunkedArray) -> np.ndarray:
    """A row of zeros and ones of each row of words of 32 bits; null has no bit."""
    rows = column.to_pylist()
    width = max((len(r) for r in rows if r is not None), default=1) or 1
    words = np.zeros((len(rows), width), np.uint32)
    for k, r in enumerate(rows):
        if r is not None:
            words[k, : len(r)] = [0 if w is None else w for w in r]
    return np.unpackbits(words.view(np.uint8).reshape(len(rows), -1), axis=1).astype(np.float32)


def best_overlap(queries: DataFrame, library: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(query_id, id, score) of the library row (id, bits) of greatest set similarity but the query's own, of equal ones the least id.

    Of library rows with one number of bits the greatest is the one that shares most, so a block keeps one of each number: the bits
    shared, and the place by id that decides between equals, are one number of at most 19 bits, exact in single precision.
    """

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, q, out = left["id"].to_numpy(), _signs(left["bits"]), []
        ids, x = right["id"].to_numpy(), _signs(right["bits"])
        width = max(q.shape[1], x.shape[1])
        q, x = (np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in (q, x))
        size, mine = x.sum(axis=1).astype(int), q.sum(axis=1)
        order = np.lexsort((ids, size))
        ids, x, size = ids[order], x[order], size[order]
        counts, first = np.unique(size, return_index=True)
        place, steps = np.arange(len(ids)), 1 << int(len(ids)).bit_length()
        both = np.hstack([x * np.float32(steps), -place[:, None].astype(np.float32)]).T.copy()
        own = {}
        for j, i in enumerate(ids.tolist()):
            own.setdefault(i, []).append(j)
        for start in range(0, len(asked), QUERIES_AT_ONCE):
            at = slice(start, start + QUERIES_AT_ONCE)
            key = np.hstack([q[at], np.ones((len(q[at]), 1), np.float32)]) @ both
            for k, i in enumerate(asked[at].tolist()):
                if i in own:
                    key[k, own[i]] = -np.inf
            top = np.maximum.reduceat(key, first, axis=1)
            shared = np.ceil(top / steps)
            either = mine[at][:, None] + counts - shared
            with np.errstate(all="ignore"):
                score = np.where(np.isinf(top), -1.0, np.where(either > 0, shared.astype(float) / either, 0.0))
                at_place = np.where(np.isinf(top), 0, shared * steps - top).astype(int)
            best = score.max(axis=1)
            chosen = np.where(score == best[:, None], ids[at_place], np.iinfo(np.int64).max).min(axis=1)
            out.append(pa.table({"query_id": asked[at], "id": chosen, "score": best}).filter(pa.array(best >= 0)))
        return pa.concat_tables(out)

    each = meet(queries.select("id", "bits", *(group or [])), library.select("id", "bits", *(group or [])), work, "query_id long, id long, score double", group)
    best = each.groupBy("query_id").agg(F.max(F.struct("score", (-F.col("id")).alias("t"))).alias("b"))
    return best.select("query_id", (-F.col("b.t")).alias("id"), F.col("b.score").alias("score"))
