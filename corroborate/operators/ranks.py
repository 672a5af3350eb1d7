"""Exact order statistics of groups of any size: value ranges are narrowed by counts until few rows are left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..similarity.common import discard, write_once

#: Ranges that a pass cuts each interval into, and rows of an interval that are sorted at last.
BINS, FEW_ROWS = 1024, 10_000


def select_ranks(rows: DataFrame, targets: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The values at given ranks (from 0, in ascending order) of each group: ``targets`` (keys, rank) with ``value``.

    Each pass counts the rows of every interval that still holds a wanted rank by ``BINS`` equal ranges, with the least and greatest
    value that stands in each, and goes on with the range that holds the rank. Ranges are cut at values that are there, so
    no row changes sides by rounding, and a range of one value is done however many rows it has. What is left of an interval, at most
    ``FEW_ROWS`` rows, is numbered. So no task holds a group. Nulls and NaN are left out; a rank beyond the group gives no row.
    """
    base = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("__v"))
    key = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    on = lambda a, b, *more: _all([*key(a, b), *more])
    ends = base.groupBy(*keys).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.count("*").alias("__n"))
    named = targets.select(*keys, F.col("rank").cast("long").alias("rank")).distinct()
    state = named.alias("t").join(ends.alias("e"), on("t", "e")).select(*[f"t.{k}" for k in keys], "rank", "__lo", "__hi", "__n", F.col("rank").alias("__left")).where("rank >= 0 and rank < __n")
    state = write_once(state, "ranks")
    while True:
        wide = state.where((F.col("__n") > FEW_ROWS) & (F.col("__lo") < F.col("__hi")))
        if not wide.limit(1).count():
            break
        intervals = wide.select(*keys, "__lo", "__hi").distinct()
        step = (F.col("__hi") - F.col("__lo")) / BINS
        met = base.alias("b").join(intervals.alias("i"), on("b", "i", F.col("__v") >= F.col("__lo"), F.col("__v") <= F.col("__hi")))
        binned = met.select(*[f"b.{k}" for k in keys], "__lo", "__hi", "__v", F.least(F.lit(BINS - 1), F.floor((F.col("__v") - F.col("__lo")) / step)).alias("__bin"))
        counted = binned.groupBy(*keys, "__lo", "__hi", "__bin").agg(F.count("*").alias("__c"), F.min("__v").alias("__a"), F.max("__v").alias("__z"))
        w = Window.partitionBy(*keys, "__lo", "__hi").orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
        placed = counted.withColumn("__before", F.sum("__c").over(w) - F.col("__c"))
        here = [F.col("w.__lo") == F.col("p.__lo"), F.col("w.__hi") == F.col("p.__hi"), F.col("w.__left") >= F.col("p.__before"), F.col("w.__left") < F.col("p.__before") + F.col("p.__c")]
        moved = wide.alias("w").join(placed.alias("p"), on("w", "p", *here)).select(*[f"w.{k}" for k in keys], "w.rank", F.col("p.__a").alias("__lo"), F.col("p.__z").alias("__hi"), F.col("p.__c").alias("__n"), (F.col("w.__left") - F.col("p.__before")).alias("__left"))
        before, state = state, write_once(moved.unionByName(state.where((F.col("__n") <= FEW_ROWS) | (F.col("__lo") >= F.col("__hi")))), "ranks")
        discard(before)
    one = state.where("__lo = __hi").select(*keys, "rank", F.col("__lo").alias(value))
    few = state.where("__lo < __hi")
    left = base.alias("b").join(few.select(*keys, "__lo", "__hi").distinct().alias("i"), on("b", "i", F.col("__v") >= F.col("__lo"), F.col("__v") <= F.col("__hi"))).select(*[f"b.{k}" for k in keys], "__lo", "__hi", "__v")
    order = Window.partitionBy(*keys, "__lo", "__hi").orderBy("__v")
    numbered = left.withColumn("__r", (F.row_number().over(order) - 1).cast("long"))
    same = [F.col("f.__lo") == F.col("r.__lo"), F.col("f.__hi") == F.col("r.__hi"), F.col("f.__left") == F.col("r.__r")]
    found = few.alias("f").join(numbered.alias("r"), on("f", "r", *same)).select(*[f"f.{k}" for k in keys], "f.rank", F.col("r.__v").alias(value))
    return one.unionByName(found)


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def quantiles(rows: DataFrame, keys: list[str], value: str, at: dict[str, float], between: bool = True) -> DataFrame:
    """Exact quantiles of each group: keys, ``n`` and a column for each of ``at``.

    ``between`` interpolates between neighbouring ranks; without it the quantile is the value at ``floor(q * (n - 1))``.
    """
    held = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    sizes = write_once(held.groupBy(*keys).agg(F.count("*").alias("n")), "rank-sizes")
    place = lambda q: F.lit(float(q)) * (F.col("n") - 1)
    wanted = F.array(*[F.floor(place(q)) for q in at.values()], *([F.ceil(place(q)) for q in at.values()] if between else []))
    found = write_once(select_ranks(rows, sizes.select(*keys, F.explode(wanted).alias("rank")), keys, value), "rank-values")
    by_rank = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", value))).alias("__m"))
    joined = sizes.alias("s").join(by_rank.alias("m"), _all([F.col(f"s.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys])).select(*[f"s.{k}" for k in keys], "n", "__m")
    out = []
    for name, q in at.items():
        low = F.col("__m")[F.floor(place(q))]
        out.append((low + (F.col("__m")[F.ceil(place(q))] - low) * (place(q) - F.floor(place(q))) if between else low).alias(name))
    return joined.select(*keys, "n", *out)


def evenly_spaced(rows: DataFrame, value: str, id_col: str, size: int) -> DataFrame:
    """``size`` rows at equal steps of rank by value, then id: (place, id, value); all rows, if they are no more.

    Rows of one value are numbered by id only where a wanted rank falls into them.
    """
    total = rows.where(F.col(value).isNotNull()).count()
    if not total:
        return rows.limit(0).select(F.lit(0).alias("place"), id_col, value)
    spark = rows.sparkSession
    steps = min(size, total)
    wanted = spark.range(steps).select((F.col("id") * total / steps).cast("long").alias("rank"), F.col("id").cast("int").alias("place"))
    values = write_once(select_ranks(rows, wanted, [], value).join(wanted, "rank"), "rank-spaced")
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("__v"))
    # what stands below each chosen value: counted in one pass over distinct values
    chosen = values.select(F.col(value).alias("__c")).distinct()
    below = chosen.join(counts.agg(F.count("*").alias("__n")), F.col("__v") < F.col("__c"), "left").groupBy("__c").agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("__below"))
    placed = values.join(below, F.col(value) == F.col("__c")).select("place", F.col(value).alias("__at"), (F.col("rank") - F.col("__below")).alias("rank"))
    ties = rows.select(F.col(id_col).cast("double").alias("__id"), F.col(value).cast("double").alias("__at")).join(F.broadcast(placed.select("__at").distinct()), "__at")
    ids = select_ranks(ties, placed.select("__at", "rank"), ["__at"], "__id")
    return ids.join(placed, ["__at", "rank"]).select("place", F.col("__id").cast("long").alias(id_col), F.col("__at").alias(value))
