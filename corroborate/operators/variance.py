"""How far repeats disagree within and between sources: spreads, distributions and the pooling rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evidence import with_roles


def index_quantiles(df: DataFrame, group: str | None, value: str, at: dict[str, float], rounded: bool = False) -> DataFrame:
    """Quantiles that are members of the sample: the row at ``q * (n - 1)``, cut off or rounded half to even.

    Ranked within groups, so that no group's values are gathered into an array; without a group a global sort by range
    would be needed, so callers group by something.
    """
    keys = [group] if group else []
    rows = df.where(F.col(value).isNotNull()).withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(value)) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    place = lambda q: (F.bround(F.lit(q) * (F.col("__n") - 1)) if rounded else F.floor(F.lit(q) * (F.col("__n") - 1)))
    picks = [F.max(F.when(F.col("__r") == place(q), F.col(value))).alias(name) for name, q in at.items()]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *picks)


def summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """p10, median and p90 as index quantiles, mean, and the share over 1."""
    extra = df.groupBy(group).agg(F.avg(value).alias("mean"), F.avg((F.col(value) > 1.0).cast("int")).alias("over_one"))
    return index_quantiles(df, group, value, {"p10": 0.1, "median": 0.5, "p90": 0.9}).join(extra, group)


def exact_rows(obs: DataFrame) -> DataFrame:
    return with_roles(obs).where("role = 'exact'")


def within_spread(rows: DataFrame, key: str) -> DataFrame:
    """Spread of the repeats of a pair inside one value of ``key``, where there are two or more."""
    found = rows.groupBy("item", "grp", key).agg(F.count("*").alias("n"), (F.max("p") - F.min("p")).alias("spread"))
    return found.where("n >= 2")


def between_spread(rows: DataFrame, key: str) -> DataFrame:
    """Spread of a pair's medians over the values of ``key``, where there are two or more."""
    medians = rows.groupBy("item", "grp", key).agg(F.percentile(F.col("p"), F.lit(0.5)).alias("m"))
    found = medians.groupBy("item", "grp").agg(F.count("*").alias("n"), (F.max("m") - F.min("m")).alias("spread"))
    return found.where("n >= 2")


def spreads(rows: DataFrame, key: str) -> DataFrame:
    """Both kinds as one table of (kind, spread)."""
    return within_spread(rows, key).select(F.lit("within").alias("kind"), "item", "grp", "spread").unionByName(between_spread(rows, key).select(F.lit("between").alias("kind"), "item", "grp", "spread"))


def matched(rows: DataFrame, key: str, collapse: bool = False) -> DataFrame:
    """Spreads of the pairs that have both kinds, after equal reports are collapsed if so asked."""
    base = rows.dropDuplicates(["item", "grp", key, "v"]) if collapse else rows
    a, b = within_spread(base, key), between_spread(base, key)
    both = a.select("item", "grp").distinct().join(b.select("item", "grp"), ["item", "grp"])
    return spreads(base, key).join(both, ["item", "grp"], "left_semi")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Redundant reports: rows beyond the first of each key, keys that have some."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("n_redundant"), F.count_if(F.col("n") > 1).alias("n_keys_repeated"), F.count("*").alias("n_keys"))


def decide(summary_rows: DataFrame, margins: tuple[float, ...]) -> DataFrame:
    """Pool where sources disagree no more than repeats do, within a margin; restrict where more; unsuitable far beyond."""
    wide = summary_rows.agg(F.max(F.when(F.col("kind") == "within", F.col("median"))).alias("within"), F.max(F.when(F.col("kind") == "between", F.col("median"))).alias("between"))
    each = wide.withColumn("margin", F.explode(F.array(*map(F.lit, margins))))
    gap = F.col("between") - F.col("within")
    return each.withColumn("decision", F.when(gap <= F.col("margin"), "pool").when(gap <= 3 * F.col("margin"), "restrict").otherwise("unsuitable"))


def wide_between_tight_within(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """Examples to look at: pairs whose sources differ most while repeats inside each source agree."""
    tight = within_spread(rows, key).groupBy("item", "grp").agg(F.max("spread").alias("within"))
    found = between_spread(rows, key).join(tight, ["item", "grp"]).where("spread > 0.5 and within < 0.3")
    return found.orderBy(F.desc(F.round("spread", 6)), "item", "grp").limit(limit).select("item", "grp", F.col("spread").alias("between"), "within")


def flag(condition: Column) -> Column:
    return F.count_if(condition)
