"""Mixing sources to target weights by Poisson replication, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..similarity.common import write_once

#: Largest mean of one Poisson draw; larger means are sums of independent draws.
DRAW_MEAN = 16.0
#: Steps of the distribution that are tabulated: beyond 80 the tail of mean 16 is under 2**-53.
DRAW_STEPS = 80
#: Source tables up to this many rows are broadcast; larger ones are joined by a salted shuffle.
BROADCAST_SOURCES = 20_000
SALTS = 64


def source_rates(docs: DataFrame, weights: dict[str, float] | None, temperature: float, epochs: float) -> DataFrame:
    """One row a source: units, mean repetition rate, draws a document and the tabulated distribution of a draw.

    A document weighs its UTF-8 bytes plus one. Without ``weights`` a source's target is its units to the
    power ``temperature``; with ``weights``, sources that are not named get rate 0.
    """
    sized = docs.groupBy(F.col("__source")).agg(F.sum("__units").cast("double").alias("units"))
    if weights is None:
        sized = sized.withColumn("target", F.pow("units", F.lit(float(temperature))))
    else:
        named = docs.sparkSession.createDataFrame([(name, float(value)) for name, value in weights.items()], "__name string, __weight double")
        joined = sized.join(F.broadcast(named), F.col("__source").cast("string").eqNullSafe(F.col("__name")), "left")
        sized = joined.select("__source", "units", F.coalesce("__weight", F.lit(0.0)).alias("target"))
    sized = write_once(sized, "mix-sources")
    totals = sized.agg(F.sum("units").alias("units"), F.sum("target").alias("target")).first()
    # two numbers reach the driver; without any target no document is repeated
    rate = F.lit(float(epochs) * (totals["units"] or 0.0)) * (F.col("target") / F.lit(totals["target"])) / F.col("units") if totals["target"] else F.lit(0.0)
    rated = sized.select("__source", rate.alias("__rate"))
    draws = F.greatest(F.lit(1), F.ceil(F.col("__rate") / DRAW_MEAN)).cast("int")
    mean = F.col("__rate") / F.col("__draws")
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(DRAW_STEPS - 1)),
        F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf")),
        lambda acc, k: F.struct((acc.p * mean / k).alias("p"), F.concat(acc.cdf, F.array(F.element_at(acc.cdf, -1) + acc.p * mean / k)).alias("cdf")),
        lambda acc: acc.cdf,
    )
    return rated.withColumn("__draws", draws).withColumn("__cdf", steps)


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a SHA-256."""
    key = F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix_to_weights(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    temperature: float = 0.5,
    epochs: float = 1.0,
    seed: str = "mix",
    source_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Repeat each document a Poisson number of times whose mean brings its source to its target weight, and shuffle all copies.

    The count is the inverse of the Poisson distribution at a uniform number hashed from ``seed`` and the document's id,
    so it depends on nothing else. Returns the columns of ``docs`` and ``copy_no`` (from 1), in a random order over
    partitions and within each.

    A null source is a source of its own; a null text weighs as an empty one; a row without an id is hashed by the digest
    of its text, so rows without ids draw apart unless their texts are equal; rows that share an id get the same count each;
    an empty table gives an empty one. A column of ``docs`` that is named ``copy_no`` is replaced. Rows are dropped only by
    a count of 0, copies only added by a count over 1.
    """
    kept = [c for c in docs.columns if c != "copy_no"]
    name = F.coalesce(F.col(id_col).cast("string"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    base = docs.select(*kept, F.col(source_col).alias("__source"), name.alias("__name"), (F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 1).cast("long").alias("__units"))
    rates = write_once(source_rates(base, weights, temperature, epochs), "mix-rates")
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        named = rates.withColumnRenamed("__source", "__named")
        joined = base.join(F.broadcast(named), F.col("__source").eqNullSafe(F.col("__named")), "left")
    else:
        salted = rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("__source", "__named")
        base = base.withColumn("__salt0", F.pmod(F.xxhash64("__name"), F.lit(SALTS)).cast("int"))
        joined = base.join(salted, (F.col("__salt0") == F.col("__salt")) & F.col("__source").eqNullSafe(F.col("__named")), "left")
    drawn = F.aggregate(
        F.sequence(F.lit(0), F.col("__draws") - 1),
        F.lit(0),
        lambda acc, c: acc + F.transform(F.array(uniform(seed, F.col("__name"), c)), lambda u: F.size(F.filter(F.col("__cdf"), lambda x: x <= u)))[0],
    )
    counted = joined.where(F.col("__rate") > 0).withColumn("__count", drawn).where(F.col("__count") > 0)
    copies = counted.select(*kept, "__name", F.explode(F.sequence(F.lit(1), F.col("__count"))).alias("copy_no"))
    spread = copies.withColumn("__order", F.xxhash64(F.lit(seed), F.col("__name"), F.col("copy_no"), F.lit("order")))
    return spread.repartition("__order").sortWithinPartitions("__order").drop("__order", "__name")


SQL = """
with d as (select *, strlen(coalesce(text, '')) + 1 as units from documents),
s as (select source, sum(units)::double as units, pow(sum(units)::double, 0.5) as target from d group by source),
r as (select source, target / (select sum(target) from s) * (select sum(units) from s) / units as rate from s),
w as (select source, greatest(1, ceil(rate / 16.0))::int as draws, rate / greatest(1, ceil(rate / 16.0)) as mean from r),
t as (select source, draws, list_transform(range(0, 80), lambda k: list_sum(list_transform(range(0, k + 1), lambda j: exp(-mean + j * ln(mean) - lgamma(j + 1.0))))) as cdf from w),
c as (select d.* exclude (units), list_sum(list_transform(range(0, draws), lambda i: len(list_filter(cdf, lambda x: x <= ('0x' || substr(sha256('mix:' || coalesce(doc_id::varchar, sha256(coalesce(text, ''))) || ':' || i), 1, 13))::bigint / 4503599627370496.0))))::int as n
      from d join t on d.source is not distinct from t.source)
select doc_id, text, lang, source, n_chars, unnest(range(1, n + 1))::int as copy_no from c where n > 0
"""
