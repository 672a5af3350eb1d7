"""Streams over the arrivals, run to their end and read back as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.releases import scratch
from ..sources.tables import OBS, observations, table
from ..streaming import arrivals as a
from .registry import query


def run_arrivals(spark: SparkSession, source: DataFrame, label: str, stream: Callable[[DataFrame], DataFrame], mode: str, out: str, checkpoint: str, arrivals: int = 3, by: str | None = None) -> None:
    """Run ``stream`` over the rows of ``source``, which arrive one part after the other: by hash, or in ranges of a time column ``by``.

    The source is read once and dealt. Each arrival is one batch, however many files it has, so batches do not grow in number with the rows,
    and no file of an arrival comes after the stream's time has passed it.
    """
    if by is None:
        part = F.pmod(F.xxhash64(*source.columns), F.lit(arrivals))
    else:
        least, most = source.agg(F.min(by), F.max(by)).first()
        width = F.nullif(F.lit(most).cast("double") - F.lit(least).cast("double"), F.lit(0.0))
        step = (F.col(by).cast("double") - F.lit(least).cast("double")) / width
        part = F.least(F.floor(step * arrivals), F.lit(arrivals - 1))
    path, dealt = scratch(spark, label), scratch(spark, f"{label}-dealt")
    parted = source.withColumn("__part", F.coalesce(part, F.lit(0)).cast("int"))
    parted.write.partitionBy("__part").parquet(dealt)
    written = spark.read.schema(parted.schema).parquet(dealt)
    for k in range(arrivals):
        written.where(F.col("__part") == k).drop("__part").write.mode("append").parquet(path)
        a.run_available(stream(a.read_arrivals(spark, path, source.schema, a.ALL_FILES)), mode, out, checkpoint)


RULED = "ru as (select event_id, event_type, case when event_type is null then 'missing_type' when value is null then 'missing_value' when value <= 0 then 'no_magnitude' end as rule from events)"


@query("STR01", f"with {RULED} select * from ru")
def str01(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, checkpoint = a.paths(spark, "str01")
    run_arrivals(spark, table(spark, sf_dir, "events"), "arrivals", lambda events: a.curate_stream(events).select("event_id", "event_type", "rule"), "append", out, checkpoint)
    return spark.read.parquet(out)


RELEASES = "rl as (select strftime(o_orderdate, '%Y-%m') as release, md5(strftime(o_orderdate, '%Y-%m') || ':' || count(*) || ':' || sum(o_orderkey)::bigint) as digest from orders group by strftime(o_orderdate, '%Y-%m'))"


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One release a month of orders, with a digest of its content."""
    month = F.date_format("o_orderdate", "yyyy-MM")
    content = F.concat_ws(":", F.col("release"), F.count("*").cast("string"), F.sum("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").withColumn("release", month).groupBy("release").agg(F.md5(content).alias("digest"))


@query(
    "STR02",
    f"with {RELEASES} select release, digest, 'absent' as state, 1::bigint as n from rl union all select release, digest, 'ingested', 1::bigint from rl union all select release, md5(digest), 'conflict', 1::bigint from rl where release like '%-03'",
)
def str02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All releases arrive, then all again and some with another digest."""
    source = releases(spark, sf_dir)
    out, checkpoint = a.paths(spark, "str02")
    folder = scratch(spark, "releases")
    handler = a.arrive_once(spark, f"{out}-registry", out)
    changed = source.where(F.col("release").endswith("-03")).withColumn("digest", F.md5("digest"))
    for arrival in (source, source.unionByName(changed)):
        arrival.write.mode("append").parquet(folder)
        a.run_available(a.read_arrivals(spark, folder, source.schema, files_a_batch=100_000), "append", out, checkpoint, handler)
    return spark.read.option("basePath", out).parquet(out).groupBy("release", "digest", "state").agg(F.count("*").alias("n"))


@query("STR03", "select distinct user_id from events")
def str03(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, checkpoint = a.paths(spark, "str03")
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    run_arrivals(spark, events, "arrivals", lambda came: a.distinct_keys(came, "user_id"), "append", out, checkpoint)
    return spark.read.parquet(out)


@query("STR04", f"with {RULED} select coalesce(rule, 'kept') as rule, event_type, count(*) as n from ru group by all")
def str04(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, checkpoint = a.paths(spark, "str04")
    run_arrivals(spark, table(spark, sf_dir, "events"), "arrivals", a.running_counts, "update", out, checkpoint)
    return a.latest(spark, out, ["rule", "event_type"])


@query(
    "STR05",
    f"with {OBS} select item, grp, count(*) as n, round(max(9 - log10(v)) filter (where rel in ('<', '<=')), 6) as lo, round(min(9 - log10(v)) filter (where rel in ('>', '>=')), 6) as hi from obs where v > 0 and rel in ('<', '<=', '>', '>=') group by item, grp",
)
def str05(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, checkpoint = a.paths(spark, "str05")
    with a.state_on_disk(spark):
        run_arrivals(spark, observations(spark, sf_dir).select("item", "grp", "rel", "v"), "observations", a.running_intervals, "update", out, checkpoint)
    return a.latest(spark, out, ["item", "grp"]).select("item", "grp", "n", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("STR06", "select strftime(date_trunc('day', ts), '%Y-%m-%d') as period, count(*) as n from events group by 1")
def str06(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, checkpoint = a.paths(spark, "str06")
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    run_arrivals(spark, events, "arrivals", a.period_counts, "update", out, checkpoint, by="ts")
    return a.latest(spark, out, ["period"]).select(F.date_format("period", "yyyy-MM-dd").alias("period"), "n")
