"""The supplied tables, and the measurement views that stand on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a measurement of an (item, grp) pair: assay, publication, date, type, relation and value."""
    line, order, supplier = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "supplier"))
    kind = F.element_at(F.array(*map(F.lit, ("KI", "IC50", "KD", "EC50"))), F.col("l_linenumber") % 4 + 1)
    flags = F.concat("l_returnflag", "l_linestatus")
    relation = (
        F.when(F.col("l_orderkey") % 89 == 0, "~")
        .when(F.col("l_returnflag") == "N", "=")
        .when(flags == "AF", "=")
        .when(flags == "AO", "<")
        .when(flags == "RF", ">")
        .otherwise(">=")
    )
    joined = line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(
        F.col("l_partkey").alias("item"),
        F.col("s_nationkey").alias("grp"),
        F.col("l_suppkey").alias("assay"),
        F.date_format("o_orderdate", "yyyy-MM").alias("pub"),
        F.col("l_shipdate").alias("dt"),
        kind.alias("mtype"),
        relation.alias("rel"),
        F.when(F.col("l_orderkey") % 97 == 0, 0.0).otherwise(F.col("l_extendedprice") / 30).alias("v"),
        F.col("l_orderkey").alias("okey"),
        F.col("l_linenumber").alias("line"),
        F.col("l_tax").alias("ph"),
        (F.col("l_discount") + 0.0).alias("temp"),
        F.col("l_returnflag").alias("src"),
    )


OBS = """obs as (
select l_partkey as item, s_nationkey as grp, l_suppkey as assay, strftime(o_orderdate, '%Y-%m') as pub, l_shipdate as dt,
  case l_linenumber % 4 when 0 then 'KI' when 1 then 'IC50' when 2 then 'KD' else 'EC50' end as mtype,
  case when l_orderkey % 89 = 0 then '~' when l_returnflag = 'N' then '=' when l_returnflag || l_linestatus = 'AF' then '='
       when l_returnflag || l_linestatus = 'AO' then '<' when l_returnflag || l_linestatus = 'RF' then '>' else '>=' end as rel,
  case when l_orderkey % 97 = 0 then 0.0 else l_extendedprice / 30 end as v,
  l_orderkey as okey, l_linenumber as line, l_tax as ph, l_discount + 0.0 as temp, l_returnflag as src
from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey)"""


def observation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with the value as a text field, spelled in many ways by order key."""
    n = F.floor("v").cast("long")
    sign = F.when(F.col("rel") == "=", "").otherwise(F.col("rel"))
    whole = n.cast("string")
    spelled = [
        F.concat(sign, whole),
        F.concat(sign, whole, F.lit(".0")),
        F.concat(F.lit(" "), sign, F.lit(" "), whole),
        F.concat(sign, F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"), F.lit("e1")),
        F.concat(F.lit("≥"), whole),
        F.lit(""),
        F.lit("   "),
        F.concat(sign, F.floor(n / 1000).cast("string"), F.lit(","), F.lpad((n % 1000).cast("string"), 3, "0")),
        F.lit("n.d."),
        F.concat(F.lit(">"), whole, F.lit(" nM")),
        F.concat(F.lit("≈"), whole),
    ]
    text = spelled[-1]
    for k in range(len(spelled) - 2, -1, -1):  # branches, so that a row makes one spelling and not all
        text = F.when(F.col("okey") % 11 == k, spelled[k]).otherwise(text)
    return observations(spark, sf_dir).withColumn("value_text", text)


OBS_TEXT = OBS + """, obs_text as (select *, case okey % 11
  when 0 then sg || n when 1 then sg || n || '.0' when 2 then ' ' || sg || ' ' || n
  when 3 then sg || (n // 10) || '.' || (n % 10) || 'e1' when 4 then '≥' || n when 5 then '' when 6 then '   '
  when 7 then sg || (n // 1000) || ',' || lpad((n % 1000)::varchar, 3, '0') when 8 then 'n.d.' when 9 then '>' || n || ' nM' else '≈' || n end as value_text
  from (select *, floor(v)::bigint as n, case when rel = '=' then '' else rel end as sg from obs))"""


def snapshot(spark: SparkSession, sf_dir: str, later: bool) -> DataFrame:
    """One of two releases of the observations, the later with changed values and identifiers, both with repeated rows."""
    k, repeat = F.col("okey"), 13 if later else 17
    base = observations(spark, sf_dir).where(k % 10 != (1 if later else 0))
    value = F.when(k % 7 == 0, F.col("v") + 1).otherwise(F.col("v")) if later else F.col("v")
    doi = F.when(k % 21 == 0, k + 1).otherwise(k) if later else k
    shaped = base.select(
        "item", "grp", "pub", "ph", "temp", "src", "mtype", "rel", value.alias("v"),
        F.when(k % 5 != 0, doi).alias("doi"), F.concat_ws("-", "okey", "line").alias("rsid"), "okey",
    )
    return shaped.withColumn("copy", F.explode(F.when(k % repeat == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("okey", "copy")


def _snapshot_sql(name: str, later: bool) -> str:
    value = "case when okey % 7 = 0 then v + 1 else v end" if later else "v"
    doi = "case when okey % 21 = 0 then okey + 1 else okey end" if later else "okey"
    return f"""{name} as (select item, grp, pub, ph, temp, src, mtype, rel, {value} as v, case when okey % 5 <> 0 then {doi} end as doi, okey || '-' || line as rsid
  from obs, range(0, 2) c(k) where okey % 10 <> {1 if later else 0} and (k = 0 or okey % {13 if later else 17} = 0))"""


SNAPS = OBS + ", " + _snapshot_sql("snap_a", False) + ", " + _snapshot_sql("snap_b", True)


def score_of_pair() -> Column:
    """A score with many ties for each pair."""
    return ((F.col("item") * 7919 + F.col("grp") * 104729) % 50) / 50.0


SCORES = "scores as (select distinct item, grp, ((item * 7919 + grp * 104729) % 50) / 50.0 as score from obs)"
