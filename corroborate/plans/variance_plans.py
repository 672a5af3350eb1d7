"""Queries on variance and pooling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import variance as v
from ..sources.tables import observations
from .evidence_plans import EVIDENCE, ROLES, evidence_of, r6, r6_sql
from .registry import query

EXACT = ROLES + ", ex as (select * from r where role = 'exact')"


def within_sql(key: str, source: str = "ex") -> str:
    return f"select item, grp, {key}, count(*) as n, max(p) - min(p) as spread from {source} group by all having count(*) >= 2"


def between_sql(key: str, source: str = "ex") -> str:
    return f"select item, grp, count(*) as n, max(m) - min(m) as spread from (select item, grp, {key}, median(p) as m from {source} group by all) group by item, grp having count(*) >= 2"


def spreads_sql(key: str, source: str = "ex") -> str:
    return f"sw as ({within_sql(key, source)}), sb as ({between_sql(key, source)}), sp as (select 'within' as kind, item, grp, spread from sw union all select 'between', item, grp, spread from sb)"


SUMMARY = """so as (select kind, spread, row_number() over (partition by kind order by spread) - 1 as r, count(*) over (partition by kind) as n from sp),
sm as (select kind, count(*) as n, max(spread) filter (where r = floor(0.1 * (n - 1))) as p10, max(spread) filter (where r = floor(0.5 * (n - 1))) as median, max(spread) filter (where r = floor(0.9 * (n - 1))) as p90, avg(spread) as mean, avg((spread > 1.0)::int) as over_one from so group by kind)"""


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.exact_rows(observations(spark, sf_dir))


@query("AGG11", f"with {EVIDENCE} select count(*) as n_pairs, count(*) filter (where label in ('active', 'inactive')) as n_labelled, count(*) filter (where n_exact > 0) as n_regression, count(*) filter (where n_exact > 1) as n_repeats, count(*) filter (where n_assays > 1) as n_multi_assay, count(*) filter (where n_pubs > 1) as n_multi_pub, count(*) filter (where discordant) as n_discordant from ev")
def agg11(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count_if
    return evidence_of(spark, sf_dir).agg(
        F.count("*").alias("n_pairs"), n(F.col("label").isin("active", "inactive")).alias("n_labelled"), n(F.col("n_exact") > 0).alias("n_regression"), n(F.col("n_exact") > 1).alias("n_repeats"),
        n(F.col("n_assays") > 1).alias("n_multi_assay"), n(F.col("n_pubs") > 1).alias("n_multi_pub"), n(F.col("discordant")).alias("n_discordant"),
    )


@query("AGG12", "select 'orders' as covariate, count(o_orderkey) as present, count(*) as total from lineitem left join (select o_orderkey from orders where o_orderstatus = 'F') on l_orderkey = o_orderkey union all select 'acctbal', count(s_suppkey), count(*) from lineitem left join (select s_suppkey from supplier where s_acctbal > 0) on l_suppkey = s_suppkey")
def agg12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import table

    lines = table(spark, sf_dir, "lineitem")
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("a"))
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(1).alias("b"))
    one = lines.join(done, "l_orderkey", "left").join(rich, "l_suppkey", "left").agg(F.count("a").alias("a"), F.count("b").alias("b"), F.count("*").alias("total"))
    return one.select(F.expr("stack(2, 'orders', a, total, 'acctbal', b, total) as (covariate, present, total)"))


@query("AGG13", f"with {EXACT}, k as (select item, grp, count(distinct assay) as a, count(distinct pub) as b from ex group by all) select case when a = 1 and b = 1 then 'one_each' when a = 1 then 'one_assay' when b = 1 then 'one_pub' when a = b then 'moves_together' else 'crossed' end as bucket, count(*) as n from k group by 1")
def agg13(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = rows(spark, sf_dir).groupBy("item", "grp").agg(F.size(F.collect_set("assay")).alias("a"), F.size(F.collect_set("pub")).alias("b"))
    a, b = F.col("a"), F.col("b")
    bucket = F.when((a == 1) & (b == 1), "one_each").when(a == 1, "one_assay").when(b == 1, "one_pub").when(a == b, "moves_together").otherwise("crossed")
    return k.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("AGG14", f"with {EXACT}, {spreads_sql('assay')} select kind, item, grp, round(spread, 6) as spread from sp")
def agg14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.spreads(rows(spark, sf_dir), "assay").select("kind", "item", "grp", *r6("spread"))


@query("AGG15", f"with {EXACT}, dd as (select distinct item, grp, src, v, p from ex), {spreads_sql('src', 'dd')}, bo as (select distinct item, grp from sw intersect select item, grp from sb) select kind, count(*) as n, round(avg(spread), 6) as mean from sp where (item, grp) in (select (item, grp) from bo) group by kind")
def agg15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.matched(rows(spark, sf_dir), "src", collapse=True).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("spread"), 6).alias("mean"))


@query("AGG16", f"with {EXACT}, k as (select item, grp, src, count(*) as n from ex group by all) select sum(n)::bigint as n_rows, sum(n - 1)::bigint as n_redundant, count(*) filter (where n > 1) as n_keys_repeated, count(*) as n_keys from k")
def agg16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.duplicates(rows(spark, sf_dir), "item", "grp", "src")


@query("AGG17", f"with {EXACT}, w as ({within_sql('src')}) select src, count(*) as n, round(avg(spread), 6) as mean, round(max(spread), 6) as most from w where spread > 0 group by src")
def agg17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.within_spread(rows(spark, sf_dir), "src").where("spread > 0").groupBy("src").agg(F.count("*").alias("n"), F.round(F.avg("spread"), 6).alias("mean"), F.round(F.max("spread"), 6).alias("most"))


@query("AGG18", f"with {EXACT}, m as (select item, grp, src, assay, median(p) as m from ex group by all), k as (select item, grp, src, count(*) as n, max(m) - min(m) as spread from m group by all having count(*) >= 2) select src, count(*) as n, round(avg((spread > 0.5)::int), 6) as tail from k group by src")
def agg18(spark: SparkSession, sf_dir: str) -> DataFrame:
    medians = rows(spark, sf_dir).groupBy("item", "grp", "src", "assay").agg(F.percentile(F.col("p"), F.lit(0.5)).alias("m"))
    fixed = medians.groupBy("item", "grp", "src").agg(F.count("*").alias("n"), (F.max("m") - F.min("m")).alias("spread")).where("n >= 2")
    return fixed.groupBy("src").agg(F.count("*").alias("n"), F.round(F.avg((F.col("spread") > 0.5).cast("int")), 6).alias("tail"))


@query("AGG19", f"with {EXACT}, {spreads_sql('src')}, {SUMMARY} select kind, n, {r6_sql('p10', 'median', 'p90', 'mean', 'over_one')} from sm")
def agg19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.summary(v.spreads(rows(spark, sf_dir), "src"), "kind", "spread").select("kind", "n", *r6("p10", "median", "p90", "mean", "over_one"))


@query("AGG21", f"with {EXACT}, o as (select mtype, p, row_number() over (partition by mtype order by p) - 1 as r, count(*) over (partition by mtype) as n from ex) select mtype, count(*) as n, round(max(p) filter (where r = round_even(0.25 * (n - 1), 0)), 6) as q25, round(max(p) filter (where r = round_even(0.5 * (n - 1), 0)), 6) as q50, round(max(p) filter (where r = round_even(0.75 * (n - 1), 0)), 6) as q75 from o group by mtype")
def agg21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.index_quantiles(rows(spark, sf_dir), "mtype", "p", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, rounded=True).select("mtype", "n", *r6("q25", "q50", "q75"))


@query("AGG22", f"with {EXACT}, {spreads_sql('src')}, {SUMMARY}, w as (select max(median) filter (where kind = 'within') as within, max(median) filter (where kind = 'between') as \"between\" from sm) select round(within, 6) as within, round(\"between\", 6) as \"between\", margin::double as margin, case when \"between\" - within <= margin then 'pool' when \"between\" - within <= 3 * margin then 'restrict' else 'unsuitable' end as decision from w, (select unnest([0.05, 0.1, 0.2, 0.5]::double[]) as margin)")
def agg22(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = v.summary(v.spreads(rows(spark, sf_dir), "src"), "kind", "spread")
    return v.decide(summary, (0.05, 0.1, 0.2, 0.5)).select(*r6("within", "between"), "margin", "decision")


@query("AGG23", f"with {EXACT}, {spreads_sql('src')}, t as (select item, grp, max(spread) as within from sw group by all) select item, grp, round(spread, 6) as \"between\", round(within, 6) as within from sb join t using (item, grp) where spread > 0.5 and within < 0.3 order by round(spread, 6) desc, item, grp limit 25")
def agg23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.wide_between_tight_within(rows(spark, sf_dir), "src", 25).select("item", "grp", *r6("between", "within"))
