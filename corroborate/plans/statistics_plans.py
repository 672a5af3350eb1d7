"""Queries on resampling, tests and hooks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.entities import decode_entities
from ..operators import alignment, checks, evidence, hooks
from ..operators import metrics as m
from ..operators import statistics as st
from ..similarity.common import write_once
from ..sources.releases import scratch, write_version
from ..sources.tables import OBS, observations, table
from .evidence_plans import r6, r6_sql
from .metric_plans import AP, AUROC, COHORT, GRP, SEEDS, blocks_sql, by, cohort, seeded_runs
from .registry import query
from .source_plans import PAGES


def uniform_sql(*parts: str) -> str:
    return "('0x' || substr(md5(" + " || '|' || ".join(parts) + "), 1, 13))::bigint / 4503599627370496.0"


def poisson_sql(u: str) -> str:
    total, term, out = 0.0, 0.36787944117144233, []
    for k in range(9):
        total += term
        out.append(f"({u} >= {total!r}::double)::int")
        term /= k + 1
    return "(" + " + ".join(out) + ")"


def resampled_sql(source: str, keys: list[str], rounds: int, seed: str, keep: str) -> str:
    named = " || '|' || ".join([f"'{seed}'", "(b - 1) // 4", *keys])
    weight = " + ".join(f"(draw >= '{limit}')::int" for limit in st.poisson_limits())
    return f"""u0 as (select *, substr(md5({named}), 8 * ((b - 1) % 4)::int + 1, 8) as draw from {source}, (select unnest(range(1, {rounds} + 1)) as b)),
rw as (select * from (select {keep}, b, {weight} as w from u0) where w > 0)"""


def auroc_sql(group: str, score: str, name: str) -> str:
    return f"""{name}b as (select {group}, {score} as s, sum(w) as n, sum(case when pos then w else 0 end) as p from rw group by all),
{name}c as (select *, sum(n - p) over (partition by {group} order by s rows unbounded preceding) - (n - p) as below from {name}b),
{name} as (select {group}, case when sum(p) * sum(n - p) > 0 then sum(p * (below + (n - p) / 2)) / (sum(p) * sum(n - p)) end as auroc from {name}c group by all)"""


BOOT = COHORT + ", " + resampled_sql("cohort", ["grp", "item"], 20, "boot", "grp, item, score, pos") + ", " + auroc_sql("grp, b", "score", "ba")
INTERVAL = "iv as (select grp, quantile_cont(auroc, 0.05) as low, quantile_cont(auroc, 0.95) as high, count(auroc) as n_rounds, count(*) - count(auroc) as n_single_class from ba group by grp)"


def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = st.replicate(cohort(spark, sf_dir), 20, "boot", "grp", "item")
    return st.percentile_interval(st.weighted_auroc(weighted, ["grp", "b"]), ["grp"], "auroc")


@query("STA01", f"with {BOOT}, {INTERVAL} select grp, {r6_sql('low', 'high')}, n_rounds, n_single_class from iv")
def sta01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bootstrap(spark, sf_dir).select("grp", *r6("low", "high"), "n_rounds", "n_single_class")


@query(
    "STA02",
    f"""with {BOOT}, {INTERVAL}, {GRP}, pt as (select g, {AUROC} as auroc, any_value(tp) as p, any_value(tn) - any_value(tp) as q from bl group by g)
  select grp, round(auroc, 6) as auroc, case when p < 50 or q < 50 then 'insufficient' when auroc < 0.5 then 'fail' when low > 0.5 and auroc >= 0.52 then 'pass' when high < 0.52 then 'fail' else 'inconclusive' end as decision from iv join pt on iv.grp = pt.g""",
)
def sta02(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = m.blocks(by(spark, sf_dir, "grp")).groupBy("g").agg(m.auroc().alias("auroc"), F.first("tp").alias("p"), (F.first("tn") - F.first("tp")).alias("q"))
    both = bootstrap(spark, sf_dir).join(point, F.col("grp") == F.col("g"))
    rule = st.decision(*[F.col(c) for c in ("auroc", "low", "high")], 0.52, F.col("p"), F.col("q"), 50)
    return both.select("grp", F.round("auroc", 6).alias("auroc"), rule.alias("decision"))


PAIRED = COHORT + ", two as (select grp, item, pos, score as s1, ((item * 31 + grp * 17) % 40) / 40.0 as s2 from cohort), " + resampled_sql("two", ["grp", "item"], 12, "pair", "grp, item, pos, s1, s2") + ", " + auroc_sql("grp, b", "s1", "x1") + ", " + auroc_sql("grp, b", "s2", "x2")


def _two_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort(spark, sf_dir).withColumn("s1", F.col("score")).withColumn("s2", ((F.col("item") * 31 + F.col("grp") * 17) % 40) / 40.0)


@query("STA03", f"with {PAIRED}, df as (select grp, b, x1.auroc - x2.auroc as d from x1 join x2 using (grp, b)) select grp, round(quantile_cont(d, 0.05), 6) as low, round(quantile_cont(d, 0.95), 6) as high, count(d) as n_rounds from df group by grp")
def sta03(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = st.replicate(_two_scores(spark, sf_dir), 12, "pair", "grp", "item")
    one, two = (st.weighted_auroc(weighted, ["grp", "b"], s).select("grp", "b", F.col("auroc").alias(s)) for s in ("s1", "s2"))
    return st.percentile_interval(one.join(two, ["grp", "b"]).withColumn("d", F.col("s1") - F.col("s2")), ["grp"], "d").select("grp", *r6("low", "high"), "n_rounds")


@query(
    "STA04",
    f"""with {BOOT}, gw as (select grp, b, {poisson_sql(uniform_sql("'outer'", "b", "grp"))} as gw from (select distinct grp, b from ba)), mm as (select b, sum(gw * auroc) / sum(gw) as m from ba join gw using (grp, b) where gw > 0 group by b)
  select round(quantile_cont(m, 0.05), 6) as low, round(quantile_cont(m, 0.95), 6) as high, count(*) as n_rounds from mm""",
)
def sta04(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = st.weighted_auroc(st.replicate(cohort(spark, sf_dir), 20, "boot", "grp", "item"), ["grp", "b"])
    outer = inner.withColumn("gw", st.poisson_one(st.uniform(F.lit("outer"), F.col("b"), F.col("grp")))).where("gw > 0")
    means = outer.groupBy("b").agg((F.sum(F.col("gw") * F.col("auroc")) / F.sum("gw")).alias("m"))
    return means.agg(F.round(F.percentile("m", F.lit(0.05)), 6).alias("low"), F.round(F.percentile("m", F.lit(0.95)), 6).alias("high"), F.count("*").alias("n_rounds"))


DELTAS = COHORT + ", two as (select grp, item, pos, score as s1, ((item * 31 + grp * 17) % 40) / 40.0 as s2, 1 as w from cohort), rw as (select * from two), " + auroc_sql("grp", "s1", "x1") + ", " + auroc_sql("grp", "s2", "x2") + ", de as (select grp, round(x1.auroc - x2.auroc, 3) as d from x1 join x2 using (grp))"


@query(
    "STA05",
    f"""with {DELTAS}, nz as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2 as r, count(*) over (partition by abs(d)) as t from de where d <> 0),
  ag as (select count(*) as n, sum(r) filter (where d > 0) as w_plus, count(*) filter (where d > 0) as n_up, count(*) * (count(*) + 1) * (2 * count(*) + 1) / 24 - sum(t * t - 1) / 48 as variance from nz)
  , qs as (select count(*) as n_groups, round(quantile_cont(d, 0.25), 6) as lower_quartile, round(median(d), 6) as median, round(quantile_cont(d, 0.75), 6) as upper_quartile from de where d is not null),
  z as (select n, w_plus, n_up, (w_plus - n * (n + 1) / 4) / sqrt(variance) as z from ag),
  sg as (select least(1.0, 2 * sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2)))) as sign_p from (select n, unnest(range(0, least(n_up, n - n_up) + 1)) as k from z))
  select n_groups, n, w_plus, n_up, round(z, 6) as z, round(sign_p, 6) as sign_p, median, lower_quartile, upper_quartile from z, qs, sg""",
)
def sta05(spark: SparkSession, sf_dir: str) -> DataFrame:
    ones = _two_scores(spark, sf_dir).withColumn("w", F.lit(1))
    one, two = (st.weighted_auroc(ones, ["grp"], s).select("grp", F.col("auroc").alias(s)) for s in ("s1", "s2"))
    deltas = one.join(two, "grp").withColumn("d", F.round(F.col("s1") - F.col("s2"), 3))
    return st.signed_rank(deltas, "d").select("n_groups", "n", "w_plus", "n_up", *r6("z", "sign_p", "median", "lower_quartile", "upper_quartile"))


#: Two-sided tail of the normal distribution at z, by the error function's rational approximation 7.1.26 of Abramowitz and Stegun.
NORMAL_TAIL = "list_transform([1 / (1 + 0.3275911 * abs(z) / sqrt(2.0))], lambda t: ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-z * z / 2))[1]"


@query(
    "STA06",
    f"""with {COHORT}, {GRP}, u as (select g, sum(p * (an - n + (n + 1) / 2)) - any_value(tp) * (any_value(tp) + 1) / 2 as u, any_value(tp)::bigint as n1, (any_value(tn) - any_value(tp))::bigint as n2, sum(n * n * n - n) as ties from bl group by g)
  select g, round(u, 6) as u, n1, n2, round(z, 6) as z, round({NORMAL_TAIL}, 6) as p_value from (select *, (u - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) as z from u where n1 > 0 and n2 > 0)""",
)
def sta06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.mann_whitney(by(spark, sf_dir, "grp"), "g").select("g", *r6("u"), "n1", "n2", *r6("z", "p_value"))


@query("STA07", f"with {COHORT}, zz as (select item, grp, score, (score - avg(score) over (partition by grp)) / stddev_pop(score) over (partition by grp) as z from cohort) select item, round(avg(z), 6) as mean_z, round(avg(score), 6) as mean_raw, md5(item || '|perm') as permuted from zz group by item")
def sta07(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("grp")
    z = cohort(spark, sf_dir).withColumn("z", (F.col("score") - F.avg("score").over(w)) / F.stddev_pop("score").over(w))
    return z.groupBy("item").agg(F.round(F.avg("z"), 6).alias("mean_z"), F.round(F.avg("score"), 6).alias("mean_raw")).withColumn("permuted", F.md5(F.concat_ws("|", "item", F.lit("perm"))))


@query("SRT07", f"with {COHORT}, k as (select item, grp, pos, row_number() over (partition by pos order by sha256(item || '|' || grp || '|draw'), item, grp) as r from cohort) select item, grp, pos from k where r <= 100")
def srt07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.balanced_sample(cohort(spark, sf_dir).select("item", "grp", "pos"), "pos", 100, "draw", "item", "grp")


@query("SRT08", f"with {COHORT} select grp, count(*) as n from cohort group by grp having count(*) filter (where pos) >= 10 and count(*) filter (where not pos) >= 10 order by n desc, grp limit 12")
def srt08(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = cohort(spark, sf_dir).groupBy("grp").agg(F.count("*").alias("n"), F.count_if("pos").alias("a"), F.count_if(~F.col("pos")).alias("b"))
    return sized.where("a >= 10 and b >= 10").orderBy(F.desc("n"), "grp").limit(12).select("grp", "n")


# comparisons of saved results


RUN_METRICS = SEEDS + f", {blocks_sql('seed', 'runs')}, sa as (select g as seed, {AUROC} as auroc, {AP} as ap from bl group by g), lm as (select seed, 'auroc' as metric, auroc as value from sa union all select seed, 'ap', ap from sa), "
COMPARED = RUN_METRICS + """cp as (select l.seed, l.metric, o.value as before, l.value as now from lm l full join (select seed, metric, value + case when seed = 2 and metric = 'ap' then 0.01 else 0 end as value from lm where seed <> 4) o on l.seed = o.seed and l.metric = o.metric)"""


def _long_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = m.blocks(seeded_runs(spark, sf_dir), "seed").groupBy("seed").agg(m.auroc().alias("auroc"), m.average_precision().alias("ap"))
    return found.unpivot("seed", ["auroc", "ap"], "metric", "value")


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of two versions side by side, with a flag where they differ by more than 5e-7 or one is missing."""
    now = _long_metrics(spark, sf_dir)
    shift = F.when((F.col("seed") == 2) & (F.col("metric") == "ap"), 0.01).otherwise(0.0)
    before = now.where("seed <> 4").select("seed", "metric", (F.col("value") + shift).alias("before"))
    both = now.withColumnRenamed("value", "now").join(before, ["seed", "metric"], "full_outer")
    return both.withColumn("changed", F.coalesce(F.abs(F.col("before") - F.col("now")) > 5e-7, ~F.col("before").eqNullSafe(F.col("now"))))


@query("JON23", f"with {COMPARED} select seed, metric, {r6_sql('before', 'now')}, coalesce(abs(before - now) > 5e-7, before is distinct from now) as changed from cp")
def jon23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark, sf_dir).select("seed", "metric", *r6("before", "now"), "changed")


@query("AGG50", f"with {COMPARED} select metric, count(*) as n, count(*) filter (where coalesce(abs(before - now) > 5e-7, before is distinct from now)) as n_changed, round(max(abs(before - now)), 6) as most from cp group by metric")
def agg50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark, sf_dir).groupBy("metric").agg(F.count("*").alias("n"), F.count_if("changed").alias("n_changed"), F.round(F.max(F.abs(F.col("before") - F.col("now"))), 6).alias("most"))


@query("JON24", f"with {COHORT}, pr as (select item, grp from cohort where item % 7 <> 0 union all select -1, 0) select (select count(*) from cohort where (item, grp) not in (select (item, grp) from pr)) as n_missing, (select count(*) from pr where (item, grp) not in (select (item, grp) from cohort)) as n_extra, (select count(*) from pr join cohort using (item, grp)) as n_aligned")
def jon24(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = write_once(cohort(spark, sf_dir).select("item", "grp"), "cohort-keys")
    predicted = keys.where("item % 7 <> 0").unionByName(keys.limit(1).select(F.lit(-1).cast("long").alias("item"), F.lit(0).alias("grp")))
    both = keys.withColumns({"k": F.lit(1), "p": F.lit(0)}).unionByName(predicted.withColumns({"k": F.lit(0), "p": F.lit(1)}))
    each = both.groupBy("item", "grp").agg(F.sum("k").alias("k"), F.sum("p").alias("p"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return each.agg(total(F.when(F.col("p") == 0, F.col("k"))).alias("n_missing"), total(F.when(F.col("k") == 0, F.col("p"))).alias("n_extra"), total(F.col("k") * F.col("p")).alias("n_aligned"))


@query(
    "JON25",
    """with f as (select strftime(l_shipdate, '%Y-%m-%d') as file, count(*) as n, sum(l_orderkey)::bigint as k from lineitem group by 1), e as (select * from f where k % 5 <> 1), p as (select * from f where k % 5 <> 2)
  select coalesce(e.file, p.file) as file, e.n as expected_rows, p.n as present_rows, case when p.file is null then 'missing' when e.file is null then 'unexpected' else 'present' end as state from e full join p on e.file = p.file""",
)
def jon25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file a day of shipments, as a manifest expects them and as they are found."""
    files = table(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM-dd").alias("file")).agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("k"))
    expected = files.where("k % 5 <> 1").select("file", F.col("n").alias("expected_rows"))
    present = files.where("k % 5 <> 2").select("file", F.col("n").alias("present_rows"))
    state = F.when(F.col("present_rows").isNull(), "missing").when(F.col("expected_rows").isNull(), "unexpected").otherwise("present")
    return expected.join(present, "file", "full_outer").select("file", "expected_rows", "present_rows", state.alias("state"))


@query("JON19", f"with acc as (select p_partkey as item, p_size as x from part where p_partkey % 3 = 0), ext as (select p_partkey as item, p_size as x from part where p_partkey % 3 = 1), al as (select item, x, 'accepted' as provenance from acc union all select item, x, 'extension' from ext), {OBS}, need as (select distinct item from obs) select coalesce(provenance, 'missing') as provenance, count(*) as n, count(*) filter (where x > 45) as n_unusable from need left join al using (item) group by 1")
def jon19(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_size").alias("x"))
    accepted, extension = part.where("item % 3 = 0"), part.where("item % 3 = 1")
    if accepted.join(extension, "item", "left_semi").limit(1).count():
        raise ValueError("the extension repeats accepted keys")
    bound = accepted.withColumn("provenance", F.lit("accepted")).unionByName(extension.withColumn("provenance", F.lit("extension")))
    need = observations(spark, sf_dir).select("item").distinct()
    return need.join(bound, "item", "left").groupBy(F.coalesce("provenance", F.lit("missing")).alias("provenance")).agg(F.count("*").alias("n"), F.count_if(F.col("x") > 45).alias("n_unusable"))


@query("JON20", f"with {OBS}, k as (select distinct item, sha256(item::varchar) as content from obs), a as (select p_partkey + 1000000 as accepted_id, sha256(p_partkey::varchar) as content from part where p_size < 30) select item, accepted_id from k join a using (content)")
def jon20(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = observations(spark, sf_dir).select("item").distinct().withColumn("content", F.sha2(F.col("item").cast("string"), 256))
    known = table(spark, sf_dir, "part").where("p_size < 30").select((F.col("p_partkey") + 1000000).alias("accepted_id"), F.sha2(F.col("p_partkey").cast("string"), 256).alias("content"))
    return keys.join(known, "content").select("item", "accepted_id")


@query("JON22", f"with {OBS}, g as (select grp, avg(v) as gated from obs where src = 'N' group by grp), u as (select grp, avg(v) as ungated from obs group by grp), d as (select abs(gated - ungated) as d from g join u using (grp)) select count(*) as n, round(quantile_cont(d, 0.5), 6) as median, round(quantile_cont(d, 0.9), 6) as p90 from d")
def jon22(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    gated, free = obs.where("src = 'N'").groupBy("grp").agg(F.avg("v").alias("g")), obs.groupBy("grp").agg(F.avg("v").alias("u"))
    d = gated.join(free, "grp").select(F.abs(F.col("g") - F.col("u")).alias("d"))
    return d.agg(F.count("*").alias("n"), F.round(F.percentile("d", F.lit(0.5)), 6).alias("median"), F.round(F.percentile("d", F.lit(0.9)), 6).alias("p90"))


def similar_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Evaluation texts (every fifth id), and of each its best hit among the training texts, searched over whole documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = docs.where("id % 5 = 0")
    return asked, alignment.search_best(asked, docs.where("id % 5 <> 0"))


@query("JON14")
def jon14(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, best = similar_texts(spark, sf_dir)
    return best.select("query", "target", *r6("identity", "mutual", "cov_query", "cov_target"))


@query("SPL15")
def spl15(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.near_homologs(*similar_texts(spark, sf_dir))
    return found.select("id", "target", *r6("identity", "mutual"), "near_homolog")


@query("AGG52", f"with {OBS}, ro as (select distinct case when item % 10 < 8 then 'train' else 'validation' end as role, item from obs), le as (select p_partkey as item, length(p_name) * 70 as n from part where p_size > 2) select role, count(*) as n_entities, count(n) as n_resolved, count(*) filter (where n > 1022) as n_over, max(n) as longest from ro left join le using (item) group by role")
def agg52(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = observations(spark, sf_dir).select(F.when(F.col("item") % 10 < 8, "train").otherwise("validation").alias("role"), "item").distinct()
    lengths = table(spark, sf_dir, "part").where("p_size > 2").select(F.col("p_partkey").alias("item"), (F.length("p_name") * 70).cast("long").alias("n"))
    return roles.join(lengths, "item", "left").groupBy("role").agg(F.count("*").alias("n_entities"), F.count("n").alias("n_resolved"), F.count_if(F.col("n") > 1022).alias("n_over"), F.max("n").alias("longest"))


@query("AGG53", f"with {COHORT}, s as (select pos, case when item % 11 = 0 then 'prepare' when item % 13 = 0 then 'dock' else 'scored' end as stage from cohort) select pos, count(*) filter (where stage = 'scored') as scored, count(*) filter (where stage = 'prepare') as prepare, count(*) filter (where stage = 'dock') as dock from s group by pos")
def agg53(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.when(F.col("item") % 11 == 0, "prepare").when(F.col("item") % 13 == 0, "dock").otherwise("scored")
    return cohort(spark, sf_dir).withColumn("stage", stage).groupBy("pos").pivot("stage", ["scored", "prepare", "dock"]).agg(F.count(F.lit(1)))


@query(
    "EVL11",
    f"""with {COHORT}, k as (select item, grp, y, case when item % 5 = 0 then 'evaluation' else 'train' end as role from cohort), ds as (select role, 'label' as kind, item, grp from k union all select role, 'value', item, grp from k where y is not null),
  hs as (select role, kind, sha256(item || '|' || grp) as h from ds), em as (select role, kind, count(*) as n, sha256(count(*) || ':' || sum(('0x' || substr(h, 1, 15))::hugeint) || ':' || sum(('0x' || substr(h, 16, 15))::hugeint)) as digest from hs group by role, kind)
  select role, kind, n, digest, case when role = 'train' and kind = 'value' then 'digest_differs' when role = 'evaluation' and kind = 'label' then 'count_differs' else 'as_pinned' end as verdict from em
  union all select 'calibration', 'label', 0, null, 'not_covered' union all select 'train', 'rank', 0, null, 'not_emitted'""",
)
def evl11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets of two roles and two kinds, emitted anew and compared with a pinned table that was stored before: one changed, one grown, one never made."""
    rows = cohort(spark, sf_dir).select("item", "grp", "y", F.when(F.col("item") % 5 == 0, "evaluation").otherwise("train").alias("role"))
    cells = rows.select("role", "item", "grp", F.explode(F.array_compact(F.array(F.lit("label"), F.when(F.col("y").isNotNull(), "value")))).alias("kind"))
    emitted = checks.group_digests(cells, ["role", "kind"], F.concat_ws("|", "item", "grp"))
    changed = (F.col("role") == "train") & (F.col("kind") == "value")
    grown = (F.col("role") == "evaluation") & (F.col("kind") == "label")
    pinned = emitted.select("role", "kind", F.when(grown, F.col("n") + 1).otherwise(F.col("n")).alias("n"), F.when(changed, "old").otherwise(F.col("digest")).alias("digest"))
    path = scratch(spark, "pinned")
    write_version(pinned.unionByName(spark.createDataFrame([("train", "rank", 7, "gone")], "role string, kind string, n long, digest string")), path)
    required = [(r, k) for r in ("train", "evaluation") for k in ("label", "value")] + [("calibration", "label")]
    return checks.against_pinned(emitted, spark.read.parquet(path), required)


# hooks


@query("UDF01", f"with {OBS} select okey, line, item, upper(reverse(item::varchar)) as made from obs")
def udf01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hooks.map_entities(observations(spark, sf_dir).select("okey", "line", "item"), "item", lambda k: k[::-1].upper(), "made")


@query("UDF02", f"with {PAGES} select page_id, sha256(decoded) as decoded_sha256, length(decoded) - length(replace(decoded, '&', '')) as n_ampersands from decoded")
def udf02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vectorised scalar hook, here a count by Arrow's own functions, on pages whose entities were decoded without one."""
    import pyarrow.compute as pc

    decoded = table(spark, sf_dir, "pages").select("page_id", decode_entities(F.coalesce("html", F.lit(""))).alias("decoded"))
    counted = hooks.vectorised(F.col("decoded"), lambda values: pc.cast(pc.count_substring(values, pattern="&"), "int64"), "long")
    return decoded.select("page_id", F.sha2("decoded", 256).alias("decoded_sha256"), counted.alias("n_ampersands"))


@query("UDF03", f"with {OBS}, top as (select grp, v, row_number() over (partition by grp order by v desc, okey, line) as place from obs where v > 0) select grp, count(*) as n, round(exp(avg(ln(v))), 6) as geometric_mean from top where place <= 50 group by grp")
def udf03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grouped hook on what earlier steps made small: the fifty largest values of each group, found without gathering it."""

    def work(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"grp": [group["grp"].iloc[0]], "n": [len(group)], "geometric_mean": [round(float(np.exp(np.log(group["v"]).mean())), 6)]})

    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("v"), "okey", "line"))
    top = observations(spark, sf_dir).where("v > 0").select("grp", "v", "okey", "line").withColumn("place", place).where("place <= 50")
    return hooks.grouped(top.select("grp", "v"), ["grp"], work, "grp int, n long, geometric_mean double")


@query("UDF04", f"with {OBS} select grp, round(max(9 - log10(v)) filter (where rel in ('<', '<=') and v > 0), 6) as lo, round(min(9 - log10(v)) filter (where rel in ('>', '>=') and v > 0), 6) as hi from obs where rel in ('<', '<=', '>', '>=') and v > 0 group by grp")
def udf04(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo, hi = evidence.tightest(F.col("c"))
    found = evidence.with_roles(observations(spark, sf_dir)).where("role = 'censored'").groupBy("grp").agg(lo.alias("l"), hi.alias("h"))
    return found.select("grp", F.round("l.at", 6).alias("lo"), F.round("h.at", 6).alias("hi"))
