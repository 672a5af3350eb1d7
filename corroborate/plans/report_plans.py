"""Queries on the counts that reports print."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import evidence as fn
from ..operators import curation, evidence, reports, splits
from ..sources.tables import OBS, OBS_TEXT, observation_texts, observations, table
from .evidence_plans import EVIDENCE, RULES, evidence_of, evidence_sql
from .registry import query
from .split_plans import TEMPORAL, TEST, VALIDATION, spl05

#: Labels of pairs over all their dated observations: the evidence tables of another name, so that both stand in one query.
GLOBAL_LABELS = f"with {evidence_sql('dated', 'item', 'grp')} select item, grp, label as global_label from ev"


CURATED = f"""{RULES}, cu as (select *, coalesce(rule, 'kept') as verdict, case when s_suppkey is null then 'no_rsid_match' else 'matched' end as join_status,
  case when okey % 7 = 0 or okey % 7 = 1 then 'unknown_chain_count' when okey % 7 <= 4 then 'in_scope' else 'multi_chain:' || (okey % 7 - 3) end as scope from ruled left join (select s_suppkey from supplier where s_acctbal > 0) on assay = s_suppkey)"""


@query(
    "AGG37",
    f"""with {OBS_TEXT}, {CURATED}, gs as (select verdict, mtype, rel, join_status, scope, assay, pub, src, grp, item, count(*) as n, grouping(verdict) as g1, grouping(mtype) as g2, grouping(join_status) as g3, grouping(scope) as g4, grouping(assay) as g5, grouping(pub) as g6, grouping(src) as g7, grouping(grp) as g8, grouping(item) as g9
    from cu group by grouping sets ((verdict), (mtype, rel), (mtype, rel, verdict), (join_status), (scope), (assay), (pub), (src), (grp), (item, assay))),
  many as (select 'many_sources' as section, item::varchar as key, count(*) as n from gs where g9 = 0 group by item having count(*) >= 5 order by n desc, key limit 10)
  select 'rule' as section, verdict as key, n from gs where g1 = 0 and g2 = 1 union all select 'type_relation', mtype || '|' || rel, n from gs where g2 = 0 and g1 = 1 union all select 'type_relation_rule', mtype || '|' || rel || '|' || verdict, n from gs where g2 = 0 and g1 = 0
  union all select 'join_status', join_status, n from gs where g3 = 0 union all select 'scope', scope, n from gs where g4 = 0
  union all select 'dimension', 'assay', count(*) from gs where g5 = 0 and g9 = 1 union all select 'dimension', 'pub', count(*) from gs where g6 = 0 union all select 'dimension', 'src', count(*) from gs where g7 = 0 union all select 'dimension', 'grp', count(*) from gs where g8 = 0 union all select * from many""",
)
def agg37(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by rule, type by relation, both, join status, scope, the sizes of the dimensions, and items of many assays: one pass."""
    some = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("assay"))
    ruled = curation.first_failing_rule(curation.with_chain_text(observation_texts(spark, sf_dir)), curation.demo_rules())
    ok, why = fn.scope(fn.chain_count(F.col("chains_text")))
    rows = curation.lookup_with_status(ruled, some, "assay").withColumn("scope", F.when(ok, "in_scope").otherwise(why)).withColumn("verdict", F.coalesce("rule", F.lit("kept")))
    named = {"rule": ("verdict",), "type_relation": ("mtype", "rel"), "type_relation_rule": ("mtype", "rel", "verdict"), "join_status": ("join_status",), "scope": ("scope",)}
    found = reports.sections(rows, named, sizes=("assay", "pub", "src", "grp"), members={"many_sources": ("item", "assay")})
    return reports.greatest_of(found, "many_sources", 5, 10)


@query(
    "AGG38",
    f"""with {EVIDENCE}, old as (select item, grp, label as old_label from ev3 where threshold = 7.0), z as (select ev.*, case when n_exact + n_censored >= 10 then '10+' else (n_exact + n_censored)::varchar end as n_obs, coalesce(reason, '(none)') as excluded, old_label from ev join old using (item, grp)),
  gs as (select n_obs, label, status, evidence, excluded, old_label, count(*) as n, grouping(n_obs) as g1, grouping(label) as g2, grouping(status) as g3, grouping(evidence) as g4, grouping(excluded) as g5, grouping(old_label) as g6 from z group by grouping sets ((n_obs), (label), (status), (evidence), (excluded), (label, old_label), (n_obs, label, evidence)))
  select 'observations' as section, n_obs as key, n from gs where g1 = 0 and g2 = 1 union all select 'label', label, n from gs where g2 = 0 and g1 = 1 and g6 = 1 union all select 'status', status, n from gs where g3 = 0 union all select 'evidence', evidence, n from gs where g4 = 0 and g1 = 1
  union all select 'excluded', excluded, n from gs where g5 = 0 union all select 'superseded', old_label || '|' || label, n from gs where g6 = 0 union all select 'observations_label_evidence', n_obs || '|' || label || '|' || evidence, n from gs where g1 = 0 and g2 = 0""",
)
def agg38(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by number of observations, label, status, evidence and exclusion, and how labels moved from the superseded threshold of 7."""
    k = F.col("n_exact") + F.col("n_censored")
    now = evidence_of(spark, sf_dir).withColumn("n_obs", F.when(k >= 10, "10+").otherwise(k.cast("string")))
    before = evidence.decide(now.select("*").drop("threshold", "status", "label", "evidence", "discordant", "reason", "regression_reason").withColumn("threshold", F.lit(7.0)))
    rows = now.select("item", "grp", "n_obs", "label", "status", "evidence", F.col("reason").alias("excluded")).join(before.select("item", "grp", F.col("label").alias("old_label")), ["item", "grp"])
    named = {"observations": ("n_obs",), "label": ("label",), "status": ("status",), "evidence": ("evidence",), "excluded": ("excluded",), "superseded": ("old_label", "label"), "observations_label_evidence": ("n_obs", "label", "evidence")}
    return reports.sections(rows, named)


@query(
    "AGG39",
    f"""with {TEMPORAL}, hs as (select item, grp, list_sort(list(distinct part)) as parts from dated group by all),
  sp as (select ev.item, ev.grp, ev.part as period, case when reason is not null and ev.part <> 'train' then 'excluded' else ev.part end as part, case when list_contains(parts, 'train') and ev.part <> 'train' then 'recurrent' else 'new_pair' end as stratum,
    coalesce(nullif(array_to_string(list_filter(parts, lambda p: (ev.part = 'validation' and p = 'train') or (ev.part = 'test' and p in ('train', 'validation'))), ','), ''), '(never)') as history, label from ev join hs on ev.item = hs.item and ev.grp = hs.grp),
  ga as ({GLOBAL_LABELS}),
  j as (select sp.*, ga.global_label from sp join ga using (item, grp)),
  gs as (select period, part, stratum, history, label, global_label, count(*) as n, grouping(history) as g1, grouping(label) as g2, grouping(global_label) as g3 from j group by grouping sets ((part, stratum, history), (period, stratum, label), (part, global_label, label)))
  select 'part_stratum_history' as section, part || '|' || stratum || '|' || history as key, n from gs where g1 = 0 union all select 'period_stratum_label', period || '|' || stratum || '|' || label, n from gs where g2 = 0 and g3 = 1
  union all select 'part_label_flips', part || '|' || global_label || '|' || label, n from gs where g3 = 0 and global_label <> label union all select 'part_date_source', part || '|' || date_source, count(*) from dated group by part, date_source""",
)
def agg39(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by part, stratum and history, by period and label, labels that differ from those over all periods, and where dates came from."""
    obs = observations(spark, sf_dir)
    dated = splits.temporal_parts(obs, VALIDATION, TEST)
    overall = evidence.pair_evidence(dated).select("item", "grp", F.col("label").alias("global_label"))
    rows = spl05(spark, sf_dir).join(overall, ["item", "grp"]).withColumn("history", F.coalesce("history", F.lit("(never)"))).withColumn("flipped", F.when(F.col("label") != F.col("global_label"), F.concat_ws("|", "global_label", "label")))
    found = reports.sections(rows, {"part_stratum_history": ("part", "stratum", "history"), "period_stratum_label": ("period", "stratum", "label"), "part_label_flips": ("part", "flipped")})
    flips = found.where("section <> 'part_label_flips' or key not like '%|(none)'")
    return flips.unionByName(reports.sections(dated, {"part_date_source": ("part", "date_source")}))


@query("AGG40", f"with {OBS}, m as (select p_partkey as item, p_size from part where p_size > 2) select count(*) as n_items, min(p_size) as least, max(p_size) as most, (select count(distinct grp) from obs where item in (select item from m)) as n_groups_reached, (select count(distinct grp) from obs) as n_groups from m")
def agg40(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "part").where("p_size > 2").select(F.col("p_partkey").alias("item"), "p_size")
    obs = observations(spark, sf_dir).select("item", "grp")
    reached = obs.join(members, "item", "left_semi").agg(F.count_distinct("grp").alias("n_groups_reached"))
    sizes = members.agg(F.count("*").alias("n_items"), F.min("p_size").alias("least"), F.max("p_size").alias("most"))
    return sizes.crossJoin(reached).crossJoin(obs.agg(F.count_distinct("grp").alias("n_groups")))
