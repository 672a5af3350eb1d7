"""Queries on parsing, curation and pair evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import evidence as fn
from ..operators import curation, evidence
from ..sources.tables import OBS, OBS_TEXT, observation_texts, observations, table
from .registry import query

_SIGN = "case " + " ".join(f"when starts_with(body, '{mark}') then '{mark}'" for mark in ("<=", ">=", "≤", "≥", "≈", "<", ">", "~", "=")) + " else '' end"
PARSED = OBS_TEXT + f""", bodies as (select *, trim(value_text) as body from obs_text), signed as (select *, {_SIGN} as sign from bodies where body <> ''),
amounts as (select *, replace(trim(substr(body, length(sign) + 1)), ',', '') as digits from signed),
parsed as (select *, case when trim(digits, '0123456789+-.eE') = '' then try_cast(nullif(digits, '') as double) end as number,
  case sign when '≤' then '<=' when '≥' then '>=' when '≈' then '~' when '' then case when number is null then '?' else '=' end else sign end as relation from amounts)"""


def roles_sql(source: str) -> str:
    return f"""r as (select *, case when not v > 0 then 'unusable' when rel = '=' then 'exact' when rel in ('<', '<=', '>', '>=') then 'censored' else 'no_constraint' end as role,
  case when v > 0 then 9 - log10(v) end as p from {source})"""


def evidence_sql(source: str, *keys: str) -> str:
    """Tables that lead from ``source`` to ``ev3``, evidence at three thresholds, and ``ev``, that at the first."""
    by = ", ".join(keys)
    same = " and ".join(f"r.{k} = b.{k}" for k in keys)
    return f"""{roles_sql(source)}, b as (select {by}, max(p) filter (where role = 'censored' and rel in ('<', '<=')) as lo, min(p) filter (where role = 'censored' and rel in ('>', '>=')) as hi,
  median(p) filter (where role = 'exact') as median from r group by {by}),
c as (select r.*, b.lo, b.hi, b.median from r join b on {same}),
i as (select *, bool_and(rel = '<=') filter (where role = 'censored' and rel in ('<', '<=') and p = lo) over (partition by {by}) as lo_inclusive,
  bool_and(rel = '>=') filter (where role = 'censored' and rel in ('>', '>=') and p = hi) over (partition by {by}) as hi_inclusive from c),
a as (select {by}, count(*) filter (where role = 'exact') as n_exact, count(*) filter (where role = 'censored') as n_censored, count(*) filter (where role = 'unusable') as n_unusable,
  count(*) filter (where role = 'no_constraint') as n_no_constraint, any_value(median) as median, min(p) filter (where role = 'exact') as least, max(p) filter (where role = 'exact') as most,
  median(abs(p - median)) filter (where role = 'exact') as mad,
  count(*) filter (where role = 'exact' and (lo is not null or hi is not null) and (coalesce(p < lo or (p = lo and not lo_inclusive), false) or coalesce(p > hi or (p = hi and not hi_inclusive), false))) as n_outside,
  count(distinct assay) as n_assays, count(distinct pub) as n_pubs, any_value(lo) as lo, any_value(lo_inclusive) as lo_inclusive, any_value(hi) as hi, any_value(hi_inclusive) as hi_inclusive from i group by {by}),
t as (select *, most - least as spread, coalesce(most - least > 1.0, false) as discordant, unnest([6.0, 7.0, 8.0])::double as threshold,
  case when n_exact = 0 and n_censored = 0 then 'no_usable_evidence' when n_censored > 0 and coalesce(lo > hi or (lo = hi and not (lo_inclusive and hi_inclusive)), false) then 'empty_intersection'
       when n_outside > 0 then 'exact_bound_conflict' else 'ok' end as status from a),
l as (select *, case when status <> 'ok' then 'none' when n_exact > 0 then case when median >= threshold then 'active' else 'inactive' end
       when lo >= threshold then 'active' when hi < threshold or (hi = threshold and not hi_inclusive) then 'inactive' else 'ambiguous' end as label,
  case when status = 'no_usable_evidence' then 'none' when status = 'empty_intersection' then 'censored' when n_exact > 0 and n_censored > 0 then 'both' when n_exact > 0 then 'exact' else 'censored' end as evidence from t),
ev3 as (select *, case when status <> 'ok' then status when discordant then 'discordant' when label = 'ambiguous' then 'ambiguous_label' end as reason,
  case when n_exact = 0 then null when status <> 'ok' then status when discordant then 'discordant' end as regression_reason from l),
ev as (select * from ev3 where threshold = 6.0)"""


ROLES = f"{OBS}, {roles_sql('obs')}"
EVIDENCE = f"{OBS}, {evidence_sql('obs', 'item', 'grp')}"


def r6(*names: str) -> list[F.Column]:
    return [F.round(n, 6).alias(n) for n in names]


def r6_sql(*names: str) -> str:
    return ", ".join(f"round({n}, 6) as {n}" for n in names)


def evidence_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.pair_evidence(observations(spark, sf_dir))


@query("PRJ01", f"with {PARSED} select okey, line, item, relation, sign as relation_raw, case when relation in ('<', '>') then false when relation in ('<=', '>=') then true end as bound_inclusive, body as value_text, number as value_numeric from parsed")
def prj01(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = observation_texts(spark, sf_dir).select("okey", "line", "item", F.col("value_text").alias("field"))
    return fn.with_parsed(fields, "field").drop("field")


WIDE = """wide as (select okey, line, item, grp, max(case when mtype = 'KI' then value_text end) as ki, max(case when mtype = 'IC50' then value_text end) as ic50,
  max(case when mtype = 'KD' then value_text end) as kd, max(case when mtype = 'EC50' then value_text end) as ec50 from obs_text group by okey, line, item, grp)"""


@query(
    "PRJ02",
    f"""with {OBS_TEXT}, {WIDE} select okey, line, item, grp, mtype, value_text from (
  select okey, line, item, grp, 'KI' as mtype, ki as value_text from wide union all select okey, line, item, grp, 'IC50', ic50 from wide
  union all select okey, line, item, grp, 'KD', kd from wide union all select okey, line, item, grp, 'EC50', ec50 from wide) where trim(value_text) <> ''""",
)
def prj02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.unpivot_values(curation.wide_records(observation_texts(spark, sf_dir)))


@query(
    "PRJ03",
    f"""with {OBS}, ends as (select *, case when rel like '<%' then '-infinity'::double when rel in ('=', '>', '>=') then v end as bottom, case when rel like '>%' then 'infinity'::double when rel in ('=', '<', '<=') then v end as top from obs)
  select item, grp, okey, line, rel, case when v is not null and top <= 1000 then 'active' when v is not null and (bottom > 1000 or bottom = 1000 and rel = '>') then 'inactive' else 'ambiguous' end as reading from ends""",
)
def prj03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select("item", "grp", "okey", "line", "rel", fn.decided_at(F.col("rel"), F.col("v")).alias("reading"))


@query("PRJ04", f"with {OBS} select mtype, v > 0 as usable, count(*) as n from obs group by all")
def prj04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy("mtype", fn.usable(F.col("v")).alias("usable")).agg(F.count("*").alias("n"))


@query("PRJ05", f"with {ROLES} select item, grp, okey, line, round(p, 6) as p from r")
def prj05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select("item", "grp", "okey", "line", F.round(fn.pki(F.col("v")), 6).alias("p"))


@query(
    "PRJ06",
    f"""with {ROLES} select item, grp, okey, line, case when rel in ('=', '<', '<=') then round(p, 6) end as lo, rel in ('=', '<=') as lo_inclusive,
  case when rel in ('=', '>', '>=') then round(p, 6) end as hi, rel in ('=', '>=') as hi_inclusive from r where v > 0 and rel <> '~'""",
)
def prj06(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = observations(spark, sf_dir).select("item", "grp", "okey", "line", fn.constraint(F.col("rel"), F.col("v")).alias("c")).where("c is not null")
    return found.select("item", "grp", "okey", "line", F.round("c.lo", 6).alias("lo"), "c.lo_inclusive", F.round("c.hi", 6).alias("hi"), "c.hi_inclusive")


RULES = """ruled as (select *, case when item % 23 = 0 then 'missing_structure' when item % 29 = 0 then 'invalid_structure' when assay % 31 = 0 then 'missing_target_sequence'
  when trim(value_text) = '' then 'no_measurement_value' end as rule from obs_text)"""


@query("PRJ07", f"with {OBS_TEXT}, {RULES} select item, grp, okey, line, rule, rule is null as kept from ruled")
def prj07(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = curation.first_failing_rule(observation_texts(spark, sf_dir), curation.demo_rules())
    return ruled.select("item", "grp", "okey", "line", "rule", F.col("rule").isNull().alias("kept"))


CHAINS = "chained as (select *, case when okey % 7 = 0 then null when okey % 7 = 1 then 'x' else (1 + greatest(0, okey % 7 - 4))::varchar end as chains_text from obs)"


@query(
    "PRJ08",
    f"""with {OBS}, {CHAINS} select item, grp, okey, line, coalesce(try_cast(chains_text as int) = 1, false) as in_scope,
  case when try_cast(chains_text as int) is null then 'unknown_chain_count' when try_cast(chains_text as int) <> 1 then 'multi_chain:' || chains_text end as scope_reason from chained""",
)
def prj08(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, why = fn.scope(fn.chain_count(F.col("chains_text")))
    return curation.with_chain_text(observations(spark, sf_dir)).select("item", "grp", "okey", "line", ok.alias("in_scope"), why.alias("scope_reason"))


@query("PRJ09", f"with {EVIDENCE} select item, grp, status, label, discordant, reason from ev")
def prj09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence_of(spark, sf_dir).select("item", "grp", "status", "label", "discordant", "reason")


@query(
    "PRJ10",
    f"""with {EVIDENCE}, k as (select 'all' as population, * from ev union all select 'eval_eligible', * from ev where reason is null union all select 'no_discordant', * from ev where not discordant)
  select population, count(*) as n, count(*) filter (where label = 'active') as n_active from k group by population""",
)
def prj10(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = evidence_of(spark, sf_dir).withColumn("population", F.explode(curation.populations()))
    return tagged.groupBy("population").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "active").alias("n_active"))


REFS = """refs as (select item, okey, line, case when okey % 3 = 0 then okey::varchar when okey % 3 = 1 and okey % 4 = 0 then '0' end as pmid, case when okey % 5 <> 0 then '10.1/ab ' || okey end as doi, case when okey % 2 = 0 then 'US' || okey end as patent from obs)"""


@query(
    "PRJ11",
    f"""with {OBS}, {REFS} select item, okey, line, case when coalesce(pmid, '') not in ('', '0') then 'pmid:' || upper(pmid) when coalesce(doi, '') <> '' then 'doi:' || upper(doi)
  when coalesce(patent, '') <> '' then 'patent:' || upper(patent) else 'unattributed' end as publication_ref from refs""",
)
def prj11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.with_references(observations(spark, sf_dir)).select("item", "okey", "line", fn.publication_ref(F.col("pmid"), F.col("doi"), F.col("patent")).alias("publication_ref"))


@query("AGG01", f"with {EVIDENCE} select item, grp, n_exact, n_censored, n_unusable, n_no_constraint, n_assays, n_pubs from ev")
def agg01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence_of(spark, sf_dir).select("item", "grp", "n_exact", "n_censored", "n_unusable", "n_no_constraint", "n_assays", "n_pubs")


@query("AGG02", f"with {EVIDENCE} select item, grp, n_exact, {r6_sql('median', 'least', 'most', 'mad', 'spread')}, discordant, n_assays, n_pubs, regression_reason as reason from ev where n_exact > 0")
def agg02(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence.regression_rows(evidence_of(spark, sf_dir))
    return rows.select("item", "grp", "n_exact", *r6("median", "least", "most", "mad", "spread"), "discordant", "n_assays", "n_pubs", "reason")


@query("AGG03", f"with {EVIDENCE} select item, grp, n_censored, {r6_sql('lo', 'hi')}, lo_inclusive, hi_inclusive from ev where n_censored > 0")
def agg03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.intervals(observations(spark, sf_dir)).select("item", "grp", "n_censored", *r6("lo", "hi"), "lo_inclusive", "hi_inclusive")


@query("AGG04", f"with {EVIDENCE} select item, grp, n_exact, n_outside from ev where n_exact > 0 and n_censored > 0")
def agg04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence_of(spark, sf_dir).where("n_exact > 0 and n_censored > 0").select("item", "grp", "n_exact", "n_outside")


@query("AGG05", f"with {EVIDENCE} select item, grp, label, status, evidence from ev")
def agg05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence_of(spark, sf_dir).select("item", "grp", "label", "status", "evidence")


@query("AGG06", f"with {ROLES} select item, grp, okey, line, role from r where role in ('exact', 'censored')")
def agg06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.support(observations(spark, sf_dir))


@query("AGG07", f"with {EVIDENCE} select threshold, label, status, evidence, coalesce(reason, '') as reason, count(*) as n from ev3 group by all")
def agg07(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence.endpoint(observations(spark, sf_dir))
    return found.groupBy("threshold", "label", "status", "evidence", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


@query("AGG08", f"with {OBS} select item, count(distinct src) as n_values, case when count(distinct src) = 1 then min(src) end as value from obs group by item")
def agg08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.unanimous(observations(spark, sf_dir), "item", "src")


@query("AGG09", f"with {OBS} select grp, src, count(*) as n_rows from obs group by all")
def agg09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy("grp", "src").agg(F.count("*").alias("n_rows"))


@query("AGG10", f"with {OBS} select distinct assay, pub, src, grp from obs")
def agg10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.dimension(observations(spark, sf_dir), "assay", "pub", "src", "grp")


@query(
    "AGG47",
    f"""with {EVIDENCE}, tr as (select * from ev where n_exact > 0 and (item + grp) % 3 <> 0 and grp % 5 <> 0), te as (select * from ev where n_exact > 0 and (item + grp) % 3 = 0)
  select te.item, te.grp, round(coalesce(m.own, (select avg(median) from tr)), 6) as predicted from te left join (select grp, avg(median) as own from tr group by grp) m on te.grp = m.grp""",
)
def agg47(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence_of(spark, sf_dir).where("n_exact > 0").select("item", "grp", "median")
    found = evidence.means_with_fallback(rows.where("(item + grp) % 3 <> 0 and grp % 5 <> 0"), rows.where("(item + grp) % 3 = 0"), "grp", "median")
    return found.select("item", "grp", *r6("predicted"))


@query("AGG48", f"with {EVIDENCE} select item, count(*) filter (where label = 'active') as n_active, count(*) filter (where label = 'inactive') as n_inactive from ev group by item having count(*) filter (where label = 'active') > 0 and count(*) filter (where label = 'inactive') > 0")
def agg48(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.reversal_candidates(evidence_of(spark, sf_dir))


# joins of curation


@query("JON01", f"with {OBS} select o.okey, o.line, s.s_suppkey as assay_id, s.s_name as assay_name from obs o join supplier s on split_part(o.okey || '_' || o.assay, '_', 2)::bigint = s.s_suppkey")
def jon01(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = observations(spark, sf_dir).select("okey", "line", F.concat_ws("_", "okey", "assay").alias("composite"))
    named = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("assay_id"), F.col("s_name").alias("assay_name"))
    return curation.composite_join(keyed, named, "composite", "assay_id", 2).select("okey", "line", "assay_id", "assay_name")


@query(
    "JON02",
    f"with {OBS} select o.okey, o.line, case when s.s_suppkey is null then 'no_rsid_match' else 'matched' end as join_status from obs o left join (select * from supplier where s_acctbal > 0) s on o.assay = s.s_suppkey",
)
def jon02(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("assay"))
    return curation.lookup_with_status(observations(spark, sf_dir), some, "assay").select("okey", "line", "join_status")


@query("JON03", f"with {OBS} select item, item % 2 = 0 as already_known, sha256(item::varchar) as content_id from (select distinct item from obs)")
def jon03(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = observations(spark, sf_dir).select("item").distinct()
    known = keys.where("item % 2 = 0").withColumn("content_id", F.sha2(F.col("item").cast("string"), 256))
    return curation.resolve_new(keys, known, "item", lambda c: F.sha2(c.cast("string"), 256))


@query(
    "JON04",
    f"""with {OBS} select o.okey, o.line, p.p_brand as brand, n.n_name as nation, s.s_name as assay_name, c.c_mktsegment as segment from obs o join part p on o.item = p.p_partkey join nation n on o.grp = n.n_nationkey
  join supplier s on o.assay = s.s_suppkey left join (select * from orders join customer on o_custkey = c_custkey where c_acctbal > 0) c on o.okey = c.o_orderkey""",
)
def jon04(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("brand"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("grp"), F.col("n_name").alias("nation"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("assay"), F.col("s_name").alias("assay_name"))
    buyer = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"))
    buyer = buyer.select(F.col("o_orderkey").alias("okey"), F.col("c_mktsegment").alias("segment"))
    joined = curation.star(observations(spark, sf_dir), inner=[(part, "item"), (nation, "grp"), (supplier, "assay")], left=[(buyer, "okey")])
    return joined.select("okey", "line", "brand", "nation", "assay_name", "segment")


@query(
    "JON05",
    f"""with {EVIDENCE} select p.item, p.grp, p.part, round(e.median, 6) as y, l.label from (select distinct item, grp, case when (item + grp) % 4 = 0 then 'test' else 'train' end as part from obs) p
  left join (select * from ev where n_exact > 0 and regression_reason is null) e on p.item = e.item and p.grp = e.grp left join (select * from ev where status = 'ok') l on p.item = l.item and p.grp = l.grp""",
)
def jon05(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    assigned = obs.select("item", "grp").distinct().withColumn("part", F.when((F.col("item") + F.col("grp")) % 4 == 0, "test").otherwise("train"))
    return curation.assemble_cohort(assigned, evidence_of(spark, sf_dir)).select("item", "grp", "part", *r6("y"), "label")


@query("JON06", f"with {EVIDENCE} select o.okey, o.line, o.item, o.grp from obs o where (o.item, o.grp) in (select (item, grp) from ev where label = 'active')")
def jon06(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = evidence_of(spark, sf_dir).where("label = 'active'").select("item", "grp")
    return observations(spark, sf_dir).select("okey", "line", "item", "grp").join(active, ["item", "grp"], "left_semi")


@query("JON07", f"with {EVIDENCE} select o.okey, o.line, o.item, o.grp from obs o where not exists (select 1 from ev where ev.item = o.item and ev.grp = o.grp and ev.reason is null)")
def jon07(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = evidence_of(spark, sf_dir).where("reason is null").select("item", "grp")
    return observations(spark, sf_dir).select("okey", "line", "item", "grp").join(good, ["item", "grp"], "left_anti")


@query("JON21", f"""with {OBS} select o.item, o.grp, count(*) as n, sum(case when o.rel = '=' then 1 else 0 end)::bigint as n_exact from obs o join (select p_partkey from part where p_size = 7) l on o.item = l.p_partkey where o.grp = 3 group by all""")
def jon21(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "part").where("p_size = 7").select(F.col("p_partkey").alias("item"))
    prior = observations(spark, sf_dir).where("grp = 3").join(listed, "item")
    return prior.groupBy("item", "grp").agg(F.count("*").alias("n"), F.count_if(F.col("rel") == "=").alias("n_exact"))


@query(
    "PRJ22",
    f"""with {OBS}, g as (select item, grp, count(*) filter (where rel = '=' and v > 0) as n_exact, min(v) filter (where rel = '=' and v > 0) as lo, max(v) filter (where rel = '=' and v > 0) as hi,
  list_sort(list(rel || floor(v)::bigint || ' nM') filter (where rel <> '=' and v > 0)) as bounds from obs group by all)
  select item, grp, array_to_string(list_concat(case when n_exact > 0 then [n_exact || ' exact ' || case when floor(lo) = floor(hi) then floor(lo)::bigint::varchar else floor(lo)::bigint || '-' || floor(hi)::bigint end || ' nM'] else [] end, coalesce(bounds, [])), '; ') as evidence_text from g""",
)
def prj22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.evidence_text(observations(spark, sf_dir))
