"""Queries on splits and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, evidence, splits
from ..operators.clustering import cluster_sequences
from ..operators.snapshots import set_digest
from ..similarity.common import write_once
from ..sources.tables import OBS, observations, table
from .evidence_plans import EVIDENCE, evidence_of, evidence_sql, r6
from .registry import query
from .snapshot_plans import digest_sql

VALIDATION, TEST = "2000-06-01", "2001-01-01"
PAIR_HASH = "sha256(item || '|' || grp || '|s6')"
U = "('0x' || substr({h}, 1, 13))::bigint / 4503599627370496.0"

RANDOM = EVIDENCE + """, rk as (select item, grp, row_number() over (order by sha256(item || '|' || grp || '|s1')) as r, count(*) over () as n from ev where reason is null),
rp as (select item, grp, case when r <= floor(n * 0.7::double) then 'train' when r <= floor(n * 0.7::double) + floor(n * 0.1::double) then 'validation' else 'test' end as part from rk
  union all select item, grp, 'excluded' from ev where reason is not null)"""


def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.random_pairs(evidence_of(spark, sf_dir), "s1")


@query("SPL01", f"with {RANDOM} select * from rp")
def spl01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return random_split(spark, sf_dir)


@query("SPL02")
def spl02(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = observations(spark, sf_dir).select("item", "grp").distinct()
    return splits.greedy_groups(pairs, "grp", "s2").groupBy("grp", "part").agg(F.count("*").alias("n"))


CLUSTERS = "cl as (select p_partkey as item, p_brand || '/' || p_type as cluster from part where p_size <> 13)"


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size <> 13").select(F.col("p_partkey").alias("item"), F.concat_ws("/", "p_brand", "p_type").alias("cluster"))


COLD = OBS + ", " + CLUSTERS + f""", cu as (select *, {U.format(h="sha256(cluster || '|s3')")} as u from cl),
cold as (select p.item, p.grp, coalesce(case when u < 0.7 then 'train' when u < 0.8 then 'validation' when u is not null then 'test' end, 'excluded') as part from (select distinct item, grp from obs) p left join cu on p.item = cu.item)"""


def cold_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = observations(spark, sf_dir).select("item", "grp").distinct()
    return splits.cold_groups(pairs, clusters(spark, sf_dir), "item", "s3")


@query("SPL03", f"with {COLD} select * from cold")
def spl03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cold_split(spark, sf_dir).select("item", "grp", "part")


@query(
    "SPL04",
    f"""with {EVIDENCE}, cand as (select item from ev where reason is null group by item having count(*) filter (where label = 'active') > 0 and count(*) filter (where label = 'inactive') > 0),
  rk as (select item, row_number() over (order by sha256(item || '|s4')) as r, count(*) over () as n from cand), sd as (select item, case when r <= floor(least(1000, n) / 2) then 'inactive' when r <= least(1000, n) then 'active' end as tested from rk)
  select ev.item, ev.grp, case when reason is not null then 'excluded' when tested = label then 'test' else 'train' end as part from ev left join sd on ev.item = sd.item""",
)
def spl04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.label_reversal(evidence_of(spark, sf_dir), "s4")


DATED = OBS + f""", dt0 as (select *, case when okey % 6 = 0 then null when okey % 11 = 0 then 'n/a' else strftime(dt, '%-m/%-d/%Y') end as d1, case when okey % 12 = 0 then null else strftime(dt + interval 30 day, '%-m/%-d/%Y') end as d2 from obs),
dt1 as (select *, case when regexp_matches(d1, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$') then strptime(d1, '%m/%d/%Y')::date when regexp_matches(d2, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$') then strptime(d2, '%m/%d/%Y')::date end as day,
  case when regexp_matches(d1, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$') then 'publication_date' when d2 is not null then 'entry_date' end as date_source from dt0),
dated as (select *, case when day >= date '{TEST}' then 'test' when day >= date '{VALIDATION}' then 'validation' else 'train' end as part from dt1 where day is not null)"""


@query("SCA06", f"with {DATED} select okey, line, item, strftime(day, '%Y-%m-%d') as day, date_source, part from dated")
def sca06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.temporal_parts(observations(spark, sf_dir), VALIDATION, TEST).select("okey", "line", "item", F.date_format("day", "yyyy-MM-dd").alias("day"), "date_source", "part")


TEMPORAL = DATED + ", " + evidence_sql("dated", "item", "grp", "part")


@query(
    "SPL05",
    f"""with {TEMPORAL}, hs as (select item, grp, list_sort(list(distinct part)) as parts from dated group by all)
  select ev.item, ev.grp, ev.part as period, case when reason is not null and ev.part <> 'train' then 'excluded' else ev.part end as part, case when list_contains(parts, 'train') and ev.part <> 'train' then 'recurrent' else 'new_pair' end as stratum,
  nullif(array_to_string(list_filter(parts, lambda p: (ev.part = 'validation' and p = 'train') or (ev.part = 'test' and p in ('train', 'validation'))), ','), '') as history, label, status from ev join hs on ev.item = hs.item and ev.grp = hs.grp""",
)
def spl05(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = splits.temporal_parts(observations(spark, sf_dir), VALIDATION, TEST).repartition("item", "grp")
    return splits.temporal_split(evidence.pair_evidence(dated, keys=("item", "grp", "part")))


@query("SPL06", f"with {OBS} select item, grp, {U.format(h=PAIR_HASH)} < 0.2 as held from (select distinct item, grp from obs)")
def spl06(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = observations(spark, sf_dir).select("item", "grp").distinct()
    return pairs.withColumn("held", splits.fraction(splits.keyed_hash("s6", "item", "grp")) < 0.2)


MEMBERS = EVIDENCE + f""", mem as (select item, grp, label, status, case when {U.format(h=PAIR_HASH)} < 0.2 then 'validation' else 'train' end as role,
  reason is null and label in ('active', 'inactive') as classification_eligible, n_exact > 0 and regression_reason is null as regression_eligible from ev)"""


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = splits.fraction(splits.keyed_hash("s6", "item", "grp")) < 0.2
    decided = F.col("label").isin("active", "inactive")
    return evidence_of(spark, sf_dir).select(
        "item", "grp", "label", "status", F.when(held, "validation").otherwise("train").alias("role"),
        (F.col("reason").isNull() & decided).alias("classification_eligible"), ((F.col("n_exact") > 0) & F.col("regression_reason").isNull()).alias("regression_eligible"),
    )


@query("SPL07", f"with {MEMBERS} select * from mem")
def spl07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return membership(spark, sf_dir)


@query("PRJ14", f"with {MEMBERS} select item, grp, classification_eligible, regression_eligible, regression_eligible and role = 'validation' as validation_rmse_eligible from mem")
def prj14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return membership(spark, sf_dir).select("item", "grp", "classification_eligible", "regression_eligible", (F.col("regression_eligible") & (F.col("role") == "validation")).alias("validation_rmse_eligible"))


@query(
    "PRJ15",
    f"""with {MEMBERS}, q as (select distinct item, grp from obs where okey % 3 = 0), tm as (select item, grp from mem where role = 'train' and classification_eligible)
  select q.item, q.grp, case when tm.item is not null then 'recurrent' when q.item in (select item from tm) and q.grp in (select grp from tm) then 'new_pair' when q.item in (select item from tm) then 'new_group' else 'new_item' end as stratum
  from q left join tm on q.item = tm.item and q.grp = tm.grp""",
)
def prj15(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = membership(spark, sf_dir).where("role = 'train' and classification_eligible").select("item", "grp")
    asked = observations(spark, sf_dir).where("okey % 3 = 0").select("item", "grp").distinct()
    tagged = asked.join(train.withColumn("pair", F.lit(1)), ["item", "grp"], "left").join(train.select("item").distinct().withColumn("i", F.lit(1)), "item", "left").join(train.select("grp").distinct().withColumn("g", F.lit(1)), "grp", "left")
    stratum = F.when(F.col("pair") == 1, "recurrent").when((F.col("i") == 1) & (F.col("g") == 1), "new_pair").when(F.col("i") == 1, "new_group").otherwise("new_item")
    return tagged.select("item", "grp", stratum.alias("stratum"))


@query(
    "PRJ21",
    f"""with {MEMBERS}, rr as (select m.*, case when not classification_eligible then 'not_eligible' when f.p_partkey is null then 'missing_feature' else 'kept' end as reason
  from mem m left join (select p_partkey from part where p_size <= 40) f on m.item = f.p_partkey where role = 'train') select reason, count(*) as n from rr group by reason""",
)
def prj21(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = table(spark, sf_dir, "part").where("p_size <= 40").select(F.col("p_partkey").alias("item"), F.lit(True).alias("hit"))
    rows = membership(spark, sf_dir).where("role = 'train'").join(features, "item", "left")
    reason = F.when(~F.col("classification_eligible"), "not_eligible").when(F.col("hit").isNull(), "missing_feature").otherwise("kept")
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("SPL08", f"with {RANDOM} select o.okey, o.line, o.item, o.grp from obs o where (o.item, o.grp) in (select (item, grp) from rp where part = 'train') and (o.item, o.grp) not in (select (item, grp) from ev where status <> 'ok')")
def spl08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.visible(observations(spark, sf_dir), random_split(spark, sf_dir), evidence_of(spark, sf_dir)).select("okey", "line", "item", "grp")


STRUCTURES = f"""st as (select p_partkey as item, coalesce(nullif(case when p_size % 5 = 0 then '' else p_brand end, ''), '__own__' || p_partkey) as cluster from part), su as (select *, {U.format(h="sha256(cluster || '|s9')")} as u from st),
dj as (select p.item, p.grp, case when p.reason is not null then 'excluded' when u < 0.7 then 'train' when u < 0.8 then 'validation' else 'test' end as part from ev p join su on p.item = su.item)"""
REVERSAL = """cand as (select item from ev where reason is null group by item having count(*) filter (where label = 'active') > 0 and count(*) filter (where label = 'inactive') > 0),
rk2 as (select item, row_number() over (order by sha256(item || '|s4')) as r, count(*) over () as n from cand), sd as (select item, case when r <= floor(least(1000, n) / 2) then 'inactive' when r <= least(1000, n) then 'active' end as tested from rk2),
lr as (select ev.item, ev.grp, case when reason is not null then 'excluded' when tested = label then 'test' else 'train' end as part from ev left join sd on ev.item = sd.item)"""
PERIODS = """hs as (select item, grp, list_sort(list(distinct part)) as parts from dated group by all), tp as (select ev.item, ev.grp, ev.part as period, case when reason is not null and ev.part <> 'train' then 'excluded' else ev.part end as part,
  case when list_contains(parts, 'train') and ev.part <> 'train' then 'recurrent' else 'new_pair' end as stratum from ev join hs on ev.item = hs.item and ev.grp = hs.grp)"""


def _checks_sql(split: str, tables: str, **counts: str) -> str:
    return f"(with {tables} " + " union all ".join(f"select '{split}' as split, '{name}' as check_name, ({sql})::bigint as observed, 0::bigint as expected" for name, sql in counts.items()) + ")"


def _common_sql(t: str) -> dict[str, str]:
    return {
        "known_part": f"select count(*) from {t} where part not in ('train', 'validation', 'test', 'excluded')",
        "pair_in_one_part": f"select count(*) from (select item, grp from {t} group by all having count(*) > 1)",
        "excluded_pair_held_out": f"select count(*) from {t} join ev using (item, grp) where {t}.part in ('validation', 'test') and ev.reason is not null",
    }


def _cluster_sql(t: str, c: str, name: str) -> dict[str, str]:
    scored = f"(select distinct x.item, x.part, y.cluster from {t} x left join {c} y on x.item = y.item where x.part in ('train', 'validation', 'test'))"
    return {f"{name}_in_one_part": f"select count(*) from (select cluster from {scored} where cluster is not null group by cluster having count(distinct part) > 1)", f"{name}_of_every_entity": f"select count(distinct item) from {scored} where cluster is null"}


SPLIT_CHECKS = " union all ".join([
    _checks_sql("random", RANDOM, **_common_sql("rp")),
    _checks_sql("cold_groups", EVIDENCE + ", " + COLD[len(OBS) + 2 :], **_common_sql("cold"), **_cluster_sql("cold", "cl", "cluster")),
    _checks_sql("disjoint", f"{EVIDENCE}, {STRUCTURES}", **_common_sql("dj"), **_cluster_sql("dj", "st", "structure")),
    _checks_sql("reversal", f"{EVIDENCE}, {REVERSAL}", **_common_sql("lr"), diagnostic_has_no_tuning="select count(*) from lr where part = 'validation'", reversed_entity_has_both_labels="select count(*) from (select lr.item from lr join ev using (item, grp) where lr.part in ('train', 'validation', 'test') group by lr.item having count(distinct lr.part) > 1 and count(distinct label) = 1)"),
    _checks_sql(
        "temporal", f"{TEMPORAL}, {PERIODS}", known_part=_common_sql("tp")["known_part"],
        observation_in_one_part="select count(*) from (select okey, line from dated group by all having count(distinct part) > 1)", part_has_evidence="select 3 - count(distinct part) from ev where part in ('train', 'validation', 'test')",
        label_support_of_own_part="select count(*) from r join dated d on r.okey = d.okey and r.line = d.line where role in ('exact', 'censored') and r.part <> d.part", value_support_of_own_part="select count(*) from r join dated d on r.okey = d.okey and r.line = d.line where role = 'exact' and r.part <> d.part",
        pair_has_evidence_of_own_part="select count(*) from tp where part in ('train', 'validation', 'test') and (item, grp, part) not in (select (item, grp, part) from ev)", stratum_named="select count(*) from tp where stratum is null",
        excluded_by_own_part_held_out="select count(*) from tp join ev using (item, grp, part) where tp.part in ('validation', 'test') and ev.reason is not null",
        later_exclusion_keeps_training="select count(*) from ev where part = 'train' and reason is null and (item, grp) in (select (item, grp) from tp where part = 'excluded') and (item, grp) not in (select (item, grp) from tp where part = 'train')",
    ),
])


def split_builds(spark: SparkSession, sf_dir: str) -> list[checks.SplitBuild]:
    """Five splits of the observations, one of each kind, with what each was built from."""
    obs = observations(spark, sf_dir)
    found = write_once(evidence_of(spark, sf_dir).select("item", "grp", "label", "reason"), "split-pairs")  # four of the splits stand on it
    structures = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.coalesce(F.nullif(F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_brand")), F.lit("")), F.concat(F.lit("__own__"), F.col("p_partkey").cast("string"))).alias("cluster"))
    structures, grouped = structures.hint("merge"), clusters(spark, sf_dir).hint("merge")
    disjoint = splits.cold_groups(found, structures, "item", "s9").withColumn("part", F.when(F.col("reason").isNotNull(), "excluded").otherwise(F.col("part")))
    fields = ["item", "grp", "assay", "pub", "rel", "v", "okey", "line", "part"]
    dated = write_once(splits.temporal_parts(obs, VALIDATION, TEST).select(*fields), "split-dated")
    by_part = write_once(evidence.pair_evidence(dated.repartition("item", "grp"), keys=("item", "grp", "part")).select("item", "grp", "part", "label", "status", "reason"), "split-periods")
    return [
        checks.SplitBuild("random", splits.random_pairs(found, "s1"), found),
        checks.SplitBuild("cold_groups", splits.cold_groups(found.select("item", "grp"), grouped, "item", "s3"), found, grouped),
        checks.SplitBuild("disjoint", disjoint, found, structures),
        checks.SplitBuild("reversal", splits.label_reversal(found, "s4"), found, protocol="diagnostic"),
        checks.SplitBuild("temporal", splits.temporal_split(by_part), by_part, placed=dated, support=evidence.with_roles(dated).select("item", "grp", "part", "okey", "line", "role")),
    ]


@query("SPL09", SPLIT_CHECKS)
def spl09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules for all five kinds of split. The cold split takes no notice of exclusions, and its count says so."""
    out = None
    for build in split_builds(spark, sf_dir):
        found = checks.split_checks(build)
        out = found if out is None else out.unionByName(found)
    return out


@query(
    "SPL10",
    f"""with {RANDOM}, ix as (select item, grp from rp where part = 'train' or item % 50 = 0) select 'index' as guard, count(*) as observed from ix where (item, grp) not in (select (item, grp) from rp where part = 'train')
  union all select 'fitting', count(*) from obs where (item, grp) in (select (item, grp) from rp where part = 'train') union all select 'selection', count(*) from obs where (item, grp) in (select (item, grp) from rp where part = 'validation')
  union all select 'reserved', count(*) from (select distinct item, grp from ix where (item, grp) in (select (item, grp) from rp where part = 'test'))""",
)
def spl10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each guard sees: index rows that training may not see, rows given for fitting and for selection, reserved pairs among those for fitting."""
    assigned, obs = random_split(spark, sf_dir), observations(spark, sf_dir)
    train, reserved = (assigned.where(F.col("part") == p).select("item", "grp") for p in ("train", "test"))
    index = assigned.where("part = 'train' or item % 50 = 0").select("item", "grp")
    named = lambda name, df: df.select(F.lit(name).alias("guard"), "observed")
    counted = lambda name, df: df.agg(F.lit(name).alias("guard"), F.count("*").alias("observed"))
    given = [counted(name, checks.select_for_fitting(obs, assigned, purpose)) for name, purpose in (("fitting", "fit"), ("selection", "select"))]
    hit = counted("reserved", index.distinct().join(reserved, ["item", "grp"], "left_semi"))
    return named("index", checks.not_visible(index, train, ["item", "grp"])).unionByName(given[0]).unionByName(given[1]).unionByName(hit)


@query(
    "SPL11",
    f"""with {RANDOM}, su as (select item, grp from r where role = 'exact' and ((item, grp) in (select (item, grp) from rp where part = 'train') or item % 50 = 0)), lk as (select part, count(*) as n from rp join su using (item, grp) where part in ('validation', 'test') group by part)
  select p.part, count(distinct p.item) as n_items, count(distinct p.item) filter (where p.item in (select item from rp where part = 'train')) as n_exposed, coalesce(any_value(lk.n), 0) as n_support_leaks from rp p left join lk on lk.part = p.part where p.part in ('validation', 'test') group by p.part""",
)
def spl11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out entities that training shows, and feature support from held-out pairs: some was put in, and is found."""
    assigned = random_split(spark, sf_dir)
    exact = evidence.with_roles(observations(spark, sf_dir)).where("role = 'exact'").select("item", "grp")
    train = assigned.where("part = 'train'").select("item", "grp").withColumn("__t", F.lit(True))
    support = exact.join(train, ["item", "grp"], "left").where("__t or item % 50 = 0").select("item", "grp")
    return checks.exposure(assigned, support)


@query(
    "SPL12",
    f"""with {COLD}, need as (select distinct part, item from cold), hit as (select need.*, f.p_partkey is not null as ok, row_number() over (partition by part, f.p_partkey is null order by item) as r from need left join (select p_partkey from part where p_size > 3) f on item = p_partkey)
  select part, count(*) as scored, count(*) filter (where ok) as covered, count(*) filter (where not ok) as missing, coalesce(string_agg(item::varchar, ',' order by item) filter (where not ok and r <= 3), '') as examples from hit group by part""",
)
def spl12(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = table(spark, sf_dir, "part").where("p_size > 3").select(F.col("p_partkey").alias("item"))
    return splits.coverage(cold_split(spark, sf_dir), features, "item")


@query(
    "SPL13",
    f"""with c as (select vec_id as id, embedding, case when vec_id % 97 = 0 then vec_id + 1 else vec_id end as place from embeddings), e as (select p_partkey as id, p_partkey as place from part)
  select 'duplicates' as check_name, count(*) - count(distinct id) as observed from c union all select 'missing', count(*) from e where id not in (select id from c) union all select 'extra', count(*) from c where id not in (select id from e)
  union all select 'wrong_width', count(*) from c where len(embedding) <> 64 union all select 'not_finite', count(*) from c where len(list_filter(embedding, lambda x: isnan(x) or isinf(x))) > 0
  union all select 'misaligned', count(*) from c join e using (id) where c.place <> e.place union all select 'digest_differs', ((select digest from ({digest_sql("id::varchar", "(select distinct id from c)", nested=True)})) is distinct from (select digest from ({digest_sql("id::varchar", "(select distinct id from e)", nested=True)})))::bigint""",
)
def spl13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of vectors against a manifest of ids and their places, some of them moved."""
    from ..operators.vectors import cache_checks

    place = F.when(F.col("vec_id") % 97 == 0, F.col("vec_id") + 1).otherwise(F.col("vec_id"))
    cache = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), place.alias("place"))
    return cache_checks(cache, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("place")), 64)


FROM_N = "src = 'N'"


def _manifest_sql(name: str, where: str) -> str:
    return f"""select '{name}' as population, digest, n, (select count(*) from (select distinct item from obs where {where}) where item in (select p_partkey from part where p_size > 2)) as n_with_features from ({digest_sql('item::varchar', f'(select distinct item from obs where {where})', nested=True)})"""


@query("SPL14", f"with {OBS}, m as ({_manifest_sql('release:N', FROM_N)} union all {_manifest_sql('all_rows', 'true')}) select *, n = n_with_features as complete from m")
def spl14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of a release and of all rows: members, their digest, and whether each has features."""
    obs = observations(spark, sf_dir)
    features = table(spark, sf_dir, "part").where("p_size > 2").select(F.col("p_partkey").alias("item"))
    out = None
    for name, rows in (("release:N", obs.where("src = 'N'")), ("all_rows", obs)):
        members = rows.select("item").distinct()
        covered = members.join(features, "item", "left_semi").agg(F.count("*").alias("n_with_features"))
        one = set_digest(members, F.col("item").cast("string")).crossJoin(covered).select(F.lit(name).alias("population"), "digest", "n", "n_with_features", (F.col("n") == F.col("n_with_features")).alias("complete"))
        out = one if out is None else out.unionByName(one)
    return out


CLUSTERED = """with recursive w as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as sh from w),
e as (select doc_id, len(sh) as n, unnest(sh) as g from s),
p as (select a.doc_id as x, b.doc_id as y from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
l as (select x, y from p union all select y, x from p), r as (select doc_id as node, doc_id as reach from documents union select l.x, r.reach from l join r on r.node = l.y)
select node as id, min(reach) as cluster from r group by node"""


@query("SPL16", CLUSTERED)
def spl16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_sequences(table(spark, sf_dir, "documents"))


@query("SPL17", "select p_partkey as item, coalesce(nullif(case when p_size % 5 = 0 then '' else p_brand end, ''), '__own__' || p_partkey) as cluster from part")
def spl17(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.coalesce(F.nullif(key, F.lit("")), F.concat(F.lit("__own__"), F.col("p_partkey").cast("string"))).alias("cluster"))


@query("SPL18", f"with {RANDOM} select (select count(*) from (select item from rp where part = 'train' intersect select item from rp where part = 'test')) as items_in_both, (select count(*) from (select item from rp where part = 'test' except select item from rp where part = 'train')) as items_unseen")
def spl18(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = random_split(spark, sf_dir)
    train, test = (assigned.where(F.col("part") == p).select("item").distinct() for p in ("train", "test"))
    return train.intersect(test).agg(F.count("*").alias("items_in_both")).crossJoin(test.subtract(train).agg(F.count("*").alias("items_unseen")))


@query(
    "AGG24",
    f"""with {RANDOM}, vis as (select r.* from r join rp on r.item = rp.item and r.grp = rp.grp where rp.part = 'train' and r.role = 'exact')
  select grp, count(*) as n, round(avg(p), 6) as mean, round(median(p), 6) as median, round(max(p) - min(p), 6) as spread from vis group by grp""",
)
def agg24(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = random_split(spark, sf_dir).where("part = 'train'").select("item", "grp")
    seen = evidence.with_roles(observations(spark, sf_dir)).where("role = 'exact'").join(train, ["item", "grp"], "left_semi")
    found = seen.groupBy("grp").agg(F.count("*").alias("n"), F.avg("p").alias("mean"), F.percentile(F.col("p"), F.lit(0.5)).alias("median"), (F.max("p") - F.min("p")).alias("spread"))
    return found.select("grp", "n", *r6("mean", "median", "spread"))


@query(
    "JON08",
    f"""with {TEMPORAL}, gl as (select item, grp, label from ev where part = 'train'), tl as (select item, grp, label from ev where part = 'test')
  select count(*) as n_both, count(*) filter (where gl.label is distinct from tl.label) as n_flips from gl join tl on gl.item = tl.item and gl.grp = tl.grp""",
)
def jon08(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = spl05(spark, sf_dir)
    a, b = (placed.where(F.col("period") == p).select("item", "grp", F.col("label").alias(f"{p}_label")) for p in ("train", "test"))
    return a.join(b, ["item", "grp"]).agg(F.count("*").alias("n_both"), F.count_if(~F.col("train_label").eqNullSafe(F.col("test_label"))).alias("n_flips"))
