"""Queries on vectors, similarity and shortlists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import blocks
from ..operators import vectors as v
from ..similarity.common import write_once
from ..sources.tables import table
from .evidence_plans import r6, r6_sql
from .registry import query

UNITS = "un as (select vec_id as id, label, embedding, list_transform(embedding::double[], lambda x: x / greatest(sqrt(list_dot_product(embedding::double[], embedding::double[])), 1e-9)) as u from embeddings)"
SCORED = UNITS + ", sc as (select q.id as query_id, d.id, round(list_dot_product(q.u, d.u), 9) as score from un q join un d on q.id <> d.id where q.id % 100 = 0)"


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def scores_of(spark: SparkSession, sf_dir: str, scale: float = 1.0, offset: float = 0.0, best: int | None = None) -> DataFrame:
    whole = library(spark, sf_dir)
    return v.scored(whole.where("id % 100 = 0"), whole, scale, offset, best)


@query("SCA12", f"with {UNITS} select id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as norm, round(list_sum(u), 6) as unit_sum from un")
def sca12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = v.unit(library(spark, sf_dir), "vector")
    return found.select("id", F.round(v.norm(F.col("vector")), 6).alias("norm"), F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 6).alias("unit_sum"))


@query("SCA13", f"with {SCORED} select query_id, id, round(2.5 * score + 6.0, 6) as score from sc")
def sca13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores_of(spark, sf_dir, 2.5, 6.0).select("query_id", "id", F.round("score", 6).alias("score"))


@query("SRT01", f"with {SCORED} select query_id, id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from sc) where rank <= 20")
def srt01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.top(scores_of(spark, sf_dir, best=20), 20).select("query_id", "id", *r6("score"), "rank")


@query(
    "SRT02",
    f"""with {SCORED}, ed as (select query_id, min(score) as lo, max(score) as hi, avg(score) as mean, stddev_pop(score) as sd, quantile_cont(score, 0.25) as q1, quantile_cont(score, 0.5) as median, quantile_cont(score, 0.75) as q3 from sc group by query_id),
  hs as (select query_id, case when hi = lo then 0 else least(47, floor((score - lo) / (hi - lo) * 48)) end::int as bin, count(*) as n from sc join ed using (query_id) group by all)
  select query_id, bin, n, round(lo + bin * (hi - lo) / 48, 6) as low, round(lo + (bin + 1) * (hi - lo) / 48, 6) as high, {r6_sql("q1", "median", "q3", "mean", "sd")} from hs join ed using (query_id)""",
)
def srt02(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = library(spark, sf_dir)
    return v.distribution(whole.where("id % 100 = 0"), whole, 48).select("query_id", "bin", "n", *r6("low", "high", "q1", "median", "q3", "mean", "sd"))


@query("AGG20", f"with {SCORED}, o as (select query_id, score, row_number() over (partition by query_id order by score) - 1 as r, count(*) over (partition by query_id) as n from sc) select query_id, round(max(score) filter (where r = floor(0.1 * (n - 1))), 6) as p10, round(max(score) filter (where r = floor(0.5 * (n - 1))), 6) as median, round(max(score) filter (where r = floor(0.9 * (n - 1))), 6) as p90, round(max(score) filter (where r = floor(0.99 * (n - 1))), 6) as p99, round(avg(score), 6) as mean, round(avg((score >= 0.3)::int), 6) as over_03 from o group by query_id")
def agg20(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = library(spark, sf_dir)
    asked = whole.where("id % 100 = 0")
    found = write_once(blocks.moments(asked, whole, 0.3), "score-moments")
    at = v.score_quantiles(asked, whole, found, {"p10": 0.1, "median": 0.5, "p90": 0.9, "p99": 0.99}, False)
    return found.select("query_id", "mean", "over").join(at, "query_id").select("query_id", *r6("p10", "median", "p90", "p99", "mean"), F.round("over", 6).alias("over_03"))


PROPS = "pr as (select s.query_id, s.id, rank, case when p_size = 13 then null else p_size end as size, p_retailprice as price from (select *, row_number() over (partition by query_id order by score desc, id) as rank from sc) s join part on p_partkey = s.id where rank <= 50)"


def with_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") != 13, F.col("p_size")).alias("size"), F.col("p_retailprice").alias("price"))
    return v.top(scores_of(spark, sf_dir, best=50), 50).join(part, "id")


@query("PRJ17", f"with {SCORED}, {PROPS} select query_id, id, rank, case when size is null then 'size:unknown' when size < 5 then 'size:below' when size > 40 then 'size:above' when price < 905 then 'price:below' when price > 945 then 'price:above' end as removed_because from pr")
def prj17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.property_filter(with_properties(spark, sf_dir), {"size": (5, 40), "price": (905, 945)}).select("query_id", "id", "rank", "removed_because")


@query("SRT03")
def srt03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.diverse(v.top(scores_of(spark, sf_dir, best=50), 50).select("query_id", "id", "rank"), library(spark, sf_dir), 10, 0.35)


BITS = "bt as (select vec_id as id, label, embedding[1] as y, list_transform(embedding, lambda x: case when x > 0 then 1 else 0 end) as s from embeddings)"


@query("SCA10", f"with {BITS} select id, list_sum(s)::int as n_bits from bt")
def sca10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library(spark, sf_dir).select("id", v.popcount(v.sign_words(F.col("vector"))).alias("n_bits"))


TANI = "coalesce(list_sum(list_transform(list_zip(a.s, b.s), lambda z: z[1] * z[2])) / nullif(list_sum(list_transform(list_zip(a.s, b.s), lambda z: greatest(z[1], z[2]))), 0), 0)"


@query("SCA11", f"with {BITS} select a.id as query_id, b.id, round({TANI}, 6) as similarity from bt a join bt b on a.id % 100 = 0 and a.id <> b.id")
def sca11(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = library(spark, sf_dir).select("id", v.sign_words(F.col("vector")).alias("bits"))
    asked = bits.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("bits").alias("q"))
    return v.against_all(asked, bits).where("id <> query_id").select("query_id", "id", F.round(v.tanimoto(F.col("q"), F.col("bits")), 6).alias("similarity"))


NEAR = BITS + """, refs as (select *, row_number() over (partition by label order by md5(id::varchar), id) as r from bt where id % 4 <> 0), pairs as (select a.id, b.id as ref_id, b.y, """ + TANI + """ as sim from bt a join refs b on a.label = b.label and a.id <> b.id where a.id % 4 = 0 and b.r <= 4096),
bst as (select *, row_number() over (partition by id order by sim desc, ref_id) as k from pairs)"""


@query("JON11", f"with {NEAR} select a.id, round(coalesce(b.sim, 0), 6) as sim, round(coalesce(b.y, (select avg(y) from bt where id % 4 <> 0)), 6) as predicted from bt a left join bst b on a.id = b.id and b.k = 1 where a.id % 4 = 0")
def jon11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = library(spark, sf_dir).select("id", "label", v.sign_words(F.col("vector")).alias("bits"), F.element_at("vector", 1).cast("double").alias("y"))
    found = v.nearest_in_group(rows.where("id % 4 <> 0"), rows.where("id % 4 = 0").select("id", "label", "bits"), "label", 4096)
    return found.select("id", *r6("sim", "predicted"))


@query("JON12", f"with {UNITS}, sc as (select q.id as query_id, d.id, round(list_dot_product(q.u, d.u), 9) as score from un q join un d on q.id <> d.id) select query_id, arg_max(id, struct_pack(s := score, t := -id)) as nearest, round(max(score), 6) as score from sc group by query_id")
def jon12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest row by cosine of every row: the first of each pair of blocks, then of all."""
    return blocks.nearest(library(spark, sf_dir)).select("query_id", F.col("id").alias("nearest"), *r6("score"))


@query("JON13", f"with {BITS}, pr as (select a.id, b.id as ref_id, {TANI} as sim from bt a join bt b on a.id % 5 = 0 and b.id % 5 <> 0) select id, arg_max(ref_id, struct_pack(s := sim, t := -ref_id)) as train_id, round(max(sim), 6) as nearest from pr group by id")
def jon13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every held-out row against every training row, neither side sampled, as products of blocks of bits."""
    bits = library(spark, sf_dir).select("id", v.sign_words(F.col("vector")).alias("bits"))
    found = v.nearest_by_overlap(bits.where("id % 5 = 0"), bits.where("id % 5 <> 0"))
    return found.select(F.col("query_id").alias("id"), F.col("id").alias("train_id"), F.round("score", 6).alias("nearest"))


@query("JON10", "with a as (select vec_id as id, list_transform(embedding::double[], lambda x: round(x, 3)) as x from embeddings where vec_id % 2 = 0), b as (select vec_id as id, list_transform(embedding::double[], lambda x: case when vec_id % 3 = 0 then round(x, 2) else round(x, 3) end) as y from embeddings where vec_id % 7 <> 0), p as (select id, len(list_filter(list_zip(x, y), lambda z: z[1] <> z[2])) as n, list_max(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2]))) as most from a join b using (id)) select (select count(*) from a) as n_left, (select count(*) from b) as n_right, count(*) as n_both, count(*) filter (where n > 0) as n_different, sum(n)::bigint as n_components, round(max(most), 6) as most from p")
def jon10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two caches of vectors, one made with less precision for some ids, compared by whole payloads where both have the id."""
    whole = library(spark, sf_dir).select("id", F.col("vector").cast("array<double>").alias("vector"))
    a = whole.where("id % 2 = 0").select("id", F.transform("vector", lambda x: F.round(x, 3)).alias("x"))
    b = whole.where("id % 7 <> 0").select("id", F.transform("vector", lambda x: F.when(F.col("id") % 3 == 0, F.round(x, 2)).otherwise(F.round(x, 3))).alias("y"))
    return v.compare_payloads(a, b)


@query("JON09", "with e as (select vec_id as id, label, row_number() over (partition by label order by md5(vec_id || '-7'), vec_id) as place from embeddings), p as (select least(a.id, b.id) as a, greatest(a.id, b.id) as b, a.label from e a join e b on a.label = b.label and b.place - a.place between 1 and 8) select a, b, label from p order by md5(a || '-' || b || '-7'), a, b limit 500")
def jon09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one label by hash: each member with the next eight in hash order, so a label makes eight pairs a member and not its square."""
    order = Window.partitionBy("label").orderBy(F.md5(F.concat_ws("-", "id", F.lit("7"))), "id")
    rows = library(spark, sf_dir).select("id", "label")
    near = rows.withColumn("next", F.array(*[F.lead("id", k).over(order) for k in range(1, 9)])).select("id", "label", F.explode(F.array_compact("next")).alias("other"))
    pairs = near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "label")
    return pairs.orderBy(F.md5(F.concat_ws("-", "a", "b", F.lit("7"))), "a", "b").limit(500)


@query("AGG44", "with g as (select embedding, count(*) as n from embeddings group by embedding) select count(*) as n_distinct, coalesce(sum(n) filter (where n > 1), 0)::bigint as n_sharing from g")
def agg44(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = library(spark, sf_dir).groupBy(F.sha2(F.array_join(F.col("vector").cast("array<string>"), ","), 256)).agg(F.count("*").alias("n"))
    return groups.agg(F.count("*").alias("n_distinct"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_sharing"))


@query("PRJ20", "select vec_id as id, case when embedding is null then 'null' when len(embedding) <> 64 then 'wrong_width' when len(list_filter(embedding, lambda x: isnan(x) or isinf(x))) > 0 then 'not_finite' else 'ok' end as verdict from embeddings")
def prj20(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.exists("vector", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    verdict = F.when(F.col("vector").isNull(), "null").when(F.size("vector") != 64, "wrong_width").when(bad, "not_finite").otherwise("ok")
    return library(spark, sf_dir).select("id", verdict.alias("verdict"))


HIDDEN, OUTPUTS = 16, 4


def weight_matrices() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two layers of weights by a rule that SQL can repeat."""
    h, i, o = np.arange(1, HIDDEN + 1), np.arange(1, 65), np.arange(1, OUTPUTS + 1)
    one, two = ((np.add.outer(7 * h, 13 * i)) % 17 - 8) / 40, ((np.add.outer(5 * o, 11 * h)) % 13 - 6) / 10
    return one, (h % 5 - 2) / 10, two, o / 10


@query(
    "SCA14",
    """with x as (select vec_id as id, i, embedding[i]::double as x from embeddings, range(1, 65) t(i)), st as (select i, avg(x) as m, greatest(stddev_pop(x), 1e-9) as s from x group by i), z as (select id, i, (x - m) / s as z from x join st using (i)),
  hd as (select id, h, greatest(0, sum(z * ((7 * h + 13 * i) % 17 - 8) / 40.0::double) + (h % 5 - 2) / 10.0::double) as y from z, range(1, 17) t(h) group by id, h),
  ot as (select id, o, sum(y * ((5 * o + 11 * h) % 13 - 6) / 10.0::double) + o / 10.0::double as y from hd, range(1, 5) t(o) group by id, o)
  select id, round(max(y) filter (where o = 1), 6) as y1, round(max(y) filter (where o = 2), 6) as y2, round(max(y) filter (where o = 3), 6) as y3, round(max(y) filter (where o = 4), 6) as y4 from ot group by id""",
)
def sca14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 64 components by a frozen mean and scale, then two layers, as matrix products over batches."""
    rows = library(spark, sf_dir).select("id", "vector")
    made = v.project(rows, v.Projection(*v.frozen_scale(rows, "vector", 64), *weight_matrices()))
    return made.select("id", *[F.round(F.get("projected", F.lit(k)), 6).alias(f"y{k + 1}") for k in range(OUTPUTS)])


@query("EVL10", f"with {UNITS}, pr as (select a.label = b.label as same_cluster, list_dot_product(a.u, b.u) as c from un a join un b on b.id > a.id) select same_cluster, count(*) as n, round(avg(c), 6) as mean from pr group by same_cluster")
def evl10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of rows, whose sums come from sums of unit vectors."""
    found = blocks.same_label_sums(library(spark, sf_dir))
    return found.select(F.col("same").alias("same_cluster"), "n", F.round("mean", 6).alias("mean"))


@query("SRT04", "with m as (select p_partkey as item from part where p_size > 2 order by p_partkey limit 1000) select item, sha256(string_agg(item::varchar, ',') over (order by item rows between unbounded preceding and unbounded following)) as digest from m")
def srt04(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "part").where("p_size > 2").select(F.col("p_partkey").alias("item")).distinct().orderBy("item").limit(1000)
    digest = members.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("item")), lambda x: x.cast("string")), ","), 256).alias("digest"))
    return members.crossJoin(F.broadcast(digest))


@query("SRT05", "select p_partkey as item from part order by md5(p_partkey || '42'), p_partkey limit 200")
def srt05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item")).orderBy(F.md5(F.concat(F.col("item").cast("string"), F.lit("42"))), "item").limit(200)


@query("SRT06", "select p_brand as brand, arg_min(p_partkey, struct_pack(d := abs(p_retailprice - 930), k := p_partkey)) as item from part group by p_brand")
def srt06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.min_by("p_partkey", F.struct(F.abs(F.col("p_retailprice") - 930), "p_partkey")).alias("item"))


@query("PRJ18", "with h as (select p_partkey as item, p_name as name from part where contains(lower(p_name || ' ' || p_brand), 'red') ) select item, name, k from (select *, row_number() over (order by item) as k from h) where k between 21 and 40")
def prj18(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "part").where(F.instr(F.lower(F.concat_ws(" ", "p_name", "p_brand")), "red") > 0)
    page = found.select(F.col("p_partkey").alias("item"), F.col("p_name").alias("name")).orderBy("item").limit(40)
    from pyspark.sql import Window

    return page.withColumn("k", F.row_number().over(Window.orderBy("item"))).where("k between 21 and 40")


@query("SRT10", "select p_partkey as item, k from (select p_partkey, row_number() over (partition by p_brand order by p_partkey) as k, p_brand from part) where k between 3 and 5")
def srt10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    return table(spark, sf_dir, "part").withColumn("k", F.row_number().over(w)).where("k between 3 and 5").select(F.col("p_partkey").alias("item"), "k")
