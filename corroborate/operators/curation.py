"""Curation of raw records: rules, scopes, dimensions and the joins that resolve them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALUE_COLUMNS = {"KI": "ki", "IC50": "ic50", "KD": "kd", "EC50": "ec50"}


def wide_records(texts: DataFrame) -> DataFrame:
    """One record with four value fields, as a release has them."""
    columns = [F.max(F.when(F.col("mtype") == k, F.col("value_text"))).alias(c) for k, c in VALUE_COLUMNS.items()]
    return texts.groupBy("okey", "line", "item", "grp").agg(*columns)


def unpivot_values(records: DataFrame) -> DataFrame:
    """A row for each value field that holds something but blanks."""
    long = records.unpivot(["okey", "line", "item", "grp"], list(VALUE_COLUMNS.values()), "field", "value_text")
    kind = F.upper("field")
    return long.where(F.trim("value_text") != "").select("okey", "line", "item", "grp", kind.alias("mtype"), "value_text")


def first_failing_rule(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Names the first rule that a row breaks; rows that break none have a null rule and are kept."""
    return df.withColumn("rule", F.coalesce(*[F.when(broken, name) for name, broken in rules]))


def demo_rules() -> list[tuple[str, Column]]:
    """The four exclusion rules of curation over the columns that the measurement view has."""
    return [
        ("missing_structure", F.col("item") % 23 == 0),
        ("invalid_structure", F.col("item") % 29 == 0),
        ("missing_target_sequence", F.col("assay") % 31 == 0),
        ("no_measurement_value", F.trim("value_text") == ""),
    ]


def with_chain_text(obs: DataFrame) -> DataFrame:
    k = F.col("okey") % 7
    return obs.withColumn("chains_text", F.when(k == 0, F.lit(None)).when(k == 1, "x").otherwise((1 + F.greatest(F.lit(0), k - 4)).cast("string")))


def with_references(obs: DataFrame) -> DataFrame:
    k = F.col("okey")
    pmid = F.when(k % 3 == 0, k.cast("string")).when((k % 3 == 1) & (k % 4 == 0), "0")
    doi = F.when(k % 5 != 0, F.concat(F.lit("10.1/ab "), k.cast("string")))
    return obs.withColumns({"pmid": pmid, "doi": doi, "patent": F.when(k % 2 == 0, F.concat(F.lit("US"), k.cast("string")))})


def populations() -> Column:
    """The populations that a pair belongs to."""
    tags = F.array(F.lit("all"), F.when(F.col("reason").isNull(), "eval_eligible"), F.when(~F.col("discordant"), "no_discordant"))
    return F.array_compact(tags)


def dimension(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys).dropDuplicates()


def composite_join(keyed: DataFrame, named: DataFrame, composite: str, key: str, part: int) -> DataFrame:
    """Join through one part of a key of the form ``a_b``."""
    return keyed.withColumn(key, F.split_part(composite, F.lit("_"), F.lit(part)).cast("long")).join(named, key)


def lookup_with_status(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Every row with whether its key is known; keys of ``known`` are unique, so no row is repeated."""
    hit = known.select(key, F.lit(True).alias("__hit"))
    return df.join(hit, key, "left").withColumn("join_status", F.when(F.col("__hit"), "matched").otherwise("no_rsid_match")).drop("__hit")


def resolve_new(keys: DataFrame, known: DataFrame, key: str, make: Callable[[Column], Column]) -> DataFrame:
    """Known keys with their ids, and the others with ids made for them: the costly function sees new keys only."""
    fresh = keys.join(known, key, "left_anti").withColumn("content_id", make(F.col(key)))
    return known.withColumn("already_known", F.lit(True)).unionByName(fresh.withColumn("already_known", F.lit(False)))


def star(fact: DataFrame, inner: list[tuple[DataFrame, str]], left: list[tuple[DataFrame, str]]) -> DataFrame:
    for dim, key in inner:
        fact = fact.join(dim, key)
    for dim, key in left:
        fact = fact.join(dim, key, "left")
    return fact


def assemble_cohort(assigned: DataFrame, evidence: DataFrame) -> DataFrame:
    """Assignments with the regression value and the label of their pairs, where these may be used."""
    values = evidence.where("n_exact > 0 and regression_reason is null").select("item", "grp", F.col("median").alias("y"))
    labels = evidence.where("status = 'ok'").select("item", "grp", "label")
    return assigned.join(values, ["item", "grp"], "left").join(labels, ["item", "grp"], "left")


def evidence_text(obs: DataFrame) -> DataFrame:
    """Exact range and bounds of each pair as text, kept apart."""
    exact, usable = (F.col("rel") == "=") & (F.col("v") > 0), F.col("v") > 0
    whole = F.floor("v").cast("string")
    found = obs.groupBy("item", "grp").agg(
        F.count_if(exact).alias("n"),
        F.min(F.when(exact, F.col("v"))).alias("lo"),
        F.max(F.when(exact, F.col("v"))).alias("hi"),
        F.sort_array(F.collect_list(F.when(~exact & usable, F.concat("rel", whole, F.lit(" nM"))))).alias("bounds"),
    )
    lo, hi = F.floor("lo").cast("string"), F.floor("hi").cast("string")
    span = F.when(lo == hi, lo).otherwise(F.concat(lo, F.lit("-"), hi))
    head = F.when(F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" exact "), span, F.lit(" nM")))
    return found.select("item", "grp", F.array_join(F.concat(F.array_compact(F.array(head)), F.col("bounds")), "; ").alias("evidence_text"))
