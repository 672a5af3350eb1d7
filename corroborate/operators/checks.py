"""Checks that a build must pass: splits without leakage, guards at the doors of fitting, predictions and caches as they were pinned."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..similarity.common import write_once
from .splits import PAIR, PARTS

KINDS = ("random", "cold_groups", "disjoint", "reversal", "temporal")


@dataclass(frozen=True)
class SplitBuild:
    """What a split was built from and what it says.

    ``assigned``: item, grp, part and, if temporal, stratum. ``evidence``: item, grp, label, reason; if temporal by part, as each
    period's own observations give it. ``placed``: okey, line, part of every dated observation; ``support``: item, grp, part,
    okey, line, role behind the evidence of each part. ``clusters``: ``key`` and cluster. ``protocol`` says what it may be used for.
    """

    kind: str
    assigned: DataFrame
    evidence: DataFrame
    clusters: DataFrame | None = None
    key: str = "item"
    placed: DataFrame | None = None
    support: DataFrame | None = None
    protocol: str = "tuned"


def split_checks(build: SplitBuild) -> DataFrame:
    """(split, check_name, observed, expected): how many rows break each rule that holds for this kind of split, all with nothing expected.

    Seventeen rules over five kinds. Each is a count that Spark makes of the rows themselves; none is true by construction.
    """
    if build.kind not in KINDS:
        raise ValueError(f"unknown kind of split: {build.kind}")
    kept = lambda df, label: df if hasattr(df, "written_to") else write_once(df, label)  # noqa: E731  # each is read by several counts
    dealt = lambda df: df.hint("merge")  # noqa: E731  # a table of pairs or entities grows with the input: never broadcast through the driver
    a, e = kept(build.assigned, "split-assigned"), kept(build.evidence, "split-evidence")
    held, scored = a.where("part in ('validation', 'test')"), a.where(F.col("part").isin(*PARTS))

    def counted(rows: DataFrame, *columns: str, **conditions: Column) -> DataFrame:
        """One pass over rows: the sum of each of ``columns`` and the number of rows that meet each condition, a row a check."""
        totals = [*[F.sum(c).alias(c) for c in columns], *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()]]
        checks = [F.struct(F.lit(build.kind).alias("split"), F.lit(n).alias("check_name"), F.coalesce(n, F.lit(0)).cast("long").alias("observed"), F.lit(0).cast("long").alias("expected")) for n in (*columns, *conditions)]
        return rows.agg(*totals).select(F.inline(F.array(*checks)))

    part, every = F.col("part"), F.lit(True)
    of_rows = {"known_part": part.isNull() | ~part.isin(*PARTS, "excluded")}
    found = []
    if build.kind == "temporal":
        of_rows["stratum_named"] = part.isin(*PARTS) & F.col("stratum").isNull()
        placed = kept(build.placed, "split-placed")
        own = e.where(part.isin(*PARTS))
        by_part = [*PAIR, "part"]
        observed_in = placed.select("okey", "line", part.alias("__placed"))
        foreign = build.support.where("role in ('exact', 'censored')").join(dealt(observed_in), ["okey", "line"], "left").where(~F.col("__placed").eqNullSafe(part))
        excluded = own.where("reason is not null")
        gone = a.where("part = 'excluded'").select(*PAIR)
        found = [
            counted(placed.groupBy("okey", "line").agg(F.count_distinct("part").alias("k")), observation_in_one_part=F.col("k") > 1),
            counted(a.sparkSession.createDataFrame([(p,) for p in PARTS], "part string").join(own.select("part").distinct(), "part", "left_anti"), part_has_evidence=every),
            counted(foreign, label_support_of_own_part=every, value_support_of_own_part=F.col("role") == "exact"),
            counted(scored.join(dealt(own.select(*by_part)), by_part, "left_anti"), pair_has_evidence_of_own_part=every),
            counted(held.join(dealt(excluded.select(*by_part)), by_part, "left_semi"), excluded_by_own_part_held_out=every),
            # a pair that a later period excludes still trains, if its training period does not
            counted(own.where("part = 'train' and reason is null").join(dealt(gone), PAIR, "left_semi").join(dealt(a.where("part = 'train'")), PAIR, "left_anti"), later_exclusion_keeps_training=every),
        ]
    else:
        pairs = a.groupBy(*PAIR).agg(F.count("*").alias("k"), F.count_if(part.isin("validation", "test")).alias("n"))
        out = e.where("reason is not null").select(*PAIR).distinct().withColumn("out", every)
        pairs = pairs.join(dealt(out), PAIR, "left").withColumn("excluded_pair_held_out", F.when(F.col("out"), F.col("n")))
        found = [counted(pairs, "excluded_pair_held_out", pair_in_one_part=F.col("k") > 1)]
    if build.kind in ("cold_groups", "disjoint"):
        name = "cluster" if build.kind == "cold_groups" else "structure"
        tagged = scored.select(build.key, "part").distinct().join(dealt(build.clusters.select(build.key, "cluster")), build.key, "left")
        found += [
            counted(tagged.where("cluster is not null").groupBy("cluster").agg(F.count_distinct("part").alias("k")), **{f"{name}_in_one_part": F.col("k") > 1}),
            counted(tagged.where("cluster is null").select(build.key).distinct(), **{f"{name}_of_every_entity": every}),
        ]
    if build.kind == "reversal":
        sides = scored.join(dealt(e.select(*PAIR, "label")), PAIR).groupBy("item").agg(F.count_distinct("part").alias("parts"), F.count_distinct("label").alias("labels"))
        found.append(counted(sides, reversed_entity_has_both_labels=(F.col("parts") > 1) & (F.col("labels") == 1)))
        if build.protocol == "diagnostic":
            of_rows["diagnostic_has_no_tuning"] = part == "validation"
        else:
            found.append(counted(a.limit(1), diagnostic_has_no_tuning=every))
    out = counted(a, **of_rows)
    for one in found:
        out = out.unionByName(one)
    return out


class LeakageError(ValueError):
    """What was held out was about to be used."""


def assert_training_only(index: DataFrame, visible: DataFrame, keys: list[str]) -> DataFrame:
    """An index that may be searched from predictions, or an error if it holds what training may not see."""
    leaked = not_visible(index, visible, keys).first()["observed"]
    if leaked:
        raise LeakageError(f"{leaked} rows of an index are not visible to training")
    return index


def not_visible(index: DataFrame, visible: DataFrame, keys: list[str]) -> DataFrame:
    return index.join(visible.select(*keys), keys, "left_anti").agg(F.count("*").alias("observed"))


def select_for_fitting(rows: DataFrame, assigned: DataFrame, purpose: str) -> DataFrame:
    """The rows of pairs that a purpose may use: ``fit`` those in training, ``select`` those in validation. Nothing else gives any."""
    allowed = {"fit": "train", "select": "validation"}
    if purpose not in allowed:
        raise LeakageError(f"nothing may be fitted for {purpose}")
    return rows.join(assigned.where(F.col("part") == allowed[purpose]).select(*PAIR), PAIR, "left_semi")


def assert_no_reserved(rows: DataFrame, reserved: DataFrame) -> DataFrame:
    """Rows for fitting, or an error if a pair among them is reserved for evaluation."""
    hit = rows.select(*PAIR).distinct().join(reserved.select(*PAIR), PAIR, "left_semi").count()
    if hit:
        raise LeakageError(f"{hit} pairs for fitting are reserved for evaluation")
    return rows


def exposure(assigned: DataFrame, support: DataFrame, key: str = "item") -> DataFrame:
    """By held-out part: entities, those that training shows too, and feature support that comes from held-out pairs: the last must be nothing."""
    held = assigned.where("part in ('validation', 'test')")
    seen = assigned.where("part = 'train'").select(key).distinct().withColumn("seen", F.lit(1))
    entities = held.select("part", key).distinct().join(seen, key, "left").groupBy("part").agg(F.count("*").alias("n_items"), F.count("seen").alias("n_exposed"))
    leaked = held.join(support, PAIR).groupBy("part").agg(F.count("*").alias("n_leaked"))
    return entities.join(leaked, "part", "left").select("part", "n_items", "n_exposed", F.coalesce("n_leaked", F.lit(0)).cast("long").alias("n_support_leaks"))


def assert_support(exposed: DataFrame) -> DataFrame:
    bad = exposed.where("n_support_leaks > 0").agg(F.sum("n_support_leaks")).first()[0]
    if bad:
        raise LeakageError(f"{bad} observations behind features belong to held-out pairs")
    return exposed


LABELS = ("active", "inactive")


def group_digests(rows: DataFrame, keys: list[str], row: Column) -> DataFrame:
    """(keys, n, digest): a digest of each group's rows in any order, from their number and the sums of two parts of their hashes. Sums are
    made before rows move, so a group of any size is a few numbers a task."""
    h = F.sha2(row, 256)
    part = lambda at: F.sum(F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), part(1), part(16)), 256).alias("digest"))


def run_digests(predictions: DataFrame) -> DataFrame:
    """(run, n, digest) of saved predictions."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("item", "grp", "label", "s")]
    return group_digests(predictions, ["run"], F.concat_ws("|", *fields))


def verify_predictions(predictions: DataFrame, cohort: DataFrame, manifest: DataFrame) -> DataFrame:
    """(check_name, observed, expected) of saved predictions (run, item, grp, label, s) against the cohort (item, grp, label, stratum) that they
    were to cover and the manifest (run, n, digest) that was frozen with them. ``rows`` expects what the manifest holds, all others nothing.
    """
    found, keys = run_digests(predictions), ["run", *PAIR]
    both = found.alias("f").join(manifest.alias("m"), "run", "full_outer").select("run", F.col("f.digest").alias("got"), F.col("m.digest").alias("want"), F.col("f.n").alias("n"), F.col("m.n").alias("pinned"))
    known = cohort.select(*PAIR, F.col("label").alias("__label"), "stratum", F.lit(True).alias("__known"))
    joined = predictions.join(known, PAIR, "left")
    bad_value = F.col("s").isNull() | F.isnan("s") | (F.abs("s") == float("inf"))
    count = lambda condition: F.count_if(F.coalesce(condition, F.lit(False)))
    per_row = joined.agg(
        count(F.col("label").isNull() | ~F.col("label").isin(*LABELS)).alias("unknown_label"), count(bad_value).alias("not_finite"), count(F.col("__known").isNull()).alias("not_in_cohort"),
        count(F.col("__known") & ~F.col("label").eqNullSafe(F.col("__label"))).alias("label_differs"), count(F.col("__known") & F.col("stratum").isNull()).alias("without_stratum"),
    )
    per_run = both.agg(
        F.sum("n").alias("rows"), F.sum("pinned").alias("pinned"), count(F.col("got").isNull()).alias("missing_run"), count(F.col("want").isNull()).alias("unexpected_run"), count(F.col("got") != F.col("want")).alias("digest_differs"),
    )
    repeated = predictions.groupBy(*keys).agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("repeated_pair"))
    # rows of the cohort that a run which is there does not score
    size = cohort.agg(F.count("*").alias("__size"))
    scored = joined.where("__known").groupBy("run").agg(F.count_distinct(*PAIR).alias("k")).crossJoin(size).agg(F.coalesce(F.sum(F.col("__size") - F.col("k")), F.lit(0)).alias("pair_not_scored"))
    whole = per_row.crossJoin(per_run).crossJoin(repeated).crossJoin(scored)
    names = ["missing_run", "unexpected_run", "digest_differs", "repeated_pair", "unknown_label", "not_finite", "not_in_cohort", "label_differs", "without_stratum", "pair_not_scored"]
    rows = [_check("rows", F.col("rows"), F.col("pinned")), *[_check(n, F.col(n), F.lit(0)) for n in names]]
    return whole.select(F.inline(F.array(*rows)))


def _check(name: str, observed: Column, expected: Column) -> Column:
    long = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return F.struct(F.lit(name).alias("check_name"), long(observed).alias("observed"), long(expected).alias("expected"))


def assert_verified(checks: DataFrame) -> DataFrame:
    """The checks, or an error that names those which failed."""
    failed = {r["check_name"]: r["observed"] for r in checks.where("observed <> expected").limit(50).collect()}
    if failed:
        raise ValueError("checks failed: " + ", ".join(f"{k} ({v})" for k, v in sorted(failed.items())))
    return checks


def against_pinned(emitted: DataFrame, pinned: DataFrame, required: list[tuple[str, str]]) -> DataFrame:
    """Emitted datasets (role, kind, n, digest) against pinned ones: role, kind, n, digest and the verdict. A required cell that nothing covers is named."""
    spark = emitted.sparkSession
    need = spark.createDataFrame(required, "role string, kind string").withColumn("needed", F.lit(True))
    p = pinned.select("role", "kind", F.col("n").alias("pinned_n"), F.col("digest").alias("pinned_digest"))
    whole = emitted.join(p, ["role", "kind"], "full_outer").join(need, ["role", "kind"], "full_outer")
    verdict = F.when(F.coalesce(F.col("n"), F.lit(0)) == 0, F.when(F.col("needed"), "not_covered").otherwise("not_emitted")).when(F.col("pinned_digest").isNull(), "not_pinned")
    verdict = verdict.when(F.col("n") != F.col("pinned_n"), "count_differs").when(F.col("digest") != F.col("pinned_digest"), "digest_differs").otherwise("as_pinned")
    return whole.select("role", "kind", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "digest", verdict.alias("verdict"))


def assert_pinned(verdicts: DataFrame) -> DataFrame:
    bad = [f"{r['role']} {r['kind']}: {r['verdict']}" for r in verdicts.where("verdict <> 'as_pinned'").limit(50).collect()]
    if bad:
        raise ValueError("datasets are not those that were pinned: " + "; ".join(sorted(bad)))
    return verdicts
