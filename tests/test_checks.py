"""Each check fails on a planted fault and on nothing else."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corroborate.operators import checks

PAIRS = "item long, grp int, part string, stratum string"
CASES = [(k, k % 4, ("train", "train", "validation", "test", "excluded")[k % 5], "new_pair") for k in range(60)]


def failed(build):
    return {r.check_name for r in checks.split_checks(build).where("observed <> expected").collect()}


def plain(spark, kind="random", rows=CASES, reasons=(), cluster=lambda k: f"c{k}", **more):
    evidence = spark.createDataFrame([(k, g, "active" if k % 2 else "inactive", "discordant" if k in reasons or p == "excluded" else None) for k, g, p, _ in CASES], "item long, grp int, label string, reason string")
    clusters = spark.createDataFrame([(k, cluster(k)) for k in range(60) if cluster(k)], "item long, cluster string")
    return checks.SplitBuild(kind, spark.createDataFrame(rows, PAIRS), evidence, clusters, **more)


@pytest.mark.parametrize("kind", ["random", "cold_groups", "disjoint"])
def test_faults_of_any_split_are_named(spark, kind):
    assert failed(plain(spark, kind)) == set()
    assert failed(plain(spark, kind, [*CASES, (1, 1, "elsewhere", None)])) == {"known_part", "pair_in_one_part"}
    assert failed(plain(spark, kind, [*CASES, (900, 1, None, None)])) == {"known_part"}
    assert failed(plain(spark, kind, reasons=(3,))) == {"excluded_pair_held_out"}


def test_faults_of_clusters_are_named(spark):
    assert failed(plain(spark, "cold_groups", cluster=lambda k: f"c{k // 2}")) == {"cluster_in_one_part"}
    assert failed(plain(spark, "disjoint", cluster=lambda k: f"c{k}" if k != 7 else None)) == {"structure_of_every_entity"}


def test_faults_of_a_diagnostic_are_named(spark):
    rows = [(k, g, p, None) for k in range(9) for g, p in ((0, "train"), (1, "test"))]
    labels = lambda turned: spark.createDataFrame([(k, g, "active" if (g == 1) == (k not in turned) or (k in turned) else "inactive", None) for k in range(9) for g in (0, 1)], "item long, grp int, label string, reason string")
    build = lambda rows, turned=(), protocol="diagnostic": checks.SplitBuild("reversal", spark.createDataFrame(rows, PAIRS), labels(turned), protocol=protocol)
    assert failed(build(rows)) == set()
    assert failed(build(rows, turned=(4,))) == {"reversed_entity_has_both_labels"}
    assert failed(build(rows, protocol="tuned")) == {"diagnostic_has_no_tuning"}
    assert failed(build([*rows, (70, 0, "validation", None)])) == {"diagnostic_has_no_tuning"}
    with pytest.raises(ValueError):
        checks.split_checks(checks.SplitBuild("other", spark.createDataFrame(rows, PAIRS), labels(())))


def test_faults_of_periods_are_named(spark):
    obs = [(k, 1, k % 10, 0, ("train", "validation", "test")[k % 3], "exact" if k % 2 else "censored") for k in range(60)]

    def build(rows=None, support=None, evidence=None, placed=None):
        pairs = sorted({(i, g, p) for _, _, i, g, p, _ in obs})
        rows = rows or [(*x, "new_pair") for x in pairs]
        frame = lambda data, schema: spark.createDataFrame(data, schema)
        return checks.SplitBuild(
            "temporal", frame(rows, PAIRS), frame(evidence or [(*x[:2], "active", None, x[2]) for x in pairs], "item long, grp int, label string, reason string, part string"),
            placed=frame(placed or [(o, n, p) for o, n, _, _, p, _ in obs], "okey long, line int, part string"),
            support=frame(support or [(i, g, p, o, n, r) for o, n, i, g, p, r in obs], "item long, grp int, part string, okey long, line int, role string"),
        )

    good = build()
    rows = [tuple(r) for r in good.assigned.collect()]
    evidence = [tuple(r) for r in good.evidence.collect()]
    support = [tuple(r) for r in good.support.collect()]
    assert failed(good) == set()
    assert failed(build(placed=[*[tuple(r) for r in good.placed.collect()], (0, 1, "test")])) >= {"observation_in_one_part"}
    assert failed(build(evidence=[e for e in evidence if e[4] != "test"])) == {"part_has_evidence", "pair_has_evidence_of_own_part"}
    assert failed(build(support=[(*support[1][:2], "train" if support[1][2] != "train" else "test", *support[1][3:]), *support[2:]])) == {"label_support_of_own_part", "value_support_of_own_part"}
    assert failed(build(support=[*support, (1, 0, "train", 999, 1, "censored")])) == {"label_support_of_own_part"}
    assert failed(build(rows=[*rows[1:], (*rows[0][:3], None)])) == {"stratum_named"}
    held = next(r for r in rows if r[2] == "test")
    assert failed(build(evidence=[(*e[:3], "discordant", e[4]) if (*e[:2], e[4]) == held[:3] else e for e in evidence])) == {"excluded_by_own_part_held_out"}
    pair = next(r for r in rows if r[2] == "train")
    assert failed(build(rows=[(*r[:2], "excluded", r[3]) if r[:3] == pair[:3] else r for r in rows])) == {"later_exclusion_keeps_training"}


def test_guards_refuse(spark):
    assigned = spark.createDataFrame(CASES, PAIRS)
    train, test = (assigned.where(F.col("part") == p) for p in ("train", "test"))
    assert checks.assert_training_only(train, train, ["item", "grp"]).count() == 24
    with pytest.raises(checks.LeakageError, match="12 rows"):
        checks.assert_training_only(train.unionByName(test), train, ["item", "grp"])
    assert checks.select_for_fitting(assigned, assigned, "fit").count() == 24 and checks.select_for_fitting(assigned, assigned, "select").count() == 12
    with pytest.raises(checks.LeakageError):
        checks.select_for_fitting(assigned, assigned, "test")
    assert checks.assert_no_reserved(train, test).count() == 24
    with pytest.raises(checks.LeakageError, match="12 pairs"):
        checks.assert_no_reserved(assigned, test)
    exposed = checks.exposure(assigned, train.select("item", "grp"))
    assert checks.assert_support(exposed).count() == 2
    with pytest.raises(checks.LeakageError):
        checks.assert_support(checks.exposure(assigned, assigned.where("item = 3").select("item", "grp")))


def test_predictions_are_verified(spark):
    cohort = spark.createDataFrame([(k, 0, "active" if k % 2 else "inactive", "new") for k in range(20)], "item long, grp int, label string, stratum string")
    rows = [(r, k, 0, "active" if k % 2 else "inactive", k / 20) for r in (0, 1) for k in range(20)]
    frame = lambda data: spark.createDataFrame(data, "run int, item long, grp int, label string, s double")
    manifest = checks.run_digests(frame(rows))
    bad = lambda data, cohort=cohort, manifest=manifest: {r.check_name for r in checks.verify_predictions(frame(data), cohort, manifest).where("observed <> expected").collect()}
    assert bad(rows) == set() and bad(rows[::-1]) == set()
    checks.assert_verified(checks.verify_predictions(frame(rows), cohort, manifest))
    assert bad(rows[:20]) == {"rows", "missing_run"}
    assert bad([*rows, *[(2, *r[1:]) for r in rows[:20]]]) == {"rows", "unexpected_run"}
    assert bad([*rows[1:], (*rows[0][:4], 0.7)]) == {"digest_differs"}
    assert bad([*rows[1:], (*rows[0][:4], float("inf"))]) == {"digest_differs", "not_finite"}
    assert bad([*rows[1:], (*rows[0][:3], "active", rows[0][4])]) == {"digest_differs", "label_differs"}
    assert bad([*rows[1:], (*rows[0][:3], "so so", rows[0][4])]) == {"digest_differs", "label_differs", "unknown_label"}
    assert bad([*rows[1:], (0, 99, *rows[0][2:])]) == {"digest_differs", "not_in_cohort", "pair_not_scored"}
    assert bad([*rows[1:], rows[1]]) == {"digest_differs", "repeated_pair", "pair_not_scored"}
    assert bad(rows, cohort.withColumn("stratum", F.lit(None).cast("string"))) == {"without_stratum"}
    with pytest.raises(ValueError, match="missing_run"):
        checks.assert_verified(checks.verify_predictions(frame(rows[:20]), cohort, manifest))


def test_datasets_are_those_that_were_pinned(spark):
    schema = "role string, kind string, n long, digest string"
    emitted = spark.createDataFrame([("train", "label", 3, "a"), ("train", "value", 2, "b")], schema)
    need = [("train", "label"), ("train", "value")]
    assert checks.assert_pinned(checks.against_pinned(emitted, emitted, need)).count() == 2
    for pinned, why in (([("train", "label", 3, "x"), ("train", "value", 2, "b")], "digest_differs"), ([("train", "label", 4, "a"), ("train", "value", 2, "b")], "count_differs"), ([("train", "label", 3, "a")], "not_pinned")):
        with pytest.raises(ValueError, match=why):
            checks.assert_pinned(checks.against_pinned(emitted, spark.createDataFrame(pinned, schema), need))
    with pytest.raises(ValueError, match="test label: not_covered"):
        checks.assert_pinned(checks.against_pinned(emitted, emitted, [*need, ("test", "label")]))


@pytest.mark.parametrize("kind", ["random", "cold_groups", "disjoint"])
def test_no_table_of_a_build_is_broadcast(spark, kind):
    """Pairs and clusters grow with the input; broadcast, they would pass through the driver, several at once."""
    plan = checks.split_checks(plain(spark, kind))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan
