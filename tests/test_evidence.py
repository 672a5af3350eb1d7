"""Parsing, intervals, labels and metrics on small hand-made rows."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from corroborate.functions import evidence as fn
from corroborate.operators import evidence, metrics, snapshots, splits
from corroborate.sources import releases


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("4.5", ("=", "", None, 4.5)),
        (">10000", (">", ">", False, 10000.0)),
        (" >= 1,000 ", (">=", ">=", True, 1000.0)),
        ("≤3", ("<=", "≤", True, 3.0)),
        ("~5", ("~", "~", None, 5.0)),
        ("n.d.", ("?", "", None, None)),
        (">100 nM", (">", ">", False, None)),
        ("1.2e1", ("=", "", None, 12.0)),
        ("Infinity", ("?", "", None, None)),
        ("5d", ("?", "", None, None)),
        ("= +.5e-1", ("=", "=", None, 0.05)),
        ("<-", ("<", "<", False, None)),
        ("\u00a0~ 1,0,0\t", ("~", "~", None, 100.0)),
    ],
)
def test_parse_value(spark, text, want):
    row = fn.with_parsed(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert (row.relation, row.relation_raw, row.bound_inclusive, row.value_numeric) == want


def test_blank_fields_are_no_measurement(spark):
    assert fn.with_parsed(spark.createDataFrame([("",), ("  ",), (None,)], "t string"), "t").count() == 0


@pytest.mark.parametrize(("rel", "want"), [("=", "active"), ("<", "active"), ("<=", "active"), (">", "inactive"), (">=", "ambiguous"), ("~", "ambiguous")])
def test_reading_at_the_threshold(spark, rel, want):
    assert spark.range(1).select(fn.decided_at(F.lit(rel), F.lit(1000.0))).first()[0] == want


@pytest.mark.parametrize(("text", "key"), [("12", "12"), ("12.0", "12"), ("1.2e1", "12"), (".50", "0.5"), ("-0", "0"), ("> 7.40", "7.4"), ("12 nM", "raw:12 nM"), ("", "raw:"), ("120", "120")])
def test_decimal_key(spark, text, key):
    assert spark.range(1).select(fn.decimal_key(F.lit(text))).first()[0] == key


def _label(spark, rows):
    frame = spark.createDataFrame([(1, 1, 1, "p", r, float(v) if v is not None else None) for r, v in rows], "item int, grp int, assay int, pub string, rel string, v double")
    return evidence.pair_evidence(frame).first()


def test_labels_and_statuses(spark):
    assert _label(spark, [("=", 10)]).label == "active"
    assert _label(spark, [(">", 10000)]).label == "inactive"
    assert _label(spark, [(">", 100)]).label == "ambiguous"
    assert _label(spark, [("<", 1), (">", 100)]).status == "empty_intersection"
    # the median lies inside the bound, one exact value does not
    conflict = _label(spark, [("=", 10000), ("=", 1), ("<", 1000)])
    assert (conflict.status, conflict.label, conflict.n_outside) == ("exact_bound_conflict", "none", 1)
    assert _label(spark, [("=", 0), ("~", 5), ("=", None)]).status == "no_usable_evidence"
    spread = _label(spark, [("=", 1), ("=", 100)])
    assert spread.discordant and spread.label == "active" and spread.reason == "discordant"


def test_interval_is_the_sequential_intersection_in_any_order(spark):
    rng = random.Random(3)
    rows = [(g, 1, 1, "p", rng.choice(["<", "<=", ">", ">="]), float(rng.choice([1, 10, 100, 1000]))) for g in range(60) for _ in range(rng.randint(1, 6))]
    got = {r.item: (r.lo, r.lo_inclusive, r.hi, r.hi_inclusive) for r in evidence.intervals(spark.createDataFrame(rows, "item int, grp int, assay int, pub string, rel string, v double")).collect()}
    for g in range(60):
        lo = hi = None
        for _, _, _, _, rel, v in (r for r in rows if r[0] == g):
            p = 9 - {1.0: 0, 10.0: 1, 100.0: 2, 1000.0: 3}[v]
            if rel[0] == "<":
                side = (p, rel == "<=")
                lo = side if lo is None or side[0] > lo[0] or (side[0] == lo[0] and not side[1]) else lo
            else:
                side = (p, rel == ">=")
                hi = side if hi is None or side[0] < hi[0] or (side[0] == hi[0] and not side[1]) else hi
        assert got[g] == ((lo or (None, None))[0], (lo or (None, None))[1], (hi or (None, None))[0], (hi or (None, None))[1])


@pytest.mark.parametrize(("scores", "positive", "want"), [([2, 1, 1], [True, True, False], 0.8333333333), ([1, 1, 1, 1], [True, False, False, False], 0.25), ([3, 2, 1], [False, True, True], 0.5833333333)])
def test_average_precision_takes_tied_blocks_whole(spark, scores, positive, want):
    frame = spark.createDataFrame([("g", float(s), p) for s, p in zip(scores, positive)], "g string, score double, pos boolean")
    assert metrics.blocks(frame).groupBy("g").agg(metrics.average_precision().alias("ap")).first().ap == pytest.approx(want)


def test_auroc_equals_its_definition_under_ties(spark):
    rng = random.Random(5)
    rows = [(g, rng.randint(0, 4) / 4, rng.random() < 0.4) for g in range(20) for _ in range(rng.randint(2, 30))]
    frame = spark.createDataFrame(rows, "g int, score double, pos boolean")
    fast = {r.g: r.auroc for r in metrics.blocks(frame).groupBy("g").agg(metrics.auroc().alias("auroc")).collect()}
    slow = {r.g: r.auroc for r in metrics.naive_auroc(frame, "g").collect()}
    assert {g: a for g, a in fast.items() if a is not None} == pytest.approx(slow)


SNAPSHOT = "item long, grp int, pub string, ph double, temp double, src string, mtype string, rel string, v double, doi long, rsid string"


def _diff(spark, earlier, later):
    shape = lambda rows: spark.createDataFrame([(1, 1, pub, 7.0, 0.0, "s", "KI", "=", float(v), doi, rsid) for pub, v, doi, rsid in rows], SNAPSHOT)
    return snapshots.classify_rows(shape(earlier), shape(later))


def test_diff_counts_multisets(spark):
    rows = _diff(spark, [("a", 1, None, "x"), ("a", 1, None, "y"), ("a", 2, None, "z")], [("a", 1, None, "x"), ("b", 9, None, "w")])
    kinds = {(r.side, r.kind): r.n for r in rows.groupBy("side", "kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {("a", "unchanged"): 1, ("a", "removal"): 2, ("b", "unchanged"): 1, ("b", "addition"): 1}


@pytest.mark.parametrize(
    ("before", "after", "link"),
    [((1, 5, "x"), (2, 5, "y"), "entry_doi"), ((1, 5, "x"), (2, 6, "x"), "identifier_conflict"), ((1, None, "x"), (2, 6, "x"), "reactant_set_id"), ((1, None, "x"), (2, None, "y"), "ambiguous")],
)
def test_links(spark, before, after, link):
    rows = _diff(spark, [("a", before[0], before[1], before[2])], [("a", after[0], after[1], after[2])])
    assert {r.link for r in rows.collect()} == {link}


@pytest.mark.parametrize("width", ["1", "4", "16"])
def test_diff_does_not_depend_on_the_partitions(spark, width):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        rng = random.Random(9)
        make = lambda: [(rng.choice("ab"), rng.randint(1, 3), rng.choice([None, 1, 2]), str(k % 7)) for k in range(40)]
        rows = _diff(spark, make(), make())
        assert snapshots.type_totals(rows).first().reconciles
        assert rows.where("kind = 'addition'").count() - rows.where("kind = 'removal'").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_planted_leak_fails_the_build(spark):
    obs = spark.createDataFrame([(1, 1), (2, 1)], "item int, grp int")
    clean = spark.createDataFrame([(1, 1, "train"), (2, 1, "test")], "item int, grp int, part string")
    splits.assert_clean(splits.leakage_checks(clean, obs))
    with pytest.raises(ValueError, match="pairs_in_train_and_held_out"):
        splits.assert_clean(splits.leakage_checks(clean.unionByName(spark.createDataFrame([(1, 1, "test")], clean.schema)), obs))


def test_random_split_has_exact_shares(spark):
    pairs = spark.range(1000).select(F.col("id").alias("item"), F.lit(1).alias("grp"), F.lit(None).cast("string").alias("reason"))
    counts = {r.part: r.n for r in splits.random_pairs(pairs, "s").groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert counts == {"train": 700, "validation": 100, "test": 200}


def test_greedy_groups_fill_the_parts(spark):
    pairs = spark.range(600).select(F.col("id").alias("item"), (F.col("id") % 37).cast("int").alias("grp"))
    placed = splits.greedy_groups(pairs, "grp", "s")
    assert placed.groupBy("grp").agg(F.count_distinct("part").alias("k")).where("k > 1").count() == 0
    assert placed.count() == 600


def test_median_is_the_median(spark):
    row = _label(spark, [("=", 1), ("=", 10), ("=", 100), ("=", 1000)])
    assert row.median == pytest.approx(statistics.median([9, 8, 7, 6]))


def test_header_and_versions_are_guarded(spark, tmp_path):
    with pytest.raises(ValueError, match="twice"):
        releases.validate_header(["a", "a"], [])
    with pytest.raises(ValueError, match="lacks"):
        releases.validate_header(["a"], ["b"])
    releases.write_version(spark.range(1), f"file://{tmp_path}/v1")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        releases.write_version(spark.range(1), f"file://{tmp_path}/v1")
