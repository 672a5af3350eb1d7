"""Products of blocks against plain loops over all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corroborate.operators import blocks, vectors


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "LIBRARY_BLOCK", 17)
    monkeypatch.setattr(blocks, "QUERY_BLOCK", 3)


def odd_rows(spark):
    rng = np.random.default_rng(4)
    x = [rng.normal(size=4).tolist() for _ in range(90)]
    for k in range(40, 60):
        x[k] = x[5]
    x[7], x[8], x[9], x[10], x[11] = [0.0] * 4, None, [1.0, None, 0.0, 2.0], [float("nan"), 1.0, 1.0, 1.0], [1.0, 2.0]
    return x, spark.createDataFrame(list(enumerate(x)), "id long, vector array<double>")


def plain_score(a, b):
    if a is None or b is None or None in a or None in b or len(a) != len(b):
        return None
    u, w = (np.array(v) / max(np.linalg.norm(v), 1e-9) if not np.isnan(v).any() else np.array(v) * np.nan for v in (a, b))
    return float(np.round(u @ w, 9))


def order(pair):
    k, s = pair
    return (s is None, not (s is not None and math.isnan(s)), -(s if s is not None and not math.isnan(s) else 0), k)


def test_first_rows_of_blocks_hold_the_first_of_all(spark, small_blocks):
    x, rows = odd_rows(spark)
    asked = rows.where("id % 5 = 0 or id in (7, 8, 9, 11)")
    whole = vectors.scored(asked, rows)
    assert whole.count() == asked.count() * 89
    few = vectors.scored(asked, rows, best=6)
    assert few.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 6 * 6  # six a block, not one a row
    got = {}
    for r in vectors.top(few, 6).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    for q in [r.id for r in asked.collect()]:
        want = sorted(((k, plain_score(x[q], x[k])) for k in range(90) if k != q), key=order)[:6]
        found = sorted(got[q])
        assert [k for _, k, _ in found] == [k for k, _ in want]
        for (_, _, a), (_, b) in zip(found, want):
            assert (a is None and b is None) or (math.isnan(a) and math.isnan(b)) or a == pytest.approx(b, abs=2e-9)


def test_quantiles_and_bins_without_stored_scores(spark, small_blocks):
    x, rows = odd_rows(spark)
    rows = rows.where("id not in (8, 9, 10, 11)")
    asked = rows.where("id % 5 = 0")
    found = vectors.distribution(asked, rows, 8).collect()
    sizes = blocks.moments(asked, rows, 0.3)
    at = {r.query_id: r.p for r in vectors.score_quantiles(asked, rows, sizes, {"p": 0.9}, False).collect()}
    over = {r.query_id: r.over for r in sizes.collect()}
    for q in range(0, 90, 5):
        if q == 10:
            continue
        s = np.array(sorted(plain_score(x[q], x[k]) for k in range(90) if k not in (q, 8, 9, 10, 11)))
        mine = [r for r in found if r.query_id == q]
        assert sum(r.n for r in mine) == len(s)
        assert [mine[0].q1, mine[0].median, mine[0].q3] == pytest.approx(np.quantile(s, [0.25, 0.5, 0.75]).tolist(), abs=1e-8)
        assert [mine[0].mean, mine[0].sd] == pytest.approx([s.mean(), s.std()], abs=1e-8)
        assert at[q] == pytest.approx(s[int(0.9 * (len(s) - 1))], abs=2e-9) and over[q] == pytest.approx((s >= 0.3).mean())


def test_best_overlap_of_blocks_takes_the_least_id(spark, small_blocks):
    rng = np.random.default_rng(5)
    bits = [[int(v) for v in rng.integers(0, 1 << 4, 2)] for _ in range(120)] + [None, [0, 0]]
    rows = spark.createDataFrame([(k, b, k % 3) for k, b in enumerate(bits)], "id long, bits array<long>, label int")
    sets = [set() if b is None else {(w, i) for w, n in enumerate(b) for i in range(32) if n >> i & 1} for b in bits]
    for group in (None, ["label"]):
        found = {r.query_id: (r.id, r.score) for r in blocks.best_overlap(rows.where("id % 4 < 2"), rows, group).collect()}
        for q in (k for k in range(122) if k % 4 < 2):
            pairs = [(len(sets[q] & sets[k]) / len(sets[q] | sets[k]) if sets[q] | sets[k] else 0.0, -k) for k in range(122) if k != q and (not group or k % 3 == q % 3)]
            assert found[q] == (-max(pairs)[1], pytest.approx(max(pairs)[0]))


def test_sums_of_labels_are_those_of_all_pairs(spark, monkeypatch):
    """Every pair of rows with different ids counts, whatever their ids; repeated ids, missing labels and odd vectors included."""
    monkeypatch.setattr(blocks, "SUM_ROWS", 13)
    x, _ = odd_rows(spark)
    del x[10]  # the NaN has a case of its own below
    rows = [(k % 80 + 1, v, None if k % 11 == 0 else k % 4) for k, v in enumerate(x)]
    schema = "id long, vector array<double>, label int"
    more = [[], [(200, [float("nan")] * 4, 9)]]
    for extra in more:
        mine, want = rows + extra, {}
        for k, (i, a, p) in enumerate(mine):
            for j, b, q in mine[:k]:
                if i != j:
                    want.setdefault(None if p is None or q is None else p == q, []).append(plain_score(a, b))
        found = {r.same: (r.n, r.mean) for r in blocks.same_label_sums(spark.createDataFrame(mine, schema)).collect()}
        assert set(found) == set(want) == {True, False, None}
        for same, scores in want.items():
            known = [s for s in scores if s is not None]
            assert found[same] == (len(scores), pytest.approx(np.mean(known), abs=1e-8, nan_ok=True))
    assert blocks.same_label_sums(spark.createDataFrame(rows[:1], schema)).count() == 0
    assert [(r.n, r.mean) for r in blocks.same_label_sums(spark.createDataFrame([(1, None, 3), (2, None, 3)], schema)).collect()] == [(1, None)]
    assert blocks.same_label_sums(spark.createDataFrame([], schema)).count() == 0


def test_label_contrast_leaves_no_row_out(spark, tmp_path):
    """EVL10 on rows of which no id is divisible by 100."""
    from corroborate.plans import registry

    rows = [(k, [1.0, float(k)], k % 2) for k in range(1, 6)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert {r.same_cluster: r.n for r in registry.queries()["EVL10"](spark, str(tmp_path)).collect()} == {True: 4, False: 6}


def test_every_row_has_its_nearest(spark, monkeypatch):
    monkeypatch.setattr(blocks, "NEAREST_BLOCK", 23)
    x, rows = odd_rows(spark)
    found = {r.query_id: (r.id, r.score) for r in blocks.nearest(rows).collect()}
    assert sorted(found) == list(range(90))
    for q in range(90):
        k, s = min(((k, plain_score(x[q], x[k])) for k in range(90) if k != q), key=order)
        assert found[q][0] == k
        assert found[q][1] is None if s is None else found[q][1] == pytest.approx(s, abs=2e-9, nan_ok=True)


def test_nearest_rows_are_found_for_ids_of_any_kind(spark, tmp_path):
    """JON12 on rows of which no id is divisible by 100."""
    from corroborate.plans import registry

    rows = [(k, [1.0, float(k)], 0) for k in (1, 2, 4, 7, 11)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert {r.query_id: r.nearest for r in registry.queries()["JON12"](spark, str(tmp_path)).collect()} == {1: 2, 2: 4, 4: 7, 7: 11, 11: 7}
