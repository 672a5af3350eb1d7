"""Searches, selections and loads that cut their work into parts, against plain versions that do not."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corroborate.operators import alignment, metrics, ranks, splits, statistics, vectors
from corroborate.sources import releases as rel
from corroborate.streaming import arrivals

# loading


@pytest.mark.parametrize("split", ["200", "1m"])
def test_lines_of_files_are_numbered_whatever_the_splits(spark, tmp_path, split):
    rng = random.Random(2)
    lines = [b"a\tb"] + [bytes(rng.choice(b"xyz\t\r ") for _ in range(rng.randint(0, 30))) + (b"\xff" if k % 9 == 0 else b"") for k in range(120)]
    at = [0, 50, 51, 90, len(lines)]
    for k, (a, b) in enumerate(zip(at, at[1:])):
        folder = tmp_path / "r" / f"{k // 2}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"part-{k}").write_bytes(b"".join(x + b"\n" for x in lines[a:b]))
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        header, rest = rel.read_release(spark, f"file://{tmp_path}/r", ["a"])
        got = sorted((r.line_no, bytes(r.raw)) for r in rest.collect())
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert header == ["a", "b"] and got == [(k + 2, x) for k, x in enumerate(lines[1:])]


def test_files_are_digested_in_order_piece_by_piece(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(rel, "PIECE_CHARS", 20)
    rows = [(f"f{k % 3}", k, f"line {k} é" if k % 5 else "") for k in range(300)] + [("only", 7, "")]
    got = {r.file: r.digest for r in rel.file_digests(spark.createDataFrame(rows, "file string, line_no int, text string").repartition(7)).collect()}
    want = {f: hashlib.sha256("\n".join(t for g, _, t in rows if g == f).encode()).hexdigest() for f in {r[0] for r in rows}}
    assert got == want


def test_versions_are_found_again_only_if_they_serve(spark, tmp_path):
    from corroborate.operators import snapshots

    rows = spark.range(20).selectExpr("id", "id * 0.5 as x")
    content = lambda df: snapshots.set_digest(df, F.concat_ws(":", "id", "x"))
    digest = content(rows).first()["digest"]
    for name in ("kept", "drifted"):
        rel.write_version(rows if name == "kept" else rows.withColumn("x", F.lit(1.0)), f"file://{tmp_path}/{name}")
    key = lambda width, population="p": rel.identity_key({"width": width, "model": "m"}, population)
    entry = lambda name, path, width, by=None, whole=True: (name, f"file://{tmp_path}/{path}", digest, by, key(width), whole)
    registry = spark.createDataFrame([entry("a", "kept", 1), entry("b", "drifted", 1), entry("c", "kept", 2, by="a"), entry("d", "drifted", 3), entry("e", "kept", 4, whole=False)], "name string, path string, digest string, superseded_by string, identity string, complete boolean")
    hit = rel.find_reusable(registry, key(1), content)
    assert hit.name == "a" and hit.rows.count() == 20 and set(hit.refused) == {"b"}
    for width, population, why in ((9, "p", {}), (1, "q", {}), (2, "p", {"c": "superseded"}), (3, "p", {"d": "not those"}), (4, "p", {"e": "partial"})):
        found = rel.find_reusable(registry, key(width, population), content)
        assert found.name is None and found.rows is None and set(found.refused) == set(why) and all(w in found.refused[n] for n, w in why.items())


# alignment


def plain_alignment(a, b):
    """The same recurrence over the whole matrix, cell by cell."""
    n, best = len(b), (0, 0, 0, 0, 0)
    above = [(0, 0, 0, 0, 0)] * (n + 1)  # score, equal, columns, first in a, first in b
    for i in range(1, len(a) + 1):
        row = [(0, 0, 0, 0, 0)] * (n + 1)
        for j in range(1, n + 1):
            s, m, c, fa, fb = above[j - 1]
            same = a[i - 1] == b[j - 1]
            d = (s + (alignment.MATCH if same else alignment.MISMATCH), m + same, c + 1, fa, fb) if s > 0 else (alignment.MATCH if same else alignment.MISMATCH, int(same), 1, i - 1, j - 1)
            up = above[j]
            cell = d if d[0] >= up[0] + alignment.GAP else (up[0] + alignment.GAP, up[1], up[2] + 1, up[3], up[4])
            left = row[j - 1]
            if left[0] + alignment.GAP > max(cell[0], 0):
                cell = (left[0] + alignment.GAP, left[1], left[2] + 1, left[3], left[4])
            row[j] = cell if cell[0] > 0 else (0, 0, 0, 0, 0)
            if row[j][0] > best[0]:
                best = (row[j][0], row[j][1], row[j][2], i - row[j][3], j - row[j][4])
        above = row
    return best


def mutated(rng, words, rate):
    out = []
    for w in words:
        r = rng.random()
        if r < rate / 3:
            continue
        out.append(f"new{rng.randrange(10**6)}" if r < 2 * rate / 3 else w)
        if r > 1 - rate / 3:
            out.append(f"more{rng.randrange(10**6)}")
    return out


def test_banded_alignment_equals_the_whole_matrix():
    rng = random.Random(4)
    for _ in range(60):
        a = [rng.randrange(1 << 40) for _ in range(rng.randint(8, 60))]
        b = [x if rng.random() > 0.08 else rng.randrange(1 << 40) for x in a]
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(b))
            b[k:k] = [rng.randrange(1 << 40) for _ in range(rng.randint(0, 2))]
        b = [rng.randrange(1 << 40) for _ in range(rng.randint(0, 20))] + b[rng.randint(0, 4) :]
        one, two = np.array(a, np.int64), np.array(b, np.int64)
        edges = alignment.band(one, two)
        if edges is None:
            assert plain_alignment(a, b)[1] < alignment.SEED * 3
            continue
        assert alignment.align(one, two, *edges) == plain_alignment(a, b)


def test_best_hits_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    base = [fresh(rng.randint(12, 90)) for _ in range(8)]
    common = fresh(12)  # a passage in a third of all texts
    targets = [(100 + k, w + (common if k % 3 == 0 else [])) for k, w in enumerate(base + [fresh(40) for _ in range(10)])] + [(200, base[0]), (201, base[0] + fresh(60)), (202, fresh(3))]
    queries = [(k, mutated(rng, w, rate) + (common if k % 3 == 0 else [])) for k, (w, rate) in enumerate((w, r) for w in base for r in (0.0, 0.03, 0.06))] + [(60, fresh(50)), (61, targets[-1][1]), (62, []), (63, base[1][: len(base[1]) // 2])]
    frame = lambda rows: spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "id long, text string")
    found = alignment.hits(frame(queries), frame(targets))
    got = {r.query: (r.target, round(r.identity, 6), round(r.mutual, 6)) for r in alignment.best_hits(found).collect()}
    codes = {}
    number = lambda ws: [codes.setdefault(w, len(codes)) for w in ws]
    want = {}
    for q, a in queries:
        for t, b in targets:
            score, equal, columns, span_a, span_b = plain_alignment(number(a), number(b)) if a and b else (0, 0, 0, 0, 0)
            if columns and round(equal / columns, 6) >= 0.9 and min(span_a / len(a), span_b / len(b)) >= 0.25:
                rank = (-round(min(span_a / len(a), span_b / len(b)), 6), t)
                if q not in want or rank < want[q][0]:
                    want[q] = (rank, (t, round(equal / columns, 6), round(min(span_a / len(a), span_b / len(b)), 6)))
    assert {q: v for q, v in got.items() if v[2] >= 0.25} == {q: v for q, (_, v) in want.items()}
    strata = {r.id: r.near_homolog for r in alignment.near_homologs(frame(queries), alignment.best_hits(found)).collect()}
    assert strata == {q: q in want and want[q][1][2] >= 0.5 for q, _ in queries}


def test_many_alignments_at_once_equal_single_ones():
    rng = random.Random(6)
    met = []
    for k in range(400):
        kinds = (4, 40, 10**9)[k % 3]
        a = [rng.randrange(kinds) for _ in range(rng.randint(1, 150))]
        b = [rng.randrange(kinds) for _ in range(rng.randint(0, 40))] + [x if rng.random() > 0.1 else rng.randrange(kinds) for x in a][rng.randint(0, 8) :]
        one, two = np.array(a, np.int64), np.array(b, np.int64)
        edges = alignment.band(one, two) if len(b) and k % 4 else (low := rng.randint(-160, 160), low + rng.randint(0, 70))
        if edges is not None and len(b):
            met.append((one, two, *edges))
    assert alignment.align_many(met) == [alignment.align(*pair) for pair in met]


def test_texts_with_a_near_copy_do_not_meet_those_of_a_common_passage(spark, monkeypatch):
    """40 pairs of near copies of which all texts bear one passage: the best hits are those of all pairs, and few pairs are aligned."""
    rng = random.Random(7)
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    passage = fresh(12)
    base = [fresh(rng.randint(10, 60)) + passage + fresh(10) for _ in range(40)]
    lone = [fresh(20) + passage for _ in range(3)] + [base[0][:30], fresh(9), []]
    frame = lambda rows: spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "id long, text string")
    queries = frame([(k, mutated(rng, w, 0.03)) for k, w in enumerate(base)] + [(50 + k, w) for k, w in enumerate(lone)])
    targets = frame([(100 + k, w) for k, w in enumerate(base)])
    order = lambda df: sorted(map(tuple, df.collect()))
    want = order(alignment.best_hits(alignment.hits(queries, targets)))
    met = []
    aligned = alignment._aligned
    monkeypatch.setattr(alignment, "_aligned", lambda pairs, *rest, **named: met.append(pairs.count()) or aligned(pairs, *rest, **named))
    assert order(alignment.search_best(queries, targets)) == want and len(want) >= 40
    assert sum(met) < 400  # of 1,600 and more that share the passage


def block_of(queries, targets):
    """All pairs of texts of numbers, as a block of pairs and texts; targets are named from the last on."""
    texts = [("query", k, k, w) for k, w in enumerate(queries)] + [("target", 1000 + k, len(targets) - k, w) for k, w in enumerate(targets)]
    pairs = pa.table({"query": [q for q in range(len(queries)) for _ in targets], "target": [1000 + t for _ in queries for t in range(len(targets))]})
    return pairs, pa.table({"side": [t[0] for t in texts], "seq": [t[1] for t in texts], "id": [t[2] for t in texts], "words": pa.array([t[3] for t in texts], pa.list_(pa.int64()))})


def best_of_block(rows, n_targets):
    out = {}
    for r in rows.to_pylist():
        if r["columns"] and round(r["matches"] / r["columns"], 6) >= 0.9:
            key = (-round(min(r["span_query"] / r["n_query"], r["span_target"] / r["n_target"]), 6), n_targets - (r["target"] - 1000), -round(r["matches"] / r["columns"], 6))
            out[r["query"]] = min(out.get(r["query"], key), key)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_pairs_left_out_of_a_block_hold_no_best_hit(seed):
    """Common words, repeated lines, near copies, fragments and shared passages: the best hits are those of all alignments."""
    rng = random.Random(seed)
    common = [rng.randrange(1 << 40) for _ in range((3, 8, 30)[seed % 3])]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else rng.randrange(1 << 40)
    fresh = lambda n: [word() for _ in range(n)]
    passages, line = [fresh(k) for k in (6, 9, 13, 30)], fresh(7)
    base = [fresh(rng.randint(3, 120)) for _ in range(6)]

    def made():
        kind, b = rng.randrange(6), list(rng.choice(base))
        if kind == 0:
            return fresh(rng.randint(1, 60)) + rng.choice(passages) + fresh(rng.randint(0, 60))
        if kind == 1:
            return fresh(rng.randint(0, 20)) + line * rng.randint(2, 40) + fresh(rng.randint(0, 20))
        if kind == 2:
            return b[rng.randint(0, len(b) // 2) :]
        if kind == 3:
            return b + rng.choice(passages) + b[: len(b) // 2]
        return [w if rng.random() > 0.06 else word() for w in b if rng.random() > 0.02] or b

    queries, targets = [made() for _ in range(25)], [made() for _ in range(60)]
    pairs, texts = block_of(queries, targets)
    whole, few = (alignment._align_block(pairs, texts, best) for best in (False, True))
    assert best_of_block(few, len(targets)) == best_of_block(whole, len(targets)) != {}
    assert few.num_rows < 0.7 * whole.num_rows


def test_texts_of_one_passage_are_not_all_aligned():
    """Each query shares a passage with 200 targets that are shorter: all cover as much, so the least id wins and one alignment shows it."""
    rng = random.Random(3)
    fresh = lambda n: [rng.randrange(1 << 40) for _ in range(n)]
    passage = fresh(13)
    queries, targets = [fresh(70) + passage + fresh(30) for _ in range(10)], [fresh(rng.randint(0, 50)) + passage + fresh(rng.randint(0, 50)) for _ in range(200)]
    pairs, texts = block_of(queries, targets)
    found = alignment._align_block(pairs, texts, True)
    assert best_of_block(found, 200) == {q: (-round(13 / 113, 6), 1, -1.0) for q in range(10)}
    assert found.num_rows <= 20  # of 2,000 pairs


def test_bands_of_one_text_with_many_are_those_of_each_pair():
    rng = random.Random(8)
    for kinds in (3, 40, 1 << 40):
        texts = [np.array([rng.randrange(kinds) for _ in range(rng.randint(5, 40))], np.int64) for _ in range(30)]
        texts += [np.array([*texts[0][:20], *texts[1][5:], *texts[0][3:]]), texts[0]]
        found = alignment._bands(alignment._indexed(texts[0]), [alignment._indexed(t)[0] for t in texts])
        assert len(found) >= 2 and all(edges == alignment._shared(texts[0], texts[k]) for k, edges in found.items())


def test_seeds_are_numbered_from_the_rarest_of_all_texts(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BUCKET_SEEDS", 50)
    rng = random.Random(9)
    line = [rng.randrange(-(1 << 40), 1 << 40) for _ in range(9)]
    texts = {s: [(k, [rng.randrange(6) for _ in range(rng.randint(0, 12))] + line * (k % 3)) for k in range(20)] for s in ("query", "target")}
    frames = [spark.createDataFrame(texts[s], "seq long, words array<long>") for s in ("query", "target")]
    runs = [(s, q, len(w), place, w[place : place + 5]) for s in texts for q, w in texts[s] for place in range(max(len(w) - 4, 1)) if w]
    seeds = [r.h for r in spark.createDataFrame([(k, r[4]) for k, r in enumerate(runs)], "k long, w array<long>").selectExpr("k", "xxhash64(w) h").orderBy("k").collect()]
    rows, sides = {}, {}
    for (s, *_), h in zip(runs, seeds):
        rows[h] = rows.get(h, 0) + 1
        sides.setdefault(h, set()).add(s)
    want, mine = [], {}
    for (s, q, n, place, _), h in zip(runs, seeds):
        if len(sides[h]) == 2:
            mine.setdefault((s, q, n), []).append((rows[h], h, place))
    for (s, q, n), found in mine.items():
        want += [(s, q, n, h, r, len(found)) for r, (_, h, _) in enumerate(sorted(found), 1)]
    assert sorted(map(tuple, alignment.seed_ranks(*frames).collect())) == sorted(want)


# nearest rows through cells


def gathered_vectors(rng, n, noise):
    heads = rng.normal(size=(6, 16))
    return heads[rng.integers(0, 6, n)] + noise * rng.normal(size=(n, 16))


@pytest.mark.parametrize("noise", [0.1, 3.0])
def test_nearest_by_cosine_is_exact_and_spares_gathered_rows(spark, monkeypatch, noise):
    monkeypatch.setattr(vectors, "FIRST_ROWS", 40)
    x = gathered_vectors(np.random.default_rng(3), 600, noise)
    x[5], x[6] = x[7], 0.0
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vector array<double>")
    found = {r.query_id: r for r in vectors.nearest_by_cosine(rows.where("id % 7 = 0"), rows).collect()}
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    cosine = np.round(u @ u.T, 9)
    for q in range(0, 600, 7):
        mine = cosine[q].copy()
        mine[q] = -2
        assert found[q].score == pytest.approx(mine.max(), abs=2e-9) and mine[found[q].id] >= mine.max() - 2e-9
    met = sum(r.met for r in found.values()) / (len(found) * 599)
    assert met < 0.4 if noise < 1 else met <= 1.0


def test_nearest_by_overlap_is_exact_for_every_row(spark):
    rng = random.Random(6)
    bits = lambda: [sum(1 << k for k in range(32) if rng.random() < p) for p in [rng.choice([0.1, 0.5, 0.8])] * 2]
    rows = [(k, bits()) for k in range(300)] + [(300, [0, 0]), (301, [0, 0])]
    frame = spark.createDataFrame(rows, "id long, bits array<long>")
    found = {r.query_id: (r.id, r.score) for r in vectors.nearest_by_overlap(frame.where("id % 4 = 0"), frame.where("id % 4 <> 0")).collect()}

    def overlap(a, b):
        both, either = sum((x & y).bit_count() for x, y in zip(a, b)), sum((x | y).bit_count() for x, y in zip(a, b))
        return both / either if either else 0.0

    for q, a in rows:
        if q % 4 == 0:
            score, best = max((overlap(a, b), -t) for t, b in rows if t % 4)
            assert found[q] == (-best, pytest.approx(score))


def test_projection_of_whole_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 8))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(50, None), (51, [1.0])], "id long, vector array<double>")
    mean, scale = vectors.frozen_scale(rows.where("id < 50"), "vector", 8)
    layers = (rng.normal(size=(5, 8)), rng.normal(size=5), rng.normal(size=(3, 5)), rng.normal(size=3))
    found = {r.id: r.projected for r in vectors.project(rows, vectors.Projection(mean, scale, *layers)).collect()}
    z = (x - x.mean(0)) / x.std(0)
    want = np.maximum(z @ layers[0].T + layers[1], 0) @ layers[2].T + layers[3]
    assert np.allclose([found[k] for k in range(50)], want) and found[50] is None and found[51] is None


# order statistics


@pytest.mark.parametrize("few", [10_000, 40])
def test_quantiles_equal_those_of_sorted_values(spark, monkeypatch, few):
    monkeypatch.setattr(ranks, "FEW_ROWS", few)
    monkeypatch.setattr(ranks, "BINS", 64)
    rng = random.Random(7)
    draw = {"a": lambda: rng.gauss(0, 1), "b": lambda: float(rng.randrange(4)), "c": lambda: 10 ** rng.uniform(-4, 4), None: lambda: 2.0}
    rows = [(g, f()) for g, f in draw.items() for _ in range(150)] + [("one", -1.5), ("a", None), ("a", float("nan"))]
    found = ranks.quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", {"p10": 0.1, "median": 0.5, "most": 1.0})
    index = ranks.quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", {"p90": 0.9}, between=False)
    for r in found.collect():
        mine = sorted(x for g, x in rows if g == r.g and x is not None and not math.isnan(x))
        assert r.n == len(mine) and [r.p10, r.median, r.most] == pytest.approx([np.percentile(mine, 10), np.percentile(mine, 50), mine[-1]])
    for r in index.collect():
        mine = sorted(x for g, x in rows if g == r.g and x is not None and not math.isnan(x))
        assert r.p90 == mine[int(0.9 * (len(mine) - 1))]


def test_evenly_spaced_rows_by_rank(spark):
    rows = [(k, k * 37 % 10) for k in range(95)]
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    found = ranks.evenly_spaced(spark.createDataFrame(rows, "id long, n long"), "n", "id", 9)
    assert sorted((r.place, r.id, r.n) for r in found.collect()) == [(p, *order[p * 95 // 9]) for p in range(9)]
    assert ranks.evenly_spaced(spark.createDataFrame(rows[:3], "id long, n long"), "n", "id", 9).count() == 3
    assert ranks.evenly_spaced(spark.createDataFrame([], "id long, n long"), "n", "id", 9).count() == 0


@pytest.mark.parametrize("up, n", [(0, 1), (3, 10), (5, 10), (480, 1000), (500, 1000), (49_700, 100_000), (4_999_000_000, 10_000_000_000), (10, 6_000_000_000), (2_999_900_000, 6_000_000_000)])
def test_sign_test_of_any_size(spark, up, n):
    got = spark.createDataFrame([(up, n)], "up long, n long").select(statistics.sign_test(F.col("up"), F.col("n"))).first()[0]
    few = min(up, n - up)
    if n <= 100_000:
        log = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2) for k in range(few + 1)]
        assert got == pytest.approx(min(1.0, 2 * sum(map(math.exp, log))), rel=1e-6)
    else:
        assert got == pytest.approx(min(1.0, math.erfc(-(few + 0.5 - n / 2) / math.sqrt(n / 2))), abs=1e-5)


@pytest.mark.parametrize("n", [1, 2, 31, 32, 33, 1000, 3_000_000])
def test_harmonic_sums(spark, n):
    got = spark.createDataFrame([(n,)], "n long").select(metrics.harmonic(F.col("n"))).first()[0]
    assert got == pytest.approx(math.fsum(1 / k for k in range(1, n + 1)), rel=1e-13)


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_groups_equal_the_plain_rule(spark, seed):
    rng = random.Random(seed)
    fractions = [(0.7, 0.1, 0.2), (0.4, 0.4, 0.2), (0.25, 0.25, 0.5), (0.34, 0.33, 0.33)][seed]
    sizes = {f"g{k:04d}": rng.choice([1, 1, 1, 2, 5, 5, 17]) for k in range(rng.choice([7, 60, 400]))}
    pairs = spark.createDataFrame([(g, k) for g, n in sizes.items() for k in range(n)] + [(None, 1)], "grp string, item long")
    got = {r.grp: r.part for r in splits.greedy_groups(pairs, "grp", "s", fractions).select("grp", "part").distinct().collect()}
    whole, shares = splits._shares(fractions)
    left, total = list(shares), sum(sizes.values()) + 1
    left = [s * total for s in shares]
    want = {}
    for g, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        k = splits._prefer(g, [k for k in range(3) if left[k] == max(left)], "s")
        left[k] -= n * whole
        want[g] = splits.PARTS[k]
    assert got == want


# releases as keyed state


def test_releases_go_through_their_states_and_restart(spark, tmp_path):
    def arrive(*rows):
        events = spark.createDataFrame(rows, "release string, digest string, event string, t string").selectExpr("release", "digest", "event", "cast(t as timestamp) as at")
        events.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        found = arrivals.run_release_machine(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
        return sorted((r.release, r.digest, r.state) for r in found.collect())

    one = [("a", "1", "absent"), ("b", "4", "absent"), ("b", "5", "conflict")]
    assert arrive(*[(r, d, "arrived", "2024-01-01 00:00:00") for r, d in (("a", "1"), ("a", "1"), ("b", "5"), ("b", "4"))]) == one
    two = [*one, ("a", "1", "unparsed")]  # each call starts the stream anew on the state that the last one left
    assert arrive(("a", "1", "arrived", "2024-01-01 01:00:00"), ("a", "1", "finished", "2024-01-01 02:00:00")) == sorted(two)
    three = [*two, ("a", "1", "ingested"), ("a", "2", "conflict"), ("b", "4", "stalled")]
    assert arrive(("a", "1", "arrived", "2024-01-01 03:00:00"), ("a", "2", "arrived", "2024-01-05 03:00:00")) == sorted(three)


# table functions


def test_entries_of_sparse_maps_come_by_batches(spark):
    from corroborate.operators import hooks

    rows = [(1, {"b": "x", "a": " "}), (2, {}), (3, None), (4, {"odd": "y", "c": None})] + [(k, {"c": str(k)}) for k in range(10, 60)]
    source = spark.createDataFrame(rows, "line_no long, payload map<string,string>").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        made = hooks.payload_entries(source, ["a", "b", "c"], "line_no")
        assert made.columns == ["line_no", "key", "value", "ordinal"]
        got = sorted(map(tuple, made.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    place = {"a": 0, "b": 1, "c": 2}
    assert got == sorted(((k, n, v, place.get(n)) for k, m in rows for n, v in (m or {}).items()), key=str)


# arrivals


def test_each_arrival_is_one_batch_however_many_files(spark, tmp_path):
    """Days of a month, each arrival in several files: no day's rows are late, and a batch is an arrival."""
    from corroborate.plans.stream_plans import run_arrivals
    from corroborate.streaming import arrivals

    source = spark.range(900).repartition(5).selectExpr("cast(timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id % 30 as int), 1) as timestamp) as ts")
    out, checkpoint = f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint"
    run_arrivals(spark, source, "month", arrivals.period_counts, "update", out, checkpoint, by="ts")
    got = {r.period.day: r.n for r in arrivals.latest(spark, out, ["period"]).collect()}
    assert got == {d: 30 for d in range(1, 31)}
    assert spark.read.option("basePath", out).parquet(out).where("n > 0").select("batch").distinct().count() == 3


def test_the_last_row_of_a_null_key_is_kept(spark, tmp_path):
    from corroborate.streaming import arrivals

    for k, rows in enumerate(([("a", 1), (None, 2)], [(None, 5)])):
        spark.createDataFrame(rows, "key string, n long").write.parquet(f"file://{tmp_path}/batch={k}")
    assert sorted(map(tuple, arrivals.latest(spark, f"file://{tmp_path}", ["key"]).collect()), key=str) == [("a", 1), (None, 5)]


def test_near_homologs_of_texts_that_share_a_passage_only(spark, tmp_path):
    """SPL15: of the texts that share a passage the least id is the hit and lies outside the stratum; a near copy lies within."""
    from corroborate.plans import registry

    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    passage, copied = fresh(13), fresh(40)
    rows = [(k, fresh(90) + passage) for k in (5, 10)] + [(15, copied + fresh(2)), (20, fresh(30)), (25, [])]
    rows += [(k, fresh(20) + passage) for k in range(101, 150) if k % 5] + [(151, copied)]
    spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.id: (r.target, r.near_homolog) for r in registry.queries()["SPL15"](spark, str(tmp_path)).collect()}
    assert found == {5: (101, False), 10: (101, False), 15: (151, True), 20: (None, False), 25: (None, False)}
