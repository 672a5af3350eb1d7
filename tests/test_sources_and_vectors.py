"""Line numbers, quarantine, records, clusters, shortlists and tests over groups on small rows."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corroborate.operators import clustering, hooks, statistics, vectors
from corroborate.sources import releases


def test_line_numbers_are_gapless_in_order(spark):
    lines = spark.range(500).select((F.col("id") * 7919 % 1000).alias("k"))
    numbered = releases.numbered_lines(lines.repartition(5), ["k"]).orderBy("line_no").collect()
    assert [r.line_no for r in numbered] == list(range(2, 502))
    assert [r.k for r in numbered] == sorted(r.k for r in numbered)


def test_every_line_is_loaded_or_in_quarantine_and_comes_back(spark):
    raw = [b"a\tb\tc", b"a\t\tc\r", b"a\tb", b"a\tb\xff\tc", b"\t\t", b" \tb\tc"]
    lines = spark.createDataFrame([(k + 2, bytearray(x)) for k, x in enumerate(raw)], "line_no long, raw binary")
    good, bad = releases.split_lines(lines, 3)
    rows = releases.to_payload(good, ["x", "y", "z"])
    assert {r.line_no: (r.rule, r.byte_length) for r in bad.collect()} == {4: ("field_count", 3), 5: ("invalid_utf8", 6)}
    back = {r.line_no: r.t for r in rows.select("line_no", releases.reconstruct(F.col("payload"), ["x", "y", "z"]).alias("t")).collect()}
    assert back == {k + 2: raw[k].decode() for k in (0, 1, 4, 5)}
    found = releases.reconciliation(lines, ["x", "y", "z"]).first()
    assert found.reconciles and (found.n_lines, found.n_loaded, found.n_excluded, found.n_invalid_utf8, found.n_field_count) == (6, 4, 2, 1, 1)


def test_records_are_put_together_in_order(spark):
    lines = [("f", 1, ">one"), ("f", 2, "AC"), ("f", 3, "GT"), ("f", 4, ">empty"), ("f", 5, ">two"), ("f", 6, "TT"), ("g", 1, "lost"), ("g", 2, ">three"), ("g", 3, "A")]
    good, bad = releases.fasta_records(spark.createDataFrame(lines, "file string, line_no int, text string").repartition(3))
    assert sorted((r.file, r.description, r.sequence, r.length) for r in good.collect()) == [("f", "one", "ACGT", 4), ("f", "two", "TT", 2), ("g", "three", "A", 1)]
    assert [r.description for r in bad.collect()] == ["empty"]


def test_sequences_cluster_with_their_near_copies(spark):
    rng = random.Random(1)
    base = [[f"w{rng.randrange(500)}" for _ in range(80)] for _ in range(3)]
    docs = [(10 * g + k, " ".join([*base[g], f"end{k}"])) for g in range(3) for k in range(4)] + [(90, None), (91, "a b")]
    got = {r.id: r.cluster for r in clustering.cluster_sequences(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[10 * g + k] == 10 * g for g in range(3) for k in range(4)) and got[90] == 90 and got[91] == 91


def test_clusters_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts = []
    for _ in range(6):  # drafts that grow
        draft = fresh(400)
        texts += [draft[:n] for n in range(100, 401, 10)]
    for _ in range(6):  # a pair of similarity 88 / 104 beside longer texts that quote it
        passage = fresh(100)
        texts += [passage, [*passage[:92], *fresh(8)]]
        texts += [[*fresh(20), *passage, *fresh(20)] for _ in range(20)]
    rng.shuffle(texts)
    texts = [[f"É{w}" if k % 2 else f"é{w}" for w in t] for k, t in enumerate(texts)]
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in ([w.lower() for w in t] for t in texts)]
    least = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common >= 0.75 * (len(sets[a]) + len(sets[b]) - common) and least[a] != least[b]:
                lo, hi = sorted((least[a], least[b]))
                least = [lo if x == hi else x for x in least]
    assert len(set(least)) == 6 + 6 * 21
    docs = spark.createDataFrame([*((k, " ".join(t)) for k, t in enumerate(texts)), (None, " ".join(texts[0]))], "doc_id long, text string")
    got = [(r.id, r.cluster) for r in clustering.cluster_sequences(docs).collect()]
    assert sorted(got, key=str) == sorted([*enumerate(least), (None, None)], key=str)


def test_blocks_give_what_the_broadcast_gives(spark, monkeypatch):
    rng = random.Random(2)
    rows = spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(6)]) for k in range(80)], "id long, vector array<double>")
    score = lambda: sorted(map(tuple, vectors.scored(rows.where("id < 20"), rows).collect()))
    direct = score()
    monkeypatch.setattr(vectors, "BROADCAST_ROWS", 5)
    assert score() == direct and len(direct) == 20 * 79


def test_diverse_pick_keeps_unlike_rows_in_order(spark):
    library = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.99, 0.1]), (3, [0.0, 1.0]), (4, [-1.0, 0.0])], "id long, vector array<double>")
    ranked = spark.createDataFrame([(0, k, k) for k in (1, 2, 3, 4)], "query_id long, id long, rank int")
    got = {r.id: r.outcome for r in vectors.diverse(ranked, library, 2, 0.5).collect()}
    assert got == {1: "kept", 2: "too_similar", 3: "kept", 4: "beyond_requested_count"}


def test_costly_functions_see_new_keys_once(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "k0 string")
    known = spark.createDataFrame([("a", "known")], "k string, made string")
    got = sorted((r.k0 or "", r.made or "") for r in hooks.map_entities(rows, "k0", lambda k: k.upper(), "made", known).collect())
    assert got == [("", ""), ("a", "known"), ("a", "known"), ("b", "B")]


def test_signed_rank(spark):
    deltas = [0.3, -0.1, 0.2, 0.2, 0.0, 0.5, -0.2]
    got = statistics.signed_rank(spark.createDataFrame([(d,) for d in deltas], "d double"), "d").first()
    ranks = pd.Series([abs(d) for d in deltas if d]).rank()
    assert (got.n, got.n_up) == (6, 4)
    assert got.w_plus == pytest.approx(sum(r for r, d in zip(ranks, [d for d in deltas if d]) if d > 0))
