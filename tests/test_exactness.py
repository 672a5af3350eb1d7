"""Operators against plain mirrors: order-dependent rules, rank statistics, replays and refused versions."""

from __future__ import annotations

import hashlib
import html
import math
import random

import pytest
from pyspark.sql import functions as F

from corroborate.functions import entities
from corroborate.functions import evidence as fn
from corroborate.operators import metrics, snapshots, splits, statistics, vectors
from corroborate.sources import releases as rel
from corroborate.streaming import arrivals


def test_greedy_groups_equal_the_plain_rule_for_many_groups(spark):
    rng = random.Random(1)
    sizes = {f"g{k}": rng.choice([1, 1, 1, 2, 3, 9, 40]) for k in range(5000)}
    pairs = spark.createDataFrame([(g, k) for g, n in sizes.items() for k in range(n)], "grp string, item long")
    got = {r.grp: r.part for r in splits.greedy_groups(pairs, "grp", "s").select("grp", "part").distinct().collect()}
    left = [f * sum(sizes.values()) for f in (7, 1, 2)]  # in tenths: quotas compare exactly
    for g, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        k = max(range(3), key=lambda k: (left[k], hashlib.sha256(f"{g}|{splits.PARTS[k]}|s".encode()).digest()))
        left[k] -= 10 * n
        assert got[g] == splits.PARTS[k]


@pytest.mark.parametrize("seed", [1, 2])
def test_concordance_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(f"g{rng.randrange(4)}", float(rng.randrange(9)), rng.randrange(6) / 5) for _ in range(300)] + [("one", 1.0, 1.0), ("flat", 2.0, 0.1), ("flat", 2.0, 0.9)]
    got = {r.g: r.concordance for r in metrics.concordance(spark.createDataFrame(rows, "g string, y double, s double"), "g", "y", "s").collect()}
    for g in {r[0] for r in rows}:
        mine = [(y, s) for h, y, s in rows if h == g]
        won = [1.0 if a[1] > b[1] else 0.5 if a[1] == b[1] else 0.0 for a in mine for b in mine if a[0] > b[0]]
        assert got[g] == (pytest.approx(sum(won) / len(won)) if won else None)
    capped = metrics.concordance(spark.createDataFrame(rows, "g string, y double, s double"), "g", "y", "s", cap=2)
    assert capped.where("n > 2 and concordance is not null").count() == 0


def test_signed_ranks_and_sign_test(spark):
    rng = random.Random(3)
    deltas = [rng.randrange(-9, 14) / 10 for _ in range(80)] + [None]
    row = statistics.signed_rank(spark.createDataFrame([(d,) for d in deltas], "d double"), "d").first()
    known = sorted(d for d in deltas if d is not None)
    moved = [d for d in known if d]
    rank = {a: (sum(abs(x) < a for x in moved) + 1 + sum(abs(x) <= a for x in moved)) / 2 for a in {abs(x) for x in moved}}
    assert (row.n, row.n_up, row.n_groups) == (len(moved), sum(d > 0 for d in moved), len(known))
    assert row.w_plus == pytest.approx(sum(rank[abs(d)] for d in moved if d > 0))
    few = min(row.n_up, row.n - row.n_up)
    assert row.sign_p == pytest.approx(min(1.0, 2 * sum(math.comb(row.n, k) for k in range(few + 1)) / 2**row.n))
    assert row.median == pytest.approx((known[39] + known[40]) / 2)


@pytest.mark.parametrize(("up", "n"), [(0, 0), (0, 7), (7, 7), (3, 6), (900, 2000)])
def test_sign_test_of_few_and_of_many(spark, up, n):
    got = spark.range(1).select(statistics.sign_test(F.lit(up).cast("long"), F.lit(n).cast("long"))).first()[0]
    assert got == pytest.approx(min(1.0, 2 * sum(math.comb(n, k) for k in range(min(up, n - up) + 1)) / 2**n), rel=1e-9)


def mirror_pairs(gone, new):
    """Occurrence by occurrence, in order: the plain reading of the rule."""
    gone, new = [list(x) for x in gone], [list(x) for x in new]
    found = []
    while gone and new:
        if gone[0][0] == new[0][0]:
            (gone if gone[0][3] <= new[0][3] else new).pop(0)
            continue
        found.append((gone[0][1:3], new[0][1:3]))
        for side in (gone, new):
            side[0][3] -= 1
            if not side[0][3]:
                side.pop(0)
    return found


def test_ambiguous_moves_are_paired_by_place(spark):
    rng = random.Random(4)
    rows = [
        (rng.randrange(3), 0, "KI", "=", 5.0 * rng.randrange(2), f"p{rng.randrange(4)}", 0.0, 0.0, "N", rng.choice([None, 7, 8]), rng.choice([None, "r1", "r2"]), rng.choice(["removal", "addition"]), True, rng.choice([None, "ambiguous", "entry_doi"]))
        for _ in range(160)
    ]
    schema = "item long, grp int, mtype string, rel string, v double, pub string, ph double, temp double, src string, doi long, rsid string, kind string, surplus boolean, link string"
    got = {(r.item, r.v): r for r in snapshots.pair_up(spark.createDataFrame(rows, schema)).collect()}
    groups = {}
    for item, _, _, _, v, pub, ph, temp, src, doi, rsid, kind, _, link in rows:
        if link != "entry_doi":
            record = (f"{pub}|{ph}|{temp}|{src}", -1 if doi is None else doi, rsid or "")
            sides = groups.setdefault((item, v), {"removal": {}, "addition": {}})
            sides[kind][record] = sides[kind].get(record, 0) + 1
    groups = {k: g for k, g in groups.items() if g["removal"] and g["addition"] and len(g["removal"]) + len(g["addition"]) > 2}
    assert set(got) == set(groups) and groups
    for key, sides in groups.items():
        gone, new = ([(*r, n) for r, n in sorted(sides[k].items())] for k in ("removal", "addition"))
        pairs = mirror_pairs(gone, new)
        r = got[key]
        assert (r.shape, r.n_gone, r.n_new, r.paired) == (f"{len(gone)}x{len(new)}", sum(x[3] for x in gone), sum(x[3] for x in new), len(pairs))
        assert (r.doi_both, r.doi_same) == (sum(a[0] != -1 != b[0] for a, b in pairs), sum(a[0] == b[0] != -1 for a, b in pairs))
        assert (r.rsid_both, r.rsid_same) == (sum(a[1] != "" != b[1] for a, b in pairs), sum(a[1] == b[1] != "" for a, b in pairs))


def test_a_replayed_batch_of_releases_gives_what_it_gave(spark, tmp_path):
    registry, target = f"file://{tmp_path}/registry", f"file://{tmp_path}/out"
    handle = arrivals.arrive_once(spark, registry, target)
    frame = lambda *rows: spark.createDataFrame(rows, "release string, digest string")
    read = lambda: sorted(tuple(r) for r in spark.read.option("basePath", target).parquet(target).select("batch", "release", "digest", "state").collect())
    batches = [frame(("a", "1"), ("a", "1"), ("b", "5"), ("b", "4")), frame(("a", "1"), ("a", "2"), ("c", "9")), frame(("c", "9"))]
    want = [(0, "a", "1", "absent"), (0, "b", "4", "absent"), (0, "b", "5", "conflict"), (1, "a", "1", "ingested"), (1, "a", "2", "conflict"), (1, "c", "9", "absent"), (2, "c", "9", "ingested")]
    for k, batch in enumerate(batches):
        handle(batch, k)
        handle(batch, k)  # the stream had not committed
    assert read() == want
    handle(batches[0], 0)
    assert read() == want


def test_versions_are_refused_when_superseded_changed_or_unknown(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5), (2, -0.5)], "id long, x double")
    content = lambda df: snapshots.set_digest(df, F.concat_ws(":", "id", "x"))
    rel.write_version(rows, f"file://{tmp_path}/v")
    rel.write_version(rows.withColumn("x", -F.col("x")), f"file://{tmp_path}/w")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        rel.write_version(rows, f"file://{tmp_path}/v")
    digest = content(rows).first()["digest"]
    registry = spark.createDataFrame([("old", f"file://{tmp_path}/v", digest, "new"), ("new", f"file://{tmp_path}/v", digest, None), ("changed", f"file://{tmp_path}/w", digest, None)], "name string, path string, digest string, superseded_by string")
    assert rel.load_version(registry, "new", content).count() == 2
    assert rel.load_version(registry, "old", content, allow_superseded=True).count() == 2
    for name, why in (("old", "superseded by new"), ("changed", "not those that were registered"), ("none", "no version none")):
        with pytest.raises(rel.VersionError, match=why):
            rel.load_version(registry, name, content)


@pytest.mark.parametrize("text", ["MKV\n", "\tMKV", "maß", " ab ", "é f", "", None])
def test_sequence_digest_strips_and_folds_as_unicode_does(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(fn.sequence_digest(F.col("t"))).first()[0]
    assert got == hashlib.sha256((text or "").strip().upper().encode("ascii", "ignore")).hexdigest()


def test_entities_are_decoded_as_the_library_does(spark):
    rng = random.Random(8)
    names = [*entities.NAMED, *entities.BARE]
    bit = lambda: rng.choice(["&", "&&", "a", ";", "é", " ", "<", "\n", "&" + rng.choice(names), "&" + rng.choice(names)[: rng.randint(1, 6)], "&" + rng.choice(list(entities.BARE)) + rng.choice(["", "x", "x;", ";"]), f"&#{rng.choice([0, 13, 65, 128, 150, 159, 1, 11, 127, 55296, 64976, 65534, 1114111, 1114112, 10**30, rng.randrange(1 << 20)])}", f"&#x{rng.randrange(1 << 21):X}", f"&#X{rng.randrange(1 << 8):x};", "&#", "&#x", "&#0065;", ";"])
    texts = ["a &lt; b &amp;amp; &eacute;&#x41;&#66; &nosuch; &", "", None, "&copy &notit;", *["".join(bit() for _ in range(rng.randint(1, 12))) for _ in range(3000)]]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(entities.decode_entities(F.col("t"))).collect()]
    assert [(t, g) for t, g in zip(texts, got) if g != (None if t is None else html.unescape(t))] == []


@pytest.mark.parametrize("header", ["", "a\tb\ta", "a\tc"])
def test_headers_are_checked_when_they_are_read(spark, tmp_path, header):
    spark.createDataFrame([(header,), ("1\t2",)], "value string").coalesce(1).write.text(f"file://{tmp_path}/r")
    with pytest.raises(ValueError):
        rel.read_release(spark, f"file://{tmp_path}/r", ["a", "b"])


def test_queries_beyond_a_broadcast_meet_every_row_once(spark, monkeypatch):
    rows = spark.createDataFrame([(k, [float(k % 7 - 3), float(k % 5 - 2), 1.0]) for k in range(60)], "id long, vector array<double>")
    plain = sorted(map(tuple, vectors.scored(rows.where("id % 2 = 0"), rows).collect()))
    monkeypatch.setattr(vectors, "BROADCAST_ROWS", 7)
    monkeypatch.setattr(vectors, "LIBRARY_ROWS", 11)
    assert sorted(map(tuple, vectors.scored(rows.where("id % 2 = 0"), rows).collect())) == plain and len(plain) == 30 * 59


def test_late_rows_are_counted_within_the_delay_alone(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    for days in ((1, 2, 2), (9, 8), (9,), (1, 7, 9)):
        spark.createDataFrame([(f"2024-01-{d:02d} 12:00:00",) for d in days], "t string").selectExpr("cast(t as timestamp) as ts").coalesce(1).write.mode("append").parquet(path)
    stream = arrivals.period_counts(arrivals.read_arrivals(spark, path, "ts timestamp"))
    out, checkpoint = f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint"
    arrivals.run_available(stream, "update", out, checkpoint)
    got = {r.period.day: r.n for r in arrivals.latest(spark, out, ["period"]).collect()}
    assert got == {1: 1, 2: 2, 8: 1, 9: 3, 7: 1}  # the second row of the first day came too late
