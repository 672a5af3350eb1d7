"""The pipeline's stages on a small corpus."""

from __future__ import annotations

import os
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as p
from corroborate.llm import mixing, packing, quality

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")
def test_stages_take_effect_and_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.count()]
    for name, stage in p.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), p_schema(spark))
        assert docs.columns == p.COLUMNS, name
        seen.append(docs.count())
    good, unique, apart = seen[1:4]
    assert seen[0] > good >= unique >= apart > 0
    packed = p.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").distinct().collect()}


def p_schema(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select(*p.COLUMNS).schema


def test_of_each_group_of_copies_one_stays(spark):
    rows = [(1, "same text here", "en", "s", 14), (2, "same text here", "en", "s", 14), (2, "same text here", "en", "s", 14), (3, None, "en", "s", None), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, p_docs())
    assert sorted(r.doc_id for r in p.drop_copies(spark, docs, SF).collect()) == [2, 4]
    near = " ".join(f"w{k}" for k in range(60))
    rows = [(5, near, "en", "s", 1), (6, near + " tail", "en", "s", 1), (7, "quite another text of seven words", "en", "s", 1), (None, "no name", None, None, None)]
    assert sorted(str(r.doc_id) for r in p.drop_near_copies(spark, spark.createDataFrame(rows, p_docs()), SF).collect()) == ["5", "7", "None"]


def test_each_text_without_an_id_or_with_a_shared_one_stays_once(spark):
    texts = [(None, "first"), (None, "second"), (None, "second"), (None, "third"), (None, "named too"), (9, "named too"), (7, "one text"), (7, "another text"), (7, "another text"), (-(1 << 63), "least id"), (None, None), (None, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in texts], p_docs()).repartition(4)
    kept = sorted((str(r.doc_id), r.text or "") for r in p.drop_copies(spark, docs, SF).collect())
    assert kept == sorted([("None", ""), ("None", "first"), ("None", "second"), ("None", "third"), ("9", "named too"), ("7", "one text"), ("7", "another text"), (str(-(1 << 63)), "least id")])


def test_near_copies_of_one_id_on_two_texts(spark):
    near, far = (" ".join(f"{c}{k}" for k in range(60)) for c in "wv")
    texts = [(3, near), (3, far), (4, near + " tail"), (5, far + " tail"), (6, "six"), (6, "half a dozen"), (8, far + " end"), (8, far + " End of it"), (2, far + " least id"), (6, ""), (6, "six")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in texts], p_docs())
    kept = sorted((r.doc_id, r.text) for r in p.drop_near_copies(spark, docs, SF).collect())
    assert kept == sorted([(3, near), (2, far + " least id"), (6, "six"), (6, "half a dozen"), (6, "")])


def test_run_equals_its_stages_by_brute_force(spark, tmp_path):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    texts = []
    for _ in range(60):
        base = [word() for _ in range(rng.randint(30, 90))]
        texts += [base, *([[*base[:-1], word()] for _ in range(rng.randrange(3))]), *([base] * rng.randrange(3))]
    rows = [(k, " ".join(t), "en", f"s{k % 3}", 1) for k, t in enumerate(texts)]
    rows += [(1000 + k, " ".join(word().upper() + "!!" for _ in range(60)), "en", "s0", 1) for k in range(40)]
    rows += [(None, rows[0][1], "en", "s1", 1), (None, "no id " * 20, "en", "s1", 1), (None, "none either " * 20, None, None, 1), (3, "a second text of an id " * 9, "en", "s2", 1)]
    docs = spark.createDataFrame(rows, p_docs())
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000), 0) for r in rows if r[0] is not None and r[0] != 3], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    got = p.run(spark, f"file://{tmp_path}").collect()

    kept = [r for r in rows if r[0] is None or r[0] < 1000]
    judged = quality.classify_quality(docs, labels).where("keep").select(*p.COLUMNS).collect()
    assert sorted(map(str, map(tuple, judged))) == sorted(map(str, kept))
    owner = {}
    for r in kept:
        best = owner.get(r[1])
        owner[r[1]] = r if best is None or (r[0] is not None and (best[0] is None or r[0] > best[0])) else best
    unique = list(owner.values())
    named = [r for r in unique if r[0] is not None]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (r[1].split() for r in named)]
    group = list(range(len(named)))
    for i in range(len(named)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    apart = [min((named[k] for k in range(len(named)) if group[k] == g), key=lambda r: r[0]) for g in set(group)] + [r for r in unique if r[0] is None]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", apart)
    mixed = con.execute(mixing.SQL).fetchall()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for doc_id, text, *_ in mixed:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, packing.END_ID], "<u4")
        want += [(doc_id, k, at, n, zlib.crc32(ids[at : at + n].tobytes())) for k, (at, n) in enumerate(packing.cut(len(ids), packing.CAPACITY))]
    assert sorted(map(str, [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got])) == sorted(map(str, want))
    assert len(mixed) > 40 and len(unique) > len(apart) > 50
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in map(sorted, bins.values()):
        assert all(a + n == (places[k + 1][0] if k + 1 < len(places) else a + n) for k, (a, n) in enumerate(places)) and sum(n for _, n in places) <= packing.CAPACITY


def test_stages_of_two_tables_may_interleave(spark):
    docs = [spark.createDataFrame([(k, f"text {k // 2} of {name}", "en", "s", 1) for k in range(6)], p_docs()) for name in ("one", "two")]
    first, second = (p.drop_copies(spark, d, SF) for d in docs)
    later = p.drop_near_copies(spark, second, SF)
    assert [sorted(r.doc_id for r in x.collect()) for x in (first, later, second)] == [[1, 3, 5]] * 3


def test_an_empty_table_passes_through(spark, tmp_path):
    spark.createDataFrame([], p_docs()).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert p.run(spark, f"file://{tmp_path}").count() == 0


def p_docs():
    return "doc_id long, text string, lang string, source string, n_chars long"
