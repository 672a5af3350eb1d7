"""Merkle manifest, decontamination and prefix trie against plain versions, with their edge cases."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corroborate.llm import decontaminate, fmindex, merkle, midstate, prefix_trie
from corroborate.similarity import words

TURNS = "conv_id long, turn long, role string, text string"


def sorted_rows(rows):
    return sorted((tuple(r) for r in rows), key=str)


# hash states


def test_states_resume_as_hashlib_does():
    digests = [[hashlib.sha256(f"{i} {j}".encode()).digest() for j in range(4)] for i in range(9)]
    state = midstate.begin(9)
    for j in range(5):
        found = midstate.to_bytes(midstate.finish(state, j))
        for i in range(9):
            assert found[32 * i : 32 * i + 32] == hashlib.sha256("".join(d.hex() for d in digests[i][:j]).encode()).digest()
        if j < 4:
            written = midstate.from_bytes(midstate.to_bytes(state))  # a state that was stored goes on where it stood
            state = midstate.absorb(written, midstate.from_bytes(b"".join(d[j] for d in digests)))


# Merkle manifest


def doc_rows(n, langs=("en", "fr", None, "", "é"), seed=1):
    rng = random.Random(seed)
    return [(k, rng.choice(["a", None, "bé"]), rng.choice(langs), rng.choice([None, k, 7]), rng.choice([None, "", f"text {k}", "漢字 🙂"])) for k in rng.sample(range(10 * n), n)]


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("arity", [2, 3])
def test_leaves_proofs_and_folds_equal_whole_levels(spark, arity):
    rows = [*doc_rows(300), (None, "s", "en", 3, "no id"), (None, None, None, None, None), (5000, "s", "en", 1, "same id"), (5000, "s", "en", 1, "same id, other text"), (5001, "s", "en", 2, "twice"), (5001, "s", "en", 2, "twice"), (14, "s", "one", (1 << 63) - 1, "x" * 100_000)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "lang as digest", "lang as idx", "lang as grp").repartition(5)
    found = sorted_rows(merkle.prove_documents(docs, arity).collect())
    assert found == sorted_rows(merkle.brute_force(rows, arity))
    assert 0 < sum(not r[-1] for r in found) < len(found) / 3


def test_groups_of_several_tiers(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 16)
    rows = [*doc_rows(300, ("en",), 3), *[(20_000 + k, "s", f"l{k}", 1, "alone") for k in range(20)]]
    found = merkle.prove_documents(spark.createDataFrame(rows, DOCS))
    assert sorted_rows(found.collect()) == sorted_rows(merkle.brute_force(rows))


def test_no_leaf_and_one_leaf(spark):
    assert merkle.prove_documents(spark.createDataFrame([], DOCS)).count() == 0
    only = merkle.prove_documents(spark.createDataFrame([(1, "s", "en", 1, "t")], DOCS)).first()
    assert only.leaf == only.subroot == only.root == only.folded_root and only.proof_sha256 == hashlib.sha256(b"").hexdigest() and only.verified


def test_a_fold_takes_no_left_sibling():
    leaves = midstate.from_bytes(b"".join(hashlib.sha256(bytes([k])).digest() for k in range(23)))
    tree = merkle.Subtree(leaves, merkle.levels_of(23, 4), 4)
    path = tree.path(22)
    slots = [slot for slot, *_ in merkle.read_path(path)]
    assert slots == [2, 1, 1]
    lost = bytearray(path)  # siblings to the left may be lost: the stored states stand for them
    at = 0
    for slot, size, *_ in merkle.read_path(path):
        lost[at + 34 : at + 34 + 32 * slot] = bytes(32 * slot)
        at += 34 + 32 * (size - 1)
    assert (merkle.resume(bytes(lost), leaves[:, 22:]) == tree.nodes[-1]).all()


# FM-index and decontamination


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=30), min_size=1, max_size=6), st.lists(st.lists(st.integers(0, 4), max_size=6), min_size=1, max_size=12))
def test_index_finds_every_phrase_at_every_place(texts, phrases):
    hashed = lambda xs: np.array(xs, np.uint64) * np.uint64(7919) + np.uint64(11)
    sizes = np.array([len(t) for t in texts])
    index = fmindex.FMIndex.build(hashed([w for t in texts for w in t]), np.concatenate(([0], np.cumsum(sizes))))
    flat, lens = hashed([w for p in phrases for w in p]), np.array([len(p) for p in phrases])
    live, low, high = index.search(flat, np.cumsum(lens) - lens, lens)
    found = {int(k): sorted(zip(*(x.tolist() for x in index.locate(np.arange(a, b))))) for k, a, b in zip(live, low, high)}
    for k, phrase in enumerate(phrases):
        want = [(t, p) for t, text in enumerate(texts) for p in range(len(text) - len(phrase) + 1) if phrase and text[p : p + len(phrase)] == phrase]
        assert found.get(k, []) == want


def test_suffixes_of_long_copies_are_sorted():
    one = np.tile(np.arange(1, 6), 400)
    symbols = np.concatenate((one, [0], one, [0], one[7:], [0]))
    ends, order = np.cumsum(symbols == 0), fmindex.suffix_order(symbols)
    key = lambda p: [(0, int(ends[q])) if symbols[q] == 0 else (1, int(symbols[q])) for q in range(p, p + int(np.argmax(symbols[p:] == 0)) + 1)]
    some = order[:: len(order) // 300]
    assert all(key(a) < key(b) for a, b in zip(some, some[1:]))
    assert sorted(order.tolist()) == list(range(len(symbols)))


def bench_cases():
    rng = random.Random(2)
    word = lambda: rng.choice(["alpha", "Beta", "gamma", "δέλτα", "x9", "漢字", "no"])
    passages = [" ".join(word() for _ in range(rng.randint(10, 30))) for _ in range(12)]
    bench = [(k, p) for k, p in enumerate(passages)] + [(12, passages[3]), (100, "two words"), (101, "..."), (102, None), (None, "nameless item here"), (103, "Two, WORDS!"), (7, "another text of item seven"), (104, passages[5] + " " + passages[6]), (105, "unter-wegs")]
    docs = [(k, f"{word()} {rng.choice(passages)} {word()}; {' '.join(word() for _ in range(20))}") for k in range(60)]
    docs += [(60, None), (61, ""), (62, "two words"), (63, "a nameless ITEM here"), (63, "same id: two... words"), (None, passages[0]), (64, passages[0].upper()), (65, passages[1].replace(" ", "\n--")), (66, "word " * 40_000 + passages[2]), (67, "two " * 12), (68, "unter wegs unterwegs")]
    return docs, bench


@pytest.mark.parametrize("block_words", [1 << 22, 150])
def test_hits_and_items_equal_brute_force(spark, make_docs, block_words, monkeypatch):
    docs, bench = bench_cases()
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 9 if block_words == 150 else 1 << 16)
    items = spark.createDataFrame(bench, "item_id long, text string").selectExpr("*", "text as sequence", "text as words")
    found = decontaminate.decontaminate(make_docs(docs).repartition(3), items, block_words=block_words)
    assert sorted_rows(found.drop("spans").collect()) == sorted_rows(decontaminate.brute_force(docs, bench))
    for r in found.collect():  # the spans to cut are apart, in order, and hold the words that are hit
        spans = [(s["start"], s["end"]) for s in r["spans"]]
        assert sum(b - a for a, b in spans) == r["n_hit"] and all(a < b for a, b in spans) and all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_empty_sides_of_decontamination(spark, make_docs):
    items = spark.createDataFrame([(1, "a few words")], "item_id long, text string")
    assert decontaminate.decontaminate(make_docs([]), items).count() == 0
    clean = decontaminate.decontaminate(make_docs([(1, "a few words")]), items.limit(0)).first()
    assert (clean.n_words, clean.n_hit, clean.n_items, clean.contaminated) == (3, 0, 0, False)


def test_words_that_a_polynomial_takes_for_one_are_told_apart():
    swap = str.maketrans("ab", "ba")
    word = "ab"
    while len(word) < 4096:
        word += word.translate(swap)
    for n in (16, 64, 65, 1024, 4096):
        one, two = word[:n], word[:n].translate(swap)
        data = np.frombuffer(f"{one} {two}".encode(), np.uint8)
        for other in (False, True):
            a, b = words.word_hashes(data, np.array([0, len(data)]), lower=False, other=other)[0]
            assert a != b


# prefix trie


def conversation_rows(seed=4, n=80):
    rng = random.Random(seed)
    say = lambda: (rng.choice(["user", "assistant", None]), rng.choice(["hi", "", None, "ça va?", "漢字", "why"]))
    rows = []
    for c in [*range(0, n), *range(100, 100 + n // 2), 305, -250, -200, 1 << 40]:
        rows += [(c, k, *say()) for k in range(rng.randint(1, 7))]
    first = [("user", f"turn {k}") for k in range(40)]
    for c in range(1000, 1030):  # many conversations that share a long beginning
        rows += [(c, k, *x) for k, x in enumerate(first[: rng.randint(30, 40)] + [say()])]
    for c in range(2000, 2040):  # and one that is repeated
        rows += [(c, k, "user", f"again {k}") for k in range(8)]
    return rows


@pytest.mark.parametrize("shard_nodes", [200_000, 60])
def test_nodes_equal_brute_force(spark, shard_nodes):
    rows = [*conversation_rows(), (7, None, "user", "no number"), (7, 0, "user", "same number"), (7, 0, "user", "same number"), (None, 1, "user", "no conversation"), (9, 99, "user", "long " * 30_000)]
    frame = spark.createDataFrame(rows, TURNS).selectExpr("*", "text as key", "text as node", "turn as depth").repartition(6)
    found = prefix_trie.prefix_trie(frame, parts=8, shard_nodes=shard_nodes)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(found.columns) == sorted(columns)
    assert sorted_rows(found.select(columns).collect()) == sorted_rows(prefix_trie.brute_force(rows))


def test_turnless_conversations_are_members_of_the_root(spark):
    rows = [(k, 0, "user", "x") for k in range(1, 12)]  # without a donor, those that take their first turn from it have none
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS))
    assert sorted_rows(found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()) == sorted_rows(prefix_trie.brute_force(rows))
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.booleans(), max_size=900))
def test_findclose_matches_a_stack(turns):
    bits, depth = [], 0
    for up in turns:
        if up or not depth:
            bits.append(True)
            depth += 1
        else:
            bits.append(False)
            depth -= 1
    bits = np.array(bits + [False] * depth, bool)
    if not len(bits):
        return
    stack, want = [], {}
    for k, up in enumerate(bits.tolist()):
        if up:
            stack.append(k)
        else:
            want[stack.pop()] = k
    opens = np.flatnonzero(bits)
    tree = prefix_trie.Parentheses(bits)
    assert tree.findclose(opens).tolist() == [want[k] for k in opens.tolist()]
    pairs = [k for k in opens.tolist() if want[k] == k + 1]
    assert (tree.leaf_rank[tree.findclose(opens)] - tree.leaf_rank[opens]).tolist() == [sum(a <= p < want[a] for p in pairs) for a in opens.tolist()]
