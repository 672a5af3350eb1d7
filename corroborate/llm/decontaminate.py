"""Benchmark decontamination: each shard of the corpus is indexed, and the benchmark's word windows are searched in the index."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from ..similarity.common import salted_join, text_of, write_once
from ..similarity.words import text_groups, window_hashes, word_hashes
from .fmindex import FMIndex

WINDOW = 10
#: A shard closes at so many words; a longer text is a shard of its own.
SHARD_WORDS = 1 << 19
#: Benchmark words that are sent to all tasks at once, and the words of one piece of a long item.
BLOCK_WORDS, PIECE_WORDS = 1 << 22, 1 << 16
#: Windows that are searched together, and suffixes that are located together.
TOGETHER = 1 << 18
#: Bytes of words: digits, letters, and all of any character beyond ASCII.
ITEM_LETTERS = np.zeros(256, bool)
ITEM_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_PIECES = "item string, sequence long, piece int, words binary"
_FOUND = "row long, doc_id long, n_words long, spans array<struct<start:long,end:long>>, set_id binary, sequences array<long>"


def _pieces(window: int):
    """The words of each item as hashes, in pieces that overlap so that every window lies in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for first, end, data, bounds in text_groups(batch, 1):
                words, at = word_hashes(data, bounds, lower=True, letters=ITEM_LETTERS)
                for k in range(first, end):
                    mine = words[at[k - first] : at[k - first + 1]]
                    if not len(mine):
                        continue
                    sequence = int.from_bytes(hashlib.blake2b(mine.tobytes(), digest_size=8).digest(), "little", signed=True)
                    for n, a in enumerate(range(0, max(len(mine) - window + 1, 1), PIECE_WORDS)):
                        rows.append((items[k], sequence, n, mine[a : a + PIECE_WORDS + window - 1].tobytes()))
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary())
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["item", "sequence", "piece", "words"])

    return run


class _Phrases:
    """A block of benchmark pieces as one array of word hashes, with the place, size and sequence of each window."""

    def __init__(self, pieces: list[tuple[int, bytes]], window: int) -> None:
        arrays = [np.frombuffer(p, np.uint64) for _, p in pieces]
        sizes = np.array([len(a) for a in arrays], np.int64)
        self.words = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
        first = np.cumsum(sizes) - sizes
        n = np.maximum(sizes - window + 1, 1)
        self.starts = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.sizes = np.repeat(np.minimum(sizes, window), n)
        self.sequences = np.repeat(np.array([s for s, _ in pieces], np.int64), n)


def _occurrences(index: FMIndex, phrases: _Phrases) -> Iterator[tuple[np.ndarray, ...]]:
    """Text, place, size and phrase group of each occurrence, and the (group, sequence) pairs; equal phrases form a group."""
    for a in range(0, len(phrases.starts), TOGETHER):
        part = slice(a, a + TOGETHER)
        live, low, high = index.search(phrases.words, phrases.starts[part], phrases.sizes[part])
        if not len(live):
            continue
        # phrases of one size that are equal have the same suffixes, and only those
        key = low * (int(phrases.sizes.max()) + 1) + phrases.sizes[part][live]
        _, one, group = np.unique(key, return_index=True, return_inverse=True)
        pairs = np.unique(np.stack((group, phrases.sequences[part][live])), axis=1)
        size, count = phrases.sizes[part][live][one], (high - low)[one]
        for b in _cuts(count):
            rows = np.repeat(low[one][b], count[b]) + np.arange(count[b].sum()) - np.repeat(np.cumsum(count[b]) - count[b], count[b])
            text, place = index.locate(rows)
            yield text, place, np.repeat(size[b], count[b]), np.repeat(np.arange(len(one))[b], count[b]), pairs


def _cuts(count: np.ndarray) -> Iterator[slice]:
    """Slices of groups with about ``TOGETHER`` occurrences each."""
    total, first = np.cumsum(count), 0
    while first < len(count):
        end = int(np.searchsorted(total, (total[first - 1] if first else 0) + TOGETHER, "right"))
        end = max(end, first + 1)
        yield slice(first, end)
        first = end


def _merged(place: np.ndarray, size: np.ndarray) -> tuple[list[int], list[int]]:
    """The spans that these windows cover together, sorted and apart."""
    order = np.argsort(place, kind="stable")
    start, end = place[order], np.maximum.accumulate(place[order] + size[order])
    apart = np.append(True, start[1:] > end[:-1])
    return start[apart].tolist(), np.append(end[:-1][apart[1:]], end[-1]).tolist()


def _search_shard(words: np.ndarray, bounds: np.ndarray, phrases: _Phrases) -> tuple[dict[int, tuple[list[int], list[int], bytes]], dict[bytes, np.ndarray]]:
    """By text that is hit: spans and the name of its set of sequences; and each named set once."""
    spans: dict[int, list] = {}
    held: dict[int, list] = {}
    sets: dict[bytes, np.ndarray] = {}
    index = FMIndex.build(words, bounds)
    for text, place, size, group, pairs in _occurrences(index, phrases):
        order = np.lexsort((group, text))
        text, place, size, group = text[order], place[order], size[order], group[order]
        first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        edges = np.searchsorted(pairs[0], np.arange(pairs[0][-1] + 2))
        known: dict[bytes, bytes] = {}
        for a, b in zip(first.tolist(), np.append(first[1:], len(text)).tolist()):
            groups = np.unique(group[a:b])
            name = known.get(groups.tobytes())
            if name is None:
                mine = np.unique(np.concatenate([pairs[1][edges[g] : edges[g + 1]] for g in groups.tolist()]))
                name = known[groups.tobytes()] = hashlib.blake2b(mine.tobytes(), digest_size=16).digest()
                sets[name] = mine
            k = int(text[a])
            spans.setdefault(k, []).append(np.stack((place[a:b], size[a:b])))
            held.setdefault(k, []).append(name)
    hit = {}
    joined: dict[tuple, bytes] = {}
    for k, parts in spans.items():
        place, size = np.concatenate(parts, axis=1)
        names = tuple(sorted(set(held[k])))
        name = names[0] if len(names) == 1 else joined.get(names)
        if name is None:
            mine = np.unique(np.concatenate([sets[x] for x in names]))
            name = joined[names] = hashlib.blake2b(mine.tobytes(), digest_size=16).digest()
            sets[name] = mine
        hit[k] = (*_merged(place, size), name)
    used = {name for *_, name in hit.values()}
    return hit, {name: mine for name, mine in sets.items() if name in used}


def _found_batch(rows: list[tuple]) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = (pa.int64(), pa.int64(), pa.int64(), span, pa.binary(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["row", "doc_id", "n_words", "spans", "set_id", "sequences"])


def _search(sent, window: int):
    """Index the rows of (row, doc_id, text) shard by shard and search the block's windows in each; a row a document, a row a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = _Phrases(sent.value, window)
        told: set[bytes] = set()

        def emit(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            words = np.concatenate([h[0] for h in held])
            sizes = np.concatenate([h[1] for h in held])
            rows, ids = [x for h in held for x in h[2]], [x for h in held for x in h[3]]
            hit, sets = _search_shard(words, np.concatenate(([0], np.cumsum(sizes))), phrases)
            out = []
            for k, (row, doc, n) in enumerate(zip(rows, ids, sizes.tolist())):
                start, end, name = hit.get(k, ((), (), None))
                out.append((row, doc, n, [{"start": a, "end": b} for a, b in zip(start, end)], name, None))
            for name, mine in sets.items():
                if name not in told:
                    told.add(name)
                    out.append((None, None, None, None, name, mine))
            for a in range(0, len(out), 10_000):
                yield _found_batch(out[a : a + 10_000])

        held: list[tuple] = []
        gathered = 0
        for batch in batches:
            rows, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, end, data, bounds in text_groups(batch, 2):
                words, at = word_hashes(data, bounds, lower=True, letters=ITEM_LETTERS)
                if gathered and gathered + len(words) > SHARD_WORDS:
                    yield from emit(held)
                    held, gathered = [], 0
                held.append((words, np.diff(at), rows[first:end], ids[first:end]))
                gathered += len(words)
        if held:
            yield from emit(held)

    return run


def _blocks(pieces: DataFrame, block_words: int) -> list[DataFrame]:
    """The distinct pieces in blocks that hold ``block_words`` words at most, or one piece."""
    n = F.octet_length("words") / 8
    total = pieces.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n")).first()["n"]
    k = max(1, int(-(-total // block_words)))
    while True:
        block = F.pmod(F.xxhash64("sequence", "piece"), F.lit(k))
        most = pieces.groupBy(block.alias("b")).agg(F.sum(n).alias("n"), F.count("*").alias("c")).where(f"n > {block_words} and c > 1").limit(1).count()
        if not most:
            return [pieces.where(block == b) for b in range(k)]
        k *= 2


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Find the words of each document that lie in an occurrence of a benchmark window of ``window`` words.

    Words are lower-cased runs (A-Z only) of ASCII letters, digits and characters beyond ASCII. An item of fewer words, but
    not none, is one window. Returns a row a document: doc_id, n_words, n_hit, n_items (items with an occurring window),
    items_sha256 (their ids as sorted strings, comma-joined), contaminated, and the merged spans to remove, in words.

    A task cuts its documents into shards of about ``SHARD_WORDS`` words and builds an FM-index of each. The windows
    are searched backwards through the ranks of its wavelet tree, their places read from sampled suffixes. Nothing of a
    document moves. The benchmark's distinct word sequences are sent to the tasks in blocks of ``block_words`` words (8 bytes
    each), however large it is: each block is one pass over the documents. Sets of items are named by digest, told once a
    task and turned into ids once, so documents that share passages do not repeat lists. Words are told apart by 64-bit hashes.

    A null or empty text has no words. Rows that share an id, or have none, are judged each. Items that share an id are one
    item with the windows of all; an item without an id marks words and is not counted. An empty table on either side finds nothing.
    Other columns are not read.
    """
    spark = docs.sparkSession
    items = bench.select(F.col(item_col).cast("string").alias("item"), text_of(item_text_col).alias("text"))
    phrases = write_once(map_arrow(items, _pieces(window), _PIECES), "bench-phrases")
    blocks = _blocks(phrases.dropDuplicates(["sequence", "piece"]).select("sequence", "piece", "words"), block_words)
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    slim = slim if len(blocks) == 1 else write_once(slim, "bench-docs")  # rows are numbered once
    found = None
    for block in blocks:
        sent = spark.sparkContext.broadcast([(r["sequence"], bytes(r["words"])) for r in block.select("sequence", "words").collect()])
        part = write_once(map_arrow(slim, _search(sent, window), _FOUND), "bench-found")
        sent.unpersist()
        found = part if found is None else found.unionByName(part)
    judged = found.where("row is not null").withColumn("sets", F.array_compact(F.array("set_id"))).drop("set_id", "sequences")
    if len(blocks) > 1:
        whole = [F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.flatten(F.collect_list("sets"))).alias("sets")]
        judged = judged.groupBy("row").agg(*whole).withColumn("spans", _joined(F.col("spans")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    judged = judged.select("row", "doc_id", "n_words", n_hit.alias("n_hit"), "spans", F.array_join(F.transform("sets", F.hex), "").alias("key"), "sets")
    clean = judged.where("n_hit = 0").select("doc_id", "n_words", "n_hit", F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"), "spans")
    hit = judged.where("n_hit > 0")
    named = hit.select("key", "sets").distinct().select("key", F.explode("sets").alias("set_id"))
    sets = found.where("row is null").select("set_id", "sequences").dropDuplicates(["set_id"])
    members = named.join(sets, "set_id").select("key", F.explode("sequences").alias("sequence")).distinct()
    ids = members.join(phrases.where("item is not null").select("item", "sequence").distinct(), "sequence", "left").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("ids"))
    digests = ids.select("key", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    listed = salted_join(hit, digests, "key", "row").select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", F.lit(True).alias("contaminated"), "spans")
    return listed.unionByName(clean)


def _joined(spans):
    """Sorted spans with those that meet made one."""
    last = lambda acc: F.element_at(acc, -1)
    longer = lambda acc, s: F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], s["end"]).alias("end"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    meet = lambda acc, s: F.when((F.size(acc) > 0) & (last(acc)["end"] >= s["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer(acc, s)))).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(spans, empty, meet)


def brute_force(docs: list[tuple[int | None, str | None]], bench: list[tuple[object, str | None]], window: int = WINDOW) -> list[tuple]:
    """The same result by comparing every window with every place, for tests on small tables."""

    def words(text: str | None) -> list[bytes]:
        kept = bytes(c if ITEM_LETTERS[c] else 32 for c in (text or "").encode())
        return bytes(c + 32 if 65 <= c < 91 else c for c in kept).split(b" ") if kept else []

    def of(text: str | None) -> list[bytes]:
        return [w for w in words(text) if w]

    wanted = []
    for item, text in bench:
        mine = of(text)
        for k in range(max(len(mine) - window + 1, min(len(mine), 1))):
            wanted.append((item, mine[k : k + window]))
    out = []
    for doc, text in docs:
        mine = of(text)
        hit, items = set(), set()
        for item, phrase in wanted:
            for k in range(len(mine) - len(phrase) + 1):
                if mine[k : k + len(phrase)] == phrase:
                    hit.update(range(k, k + len(phrase)))
                    items.add(item)
        ids = sorted(str(x) for x in items - {None})
        out.append((doc, len(mine), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


SQL = """
with dw as (select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from documents),
bw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from benchmark),
ph as (select distinct item_id, least(len(ws), 10) as size, array_to_string(ws[i:i + 9], ' ') as phrase from (select item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) as i from bw where len(ws) > 0)),
sz as (select distinct size from ph),
oc as (select row, i, size, array_to_string(ws[i:i + size - 1], ' ') as phrase from (select row, ws, size, unnest(range(1, len(ws) - size + 2)) as i from dw, sz where len(ws) >= size)),
fo as (select row, i, oc.size, item_id from oc join ph on oc.size = ph.size and oc.phrase = ph.phrase),
hi as (select row, count(distinct w) as n_hit from (select row, unnest(range(i, i + size)) as w from (select distinct row, i, size from fo)) group by row),
it as (select row, count(distinct item_id) as n_items, sha256(coalesce(string_agg(distinct item_id::varchar, ',' order by item_id::varchar), '')) as items_sha256 from fo group by row)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from dw left join hi using (row) left join it using (row)
"""
