"""Removal of repeated word windows, found through difference-cover anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from ..similarity.common import discard, exchange_width, text_of, write_once
from ..similarity.packed import SCHEMA, batch_of, by_group, deal, narrow, pack_arrays, release, unpack_arrays
from ..similarity.words import inside, mix, text_groups, window_hashes, word_hashes

WINDOW = 20
#: Any two positions agree, after some shift under PERIOD, on residues in COVER: every difference mod 13 is one of two residues.
PERIOD = 13
COVER = (0, 1, 3, 9)
#: Words that an anchor hashes: an aligned anchor at a shift of up to PERIOD - 1 still lies in the window.
ANCHOR = WINDOW - PERIOD + 1

FLUSH_BYTES = 24 << 20
_LOW = np.uint64((1 << 40) - 1)
#: Kinds of rows, in the order in which a task needs them.
_ANCHORS, _SHARED, _WINDOWS, _FLAGGED, _TEXTS = 0, 1, 2, 3, 4


NO_ID = -(1 << 63)


def doc_names(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A 64-bit name of each document, that is of its id and its text; it also deals the documents over parts."""
    return mix(mix(ids.view(np.uint64)) + hashes.view(np.uint64))


def _doc_columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids (a null one as the least), text hashes and names of the rows of (doc_id, text, hash)."""
    ids, hashes = batch.column(0).fill_null(NO_ID).to_numpy(), batch.column(2).to_numpy()
    return ids, hashes, doc_names(ids, hashes)


def _by_doc(kind: int, names: np.ndarray, ids: np.ndarray | None, places: np.ndarray, width: int) -> list[tuple[int, int, bytes]]:
    """Rows (one a part of documents) that tell documents, by name and, if given, id, of places in them."""
    if not len(names):
        return []
    part = (names % np.uint64(width)).astype(np.int64)
    order = np.lexsort((places, names, part))
    names, places, part = names[order], places[order], part[order]
    rows = []
    for a, c in zip(*(x.tolist() for x in by_group(part))):
        held, times = by_group(names[a : a + c])
        more = [] if ids is None else [ids[order[a : a + c][held]]]
        rows.append((int(part[a]), kind, pack_arrays(names[a : a + c][held], narrow(times), narrow(places[a : a + c]), *more)))
    return rows


def _from_doc_rows(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Names (sorted, distinct), bounds and places of all rows of one part, and the ids if they hold them."""
    names, places, ids = [], [], []
    for payload in payloads:
        held, times, at, *more = unpack_arrays(payload)
        names.append(np.repeat(held, times))
        places.append(at.astype(np.int64))
        if more:
            ids.append(np.repeat(more[0], times))
    if not names:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int64), None
    one, two = np.concatenate(names), np.concatenate(places)
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    first, _ = by_group(one)
    return one[first], np.append(first, len(one)), two, np.concatenate(ids)[order][first] if ids else None


def _sorted_windows(ids: np.ndarray, texts: np.ndarray, starts: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, ...]:
    """The order of windows by value (two hashes), document and start; which stand later than the first of their value; those firsts."""
    order = np.lexsort((starts, texts, ids, two, one))
    ids, texts, starts, one, two = ids[order], texts[order], starts[order], one[order], two[order]
    head = np.ones(len(one), bool)
    head[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    first = np.flatnonzero(head)
    lead = np.repeat(first, np.diff(np.append(first, len(one))))
    later = (ids != ids[lead]) | (texts != texts[lead]) | (starts != starts[lead])
    return order, later, first


def _deal_anchors(width: int):
    """Map side: anchors at cover positions. One that stands twice in these texts is shared; one of each value is sent on."""

    def emit(names: np.ndarray, places: np.ndarray, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(hashes, kind="stable")
        names, places, hashes = names[order], places[order], hashes[order]
        first, count = by_group(hashes)
        shared = np.repeat(count > 1, count)
        yield batch_of(_by_doc(_SHARED, names[shared], None, places[shared], width))
        names, places, hashes, known = names[first], places[first], hashes[first], (count > 1).astype(np.uint8)
        part = ((hashes >> np.uint64(40)) % np.uint64(width)).astype(np.int64)
        order = np.lexsort((names, part))
        names, places, hashes, known, part = (x[order] for x in (names, places, hashes, known, part))
        rows = []
        for a, c in zip(*(x.tolist() for x in by_group(part))):
            held, times = by_group(names[a : a + c])
            low = hashes[a : a + c] & _LOW
            rows.append((int(part[a]), _ANCHORS, pack_arrays(names[a : a + c][held], narrow(times), narrow(places[a : a + c]), (low >> np.uint64(8)).astype(np.uint32), low.astype(np.uint8), known[a : a + c])))
            if len(rows) == 64:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        gathered = 0
        for batch in batches:
            _, _, doc = _doc_columns(batch)
            for first, end, data, bounds in text_groups(batch, 1):
                words, at = word_hashes(data, bounds, lower=False)
                n = np.diff(at)
                owner = np.repeat(np.arange(end - first), n)
                place = np.arange(len(words)) - at[owner]
                anchors = window_hashes(words, ANCHOR)
                pick = inside(at, ANCHOR) & np.isin(place[: len(anchors)] % PERIOD, COVER) & (n[owner[: len(anchors)]] >= WINDOW)
                where = np.flatnonzero(pick)
                held.append((doc[first:end][owner[where]], place[where], anchors[where]))
                gathered += len(data)
                if gathered >= FLUSH_BYTES:
                    yield from emit(*(np.concatenate(x) for x in zip(*held)))
                    held, gathered = [], 0
        if held:
            yield from emit(*(np.concatenate(x) for x in zip(*held)))

    return run


def _match_anchors(width: int):
    """Reduce side: tell the documents which of the anchors they sent stand elsewhere too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list[np.ndarray]] = []
        for batch in batches:
            rows = []
            for part, kind, payload in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if kind == _SHARED:
                    rows.append((part, kind, payload))
                    continue
                names, times, places, high, low, known = unpack_arrays(payload)
                got.append([np.repeat(names, times), places.astype(np.uint32), (high.astype(np.uint64) << np.uint64(8)) | low, known])
            if rows:
                yield batch_of(rows)
        if not got:
            return
        low = np.concatenate([g[2] for g in got])
        order = np.argsort(low)
        low = low[order]
        again = low[1:] == low[:-1]
        several = order[np.concatenate((again, [False])) | np.concatenate(([False], again))]
        names, places, known = (np.concatenate([g[k] for g in got])[several] for k in (0, 1, 3))
        yield batch_of(_by_doc(_SHARED, names[known == 0], None, places[known == 0], width))

    return run


def _deal_texts(width: int):
    """Whole texts to the part of their document, compressed many at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)

        def emit(held: dict[int, list[tuple[int, int, bytes]]]) -> Iterator[pa.RecordBatch]:
            for part, docs in held.items():
                ids, hashes = (np.array([d[k] for d in docs], np.int64) for k in range(2))
                sizes = np.array([len(t) for _, _, t in docs], np.int64)
                body = squeeze.compress(b"".join(t for _, _, t in docs))
                yield batch_of([(part, _TEXTS, pack_arrays(ids, hashes, sizes, np.frombuffer(body, np.uint8)))])

        held: dict[int, list[tuple[int, int, bytes]]] = {}
        gathered = 0
        for batch in batches:
            ids, hashes, names = _doc_columns(batch)
            for doc, tag, part, text in zip(ids.tolist(), hashes.tolist(), (names % np.uint64(width)).tolist(), batch.column(1).cast(pa.binary()).to_pylist()):
                held.setdefault(part, []).append((doc, tag, text))
                gathered += len(text)
                if gathered >= FLUSH_BYTES:
                    yield from emit(held)
                    held, gathered = {}, 0
        yield from emit(held)

    return run


def _texts_of(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    ids, hashes, sizes, body = unpack_arrays(payload)
    text = zstandard.ZstdDecompressor().decompress(body.tobytes(), max_output_size=int(sizes.sum()))
    return ids, hashes, np.concatenate(([0], np.cumsum(sizes))), text


def _extend(width: int):
    """Extend around shared anchors: hash the windows that hold one, settle repeats within the part, send on one of each value."""

    def one_part(shared: list[bytes], texts: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        known, edges, places, _ = _from_doc_rows(shared)
        found: list[tuple[np.ndarray, ...]] = []
        for payload in texts:
            ids, hashes, bounds, body = _texts_of(payload)
            names = doc_names(ids, hashes)
            at = np.minimum(np.searchsorted(known, names), max(len(known) - 1, 0))
            for k in np.flatnonzero(known[at] == names) if len(known) else []:
                data = np.frombuffer(body, np.uint8, int(bounds[k + 1] - bounds[k]), int(bounds[k]))
                ends = np.array([0, len(data)])
                words, _ = word_hashes(data, ends, lower=False)
                n = len(words) - WINDOW + 1
                told = places[edges[at[k]] : edges[at[k] + 1]]
                if n <= 0 or told[-1] >= len(words):
                    continue  # a shorter text is not the one that was meant, in spite of its name
                mark = np.zeros(len(words) + PERIOD + 1, np.int32)
                mark[told] = 1
                total = np.concatenate(([0], np.cumsum(mark)))
                starts = np.flatnonzero(total[PERIOD : PERIOD + n] > total[:n])
                again, _ = word_hashes(data, ends, lower=False, other=True)
                found.append((np.full(len(starts), ids[k]), np.full(len(starts), hashes[k]), starts, window_hashes(words, WINDOW)[starts], window_hashes(again, WINDOW)[starts]))
        if not found:
            return
        ids, tags, starts, one, two = (np.concatenate(x) for x in zip(*found))
        order, later, first = _sorted_windows(ids, tags.view(np.uint64), starts, one, two)
        gone, on = order[later], order[first]
        yield batch_of(_by_doc(_FLAGGED, doc_names(ids[gone], tags[gone]), ids[gone], starts[gone], width))
        part = ((one[on] >> np.uint64(32)) % np.uint64(width)).astype(np.int64)
        again = np.lexsort((tags[on], ids[on], part))
        on, part = on[again], part[again]
        rows = []
        for a, c in zip(*(x.tolist() for x in by_group(part))):
            mine = on[a : a + c]
            rows.append((int(part[a]), _WINDOWS, pack_arrays(ids[mine], tags[mine], narrow(starts[mine]), one[mine], two[mine])))
        yield batch_of(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _each_part(batches, _SHARED, one_part)

    return run


def _each_part(batches: Iterator[pa.RecordBatch], lead: int, work) -> Iterator[pa.RecordBatch]:
    """Of each part, call ``work`` with the payloads of the leading kind and a stream of its texts."""
    rows = (r for batch in batches for r in zip(*(batch.column(k).to_pylist() for k in range(3))))
    row = next(rows, None)
    while row is not None:
        part, told = row[0], []
        while row is not None and row[0] == part and row[1] == lead:
            told.append(row[2])
            row = next(rows, None)

        def texts() -> Iterator[bytes]:
            nonlocal row
            while row is not None and row[0] == part:
                yield row[2]
                row = next(rows, None)

        stream = texts()
        yield from work(told, stream)
        for _ in stream:
            pass


def _first_windows(width: int):
    """Reduce side: of each window value the least (document, start) stays, the others are flagged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for batch in batches:
            rows = []
            for part, kind, payload in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if kind == _FLAGGED:
                    rows.append((part, kind, payload))
                else:
                    ids, tags, starts, one, two = unpack_arrays(payload)
                    got.append((ids, tags, starts.astype(np.int64), one, two))
            if rows:
                yield batch_of(rows)
        if not got:
            return
        ids, tags, starts, one, two = (np.concatenate(x) for x in zip(*got))
        order, later, _ = _sorted_windows(ids, tags.view(np.uint64), starts, one, two)
        gone = order[later]
        yield batch_of(_by_doc(_FLAGGED, doc_names(ids[gone], tags[gone]), ids[gone], starts[gone], width))

    return run


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _cut_out(with_text: bool):
    def one_part(flagged: list[bytes], texts: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        known, edges, starts, whose = _from_doc_rows(flagged)
        table = {d: k for k, d in enumerate(known.tolist())}
        out: list[tuple] = []
        size = 0
        for payload in texts:
            ids, hashes, bounds, body = _texts_of(payload)
            for k, (doc, name) in enumerate(zip(ids.tolist(), doc_names(ids, hashes).tolist())):
                words = body[bounds[k] : bounds[k + 1]].split()
                n, at = len(words), table.get(name)
                if at is not None and whose[at] == doc:
                    cover = np.zeros(n + WINDOW + 1, np.int32)
                    mine = starts[edges[at] : edges[at + 1]]
                    mine = mine[mine + WINDOW <= n]
                    np.add.at(cover, mine, 1)
                    np.add.at(cover, mine + WINDOW, -1)
                    keep = np.cumsum(cover)[:n] == 0
                    words = [w for w, ok in zip(words, keep.tolist()) if ok]
                kept = b" ".join(words)
                out.append((None if doc == NO_ID else doc, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None))
                size += len(kept) if with_text else 100
                if size > 4 << 20:
                    yield _result_batch(out)
                    out, size = [], 0
        if out:
            yield _result_batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _each_part(batches, _FLAGGED, one_part)

    return run


def _result_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, parts: int | None = None) -> DataFrame:
    """Remove each word that lies in a window of 20 words whose sequence also starts earlier in the corpus.

    Earlier is a smaller id, or the same id and a smaller start. Returns doc_id, n_words, n_removed, kept_sha256 and, with
    ``with_text``, the kept words as ``kept`` (else null).

    Anchors of 8 words are hashed at positions whose residue modulo 13 is in a difference cover, so two equal windows share
    an anchor at the same shift. Windows that hold an anchor which stands twice are compared whole, by two independent 64-bit
    hashes of their words; of each value the first stays. Both exchanges send one entry a value and task, so a passage in a
    large part of all texts costs a task one entry for each task. Texts travel compressed, twice.

    A null text has no words. A null id stays null and ranks before every other (the least long, which stands for it inside,
    comes out as null too). Texts that share an id, or have none, rank by a hash of the text (XXH64, seed 42, unsigned);
    rows that share id and text lose the same words. Texts of fewer than 20 words lose nothing. An empty table gives an
    empty one. Other columns are not read.
    """
    spark = docs.sparkSession
    width = exchange_width(spark, parts)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).withColumn("hash", F.xxhash64("text"))
    shared = write_once(deal(map_arrow(slim, _deal_anchors(width), SCHEMA), _match_anchors(width), width), "windows-shared")
    release(docs)
    texts = map_arrow(slim, _deal_texts(width), SCHEMA)
    windows = deal(shared.unionByName(texts), _extend(width), width)
    flagged = write_once(deal(windows, _first_windows(width), width), "windows-flagged")
    release(docs)
    discard(shared)
    return deal(flagged.unionByName(map_arrow(slim, _deal_texts(width), SCHEMA)), _cut_out(with_text), width, _RESULT)


def brute_force(rows: list[tuple[int | None, str | None]]) -> list[tuple[int | None, int, int, str]]:
    """The same result by a dictionary of all windows, for tests on small tables."""
    texts = [((NO_ID if d is None else d, xxhash.xxh64_intdigest((t or "").encode(), 42)), (t or "").encode().split()) for d, t in rows]
    least: dict[tuple, tuple] = {}
    for doc, words in texts:
        for k in range(len(words) - WINDOW + 1):
            key = tuple(words[k : k + WINDOW])
            least[key] = min(least.get(key, (doc, k)), (doc, k))
    out = []
    for doc, words in texts:
        gone = set()
        for k in range(len(words) - WINDOW + 1):
            if least[tuple(words[k : k + WINDOW])] < (doc, k):
                gone.update(range(k, k + WINDOW))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((None if doc[0] == NO_ID else doc[0], len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
