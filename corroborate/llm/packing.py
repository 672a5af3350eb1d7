"""Best-fit packing of tokenised documents into sequences, certified by dual-feasible functions."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from ..similarity.common import text_of, write_once

CAPACITY = 1024
END_ID = 2
#: Added tokens of the vocabulary, which its JSON file lists and its rank file does not hold; texts may contain them literally.
ADDED = {"<|endoftext|>": 50256}
#: Pieces that one packing task holds: a bound on a task's memory, not on the input.
PART_ROWS = 40_000
#: From a partition that is not certified, the emptiest bins are exchanged: this many for each bin of the gap, and at least as many again.
RELEASED = 8
ROUNDS = 2

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = _PIECES + ", row long, part int, bin int, offset long, released boolean, gap int"


def tokenizer_files() -> tuple[str, str]:
    """The vocabulary as rank file (same ids, several times faster to apply) and its splitting pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Callable[[str], list[int]]:
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=ADDED)
    return lambda text: encoding.encode(text, allowed_special="all")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def tokenize_pieces(docs: DataFrame, vocabulary: tuple[str, str], capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: its document's ids followed by the end id, cut to the capacity, with the CRC of its ids."""
    path, pattern = vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path, pattern)
        for batch in batches:
            rows: list[tuple[int | None, int, int, int, int]] = []
            known: dict[str, list[tuple[int, int, int, int]]] = {}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                made = known.get(text)
                if made is None:
                    ids = np.array([*encode(text), END_ID], dtype="<u4")
                    made = known[text] = [(k, at, n, zlib.crc32(ids[at : at + n])) for k, (at, n) in enumerate(cut(len(ids), capacity))]
                rows.extend((doc_id, *m) for m in made)
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return map_arrow(slim, run, _PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The least number of bins that two families of dual-feasible functions prove for these lengths."""
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * x).sum()) // capacity)
    # sizes over C - e count as C, sizes under e as nothing
    for e in range(1, capacity // 2 + 1):
        mapped = np.where(x > capacity - e, capacity, np.where(x < e, 0, x))
        best = max(best, -(-int((counts * mapped).sum()) // capacity))
    # sizes are rounded down to multiples of 1 / (k + 1) and measured in k-ths, unless they are such multiples
    for k in range(1, 101):
        scaled = x * (k + 1)
        mapped = np.where(scaled % capacity == 0, x * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((counts * mapped).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and the room left in each bin. Lengths must not exceed the capacity."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int32), np.zeros(len(lengths), np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    room: list[int] = []
    filled = 0  # bit r: some bin has room r
    for at, n in zip(order.tolist(), lengths[order].tolist()):
        fits = filled >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = open_at[r].pop()
            if not open_at[r]:
                filled &= ~(1 << r)
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[at], offsets[at] = b, capacity - r
        left = room[b] = r - n
        if left:
            open_at[left].append(b)
            filled |= 1 << left
    return bins, offsets, np.array(room, np.int64)


def _pack_parts(pieces: DataFrame, rows: int, capacity: int, salt: int) -> DataFrame:
    """Deal the pieces at random over parts of bounded size and pack each part."""
    parts = -(-rows // PART_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches), schema=None) if (batches := [b for b in batches if b.num_rows]) else None
        if whole is None:
            return
        whole = whole.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("row", "ascending")])
        lengths = whole.column("length").to_numpy()
        bins, offsets, room = best_fit_decreasing(lengths, capacity)
        gap = len(room) - lower_bound(lengths, capacity)
        loose = np.argsort(-room, kind="stable")[: RELEASED * (gap + 1)] if gap else []
        released = np.zeros(len(room), bool)
        released[loose] = True
        released &= room > 0
        whole = whole.append_column("bin", pa.array(bins)).append_column("offset", pa.array(offsets))
        whole = whole.append_column("released", pa.array(released[bins])).append_column("gap", pa.array(np.full(len(bins), gap, np.int32)))
        yield from whole.select(["doc_id", "piece", "start", "length", "ids_crc32", "row", "part", "bin", "offset", "released", "gap"]).to_batches(10_000)

    # rows may share an id, or have none: the checksum, and a number that was drawn when the pieces were written, spread them
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", "row", F.lit(salt)), F.lit(max(parts, 1))).cast("int"))
    return map_arrow(dealt.repartitionById(max(parts, 1), F.col("part")), run, _PACKED)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Assign every piece a sequence and an offset.

    Each part is packed best-fit decreasing; dual-feasible functions certify a part whose bin count no packing can beat.
    The other parts release their emptiest bins, whose pieces meet in new parts and are packed again; what comes back is
    taken if it needs fewer bins.
    """
    columns = pieces.columns
    pieces = write_once(pieces.withColumn("row", F.monotonically_increasing_id()), "pack-pieces")
    settled: list[DataFrame] = []
    current = pieces
    rows = current.count()
    for turn in range(ROUNDS + 1):
        packed = write_once(_pack_parts(current, rows, capacity, turn), "pack-bins")
        numbered = packed.withColumn("sequence_id", (F.col("part").cast("long") * (1 << 32) + F.col("bin")) * (ROUNDS + 1) + turn)
        if turn:
            before = settled.pop()
            old, new = (x.select("sequence_id").distinct().count() for x in (before, numbered))
            if new >= old:
                settled.append(before)
                break
        open_rows = numbered.where("released").count() if turn < ROUNDS else 0
        if not open_rows:
            settled.append(numbered)
            break
        settled += [numbered.where(~F.col("released")), numbered.where("released")]
        current = numbered.where("released").select(*pieces.columns)
        rows = open_rows
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.select(*columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocabulary: tuple[str, str] | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise documents, cut those over the capacity and pack all pieces into few sequences.

    Returns a row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Only lengths travel: the texts
    are read once, in place. An added token that stands in a text is its one id. A null or empty text is its end id alone.
    Rows that share an id, or have none, are packed each. An empty table gives an empty one. Other columns are not read. A
    very long text becomes many pieces, all but the first full.
    """
    return pack(tokenize_pieces(docs, vocabulary or tokenizer_files(), capacity, id_col, text_col), capacity)
