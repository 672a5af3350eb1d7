"""Search for similar sequences: shared seeds give candidate pairs, a banded local alignment gives identity and both coverages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship_package
from ..similarity.common import write_once

#: Words of a seed. An alignment of ten columns or more, nine in ten of them equal, has so many equal ones in a row.
SEED = 5
MATCH, MISMATCH, GAP = 2, -3, -3
#: Diagonals on each side of the chained seeds that an alignment may use.
MARGIN = 16

_HIT = "query long, target long, score long, matches long, columns long, n_query long, n_target long, span_query long, span_target long"


def word_codes(text: Column) -> Column:
    """The words of a text, without regard to case of A-Z, as 64-bit numbers."""
    folded = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(F.filter(F.split(folded, r"[ \t\n\x0B\f\r]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


#: Words whose seeds are made at once, and seeds of a bucket, about.
SLICE_WORDS, BUCKET_SEEDS = 1 << 20, 1 << 20
_DEALT = "bucket int, side string, seeds array<long>, seqs array<long>, sizes array<int>, places array<int>"
_KNOWN = "side string, seq long, n int, seed long, rows long, place int"


def _chained(x: np.ndarray, size: int) -> np.ndarray:
    """``xxhash64`` of every run of ``size`` numbers, as Spark hashes an array of them."""
    one, two, three, four, five = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, k: (v << np.uint64(k)) | (v >> np.uint64(64 - k))
    x, n = turn(x.view(np.uint64) * two, 31) * one, len(x) - size + 1
    h = np.full(n, 42, np.uint64)
    for k in range(size):
        h = turn((h + five + np.uint64(8)) ^ x[k : k + n], 27) * one + four
        h = (h ^ (h >> np.uint64(33))) * two
        h = (h ^ (h >> np.uint64(29))) * three
        h ^= h >> np.uint64(32)
    return h


def _dealt_seeds(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Seeds of (side, seq, words) with their places, a row a bucket and slice of texts; every run of ``SEED`` words is one, a shorter text is one."""
    for batch in batches:
        ends = np.cumsum(np.asarray(batch.column("words").value_lengths()))
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_WORDS, "right")))
            part = batch.slice(at, upto - at)
            at = upto
            lists = part.column("words")
            sizes, flat = np.asarray(lists.value_lengths()).astype(np.int32), np.asarray(lists.flatten())
            starts = np.cumsum(sizes) - sizes
            n_seeds = np.where(sizes > 0, np.maximum(sizes - SEED + 1, 1), 0)
            owner = np.repeat(np.arange(len(sizes)), n_seeds)
            places = np.arange(len(owner)) - np.repeat(np.cumsum(n_seeds) - n_seeds, n_seeds)
            from_, short = starts[owner] + places, sizes[owner]
            seeds = np.zeros(len(owner), np.uint64)
            for size in range(1, SEED + 1):
                mine = np.flatnonzero(np.minimum(short, SEED) == size)
                if len(mine):
                    seeds[mine] = _chained(flat, size)[from_[mine]]
            bucket = (seeds % np.uint64(buckets)).astype(np.int32)
            side = (np.asarray(part.column("side").to_numpy(zero_copy_only=False)) == "target")[owner]
            key = bucket * 2 + side
            order = np.argsort(key, kind="stable")
            held, first = np.unique(key[order], return_index=True)
            cuts = pa.array(np.append(first, len(order)).astype(np.int32))
            made = lambda v: pa.ListArray.from_arrays(cuts, pa.array(v[order]))
            seqs = np.asarray(part.column("seq"))[owner]
            sides = pa.array(["target" if k % 2 else "query" for k in held.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(held // 2, pa.int32()), sides, made(seeds.view(np.int64)), made(seqs), made(short), made(places.astype(np.int32))], names=[c.split()[0] for c in _DEALT.split(", ")])


def _known_seeds(dealt: pa.Table) -> pa.Table:
    """The seeds of a bucket that both sides have, with how often they stand in all texts."""
    lists = {c: dealt.column(c).combine_chunks() for c in ("seeds", "seqs", "sizes", "places")}
    side = np.repeat(np.asarray(dealt.column("side").to_numpy()) == "target", np.asarray(lists["seeds"].value_lengths()))
    seeds, seqs, sizes, places = (np.asarray(v.flatten()) for v in lists.values())
    order = np.argsort(seeds, kind="stable")
    seeds, side = seeds[order], side[order]
    first = np.flatnonzero(np.concatenate(([True], seeds[1:] != seeds[:-1])))
    n, targets = np.diff(np.append(first, len(seeds))), np.add.reduceat(side.astype(np.int64), first)
    kept = np.repeat((targets > 0) & (targets < n), n)
    chosen = order[kept]
    columns = [pa.DictionaryArray.from_arrays(pa.array(side[kept].astype(np.int32)), pa.array(["query", "target"])).cast(pa.string()), seqs[chosen], sizes[chosen], seeds[kept], np.repeat(n, n)[kept], places[chosen]]
    return pa.Table.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in columns], names=[c.split()[0] for c in _KNOWN.split(", ")])


def seed_ranks(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """(side, seq, n, seed, r, shared) of the seeds that both sides have, each sequence's numbered from the rarest; sides of (seq, words).

    Seeds travel once, in lists by bucket, and those of one side alone end there: they are the rarest in effect, and take places of the
    prefix without ever being joined.
    """
    ship_package(queries.sparkSession)
    both = queries.select(F.lit("query").alias("side"), "seq", "words").unionByName(targets.select(F.lit("target").alias("side"), "seq", "words"))
    buckets = max(1, -(-(both.agg(F.sum(F.size("words"))).first()[0] or 0) // BUCKET_SEEDS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _dealt_seeds(batches, buckets)

    def known(dealt: pa.Table) -> pa.Table:
        return _known_seeds(dealt)

    found = both.where(F.size("words") > 0).mapInArrow(deal, _DEALT).groupBy("bucket").applyInArrow(known, _KNOWN)
    mine = Window.partitionBy("side", "seq")
    ranked = found.withColumn("r", F.row_number().over(mine.orderBy("rows", "seed", "place"))).withColumn("shared", F.count("*").over(mine))
    return write_once(ranked.select("side", "seq", "n", "seed", "r", "shared"), "align-ranked")


def pairs_within(ranked: DataFrame, cover: float) -> DataFrame:
    """(query, target) pairs that can reach an identity of 0.9 over ``cover`` of both, of the sequences in ``seed_ranks``.

    Of an alignment's columns a tenth may differ, and each spoils ``SEED`` runs, so at least half of the columns less four begin
    a shared seed. The rarest shared seed then stands among the rarest of both sequences once that many are left out, and
    only those are joined. Seeds that many sequences share are dealt over several tasks.
    """
    need = F.greatest(F.lit(1), F.ceil(F.col("n") * (0.5 * cover)) - (SEED - 1))
    kept = write_once(ranked.where(F.col("r") <= F.col("shared") - need + 1).select("side", "seq", "n", "seed").distinct(), "align-prefix")
    asked, found = (kept.where(F.col("side") == s).select("seed", F.col("seq").alias(s), F.col("n").alias(f"n_{s}")) for s in ("query", "target"))
    rows = found.groupBy("seed").agg(F.count("*").alias("rows"))
    spread = asked.join(rows, "seed").withColumn("slices", F.ceil(F.col("rows") / 1000).cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    dealt = found.join(rows, "seed").withColumn("slice", F.pmod(F.xxhash64("target"), F.ceil(F.col("rows") / 1000).cast("int")).cast("int"))
    return spread.select("seed", "slice", "query", "n_query").join(dealt.select("seed", "slice", "target", "n_target"), ["seed", "slice"]).select("query", "target", "n_query", "n_target")


def candidates(queries: DataFrame, targets: DataFrame, cover: float) -> DataFrame:
    """(query, target) pairs that can reach an identity of 0.9 over ``cover`` of both; each of (seq, words)."""
    return pairs_within(seed_ranks(queries, targets), cover).select("query", "target").distinct()


def _runs(x: np.ndarray, size: int) -> np.ndarray:
    """A number of every run of ``size`` words."""
    n = len(x) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += x[k : k + n].astype(np.uint64) * _POWERS[k]
    return out


_POWERS = np.uint64(0x9E3779B97F4A7C15) ** np.arange(SEED, dtype=np.uint64)


def _indexed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The seeds of a text, their places in order of the seeds, and the seeds in that order; none of a text shorter than a seed."""
    if len(x) < SEED:
        return None
    key = _runs(x, SEED)
    order = np.argsort(key, kind="stable")
    return key, order, key[order]


def _shared(a: np.ndarray, b: np.ndarray, of_a=None, of_b=None) -> tuple[int, int, int] | None:
    """``band``, and a score that an alignment within it reaches at least: that of the longest run of equal words."""
    size = min(SEED, len(a), len(b))
    if not size:
        return None
    if size == SEED:
        ka, (_, order, ordered) = (of_a or _indexed(a))[0], of_b or _indexed(b)
    else:
        ka, kb = _runs(a, size), _runs(b, size)
        order = np.argsort(kb, kind="stable")
        ordered = kb[order]
    left, right = ordered.searchsorted(ka), ordered.searchsorted(ka, "right")
    n = right - left
    met = np.flatnonzero(n)
    if not len(met):
        return None
    n, left = n[met], left[met]
    pa_ = np.repeat(met, n)
    pb = order[np.repeat(left, n) + np.arange(len(pa_)) - np.repeat(np.cumsum(n) - n, n)]
    apart = pb - pa_
    by = np.lexsort((pa_, apart))
    apart, pa_ = apart[by], pa_[by]
    steps = np.diff(apart)
    # neighbouring diagonals chain: the heaviest group whose steps are within the margin
    cuts = np.concatenate(([0], np.flatnonzero(steps > MARGIN) + 1, [len(apart)]))
    heaviest = int(np.argmax(np.diff(cuts)))
    start, end = int(cuts[heaviest]), int(cuts[heaviest + 1])
    breaks = np.flatnonzero((steps[start : end - 1] != 0) | (np.diff(pa_[start:end]) != 1))
    longest = int(np.diff(np.concatenate(([-1], breaks, [end - start - 1]))).max())
    return int(apart[start]) - MARGIN, int(apart[end - 1]) + MARGIN, MATCH * (longest + size - 1)


def band(a: np.ndarray, b: np.ndarray) -> tuple[int, int] | None:
    """The diagonals (place in ``b`` less place in ``a``) of the best chain of shared seeds, with a margin; none without a seed."""
    found = _shared(a, b)
    return None if found is None else found[:2]


def align(a: np.ndarray, b: np.ndarray, low: int, high: int) -> tuple[int, int, int, int, int]:
    """Best local alignment between the diagonals: score, equal columns, columns, and words of both that it spans.

    Of equal scores the first end in ``a``, then in ``b``; on the way back equal words before gaps in ``b``, before gaps in ``a``.
    Each cell carries where its path began and what it has met, so no matrix is kept.
    """
    width = high - low + 1
    zero = np.zeros(width, np.int64)
    score, matches, columns, from_a, from_b = (zero.copy() for _ in range(5))
    best = (0, 0, 0, 0, 0)
    steps = np.arange(width) * -GAP
    places = np.arange(width)
    for i in range(len(a)):
        j = i + low + places
        inside = (j >= 0) & (j < len(b))
        if not inside.any():
            if i + low >= len(b):
                break
            score, matches, columns, from_a, from_b = (zero.copy() for _ in range(5))
            continue
        same = np.zeros(width, bool)
        same[inside] = b[j[inside]] == a[i]
        # one row up, the cell of this diagonal is (i - 1, j - 1); the next one is (i - 1, j)
        began = score <= 0
        diagonal = np.where(began, 0, score) + np.where(same, MATCH, MISMATCH)
        up = np.append(score[1:], 0) + GAP
        take = diagonal >= up
        x = np.maximum(np.maximum(diagonal, up), 0)
        shift = lambda v: np.append(v[1:], 0)
        m = np.where(take, np.where(began, 0, matches) + same, shift(matches))
        c = np.where(take, np.where(began, 0, columns) + 1, shift(columns) + 1)
        fa = np.where(take, np.where(began, i, from_a), shift(from_a))
        fb = np.where(take, np.where(began, j, from_b), shift(from_b))
        x[~inside] = 0
        # gaps along the row: the greatest of what stands to the left, less its distance
        lifted = x + steps
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, places, 0))
        score = top - steps
        matches, columns, from_a, from_b = m[source], c[source] + (places - source), fa[source], fb[source]
        dead = (score <= 0) | ~inside
        score[dead] = 0
        k = int(np.argmax(score))
        if score[k] > best[0]:
            best = (int(score[k]), int(matches[k]), int(columns[k]), i - int(from_a[k]) + 1, int(j[k]) - int(from_b[k]) + 1)
    return best


#: Cells of a row, of all pairs of a batch together, and pairs of a batch.
CELLS, PAIRS = 1 << 14, 256
#: Bits of a count or a place in what a cell carries; longer sequences are aligned one at a time.
BITS = 21


#: Equal words of a row and its band are looked for in so many cells at once.
LOOKED = 1 << 20


def _stretches(a: np.ndarray, b: np.ndarray, low: int, high: int, least: int = 1) -> list[tuple[int, int, int]]:
    """(first, end, equal) of the rows of ``a`` between which a score of ``least`` can arise, and of those that have an equal word in the band.

    A row's greatest score is at most that of the row above and a match, if the band holds its word there, else that less a mismatch. Where
    this falls to nothing every cell is 0, so what lies between two such rows is aligned by itself with the same result.
    """
    first, end, width = max(0, -high), min(len(a), len(b) - low), high - low + 1
    if end <= first:
        return []
    start = first + low
    left, right = max(0, -start), max(0, end - 1 + high + 1 - len(b))
    part = b[max(0, start) : end + high]
    if left or right:
        part = np.concatenate((np.zeros(left, b.dtype), part, np.zeros(right, b.dtype)))
    view, step = np.lib.stride_tricks.sliding_window_view(part, width), max(1, LOOKED // width)
    equal = np.concatenate([(view[k : k + step] == a[first + k : min(first + k + step, end), None]).any(axis=1) for k in range(0, end - first, step)])
    total = np.cumsum(np.where(equal, MATCH, max(MISMATCH, GAP)))
    over = total - np.minimum(0, np.minimum.accumulate(total))
    alive = np.concatenate(([False], over > 0, [False]))
    edges = np.flatnonzero(alive[1:] != alive[:-1]).reshape(-1, 2)
    if not len(edges):
        return []
    edges = edges[np.maximum.reduceat(over, edges[:, 0]) >= least]
    before, places = np.concatenate(([0], np.cumsum(equal))), np.flatnonzero(equal)
    # no alignment ends in a row without an equal word
    return [(first + f, first + int(places[before[e] - 1]) + 1, int(before[e] - before[f])) for f, e in edges.tolist()]


def _batches_of(sizes: list[tuple[int, int]]) -> Iterator[list[int]]:
    """The parts of (rows, width) in batches of nearly the same widths, each from the most rows down."""
    kind = [int(np.log(w) / np.log(1.2)) for _, w in sizes]
    now: list[int] = []
    for k in sorted(range(len(sizes)), key=lambda k: (kind[k], -sizes[k][0])):
        if now and (kind[now[0]] != kind[k] or len(now) >= max(1, min(PAIRS, CELLS // sizes[k][1])) or (len(now) + 1) * (sizes[now[0]][0] + sizes[k][1]) > LOOKED * 4):
            yield now
            now = []
        now.append(k)
    if now:
        yield now


def align_many(pairs: list[tuple[np.ndarray, np.ndarray, int, int]], stretches: list[list[tuple[int, int, int]]] | None = None) -> list[tuple[int, int, int, int, int]]:
    """What ``align`` gives of each (a, b, low, high), of many pairs at once, each by its ``_stretches``.

    A column of the arrays is a stretch, a row is a diagonal. A cell carries its score and, in one number, the equal columns and the place and
    diagonal where its path began; the columns follow, since the score is five times the equal columns less three times all.
    """
    out: list[tuple[int, int, int, int, int]] = [(0, 0, 0, 0, 0)] * len(pairs)
    sizes, parts = [], []
    for k, (a, b, low, high) in enumerate(pairs):
        if max(len(a), len(b), high - low + 1) >= 1 << BITS:
            out[k] = align(a, b, low, high)
            continue
        for first, end, _ in _stretches(a, b, low, high) if stretches is None else stretches[k]:
            parts.append((k, first, end))
            sizes.append((end - first, high - low + 1))
    found: list[tuple[int, int, int, int, int]] = [(0, 0, 0, 0, 0)] * len(parts)
    for batch in _batches_of(sizes):
        for x, one in zip(batch, _align_batch([(*pairs[parts[x][0]], *parts[x][1:]) for x in batch])):
            found[x] = one
    for (k, _, _), one in zip(parts, found):  # of equal scores the first end in a
        if one[0] > out[k][0]:
            out[k] = one
    return out


def _align_batch(members: list[tuple[np.ndarray, np.ndarray, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """The best alignments of stretches (a, b, low, high, first, end), given from the most rows down: those that end leave the arrays."""
    n = len(members)
    lengths = [end - first for *_, first, end in members]
    rows = lengths[0]
    width = max(high - low + 1 for _, _, low, high, *_ in members)
    # row r of a stretch meets the words of b that stand in rows r to r + width of its column
    one, two, inside = np.zeros((rows, n), np.int64), np.zeros((rows + width, n), np.int64), np.zeros((rows + width, n), bool)
    for p, (a, b, low, high, first, end) in enumerate(members):
        one[: end - first, p] = a[first:end]
        start = first + low
        left = max(0, -start)
        part = b[max(0, start) : end + low + width]
        two[left : left + len(part), p] = part
        inside[left : left + len(part), p] = True
    spare = np.array([width - (high - low + 1) for _, _, low, high, *_ in members])
    narrow = (np.arange(width)[:, None] < width - spare[None, :]) if spare.any() else None
    firsts = np.array([first for *_, first, _ in members], np.int64)
    shift = int(width).bit_length()
    kind = np.int32 if (MATCH * rows - GAP * width + 1) << shift < 2**31 else np.int64
    places = np.arange(width, dtype=kind)[:, None]
    steps = places * kind(-GAP)
    lift = (steps << shift) | places
    columns = np.arange(n)[None, :]
    begin = places.astype(np.int64) | (firsts << BITS)[None, :]
    score, carried = np.zeros((width, n), kind), begin.copy()
    best, held, at, on = np.zeros(n, kind), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    up, lower = np.full((width, n), GAP, kind), np.zeros((width, n), np.int64)
    m = n
    for r in range(rows):
        if lengths[m - 1] <= r:
            while lengths[m - 1] <= r:
                m -= 1
            score, carried, up, lower, begin, columns = (x[:, :m] for x in (score, carried, up, lower, begin, columns))
            narrow = None if narrow is None else narrow[:, :m]
        live = inside[r : r + width, :m] if narrow is None else inside[r : r + width, :m] & narrow
        same = (two[r : r + width, :m] == one[r, :m]) & live
        # one row up, the cell of this diagonal is (i - 1, j - 1); the next one is (i - 1, j)
        x = score + np.where(same, kind(MATCH), kind(MISMATCH))
        np.add(score[1:], kind(GAP), out=up[:-1])
        lower[:-1] = carried[1:]
        carried = carried + (same.astype(np.int64) << (2 * BITS))
        np.copyto(carried, lower, where=up > x)
        np.maximum(x, up, out=x)
        np.maximum(x, 0, out=x)
        x *= live
        # gaps along the row: the greatest of what stands to the left, less its distance, and of equal ones the nearest
        top = np.maximum.accumulate((x << shift) + lift, axis=0)
        source = top & kind((1 << shift) - 1)
        score = ((top >> shift) - steps) * live
        carried = carried[source, columns]
        peak = score.max(axis=0)
        better = np.flatnonzero(peak > best[:m])
        if len(better):
            k = np.argmax(score[:, better], axis=0)
            best[better], held[better], at[better], on[better] = peak[better], carried[k, better], r, k
        np.copyto(carried, begin + ((r + 1) << BITS), where=score == 0)
    mask = (1 << BITS) - 1
    found = []
    for p, (_, _, low, _, first, _) in enumerate(members):
        if not best[p]:
            found.append((0, 0, 0, 0, 0))
            continue
        matches, from_a, diagonal = int(held[p]) >> (2 * BITS), (int(held[p]) >> BITS) & mask, int(held[p]) & mask
        total = (((MATCH - MISMATCH) * matches) - int(best[p])) // -GAP
        i = first + int(at[p])
        found.append((int(best[p]), matches, total, i - from_a + 1, i + int(on[p]) - (from_a + diagonal) + 1))
    return found


#: Words of the queries of a block, and its pairs, about; words of the targets that one block meets; pairs that are aligned at once.
QUERY_WORDS, BLOCK_PAIRS, TARGET_WORDS, AT_ONCE = 20_000, 50_000, 4_000_000, 4_096
MOST_TASKS = 2_000
#: The identity that a best hit has at least, less what rounding to six places gives away.
_LEAST = 0.8999995


#: Places at which a text meets another's seeds, beyond which its band is found only when it is needed: both repeat the same words often.
OFTEN = 512


def _bands(of_a: tuple, keys: list[np.ndarray]) -> dict[int, tuple[int, int, int] | None]:
    """``_shared`` of one text with many, all of ``SEED`` words or more, given by their seeds; but for those that meet it ``OFTEN``."""
    (_, order, ordered), sizes = of_a, np.array([len(k) for k in keys])
    key, text = np.concatenate(keys), np.repeat(np.arange(len(keys)), sizes)
    left, right = ordered.searchsorted(key), ordered.searchsorted(key, "right")
    n = right - left
    few = np.bincount(text, n, len(keys)) <= OFTEN
    found: dict[int, tuple[int, int, int] | None] = dict.fromkeys(np.flatnonzero(few).tolist())
    met = np.flatnonzero((n > 0) & few[text])
    if not len(met):
        return found
    n, left, text = n[met], left[met], text[met]
    pb = np.repeat(met - (np.cumsum(sizes) - sizes)[text], n)
    pa_ = order[np.repeat(left, n) + np.arange(len(pb)) - np.repeat(np.cumsum(n) - n, n)]
    rows, spread = len(order), len(order) + int(sizes.max())
    placed = np.sort((np.repeat(text, n) * spread + (pb - pa_ + rows)) * rows + pa_)  # by text, diagonal and place in one number
    placed, pa_ = np.divmod(placed, rows)
    text, apart = np.divmod(placed, spread)
    apart -= rows
    other, steps = text[1:] != text[:-1], np.diff(apart)
    cut = other | (steps > MARGIN)
    first = np.concatenate(([0], np.flatnonzero(cut) + 1))
    ends = np.append(first[1:], len(text))
    runs = np.concatenate(([0], np.flatnonzero(cut | (steps != 0) | (np.diff(pa_) != 1)) + 1))
    longest = np.maximum.reduceat(np.diff(np.append(runs, len(text))), np.searchsorted(runs, first))
    heaviest = np.lexsort((first - ends, text[first]))
    heaviest = heaviest[np.concatenate(([True], np.diff(text[first][heaviest]) != 0))]
    for k, low, high, run in zip(text[first][heaviest].tolist(), apart[first][heaviest].tolist(), apart[ends - 1][heaviest].tolist(), longest[heaviest].tolist()):
        found[k] = low - MARGIN, high + MARGIN, MATCH * (run + SEED - 1)
    return found


#: Words that do not match which a part of a text is looked at with; of more, all that match in the text are taken.
MISSES = 8


def _most_covered(n_a: int, known: np.ndarray, texts: list[np.ndarray], least: np.ndarray) -> np.ndarray:
    """What an alignment of identity 0.9 and a score of ``least`` covers at most of both, for one text, of ``known`` different words, and each other.

    In the other text it lies in a part of which nine in ten words are known. Its score grows to its end and from its start, so if a
    word does not match, two or more words beyond it do.
    """
    sizes = np.array([len(t) for t in texts])
    text = np.repeat(np.arange(len(texts)), sizes + 1)
    words = np.concatenate([np.append(t, 0) for t in texts])
    at = known.searchsorted(words)
    at[at == len(known)] = 0
    equal = known[at] == words
    stops = np.cumsum(sizes + 1) - 1  # what stands between two texts matches nothing
    equal[stops] = False
    n_equal = np.add.reduceat(equal.astype(np.int64), stops - sizes)
    missing = np.concatenate(([-1], np.flatnonzero(~equal)))
    run = np.diff(missing) - 1
    matches, longest = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for m in range(MISSES + 1):
        if len(missing) < m + 2:
            break
        size = missing[m + 1 :] - missing[: -m - 1] - 1
        good = (size - m >= _LEAST * size) & (size > m)
        if m:
            good &= (run[:-m] > 1) & (run[m:] > 1)
        good = np.flatnonzero(good)
        size, mine = size[good], text[missing[good] + 1]
        inside = (mine == text[missing[good + m + 1] - 1]) & (MATCH * (size - m) + MISMATCH * m >= least[mine])
        size, mine = size[inside], mine[inside]
        np.maximum.at(matches, mine, size - m)
        np.maximum.at(longest, mine, size)
    more = n_equal >= _LEAST * 10 * (MISSES + 1) - 1
    matches, longest = np.where(more, n_equal, matches), np.where(more, sizes, longest)
    columns = _columns(matches, least)
    return np.minimum(1.0, np.minimum(columns / n_a, np.minimum(columns, longest) / sizes))


def _columns(matches, least):
    """The most columns of an alignment with so many equal ones at most, at an identity of 0.9 and a score of ``least``."""
    return matches + np.maximum(0, np.minimum((MATCH * matches - least) // -GAP, (matches / _LEAST).astype(np.int64) - matches))


def _align_block(pairs: pa.Table, texts: pa.Table, best: bool) -> pa.Table:
    """The hits of a block's pairs. With ``best``, a pair is left out if it cannot be a better hit, at an identity of 0.9, than one of that query
    which the block has found: the words that both share are too few, or those of any stretch, or they can reach as much only and the target comes later.
    """
    words: dict[tuple[str, int], np.ndarray] = {}
    named: dict[int, object] = {}
    for side, seq, name, text in zip(texts.column("side").to_pylist(), texts.column("seq").to_pylist(), texts.column("id").to_pylist(), (x for c in texts.column("words").chunks for x in c)):
        words[side, seq] = text.values.to_numpy()
        if side == "target":
            named[seq] = name
    indexed: dict[tuple[str, int], tuple] = {}
    todo = [(("query", q), ("target", t)) for q, t in zip(pairs.column("query").to_pylist(), pairs.column("target").to_pylist())]
    rows: list[tuple] = []
    reached: dict[int, tuple[float, object]] = {}
    banded: dict[int, tuple[int, int, int] | None] = {}  # of the pairs whose band is known

    def index(key: tuple[str, int]):
        if key not in indexed:
            indexed[key] = _indexed(words[key])
        return indexed[key]

    def loses(k: int, bound: float) -> bool:
        """Whether no hit of the pair that covers so much at most comes before the best one of its query so far."""
        (_, query), (_, target) = todo[k]
        if query not in reached:
            return bound <= 0
        most, holder = reached[query]
        return bound <= 0 or bound < most - 1.1e-6 or (bound <= most and None not in (holder, named[target]) and named[target] > holder)

    def work(chosen: list[int]) -> None:
        ids, met, stretches = [], [], []
        for k in chosen:
            a, b = (words[x] for x in todo[k])
            edges = banded[k] if k in banded else _shared(a, b, *(index(x) for x in todo[k]))
            if edges is None:
                continue
            parts = _stretches(a, b, *edges)
            if best:
                columns = [int(c) for c in _columns(np.array([equal for *_, equal in parts], np.int64), edges[2])]
                if loses(k, max((min(min(end - first, c) / len(a), c / len(b), 1.0) for (first, end, _), c in zip(parts, columns)), default=0.0)):
                    continue
            ids.append(k)
            met.append((a, b, *edges[:2]))
            stretches.append(parts)
        for k, (a, b, *_), (score, matches, columns, span_a, span_b) in zip(ids, met, align_many(met, stretches)):
            (_, query), (_, target) = todo[k]
            rows.append((query, target, score, matches, columns, len(a), len(b), span_a, span_b))
            if columns and matches >= 0.9 * columns:
                mutual = min(span_a / len(a), span_b / len(b))
                if query not in reached or not loses(k, mutual):
                    reached[query] = mutual, named[target]

    if not best:
        for at in range(0, len(todo), AT_ONCE):
            work(list(range(at, min(at + AT_ONCE, len(todo)))))
    else:
        bound = np.ones(len(todo))
        of: dict[int, list[int]] = {}
        for k, ((_, query), target) in enumerate(todo):
            if SEED <= min(len(words["query", query]), len(words[target])) and max(len(words["query", query]), len(words[target])) < 1 << BITS:
                of.setdefault(query, []).append(k)
        for query, mine in of.items():
            a, known = words["query", query], np.unique(words["query", query])
            step = max(1, LOOKED // 4 * len(mine) // sum(len(words[todo[k][1]]) for k in mine))
            for part in (mine[at : at + step] for at in range(0, len(mine), step)):
                banded |= {part[i]: edges for i, edges in _bands(index(("query", query)), [index(todo[k][1])[0] for k in part]).items()}
                least = np.array([MATCH * SEED if (edges := banded.get(k)) is None else edges[2] for k in part])
                bound[part] = _most_covered(len(a), known, [words[todo[k][1]] for k in part], least)
                bound[[k for k in part if k in banded and banded[k] is None]] = 0.0
        # each query's pairs from the greatest bound and least target on, in rounds of one, two, four and so on
        left: dict[int, list[int]] = {}
        for k in sorted(range(len(todo)), key=lambda k: (-bound[k], (name := named[todo[k][1][1]]) is not None, 0 if name is None else name)):
            if bound[k] > 0:
                left.setdefault(todo[k][0][1], []).append(k)
        taken = 1
        while left:
            chosen = [k for mine in left.values() for k in mine[:taken]]
            for at in range(0, len(chosen), AT_ONCE):
                work(chosen[at : at + AT_ONCE])
            left = {q: rest for q, mine in left.items() if (rest := [k for k in mine[taken:] if not loses(k, bound[k])])}
            taken = min(2 * taken, AT_ONCE)
    names = [c.split()[0] for c in _HIT.split(", ")]
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*rows)) or [()] * 9)], names=names)


def _sequences(queries: DataFrame, targets: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Each side's (id, seq), and its different sequences (seq, id, n, words) with their least id."""
    # texts without a word are left out when this is read: a filter before it would make the words twice
    sides = [s.select("id", word_codes(F.col("text")).alias("words")).withColumn("seq", F.xxhash64("words")).withColumn("n", F.size("words")) for s in (queries, targets)]
    named = [write_once(s, "align-sequences").where("n > 0") for s in sides]
    distinct = [s.groupBy("seq").agg(F.min("id").alias("id"), F.first("words").alias("words")).withColumn("n", F.size("words")) for s in named]
    return [s.select("id", "seq") for s in named], [write_once(s, "align-distinct") for s in distinct]


def _aligned(pairs: DataFrame, distinct: list[DataFrame], best: bool = False) -> DataFrame:
    """The hits of pairs (query, target) of sequences, with identity and both coverages; with ``best``, those that can be a query's best.

    Pairs meet in blocks of both sides, so a text goes once to each block in which it has a pair, and not once for each pair.
    """
    spark = pairs.sparkSession
    ship_package(spark)
    placed, n_pairs, blocks = pairs.select("query", "target"), pairs.count(), []
    for side, known in zip(("query", "target"), distinct):
        total = placed.select(F.col(side).alias("seq")).distinct().join(known.select("seq", "n"), "seq").agg(F.sum("n")).first()[0] or 0
        blocks.append(max(1, -(-total // QUERY_WORDS), -(-n_pairs // BLOCK_PAIRS)) if side == "query" else max(1, -(-total // TARGET_WORDS)))
        placed = placed.withColumn(f"{side}_block", F.pmod(F.xxhash64(side), F.lit(blocks[-1])).cast("int"))
    keys = ["query_block", "target_block"]
    sent = [placed.select(*[F.col(k).alias(f"{k}_met") for k in keys], F.lit(side).alias("side"), F.col(side).alias("seq")).distinct().join(known.select("seq", "id", "words"), "seq") for side, known in zip(("query", "target"), distinct)]
    texts = sent[0].unionByName(sent[1])
    tasks = min(MOST_TASKS, blocks[0] * blocks[1])  # a block is little data and much work: not for the engine to put together

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _align_block(left, right, best)

    met = placed.repartition(tasks, *keys).groupBy(*keys).cogroup(texts.repartition(tasks, *[f"{k}_met" for k in keys]).groupBy(*[f"{k}_met" for k in keys])).applyInArrow(run, _HIT)
    found = write_once(met, "align-hits").where("columns > 0")
    ratios = [(F.col("matches") / F.col("columns")).alias("identity"), (F.col("span_query") / F.col("n_query")).alias("cov_query"), (F.col("span_target") / F.col("n_target")).alias("cov_target")]
    return found.select("query", "target", "score", *ratios)


def _named(found: DataFrame, named: list[DataFrame], distinct: list[DataFrame]) -> DataFrame:
    """Hits of sequences as hits of ids: each query's, with the least target."""
    asked = named[0].select(F.col("seq").alias("query"), F.col("id").alias("query_id"))
    least = distinct[1].select(F.col("seq").alias("target"), F.col("id").alias("target_id"))
    return found.join(asked, "query").join(least, "target").select(F.col("query_id").alias("query"), F.col("target_id").alias("target"), "score", "identity", "cov_query", "cov_target")


def hits(queries: DataFrame, targets: DataFrame, cover: float = 0.25) -> DataFrame:
    """Alignments of queries with targets, each of (id, text): query, target, score, identity, cov_query, cov_target.

    Sequences are words. All pairs with an identity of 0.9 over at least ``cover`` of both are found, and others that share rare
    seeds. Equal sequences are aligned once: each of their queries gets the hit, and the least of their targets stands for all.
    Texts without a word hit nothing.
    """
    named, distinct = _sequences(queries, targets)
    pairs = write_once(candidates(*(s.select("seq", "words") for s in distinct), cover), "align-pairs")
    return _named(_aligned(pairs, distinct), named, distinct)


def search_best(queries: DataFrame, targets: DataFrame, cover: float = 0.25, levels: tuple[float, ...] = (0.8, 0.5)) -> DataFrame:
    """The rows that ``best_hits`` gives of all ``hits``, at an identity of 0.9, without aligning all their pairs.

    Pairs that can cover 0.8 of both come first. A query that gets such a hit is done, since all that can be better were among them;
    the others go on to the next level, and those left to the pairs that ``hits`` aligns. So a text with a near copy never meets the
    many texts with which it shares a common passage only.
    """
    named, distinct = _sequences(queries, targets)
    ranked = seed_ranks(*(s.select("seq", "words") for s in distinct))
    parts: list[DataFrame] = []
    met = done = None
    for level in (*(x for x in levels if x > cover), cover):
        left = ranked if done is None else ranked.join(done.withColumn("side", F.lit("query")), ["side", "seq"], "left_anti")
        # a thousandth below the level, so that rounded ratios lose nothing
        last = level == cover
        reach = cover if last else level - 0.001
        close = F.lit(True) if last else F.least("n_query", "n_target") >= F.greatest("n_query", "n_target") * (0.89 * reach)
        pairs = pairs_within(left, reach).where(close).select("query", "target").distinct()
        pairs = write_once(pairs if met is None else pairs.join(met, ["query", "target"], "left_anti"), "align-pairs")
        met = pairs if met is None else met.unionByName(pairs)
        parts.append(_aligned(pairs, distinct, best=True))
        good = parts[-1].where((F.round("identity", 6) >= 0.9) & (F.round(F.least("cov_query", "cov_target"), 6) >= level)).select(F.col("query").alias("seq")).distinct()
        done = good if done is None else done.unionByName(good).distinct()
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return best_hits(_named(found, named, distinct))


def best_hits(found: DataFrame, identity: float = 0.9) -> DataFrame:
    """Of each query's hits at the identity cut, the one with the greatest mutual coverage; then the least target, then the greater identity."""
    mutual = F.least("cov_query", "cov_target")
    order = Window.partitionBy("query").orderBy(F.round(mutual, 6).desc(), "target", F.round("identity", 6).desc())
    kept = found.where(F.round("identity", 6) >= identity).withColumn("mutual", mutual)
    return kept.withColumn("k", F.row_number().over(order)).where("k = 1").select("query", "target", "identity", "mutual", "cov_query", "cov_target")


def near_homologs(queries: DataFrame, best: DataFrame, identity: float = 0.9, mutual: float = 0.5) -> DataFrame:
    """Each query with its best hit, if any, and whether that lies in the near-homolog stratum."""
    known = best.select(F.col("query").alias("id"), "target", "identity", "mutual")
    near = (F.round("identity", 6) >= identity) & (F.round("mutual", 6) >= mutual)
    return queries.select("id").join(known, "id", "left").select("id", "target", "identity", "mutual", F.coalesce(near, F.lit(False)).alias("near_homolog"))
