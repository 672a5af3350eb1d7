"""Words of whole texts as 64-bit hashes, computed over Arrow buffers with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Texts are worked on in groups of about so many bytes; a longer text is a group of its own.
GROUP_BYTES = 2 << 20
#: Words of more bytes are hashed one by one.
_LONG_WORD = 64
_SEED, _OTHER_SEED = 0x9E3779B97F4A7C55, 0xC2B2AE3D27D4EB4F
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: The low bytes of an 8-byte piece that belong to a word with so many bytes left.
_LEFT = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
LETTERS = ~_SPACE
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_groups(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) of groups of rows; nulls count as empty."""
    texts = batch.column(column).cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(offsets, offsets[first] + GROUP_BYTES, "right")) - 1
        end = min(max(end, first + 1), len(texts))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_bounds(data: np.ndarray, bounds: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of bytes that ``letters`` (a flag for each byte value) marks; no run crosses a text's end."""
    letter = np.frombuffer(data.tobytes().translate(letters.tobytes()), bool)
    n = len(letter)
    edge = np.ones(n + 1, bool)
    edge[0], edge[n] = letter[0], letter[-1]
    np.not_equal(letter[1:], letter[:-1], out=edge[1:n])
    edges = np.flatnonzero(edge)
    inner = np.unique(bounds[(bounds > 0) & (bounds < n)])
    inner = inner[letter[inner - 1] & letter[inner]]
    if not len(inner):
        return edges[::2], edges[1::2]
    return np.sort(np.concatenate((edges[::2], inner))), np.sort(np.concatenate((edges[1::2], inner)))


def word_hashes(data: np.ndarray, bounds: np.ndarray, lower: bool, other: bool = False, letters: np.ndarray = LETTERS) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, in order, and the bounds of each text in that array. Words are runs without ASCII white space, or of ``letters``.

    A word's bytes are taken eight at a time; each piece is scrambled together with what came before it, its size first.
    ``lower`` takes A-Z for a-z. ``other`` starts from another seed, which gives a second, independent hash.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    data = np.frombuffer(data.tobytes().translate(_ASCII_LOWER.tobytes()), np.uint8) if lower else data
    starts, ends = word_bounds(data, bounds, letters)
    sizes = ends - starts
    seed = _OTHER_SEED if other else _SEED
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    pieces = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    first = mix(np.arange(1, _LONG_WORD + 2, dtype=np.uint64) * _STEP + np.uint64(seed))
    hashes = mix(first[np.minimum(sizes, _LONG_WORD + 1) - 1] ^ (pieces[starts] & _LEFT[np.minimum(sizes, 8)]))
    at = np.flatnonzero((sizes > 8) & (sizes <= _LONG_WORD))
    done = 8
    while len(at):
        hashes[at] = mix(hashes[at] ^ (pieces[starts[at] + done] & _LEFT[np.minimum(sizes[at] - done, 8)]))
        done += 8
        at = at[sizes[at] > done]
    for k in np.flatnonzero(sizes > _LONG_WORD).tolist():
        hashes[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes(), seed)
    return hashes, np.searchsorted(starts, bounds)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, over the ends of texts too."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n].copy()
    for k in range(1, size):
        total *= _STEP
        total += words[k : k + n]
    return mix(total + np.uint64(size))


def inside(bounds: np.ndarray, size: int) -> np.ndarray:
    """Of the positions of ``window_hashes``, those whose window lies in one text."""
    n = max(int(bounds[-1]) - size + 1, 0)
    ok = np.ones(n, bool)
    for end in range(1, size):
        at = bounds[1:] - end
        ok[at[(at >= 0) & (at < n)]] = False
    return ok
