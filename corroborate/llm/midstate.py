"""SHA-256 over arrays of messages whose state can be kept, copied and resumed: hash states are columns of eight 32-bit words.

A digest as hex text is 64 bytes, one block of SHA-256, so the state before each of several concatenated digests is a state
between blocks. ``hashlib`` has such states too but cannot write them down.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def _root_bits(n: int, root: int, count: int) -> list[int]:
    """The first 32 bits of the fractional part of the ``root``-th root of each of the first ``count`` primes."""
    primes = []
    k = 2
    while len(primes) < count:
        if all(k % p for p in primes):
            primes.append(k)
        k += 1
    out = []
    for p in primes:
        target, low, high = p << (32 * root), 0, p << 32
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if mid**root <= target else (low, mid)
        out.append(low & n)
    return out


_MASK = 0xFFFFFFFF
_ROUND = np.array(_root_bits(_MASK, 3, 64), np.uint32)
#: The state before any block.
START = np.array(_root_bits(_MASK, 2, 8), np.uint32)

_DIGIT = np.frombuffer(b"0123456789abcdef", np.uint8).astype(np.uint32)
_two = (_DIGIT[:, None] << np.uint32(8) | _DIGIT).ravel()
_HEX = (_two[:, None] << np.uint32(16) | _two).ravel()


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def hex_block(digests: np.ndarray) -> np.ndarray:
    """Digests (8 words each, one a column) as the block of their hex text (16 words each)."""
    block = np.empty((16, digests.shape[1]), np.uint32)
    block[0::2] = _HEX[digests >> np.uint32(16)]
    block[1::2] = _HEX[digests & np.uint32(0xFFFF)]
    return block


def _schedule(block: np.ndarray) -> list[np.ndarray]:
    w = list(block)
    for k in range(16, 64):
        a, b = w[k - 15], w[k - 2]
        w.append(w[k - 16] + (_turn(a, 7) ^ _turn(a, 18) ^ (a >> np.uint32(3))) + w[k - 7] + (_turn(b, 17) ^ _turn(b, 19) ^ (b >> np.uint32(10))))
    return w


def _compress(state: np.ndarray, w: list[np.ndarray]) -> np.ndarray:
    a, b, c, d, e, f, g, h = state
    for k in range(64):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + (w[k] + _ROUND[k])
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack((a, b, c, d, e, f, g, h))


def absorb(state: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """States (8 words a column) after one more digest's hex text each."""
    if not state.shape[1]:
        return state
    return _compress(state, _schedule(hex_block(digests)))


@lru_cache(maxsize=64)
def _padding(blocks: int) -> list[np.ndarray]:
    last = np.zeros((16, 1), np.uint32)
    last[0], last[14], last[15] = 1 << 31, blocks * 512 >> 32, blocks * 512 & _MASK
    with np.errstate(over="ignore"):
        return _schedule(last)


def finish(state: np.ndarray, blocks: int) -> np.ndarray:
    """The digests of states that have taken ``blocks`` blocks and no byte more."""
    if not state.shape[1]:
        return state
    return _compress(state, _padding(blocks))


def begin(n: int) -> np.ndarray:
    return np.repeat(START[:, None], n, axis=1)


def to_bytes(digests: np.ndarray) -> bytes:
    """Digests or states, 32 bytes each."""
    return np.ascontiguousarray(digests.T).astype(">u4").tobytes()


def from_bytes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, ">u4").astype(np.uint32).reshape(-1, 8).T)
