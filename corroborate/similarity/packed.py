"""Rows that carry numpy arrays, so that a shuffle moves few large rows in place of many small ones."""

from __future__ import annotations

import gc
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow

SCHEMA = "part int, kind int, payload binary"
_HEAD = struct.Struct("<2sI")


def pack_arrays(*arrays: np.ndarray) -> bytes:
    return b"".join(x for a in arrays for x in (_HEAD.pack(a.dtype.str[1:].encode(), len(a)), a.tobytes()))


def unpack_arrays(payload: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(payload):
        kind, n = _HEAD.unpack_from(payload, at)
        dtype = np.dtype(kind.decode())
        out.append(np.frombuffer(payload, dtype, n, at + _HEAD.size))
        at += _HEAD.size + n * dtype.itemsize
    return out


def narrow(values: np.ndarray) -> np.ndarray:
    """The smallest unsigned type that holds these numbers."""
    most = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    parts, kinds, payloads = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(kinds, pa.int32()), pa.array(payloads, pa.binary())], names=["part", "kind", "payload"])


def by_group(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a sorted array: the first place of each value, and how often it stands there."""
    if not len(group):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    return first, np.diff(np.append(first, len(group)))


def deal(df: DataFrame, run, width: int, schema: str = SCHEMA) -> DataFrame:
    """Bring the rows of each part to one task, smaller kinds first, and apply ``run`` there."""
    return map_arrow(df.repartitionById(width, F.col("part")).sortWithinPartitions("part", "kind"), run, schema)


def release(df: DataFrame) -> None:
    """Let Spark remove the shuffle files of finished steps: its cleaner acts when the driver's collector finds them unused."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
