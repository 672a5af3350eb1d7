"""Helpers that similarity and training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_fallback: str | None = None
_recorders: ContextVar[tuple[list[str], ...]] = ContextVar("recorders", default=())


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only a session on one machine may leave it unset; it then gets a folder of its own."""
    global _fallback
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _fallback is None:
        _fallback = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _fallback


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def write_once(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` under the shared folder and read it back: the rows survive a lost executor and the lineage ends here."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    for paths in _recorders.get():
        paths.append(path)
    return out


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of all tables that ``write_once`` writes within, in this thread, for a caller who knows when nothing reads them any more."""
    paths: list[str] = []
    token = _recorders.set((*_recorders.get(), paths))
    try:
        yield paths
    finally:
        _recorders.reset(token)


def discard(*tables: DataFrame | str) -> None:
    """Remove tables of ``write_once`` that no later step reads. What they led to must have been written before."""
    for table in tables:
        store, path = fs.FileSystem.from_uri(table if isinstance(table, str) else table.written_to)
        if store.get_file_info(path).type != fs.FileType.NotFound:
            store.delete_dir(path)


def exchange_width(spark: SparkSession, parts: int | None = None) -> int:
    """Parts of an exchange: ``parts``, or what the session sets in ``spark.sql.shuffle.partitions``.

    A task of the operators that use it holds numpy arrays of some times its part's text. Parts of 64 MB suit executors of
    a few GB: 16,000 parts a TB. Larger executors take larger parts in proportion.
    """
    return parts or int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def salted_join(facts: DataFrame, groups: DataFrame, key: str, spread: str, counts: DataFrame | None = None, total: int | None = None, share: int = 1000) -> DataFrame:
    """Inner join of ``facts`` to ``groups`` (one row a key) in which no task gets over about 1 / ``share`` of the facts for one key.

    Keys with more rows number fewer than ``share``. They and their number of salts are broadcast; the facts of such a key
    are dealt over the salts by the column ``spread``, and its group row is repeated for each. ``counts`` (key, rows) and ``total``
    spare counting.
    """
    counts = facts.groupBy(key).agg(F.count("*").alias("rows")) if counts is None else counts.select(key, "rows")
    limit = max(1, (facts.count() if total is None else total) // share)
    hot = F.broadcast(write_once(counts.where(F.col("rows") > limit).select(key, F.ceil(F.col("rows") / limit).cast("int").alias("__k")), "hot-keys"))
    k = F.coalesce("__k", F.lit(1))
    dealt = facts.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(spread), k).cast("int")).drop("__k")
    repeated = groups.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), k - 1))).drop("__k")
    return dealt.join(repeated, [key, "__salt"]).drop("__salt")
