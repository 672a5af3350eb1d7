"""Exact deduplication by Patricia-trie owners."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from ..similarity.common import exchange_width, text_of, write_once
from .trie import OwnerTrie

_MEMBERS = "doc_id long, place int, local_id long, local_rows long, n_bytes long, digest binary, body binary"
_OWNERS = "name long, digest binary, keep_id long, group_size long"


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within each batch, one row of every group of equal texts carries the text and its best id; the others point to that row's place."""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        bodies = batch.column(1).to_pylist()
        trie = OwnerTrie(budget=1 << 62)
        owners = []
        for identifier, body in zip(ids, bodies):
            owner = trie.owner(body)
            if owner.rows == 0:
                owner.key = hashlib.sha256(body).digest()
            owner.add(identifier, 1, True, len(owners))
            owners.append(owner)
        lead = [next(iter(o.askers)) for o in owners]
        first = [k == a for k, a in enumerate(lead)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([a - k for k, a in enumerate(lead)], pa.int32()),
                pa.array([o.best for o in owners], pa.int64()),
                pa.array([o.rows if f else None for o, f in zip(owners, first)], pa.int64()),
                pa.array([len(b) for b in bodies], pa.int64()),
                pa.array([o.key for o in owners], pa.binary()),
                pa.array([b if f else None for b, f in zip(bodies, first)], pa.binary()),
            ],
            names=["doc_id", "place", "local_id", "local_rows", "n_bytes", "digest", "body"],
        )


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One trie over the partition; every local group learns its owner."""
    trie = OwnerTrie()
    for batch in batches:
        for name, local_id, rows, digest, body in zip(*(batch.column(k).to_pylist() for k in range(5))):
            trie.insert(body, local_id, rows, digest, name)
    rows: list[tuple] = []

    def out() -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 4
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["name", "digest", "keep_id", "group_size"])

    for owner in trie.owners():
        rows.extend((asker, owner.key, owner.best, owner.rows) for asker in owner.askers)
        if len(rows) >= 10_000:
            yield out()
            rows.clear()
    yield out()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Find the groups of equal texts; of each, the row with the largest id stays.

    Each input batch first collapses its own copies in a trie, so a group that holds a large part of all rows sends one
    row a batch. Those rows are dealt by length and content hash; each partition inserts the full byte strings into a
    radix trie whose terminal nodes keep the owner, spilling subtrees to the task's own disk. Members then learn their
    owner by a join on the row that carried their batch's text: no key has more rows than a batch, with or without ids.

    Returns, for each input row: doc_id, keep_id, group_size, kept, text_sha256. A null text equals an empty one. Rows
    that share both id and text count in ``group_size`` each and are all ``kept``, if theirs is the largest id. A null id
    is smaller than any other; a group of only null ids keeps all. An empty table gives an empty one. Other columns are not read.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(text_of(text_col), "UTF-8").alias("body"))
    members = write_once(map_arrow(slim, _collapse, _MEMBERS).withColumn("row", F.monotonically_increasing_id()), "exact-members")
    members = members.withColumn("name", F.col("row") + F.col("place"))  # a batch stands together: the row that carries the text
    dealt = members.where(F.col("local_rows").isNotNull()).repartition(exchange_width(spark, parts), "n_bytes", "digest")
    owners = map_arrow(dealt.select("name", "local_id", "local_rows", "digest", "body"), _owners, _OWNERS)
    joined = members.select("doc_id", "name", "digest").join(owners.select("name", "keep_id", "group_size"), "name")
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


SQL = """
with t as (select doc_id, coalesce(text, '') as body from documents),
g as (select body, max(doc_id) as keep_id, count(*) as group_size from t group by body)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, sha256(body) as text_sha256 from t join g using (body)
"""
