"""The corpus pipeline: classify, remove exact copies, remove near copies, mix sources, pack into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. ``run``
writes each stage's result to the shared folder and reads it again as the next one's input.

A stage leaves in the shared folder only what its result still reads, a few bytes a document; ``run`` removes that, too, as soon
as the next stage's input is written. No state is kept between calls: stages and runs may interleave.

A null text counts as an empty one in every stage. A row without an id is a document of its own text; rows that share an id
are told apart by their texts. Columns beside those of documents are left behind. An empty table passes through as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.llm import exact, mixing, ngram_join, packing, quality
from corroborate.similarity.common import discard, recorded, text_of, write_once

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _row_key() -> list:
    """Two numbers that name a row by all its columns, and by which of them are null: the hash passes over nulls."""
    nulls = F.concat(*[F.isnull(c).cast("string") for c in COLUMNS])
    return [F.xxhash64(F.lit(k), nulls, *COLUMNS).alias(f"__k{k}") for k in (1, 2)]


def _decided(work: Callable[[], DataFrame]) -> DataFrame:
    """A stage's decision written out; the larger tables on the way to it are removed."""
    with recorded() as paths:
        decision = write_once(work(), "decision")
    discard(*[p for p in paths if p != decision.written_to])
    return decision


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject: each row by its own text and site, repeated rows alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    keyed = docs.select(*COLUMNS, *_row_key())
    kept = _decided(lambda: quality.classify_quality(keyed, labels, columns=["__k1", "__k2"]).where("keep").select("__k1", "__k2").distinct())
    return keyed.join(kept, ["__k1", "__k2"], "left_semi").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest id stays; of equal texts without any id, one. One id may name several texts: each stays.

    One key column of id and digest serves the join and the last step: one exchange.
    """
    # concat_ws leaves out a null id; digests are of one length, so no two pairs give the same key
    key = lambda digest: F.concat_ws(":", F.col("doc_id").cast("string"), digest).alias("__key")
    kept = _decided(lambda: exact.exact_dedup(docs).where("kept").select(key(F.col("text_sha256"))).distinct())
    rows = docs.select(*COLUMNS, key(F.sha2(F.encode(text_of("text"), "UTF-8"), 256)))
    return rows.join(kept, "__key", "left_semi").dropDuplicates(["__key"]).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest id stays. Documents without an id cannot be named and stay.

    One id may name several texts, so groups are of (id, text) by a 64-bit hash; two rows that it takes for one both stay.
    """
    named = docs.where("doc_id is not null").select(*COLUMNS, F.xxhash64("doc_id", text_of("text")).alias("__row"))

    def first_of_each() -> DataFrame:
        linked = ngram_join.ngram_join(named, id_col="__row").select(F.col("doc_id").alias("__row"), "component_id")
        ids = linked.join(named.select("__row", "doc_id").distinct(), "__row")
        return ids.groupBy("component_id").agg(F.min(F.struct("doc_id", "__row")).alias("first")).select("first.__row").distinct()

    first = _decided(first_of_each)
    kept = named.join(first, "__row", "left_semi").dropDuplicates(["__row", "doc_id"]).select(*COLUMNS)
    return kept.unionByName(docs.where("doc_id is null").select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights; a repeated document is several equal rows, which its columns do not tell apart."""
    return mixing.mix_to_weights(docs.select(*COLUMNS)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequence and place; each copy of a document is packed whole, by its rows."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL has neither the fitted classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with recorded() as paths:
            docs = write_once(stage(spark, docs, sf_dir), "stage")
        discard(*[p for p in paths if p != docs.written_to])
    return STAGES[-1][1](spark, docs, sf_dir)
