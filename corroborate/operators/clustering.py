"""Clusters of similar sequences: connected components of the exact set-similarity join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..similarity.set_join import linked_classes, named_components


def cluster_sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.75) -> DataFrame:
    """(id, cluster): cluster is the least id that links reach. Two sequences link at a Jaccard similarity of ``threshold``, a whole percentage.

    No pair that links is left out unless earlier links connect it already. A sequence without an id links with nothing
    and has no cluster.
    """
    percent = round(100 * threshold)
    if abs(percent - 100 * threshold) > 1e-9:
        raise ValueError(f"threshold {threshold} is not a whole percentage")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.lower(text_col).alias("text"))
    linked = named_components(*linked_classes(rows.where("doc_id is not null"), words, percent)).select(F.col("doc_id").alias("id"), F.col("component").alias("cluster"))
    return linked.unionByName(rows.where("doc_id is null").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("cluster")))
