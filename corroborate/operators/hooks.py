"""Hooks for a caller's own functions: per distinct key, per column, and per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_package


def map_entities(df: DataFrame, key: str, make: Callable[[str], str | None], name: str, known: DataFrame | None = None) -> DataFrame:
    """Apply a costly per-row function once for each distinct key that is not known yet, and join the results back."""
    ship_package(df.sparkSession)
    keys = df.select(F.col(key).cast("string").alias("k")).where("k is not null").distinct()
    fresh = keys if known is None else keys.join(known.select("k"), "k", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"k": batch["k"], name: [make(x) for x in batch["k"]]})

    made = fresh.mapInPandas(run, f"k string, {name} string")
    made = made if known is None else known.select("k", name).unionByName(made)
    return df.join(made, F.col(key).cast("string") == F.col("k"), "left").drop("k")


def vectorised(column: Column, work: Callable[[pa.Array], pa.Array], kind: str) -> Column:
    """A caller's function of whole Arrow arrays, as a column: what it computes it computes for a batch at a time."""

    @F.arrow_udf(kind)
    def run(values: pa.Array) -> pa.Array:
        return work(values)

    return run(column)


def grouped(df: DataFrame, keys: list[str], work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A function of one group's rows at a time; for groups that earlier steps made small."""
    ship_package(df.sparkSession)
    return df.groupBy(*keys).applyInPandas(work, schema)


def payload_entries(rows: DataFrame, header: list[str], key: str, payload: str = "payload") -> DataFrame:
    """(key, value, ordinal) beside ``key`` for each field of each row's sparse map: a table function of whole batches of rows.

    The ordinal is the field's place in the header from 0, and null for one that the header does not name. A null map has no fields.
    """
    kind = rows.schema[key].dataType.simpleString()

    class Entries:
        def eval(self, batch: pa.RecordBatch):
            maps = batch.column(1)
            ends = maps.offsets.to_numpy()
            names, values = (x.slice(ends[0], ends[-1] - ends[0]) for x in (maps.keys, maps.items))
            parent = np.repeat(np.arange(len(maps)), np.diff(ends))
            ordinal = pc.index_in(names, value_set=pa.array(header, names.type))
            yield pa.table({"id": batch.column(0).take(pa.array(parent)), "key": names, "value": values, "ordinal": ordinal})

    made = F.arrow_udtf(Entries, returnType=f"id {kind}, key string, value string, ordinal int")
    return made(rows.select(key, payload).asTable()).withColumnRenamed("id", key)
