"""Reports as named sections of counts, all from one pass over the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sections(rows: DataFrame, named: dict[str, tuple[str, ...]], sizes: tuple[str, ...] = (), members: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(section, key, n): counts by the columns of each of ``named``, joined by bars into a key; nulls read ``(none)``.

    ``sizes`` adds a section ``dimension`` with the number of different values of each of those columns, and ``members`` a section
    with, for each value of its first column, the number of different values of its second. All are grouping sets of one
    aggregation, so rows are read once and exchanged once, summed before they move; what follows sees one row a group.
    """
    members = members or {}
    sets = [*named.items(), *((f"dimension:{c}", (c,)) for c in sizes), *((name, pair) for name, pair in members.items())]
    columns = list(dict.fromkeys(c for _, s in sets for c in s))
    text = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias(c) for c in columns])
    counted = text.groupingSets([list(s) for _, s in sets], *columns).agg(F.grouping_id(*columns).alias("__set"), F.count("*").alias("__n"))
    bit = {c: 1 << (len(columns) - 1 - k) for k, c in enumerate(columns)}
    missing = {name: sum(b for c, b in bit.items() if c not in s) for name, s in sets}
    parts = []
    for name, s in sets:
        of_set = F.col("__set") == missing[name]
        if name.startswith("dimension:"):
            part = F.struct(F.lit("dimension").alias("section"), F.lit(s[0]).alias("key"), F.lit(1).cast("long").alias("n"))
        elif name in members:
            part = F.struct(F.lit(name).alias("section"), F.col(s[0]).alias("key"), F.lit(1).cast("long").alias("n"))
        else:
            part = F.struct(F.lit(name).alias("section"), F.concat_ws("|", *s).alias("key"), F.col("__n").alias("n"))
        parts.append(F.when(of_set, part))
    return counted.select(F.inline(F.array_compact(F.array(*parts)))).groupBy("section", "key").agg(F.sum("n").alias("n"))


def greatest_of(report: DataFrame, section: str, least: int, first: int) -> DataFrame:
    """The report with one section cut to its ``first`` greatest keys of ``least`` or more, ties by key."""
    top = report.where((F.col("section") == section) & (F.col("n") >= least)).orderBy(F.desc("n"), "key").limit(first)
    return report.where(F.col("section") != section).unionByName(top)
