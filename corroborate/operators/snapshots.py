"""Comparison of two releases as counted multisets, and the increments that follow from it.

A slot says what was measured, a value what was reported. All windows below are over keys that contain the pair, so one
exchange on the pair serves them all.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship_package
from ..similarity.common import write_once
from .evidence import pair_evidence

PAIR = ["item", "grp"]
SLOT = ["item", "grp", "pub", "ph", "temp", "src"]
VALUE = ["mtype", "rel", "v"]


def classify_rows(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """Every row of both sides with its class: unchanged, removal or addition; and how its slot is linked.

    Of n rows of one value in the earlier and m in the later release, the first min(n, m) are unchanged on either side.
    A correction is inferred only in a slot of both sides with one surplus row on each: entry identifiers decide where
    both rows have one, else the row identifiers do; entry identifiers that differ are a conflict.
    """
    both = earlier.withColumn("side", F.lit("a")).unionByName(later.withColumn("side", F.lit("b"))).repartition(*PAIR)
    sv, sl = Window.partitionBy(*SLOT, *VALUE), Window.partitionBy(*SLOT)
    a, b = F.col("side") == "a", F.col("side") == "b"
    counted = both.withColumns(
        {"na": F.count_if(a).over(sv), "nb": F.count_if(b).over(sv), "k": F.row_number().over(Window.partitionBy(*SLOT, *VALUE, "side").orderBy("rsid", "doi"))}
    )
    surplus = counted.withColumn("surplus", F.col("k") > F.least("na", "nb"))
    gone, new = a & F.col("surplus"), b & F.col("surplus")
    slots = surplus.withColumns(
        {
            "in_a": F.count_if(a).over(sl) > 0,
            "in_b": F.count_if(b).over(sl) > 0,
            "n_gone": F.count_if(gone).over(sl),
            "n_new": F.count_if(new).over(sl),
            "doi_a": F.max(F.when(gone, F.col("doi"))).over(sl),
            "doi_b": F.max(F.when(new, F.col("doi"))).over(sl),
            "rsid_a": F.max(F.when(gone, F.col("rsid"))).over(sl),
            "rsid_b": F.max(F.when(new, F.col("rsid"))).over(sl),
        }
    )
    kind = F.when(~F.col("surplus"), "unchanged").when(a, "removal").otherwise("addition")
    return slots.withColumn("kind", kind).withColumn("link", link()).drop("na", "nb")


def link() -> Column:
    single = (F.col("n_gone") == 1) & (F.col("n_new") == 1)
    decided = F.col("doi_a").isNotNull() & F.col("doi_b").isNotNull()
    inner = (
        F.when(single & decided, F.when(F.col("doi_a") == F.col("doi_b"), "entry_doi").otherwise("identifier_conflict"))
        .when(single & (F.col("rsid_a") == F.col("rsid_b")), "reactant_set_id")
        .otherwise("ambiguous")
    )
    return F.when((F.col("n_gone") > 0) & (F.col("n_new") > 0), inner)


def linked() -> Column:
    return F.coalesce(F.col("link").isin("entry_doi", "reactant_set_id"), F.lit(False))


def corrections(rows: DataFrame) -> DataFrame:
    """One row a slot whose single removal and addition are linked."""
    changed = rows.where(linked() & F.col("surplus"))
    found = changed.groupBy(*SLOT, "link").agg(F.max(F.when(F.col("side") == "a", F.col("v"))).alias("v_before"), F.max(F.when(F.col("side") == "b", F.col("v"))).alias("v_after"))
    return found


def type_totals(rows: DataFrame) -> DataFrame:
    """Per type: unchanged, added and removed observations, and whether both sides add up."""
    n = lambda c: F.count_if(c)
    a, kind = F.col("side") == "a", F.col("kind")
    found = rows.groupBy("mtype").agg(n(a & (kind == "unchanged")).alias("unchanged"), n(kind == "addition").alias("added"), n(kind == "removal").alias("removed"), n(a).alias("in_a"), n(~a).alias("in_b"))
    return found.withColumn("reconciles", (F.col("in_a") == F.col("unchanged") + F.col("removed")) & (F.col("in_b") == F.col("unchanged") + F.col("added")))


def readings(rows: DataFrame) -> DataFrame:
    """Rows as evidence of three readings: the earlier release, the whole later one, and the increment.

    A correction withholds its one added row from the increment; the later release keeps it.
    """
    tags = F.array_compact(F.array(F.when(F.col("side") == "a", "training").otherwise("full_b"), F.when((F.col("kind") == "addition") & ~linked(), "increment")))
    return rows.withColumn("reading", F.explode(tags)).withColumn("rel", F.coalesce("rel", F.lit("="))).withColumn("assay", F.lit(None).cast("long"))


def reading_evidence(rows: DataFrame, threshold: float = 6.0) -> DataFrame:
    """Statistics, status and label of each reading of each pair. Here a missing label is ambiguous."""
    found = pair_evidence(readings(rows), threshold, keys=("item", "grp", "reading"))
    return found.withColumn("label", F.when(F.col("label") == "none", "ambiguous").otherwise(F.col("label")))


def outcomes(evidence: DataFrame) -> DataFrame:
    """One row a pair: the three labels and statuses, whether it may be scored, and in which branch."""
    columns = [F.max(F.when(F.col("reading") == r, F.col(c))).alias(f"{r}_{c}") for r in ("training", "full_b", "increment") for c in ("status", "label")]
    spread = F.max(F.when(F.col("reading") == "increment", F.col("discordant"))).alias("discordant")
    wide = evidence.groupBy(*PAIR).agg(*columns, spread)
    for r in ("training", "full_b", "increment"):
        wide = wide.withColumn(f"{r}_status", F.coalesce(f"{r}_status", F.lit("no_usable_evidence"))).withColumn(f"{r}_label", F.coalesce(f"{r}_label", F.lit("ambiguous")))
    status = F.col("increment_status")
    reason = F.when(status != "ok", status).when(F.coalesce("discordant", F.lit(False)), "discordant").when(F.col("increment_label") == "ambiguous", "ambiguous_label")
    wide = wide.withColumn("reason", reason)
    screened = F.col("full_b_status").isin("exact_bound_conflict", "empty_intersection")
    ok = F.col("reason").isNull()
    stratum = F.when(F.col("training_status") == "no_usable_evidence", "new_pair").otherwise("recurrent")
    return wide.withColumns({"in_primary": ok & ~screened, "in_sensitivity": ok, "screened_because": F.when(ok & screened, F.col("full_b_status")), "stratum": stratum}).drop("discordant")


def moved(rows: DataFrame) -> DataFrame:
    """Values of a pair that left one slot and entered another: counts, and up to the lesser count of first added locators."""
    open_rows = rows.where(F.col("surplus") & ~linked())
    gone, new = F.col("kind") == "removal", F.col("kind") == "addition"
    found = open_rows.groupBy(*PAIR, *VALUE).agg(
        F.count_if(gone).alias("n_gone"), F.count_if(new).alias("n_new"),
        F.max(F.when(gone, F.col("pub"))).alias("pub_before"), F.max(F.when(new, F.col("pub"))).alias("pub_after"),
        F.max(F.when(gone, F.col("doi"))).alias("doi_before"), F.max(F.when(new, F.col("doi"))).alias("doi_after"),
        F.sort_array(F.collect_list(F.when(new, F.col("rsid")))).alias("locators"),
    )
    return found.where("n_gone > 0 and n_new > 0").withColumn("matched", F.least("n_gone", "n_new")).withColumn("unambiguous", (F.col("n_gone") == 1) & (F.col("n_new") == 1))


def excluded_locators(found: DataFrame) -> DataFrame:
    """The added rows that moved values account for: of each group the first ones, in order."""
    return found.select(*PAIR, F.explode(F.expr("slice(locators, 1, cast(matched as int))")).alias("rsid"))


def pair_up(rows: DataFrame) -> DataFrame:
    """Ambiguous groups of one value: their removals and additions paired by place, and how often identifiers agree in pairs.

    A group is ambiguous if the value left or entered more than one record; records that agree in slot and identifiers are
    one, with a count. In the order of slot and identifiers, the first open removal takes the first open addition of another
    slot, as many occurrences as both have; where both stand in one slot, the side with fewer left moves on. Each record is
    used up to its count. Returns, a group with removals and additions: its shape and totals, the bound of what could be
    paired, what was, and on how many paired occurrences either identifier stands on both sides and agrees.

    Records are counted first and laid end to end, so a record is a stretch of its side's line. Where no slot stands on both sides, what
    pairs is where stretches overlap, which a join finds; only groups in which a slot meets itself are gone through in order.
    """
    open_rows = rows.where(F.col("surplus") & ~linked() & F.col("kind").isin("removal", "addition"))
    slot = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("pub", "ph", "temp", "src")])
    keys, ids = [*PAIR, *VALUE], ["slot", "doi", "rsid"]
    records = write_once(open_rows.groupBy(*keys, slot.alias("slot"), F.coalesce("doi", F.lit(-1)).alias("doi"), F.coalesce("rsid", F.lit("")).alias("rsid"), "kind").agg(F.count("*").alias("n")), "records")
    gone, new = F.col("kind") == "removal", F.col("kind") == "addition"
    groups = records.groupBy(*keys).agg(
        F.count_if(gone).alias("r"), F.count_if(new).alias("a"), F.sum(F.when(gone, F.col("n"))).alias("n_gone"), F.sum(F.when(new, F.col("n"))).alias("n_new"),
        F.min(F.struct("doi", "rsid")).alias("least"), F.max(F.struct("doi", "rsid")).alias("most_id"),
    ).where("r > 0 and a > 0 and r + a > 2")
    groups = groups.select(*keys, F.concat_ws("x", "r", "a").alias("shape"), "n_gone", "n_new", F.least("n_gone", "n_new").alias("most"), (F.col("least") != F.col("most_id")).alias("identifiers_differ"))
    upto = F.sum("n").over(Window.partitionBy(*keys, "kind").orderBy(*ids).rowsBetween(Window.unboundedPreceding, 0))
    placed = write_once(records.join(groups.select(*keys), keys).withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col("n")), "records-placed")
    sides = {c: placed.where(F.col("kind") == kind).select(*keys, *[F.col(x).alias(f"{c}_{x}") for x in (*ids, "lo", "hi")]) for c, kind in (("r", "removal"), ("a", "addition"))}
    meeting = write_once(placed.groupBy(*keys, "slot").agg(F.count_distinct("kind").alias("k")).where("k = 2").select(*keys).distinct(), "records-meeting")

    # occurrences in one line each: where no slot stands on both sides, a removal and an addition pair where their stretches overlap
    apart = sides["r"].join(meeting, keys, "left_anti").join(sides["a"], keys).withColumn("t", F.least("r_hi", "a_hi") - F.greatest("r_lo", "a_lo")).where("t > 0")
    stretch = lambda c: F.array_sort(F.collect_list(F.struct(f"{c}_hi", f"{c}_slot")))
    lines = sides["r"].join(meeting, keys).groupBy(*keys).agg(stretch("r").alias("r")).join(sides["a"].groupBy(*keys).agg(stretch("a").alias("a")), keys)
    ship_package(rows.sparkSession)
    overlaps = F.pandas_udf(_overlaps, "array<struct<r:long,a:long,t:long>>")
    met = lines.select(*keys, F.explode(overlaps(F.col("r.r_hi"), F.col("r.r_slot"), F.col("a.a_hi"), F.col("a.a_slot"))).alias("o")).select(*keys, F.col("o.r").alias("r_hi"), F.col("o.a").alias("a_hi"), F.col("o.t").alias("t"))
    tied = met.join(sides["r"], [*keys, "r_hi"]).join(sides["a"], [*keys, "a_hi"])
    pairs = apart.select(*keys, "t", *[f"{c}_{x}" for c in "ra" for x in ids]).unionByName(tied.select(*keys, "t", *[f"{c}_{x}" for c in "ra" for x in ids]))

    def agreed(name: str, missing) -> list[Column]:
        both = (F.col(f"r_{name}") != F.lit(missing)) & (F.col(f"a_{name}") != F.lit(missing))
        total = lambda c: F.coalesce(F.sum(F.when(c, F.col("t"))), F.lit(0)).cast("long")
        return [total(both).alias(f"{name}_both"), total(both & (F.col(f"r_{name}") == F.col(f"a_{name}"))).alias(f"{name}_same")]

    counted = pairs.groupBy(*keys).agg(F.sum("t").alias("paired"), *agreed("doi", -1), *agreed("rsid", ""))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("paired", "doi_both", "doi_same", "rsid_both", "rsid_same")]
    named = groups.alias("g").join(counted.alias("c"), _same("g", "c", keys), "left")
    return named.select("g.*", *["c.paired", "c.doi_both", "c.doi_same", "c.rsid_both", "c.rsid_same"]).select(*keys, "shape", "n_gone", "n_new", "most", "identifiers_differ", *zero)


def _same(a: str, b: str, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def _overlaps(r_ends: pd.Series, r_slots: pd.Series, a_ends: pd.Series, a_slots: pd.Series) -> pd.Series:
    """Overlaps of the two lines of a group in which some slot stands on both, each named by the ends of its stretches.

    A place on either line moves on. Where both stretches lie in one slot they must not pair, and the line with less of its stretch
    ahead leaves it out; the lines are shifted against each other from there.
    """
    out = []
    for r, rs, a, as_ in zip(r_ends, r_slots, a_ends, a_slots):
        x = y = 0
        found = []
        while x < r[-1] and y < a[-1]:
            i, j = bisect_right(r, x), bisect_right(a, y)
            ahead, beyond = int(r[i]) - x, int(a[j]) - y
            step = min(ahead, beyond)
            if rs[i] != as_[j]:
                found.append((int(r[i]), int(a[j]), step))
                x, y = x + step, y + step
            elif step == ahead:
                x += ahead
            else:
                y += beyond
        out.append(found)
    return pd.Series(out)


def set_digest(df: DataFrame, row: Column) -> DataFrame:
    """A digest of all rows that does not depend on their order: of rows by six hex digits of their hash, of these by three, of all.

    The levels are the same at every size: of 10^11 rows, some thousands meet in a bucket, then 4,096 digests at most.
    """

    def folded(key: str) -> Column:
        return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, "d"))), lambda x: x.d), ","), 256).alias("d")

    rows = df.select(F.sha2(row, 256).alias("d")).withColumn("h", F.col("d"))
    six = rows.groupBy(F.substring("h", 1, 6).alias("six")).agg(folded("h"), F.count("*").alias("n"))
    three = six.groupBy(F.substring("six", 1, 3).alias("three")).agg(folded("six"), F.sum("n").alias("n"))
    return three.agg(folded("three").alias("digest"), F.sum("n").alias("n"))
