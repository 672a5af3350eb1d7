"""Splits of pairs and observations without leakage, and the checks that fail a build which leaks."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship_package
from ..similarity.common import write_once
from ..sources.releases import numbered_lines

PARTS = ("train", "validation", "test")
PAIR = ["item", "grp"]


def keyed_hash(seed: str, *columns: str) -> Column:
    return F.sha2(F.concat_ws("|", *columns, F.lit(seed)), 256)


def fraction(h: Column) -> Column:
    """The number in [0, 1) that the first 52 bits of a hex digest stand for."""
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def global_rank(df: DataFrame, h: str) -> DataFrame:
    """Rank (from 1) of each row by the digest in ``h`` and the number of rows, without a window over all rows.

    Rows are ranked within the 4,096 buckets of the digest's first three digits; the buckets' running totals come first.
    """
    bucketed = df.withColumn("__b", F.substring(h, 1, 3))
    sizes = bucketed.groupBy("__b").agg(F.count("*").alias("__n"))
    before = sizes.select("__b", (F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("total"))
    ranked = bucketed.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy(h)))
    return ranked.join(F.broadcast(before), "__b").withColumn("rank", F.col("__before") + F.col("__r")).drop("__b", "__r", "__before")


def random_pairs(pairs: DataFrame, seed: str, fractions: tuple[float, float] = (0.7, 0.1)) -> DataFrame:
    """Whole pairs in hash order: the first share trains, the next validates, the rest tests. Pairs with a reason are excluded.

    Hash order stands for a seeded shuffle, which no engine can repeat across versions.
    """
    usable = pairs.where("reason is null").select(*PAIR, keyed_hash(seed, *PAIR).alias("h"))
    ranked = global_rank(usable, "h")
    n1, n2 = F.floor(F.col("total") * fractions[0]), F.floor(F.col("total") * fractions[1])
    part = F.when(F.col("rank") <= n1, "train").when(F.col("rank") <= n1 + n2, "validation").otherwise("test")
    excluded = pairs.where("reason is not null").select(*PAIR, F.lit("excluded").alias("part"))
    return ranked.select(*PAIR, part.alias("part")).unionByName(excluded)


def _shares(fractions: tuple[float, ...]) -> tuple[int, list[int]]:
    """Fractions as whole shares of a common whole, so that quotas compare exactly."""
    exact = [Fraction(str(f)) for f in fractions]
    whole = math.lcm(*[f.denominator for f in exact])
    return whole, [int(f * whole) for f in exact]


def _prefer(group: str, parts: list[int], seed: str) -> int:
    """Which of equally needy parts a group goes to."""
    return max(parts, key=lambda k: hashlib.sha256(f"{group}|{PARTS[k]}|{seed}".encode()).digest())


def _taken(left: list[int], step: int, count: int) -> tuple[list[int], int]:
    """How many of the ``count`` greatest values of the sequences left[k], left[k] - step, ... each surely has, and the value where they end.

    Values above that one are taken; sequences that reach it tie for the rest.
    """
    above = lambda v: [max(0, -(-(x - v) // step)) for x in left]
    low, high = min(left) - step * count, max(left)
    while low < high:  # the greatest value with at least ``count`` at or above it
        mid = (low + high + 1) // 2
        if sum(above(mid - 1)) >= count:
            low = mid
        else:
            high = mid - 1
    return above(low), low


def _run_starts(whole: int, seed: str, shares: list[int], total: int):
    """Runs of equal groups, largest first, to what each part lacks when the run begins."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = [s * total for s in shares]
        for frame in frames:
            rows = []
            for n, count, first, last in zip(frame["n"].tolist(), frame["count"].tolist(), frame["first"].tolist(), frame["last"].tolist()):
                rows.append((n, first, [str(x) for x in left]))
                step = n * whole
                taken, level = _taken(left, step, count)
                tied = [k for k in range(len(left)) if left[k] - step * taken[k] == level]
                open_ = count - sum(taken)
                if open_ == len(tied):
                    taken = [t + (k in tied) for k, t in enumerate(taken)]
                else:  # the groups that end the run choose among the parts that tie
                    for group in last[len(last) - open_ :]:
                        k = _prefer(group, tied, seed)
                        tied.remove(k)
                        taken[k] += 1
                left = [x - step * t for x, t in zip(left, taken)]
            yield pd.DataFrame(rows, columns=["n", "first", "left"])

    return run


def greedy_groups(pairs: DataFrame, group: str, seed: str, fractions: tuple[float, ...] = (0.7, 0.1, 0.2)) -> DataFrame:
    """Whole groups, largest first and by name, each to the part furthest below its quota; ties by hash. Rows without a group are left out.

    Groups of one size form a run. Within a run a part's lack falls by equal steps, so the run's t-th group takes the t-th greatest of a
    few arithmetic sequences, which each group finds for itself. One task sees a row a run: sizes that differ add up to the rows, so N rows
    make at most the root of 2 N runs. Groups are numbered by ranges. Parts that tie for a few neighbouring groups of a run are dealt
    among just those, by the groups' hashes.
    """
    spark = pairs.sparkSession
    whole, shares = _shares(fractions)
    sizes = write_once(pairs.where(F.col(group).isNotNull()).groupBy(F.col(group).cast("string").alias("g")).agg(F.count("*").alias("n")), "groups")
    total = pairs.count()
    placed = numbered_lines(sizes.withColumn("less", -F.col("n")), ["less", "g"], first=0).select("g", "n", F.col("line_no").alias("at"))
    runs = placed.groupBy("n").agg(F.count("*").alias("count"), F.min("at").alias("first"))
    ends = placed.join(F.broadcast(runs), "n").where(F.col("at") >= F.col("first") + F.col("count") - (len(PARTS) - 1)).groupBy("n").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "g"))), lambda x: x["g"]).alias("last"))
    ship_package(spark)
    ordered = runs.join(ends, "n").select("n", "count", "first", "last").repartition(1).sortWithinPartitions(F.desc("n"))
    starts = write_once(ordered.mapInPandas(_run_starts(whole, seed, shares, total), "n long, first long, left array<string>"), "runs")

    @F.pandas_udf("struct<at:long,level:string,parts:array<int>>")
    def turn(n: pd.Series, place: pd.Series, left: pd.Series) -> pd.DataFrame:
        """Place in the run of the first group that shares this one's turn, and the parts that tie for it."""
        out = []
        for size, t, lack in zip(n.tolist(), place.tolist(), left.tolist()):
            have, step = [int(x) for x in lack], size * whole
            taken, level = _taken(have, step, t + 1)
            tied = [k for k in range(len(have)) if have[k] - step * taken[k] == level]
            out.append((sum(taken), str(level), tied))
        return pd.DataFrame(out, columns=["at", "level", "parts"])

    @F.pandas_udf("array<int>")
    def choose(groups: pd.Series, parts: pd.Series) -> pd.Series:
        out = []
        for names, tied in zip(groups.tolist(), parts.tolist()):
            free, chosen = list(tied), []
            for name in names:
                chosen.append(_prefer(name, free, seed))
                free.remove(chosen[-1])
            out.append(chosen)
        return pd.Series(out)

    turned = placed.join(F.broadcast(starts), "n").withColumn("turn", turn("n", F.col("at") - F.col("first"), "left"))
    turned = write_once(turned.select("g", "n", "at", F.col("turn.at").alias("turn"), F.col("turn.parts").alias("parts")), "turns")
    sure = turned.where(F.size("parts") == 1).select("g", F.col("parts")[0].alias("k"))
    shared = turned.where(F.size("parts") > 1).groupBy("n", "turn").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "g"))), lambda x: x["g"]).alias("groups"), F.first("parts").alias("parts"))
    dealt = shared.select(F.explode(F.arrays_zip("groups", choose("groups", "parts").alias("k"))).alias("x")).select(F.col("x.groups").alias("g"), F.col("x.k").alias("k"))
    named = sure.unionByName(dealt).select("g", F.get(F.array(*map(F.lit, PARTS)), F.col("k")).alias("part"))
    return pairs.withColumn("g", F.col(group).cast("string")).join(named, "g").drop("g")


def cold_groups(pairs: DataFrame, clusters: DataFrame, key: str, seed: str) -> DataFrame:
    """Each cluster of entities in one part by its hash; pairs whose entity has no cluster are excluded."""
    placed = clusters.withColumn("u", fraction(keyed_hash(seed, "cluster")))
    placed = placed.withColumn("part", F.when(F.col("u") < 0.7, "train").when(F.col("u") < 0.8, "validation").otherwise("test"))
    return pairs.join(placed.select(key, "cluster", "part"), key, "left").withColumn("part", F.coalesce("part", F.lit("excluded")))


def label_reversal(labels: DataFrame, seed: str, n_items: int = 500) -> DataFrame:
    """Items active somewhere and inactive elsewhere test on one class and train on the other. A diagnostic split."""
    counts = labels.where("reason is null").groupBy("item").agg(F.count_if(F.col("label") == "active").alias("a"), F.count_if(F.col("label") == "inactive").alias("b"))
    ranked = global_rank(counts.where("a > 0 and b > 0").select("item", keyed_hash(seed, "item").alias("h")), "h")
    take = F.least(F.lit(2 * n_items), F.col("total"))
    side = F.when(F.col("rank") <= F.floor(take / 2), "inactive").when(F.col("rank") <= take, "active")
    sides = ranked.select("item", side.alias("tested")).where("tested is not null")
    part = F.when(F.col("reason").isNotNull(), "excluded").when(F.col("tested") == F.col("label"), "test").otherwise("train")
    return labels.join(sides, "item", "left").select(*PAIR, part.alias("part"))


def date_texts(obs: DataFrame) -> DataFrame:
    """Dates as the two text fields that a release has, some missing or malformed."""
    k = F.col("okey")
    first = F.when(k % 6 == 0, F.lit(None)).when(k % 11 == 0, F.lit("n/a")).otherwise(F.date_format("dt", "M/d/yyyy"))
    second = F.when(k % 12 == 0, F.lit(None)).otherwise(F.date_format(F.date_add("dt", 30), "M/d/yyyy"))
    return obs.withColumns({"publication_date": first, "entry_date": second})


def first_date(*texts: str) -> tuple[Column, Column]:
    """The first text that is a date, as a date, and which it was."""
    ok = [F.col(t).rlike(r"^\d{1,2}/\d{1,2}/\d{4}$") for t in texts]
    parsed = F.coalesce(*[F.when(c, F.try_to_timestamp(F.col(t), F.lit("M/d/yyyy")).cast("date")) for c, t in zip(ok, texts)])
    source = F.coalesce(*[F.when(c, F.lit(t)) for c, t in zip(ok, texts)])
    return parsed, source


def temporal_parts(obs: DataFrame, validation: str, test: str) -> DataFrame:
    """Observations with a date and the period that it falls in."""
    parsed, source = first_date("publication_date", "entry_date")
    dated = date_texts(obs).withColumn("day", parsed).withColumn("date_source", source).where("day is not null")
    return dated.withColumn("part", F.when(F.col("day") >= F.lit(test).cast("date"), "test").when(F.col("day") >= F.lit(validation).cast("date"), "validation").otherwise("train"))


def temporal_split(evidence: DataFrame) -> DataFrame:
    """Pairs of each period, labelled from that period alone: stratum against the training period, and their history.

    A reason excludes a pair from evaluation periods only.
    """
    w = Window.partitionBy(*PAIR)
    parts = F.collect_set("part").over(w)
    seen = F.array_contains(parts, "train")
    earlier = F.expr("array_sort(filter(parts, p -> (part = 'validation' and p = 'train') or (part = 'test' and p in ('train', 'validation'))))")
    placed = evidence.withColumn("parts", parts).withColumn("stratum", F.when(seen & (F.col("part") != "train"), "recurrent").otherwise("new_pair"))
    placed = placed.withColumn("history", F.nullif(F.array_join(earlier, ","), F.lit("")))
    assigned = F.when(F.col("reason").isNotNull() & (F.col("part") != "train"), "excluded").otherwise(F.col("part"))
    return placed.select(*PAIR, F.col("part").alias("period"), assigned.alias("part"), "stratum", "history", "label", "status")


def visible(obs: DataFrame, assigned: DataFrame, evidence: DataFrame) -> DataFrame:
    """Observations that training may see: of pairs in the training part that are not themselves excluded there."""
    train = assigned.where("part = 'train'").select(*PAIR)
    return obs.join(train, PAIR, "left_semi").join(evidence.where("status <> 'ok'").select(*PAIR), PAIR, "left_anti")


def leakage_checks(assigned: DataFrame, obs: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """Named counts with what they must be; ``assert_clean`` fails a build where one differs."""
    train, held = assigned.where("part = 'train'"), assigned.where("part in ('validation', 'test')")
    counts = {
        "pairs_assigned_twice": assigned.groupBy(*PAIR).count().where("count > 1"),
        "pairs_unassigned": obs.select(*PAIR).distinct().join(assigned, PAIR, "left_anti"),
        "pairs_without_observations": assigned.join(obs, PAIR, "left_anti"),
        "unknown_parts": assigned.where("part not in ('train', 'validation', 'test', 'excluded')"),
        "pairs_in_train_and_held_out": train.join(held, PAIR, "left_semi"),
        "null_keys": assigned.where("item is null or grp is null"),
    }
    if clusters is not None:
        tagged = assigned.join(clusters, "item")
        counts["clusters_across_parts"] = tagged.where("part <> 'excluded'").groupBy("cluster").agg(F.count_distinct("part").alias("k")).where("k > 1")
    out = None
    for name, rows in counts.items():
        one = rows.agg(F.lit(name).alias("check_name"), F.count("*").alias("observed"), F.lit(0).cast("long").alias("expected"))
        out = one if out is None else out.unionByName(one)
    return out


def assert_clean(checks: DataFrame) -> DataFrame:
    """The checks, or an error that names those which failed."""
    failed = [r["check_name"] for r in checks.where("observed <> expected").limit(50).collect()]
    if failed:
        raise ValueError(f"leakage checks failed: {', '.join(failed)}")
    return checks


def coverage(assigned: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """By part: entities scored, covered and missing, with the first missing ones as examples."""
    need = assigned.select("part", key).distinct()
    hit = need.join(features.select(key).distinct().withColumn("__hit", F.lit(True)), key, "left")
    missing = hit.where("__hit is null")
    first = missing.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy(key))).where("r <= 3").groupBy("part").agg(F.array_join(F.sort_array(F.collect_list(key)), ",").alias("examples"))
    found = hit.groupBy("part").agg(F.count("*").alias("scored"), F.count("__hit").alias("covered"))
    return found.join(first, "part", "left").select("part", "scored", "covered", (F.col("scored") - F.col("covered")).alias("missing"), F.coalesce("examples", F.lit("")).alias("examples"))
