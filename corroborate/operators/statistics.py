"""Resampling by hashed weights, tests over groups, and checks of saved predictions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..similarity.common import write_once
from .ranks import quantiles


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) hashed from the parts: the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_one(u: Column) -> Column:
    """A Poisson count of mean one, by inverting its distribution at ``u``."""
    total, term, cdf = 0.0, 0.36787944117144233, []
    for k in range(9):
        total += term
        cdf.append(total)
        term /= k + 1
    return sum(F.when(u >= F.lit(c), 1).otherwise(0) for c in cdf)


#: Rounds that share one MD5: each takes eight of its hex digits.
DRAWS = 4


def poisson_limits(steps: int = 9) -> list[str]:
    """The distribution of a Poisson count of mean one as eight hex digits a step: a draw of as many digits compares as text."""
    total, term, out = 0.0, math.exp(-1), []
    for k in range(steps):
        total += term
        out.append(f"{min(math.ceil(total * (1 << 32)), (1 << 32) - 1):08x}")
        term /= k + 1
    return out


def poisson_text(draw: Column) -> Column:
    """The Poisson count of mean one for a draw of eight hex digits; most draws end after one or two comparisons."""
    found = F.lit(9)
    for k, limit in reversed(list(enumerate(poisson_limits()))):
        found = F.when(draw < limit, k).otherwise(found)
    return found


def replicate(df: DataFrame, rounds: int, seed: str, *keys: str) -> DataFrame:
    """Each row in each bootstrap round (``b``) with its hashed Poisson weight (``w``); rows of weight 0 are left out."""
    each = df.withColumn("__k", F.explode(F.array(*map(F.lit, range(-(-rounds // DRAWS))))))
    hashed = each.withColumn("__d", F.md5(F.concat_ws("|", F.lit(seed), F.col("__k").cast("string"), *[F.col(c).cast("string") for c in keys])))
    drawn = [F.struct((F.col("__k") * DRAWS + j + 1).alias("b"), poisson_text(F.substring("__d", 8 * j + 1, 8)).alias("w")) for j in range(DRAWS)]
    return hashed.select(*df.columns, F.inline(F.array(*drawn))).where((F.col("w") > 0) & (F.col("b") <= rounds))


def weighted_auroc(df: DataFrame, group: list[str], score: str = "score") -> DataFrame:
    """AUROC of weighted rows in each group, exact under ties."""
    base = df.groupBy(*group, F.col(score).alias("s")).agg(F.sum("w").alias("n"), F.sum(F.when(F.col("pos"), F.col("w")).otherwise(0)).alias("p"))
    up = Window.partitionBy(*group).orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    ranked = base.withColumn("below", F.sum(F.col("n") - F.col("p")).over(up) - (F.col("n") - F.col("p")))
    found = ranked.groupBy(*group).agg(F.sum(F.col("p") * (F.col("below") + (F.col("n") - F.col("p")) / 2)).alias("u"), F.sum("p").alias("tp"), F.sum(F.col("n") - F.col("p")).alias("tq"))
    return found.withColumn("auroc", F.when(F.col("tp") * F.col("tq") > 0, F.col("u") / (F.col("tp") * F.col("tq")))).drop("u")


def percentile_interval(df: DataFrame, group: list[str], value: str, level: float = 0.9) -> DataFrame:
    tail = (1 - level) / 2
    return df.groupBy(*group).agg(
        F.percentile(F.col(value), F.lit(tail)).alias("low"), F.percentile(F.col(value), F.lit(1 - tail)).alias("high"), F.count(value).alias("n_rounds"), F.count_if(F.col(value).isNull()).alias("n_single_class")
    )


def decision(auroc: Column, low: Column, high: Column, threshold: float, n_pos: Column, n_neg: Column, least: int) -> Column:
    return (
        F.when((n_pos < least) | (n_neg < least), "insufficient")
        .when(auroc < 0.5, "fail")
        .when((low > 0.5) & (auroc >= threshold), "pass")
        .when(high < threshold, "fail")
        .otherwise("inconclusive")
    )


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution, by the rational approximation of the error function (Abramowitz and Stegun 7.1.26)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    return ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-x * x)


def signed_rank(df: DataFrame, delta: str) -> DataFrame:
    """Wilcoxon signed-rank and sign test over the rows: rank sum and counts of positives, z with tie correction, both two-sided
    p-values (the sign test's exact), and quartiles of all deltas.

    Ranks come from the counts of distinct sizes: within ranges of size first, then over the ranges' totals.
    """
    df = write_once(df.select(delta), "deltas")  # one number a group, read several times
    rows = df.where(F.col(delta).isNotNull() & (F.col(delta) != 0)).select(F.col(delta).alias("d"), F.abs(delta).alias("a"))
    tied = rows.groupBy("a").agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("up")).withColumn("band", F.floor(F.log2("a") * 64))
    bands = tied.groupBy("band").agg(F.sum("n").alias("m"))
    before = bands.select("band", (F.sum("m").over(Window.orderBy("band").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")).alias("under"))
    within = F.sum("n").over(Window.partitionBy("band").orderBy("a").rowsBetween(Window.unboundedPreceding, 0))
    ranked = tied.withColumn("upto", within).join(F.broadcast(before), "band").withColumn("r", F.col("under") + F.col("upto") - (F.col("n") - 1) / 2)
    n = F.sum("n")
    found = ranked.agg(
        n.alias("n"), F.sum(F.col("up") * F.col("r")).alias("w_plus"), F.sum("up").alias("n_up"),
        (n * (n + 1) * (2 * n + 1) / 24 - F.sum(F.pow("n", F.lit(3)) - F.col("n")) / 48).alias("variance"),
    )
    z = (F.col("w_plus") - F.col("n") * (F.col("n") + 1) / 4) / F.sqrt("variance")
    spread = quantiles(df, [], delta, {"lower_quartile": 0.25, "median": 0.5, "upper_quartile": 0.75}).withColumnRenamed("n", "n_groups")
    return found.withColumn("z", z).withColumn("p_value", normal_tail(z)).withColumn("sign_p", sign_test(F.col("n_up"), F.col("n"))).crossJoin(spread)


#: Terms of a binomial tail that are added. Further ones add less than one part in 10**16 of the sum.
TAIL_TERMS = 4_000


def sign_test(up: Column, n: Column) -> Column:
    """Two-sided binomial tail of ``up`` positives in ``n``.

    The greatest term of the tail is at its end, P(few). Going down from there each term is the one before times
    k / (n - k + 1), a ratio under 1 that only falls. ``TAIL_TERMS`` terms give the sum to double precision unless ``few`` is so near n / 2
    that the ratios stay close to 1; there n is large, and the normal distribution with a half-step correction takes over, whose
    error is below 1e-6. Work and memory do not grow with ``n``.
    """
    few = F.least(up, n - up).cast("double")
    m = n.cast("double")
    last = _log_factorial(m) - _log_factorial(few) - _log_factorial(m - few) - m * F.log(F.lit(2.0))
    step = lambda acc, k: F.struct((acc.t * (few - k) / (m - few + k + 1)).alias("t"), (acc.s + acc.t * (few - k) / (m - few + k + 1)).alias("s"))
    terms = F.sequence(F.lit(0), F.greatest(F.lit(0), F.least(few, F.lit(float(TAIL_TERMS))).cast("int") - 1))
    ratio = F.aggregate(terms, F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), step, lambda acc: acc.s)
    exact = F.exp(last) * F.when(few < 1, 1.0).otherwise(ratio)
    z = (few + 0.5 - m / 2) / F.sqrt(m / 4)
    # what was left out is less than a geometric series at the ratio of the last term
    held = (few - TAIL_TERMS) / (m - few + TAIL_TERMS + 1)
    enough = (few <= TAIL_TERMS) | (held < 0.99)
    return F.least(F.lit(1.0), F.when(enough, 2 * exact).otherwise(normal_tail(F.least(z, F.lit(0.0)))))


def _log_factorial(x: Column) -> Column:
    """Logarithm of x!: the sum of logarithms below 16, Stirling's series beyond, exact to 1e-13 there."""
    small = F.aggregate(F.sequence(F.lit(1), F.lit(16)), F.lit(0.0), lambda acc, k: acc + F.when(k <= x, F.log(k.cast("double"))).otherwise(0.0))
    y = F.greatest(x, F.lit(1.0))
    series = y * F.log(y) - y + F.log(2 * math.pi * y) / 2 + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5)))
    return F.when(x < 16, small).otherwise(series)


def mann_whitney(df: DataFrame, group: str) -> DataFrame:
    """U of the positives in each group with its normal approximation, tie-corrected, and the two-sided p-value; 1 where all scores are tied."""
    from .metrics import blocks

    b = blocks(df, group)
    n, p = F.first("tn"), F.first("tp")
    found = b.groupBy(group).agg(
        (F.sum(F.col("p") * (F.col("an") - F.col("n") + (F.col("n") + 1) / 2)) - p * (p + 1) / 2).alias("u"), p.alias("n1"), (n - p).alias("n2"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties")
    )
    total = F.col("n1") + F.col("n2")
    variance = F.col("n1") * F.col("n2") / 12 * (total + 1 - F.col("ties") / (total * (total - 1)))
    z = (F.col("u") - F.col("n1") * F.col("n2") / 2) / F.sqrt(variance)
    return found.where("n1 > 0 and n2 > 0").withColumn("z", z).withColumn("p_value", F.when(variance > 0, normal_tail(z)).otherwise(1.0))


def balanced_sample(pool: DataFrame, label: str, n: int, seed: str, *keys: str) -> DataFrame:
    """The first ``n`` rows of each class in hash order, or an error if a class of the pool has fewer: a cohort is not filled up from elsewhere."""
    sizes = {r[label]: r["n"] for r in pool.groupBy(label).agg(F.count("*").alias("n")).limit(1000).collect()}
    short = {k: v for k, v in sizes.items() if v < n}
    if short or len(sizes) < 2:
        raise ValueError(f"{n} rows a class were asked for; the pool has {sizes}")
    h = F.sha2(F.concat_ws("|", *keys, F.lit(seed)), 256)
    picked = [pool.where(F.col(label) == k).orderBy(h, *keys).limit(n) for k in sizes]
    out = picked[0]
    for one in picked[1:]:
        out = out.unionByName(one)
    return out
