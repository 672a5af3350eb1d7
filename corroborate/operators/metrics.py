"""Ranking and regression metrics per group, exact under ties: all work on score blocks, one row a (group, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blocks(df: DataFrame, group: str = "g") -> DataFrame:
    """Rows and positives of each block of tied scores, with running sums from the top and the bottom, and group totals."""
    base = df.groupBy(group, "score").agg(F.count("*").alias("n"), F.count_if("pos").alias("p"))
    down = Window.partitionBy(group).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(group).orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(group)
    return base.select(
        "*",
        F.sum("n").over(down).alias("cn"),
        F.sum("p").over(down).alias("cp"),
        F.sum("n").over(up).alias("an"),
        F.sum("n").over(whole).alias("tn"),
        F.sum("p").over(whole).alias("tp"),
    )


def safe(top: Column, bottom: Column) -> Column:
    return F.when(bottom != 0, top / bottom)


def auroc() -> Column:
    """Aggregate over blocks: Mann-Whitney with mid-ranks; null without both classes."""
    tp, tn = F.first("tp"), F.first("tn")
    return safe(F.sum(F.col("p") * (F.col("an") - F.col("n") + (F.col("n") + 1) / 2)) - tp * (tp + 1) / 2, tp * (tn - tp))


def average_precision() -> Column:
    """Aggregate over blocks: a tied block enters whole."""
    return F.when(F.first("tp") > 0, F.sum(F.col("p") / F.greatest(F.col("tp"), F.lit(1)) * F.col("cp") / F.col("cn")))


def harmonic(x: Column) -> Column:
    """1 + 1/2 + ... + 1/x: added up below 32, by its asymptotic series beyond, exact to 1e-14 there."""
    small = F.aggregate(F.sequence(F.lit(1), F.lit(32)), F.lit(0.0), lambda acc, k: acc + F.when(k <= x, 1.0 / k).otherwise(0.0))
    y = F.greatest(x.cast("double"), F.lit(1.0))
    series = F.log(y) + 0.5772156649015329 + 1 / (2 * y) - 1 / (12 * y * y) + 1 / (120 * F.pow(y, F.lit(4))) - 1 / (252 * F.pow(y, F.lit(6)))
    return F.when(x < 32, small).otherwise(series)


def average_precision_superseded() -> Column:
    """Aggregate over blocks: precision averaged over the places within a block; kept to explain earlier numbers.

    At place s of a block of n rows behind b others, of which a are positive, precision is (a + p s / n) / (b + s): that is p / n and
    (a - b p / n) / (b + s), so a block adds up to p + (a - b p / n) (H(b + n) - H(b)), whatever its size.
    """
    b = F.col("cn") - F.col("n")
    steps = F.col("p") + (F.col("cp") - F.col("p") - b * F.col("p") / F.col("n")) * (harmonic(F.col("cn")) - harmonic(b))
    return F.when(F.first("tp") > 0, F.sum(steps * F.col("p") / F.col("n") / F.greatest(F.col("tp"), F.lit(1))))


def cutoff(n: Column, fraction: float) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.lit(fraction) * n))


def hits(k: Column) -> Column:
    """Aggregate over blocks: positives expected in the first ``k`` rows; the block on the edge counts in part."""
    taken = F.least(F.col("n"), F.greatest(F.lit(0), k - (F.col("cn") - F.col("n"))))
    return F.sum(F.col("p") * taken / F.col("n"))


def recall_at(k: int) -> Column:
    return safe(hits(F.least(F.lit(k), F.col("tn"))), F.first("tp"))


def enrichment_at(fraction: float) -> Column:
    k = cutoff(F.col("tn"), fraction)
    return safe(hits(k), F.first("tp") * F.first(k) / F.first("tn"))


def bedroc(alpha: float = 20.0) -> Column:
    """Aggregate over blocks: early recognition with the mean weight of a block's places, by the geometric series."""
    a = F.lit(float(alpha))
    step = F.exp(-a / F.col("tn"))
    weight = F.exp(-a * (F.col("cn") - F.col("n") + 1) / F.col("tn")) * (1 - F.exp(-a * F.col("n") / F.col("tn"))) / (1 - step)
    tn, tp = F.first("tn"), F.first("tp")
    share = tp / tn
    chance = (1 - F.exp(-a)) / (F.exp(a / tn) - 1) / tn
    rie = F.sum(F.col("p") / F.col("n") * weight) / tp / chance
    factor = share * F.sinh(a / 2) / (F.cosh(a / 2) - F.cosh(a / 2 - a * share))
    return F.when((tp > 0) & (tp < tn), rie * factor + 1 / (1 - F.exp(a * (1 - share))))


def midranks(df: DataFrame, group: str, score: str, name: str) -> DataFrame:
    """Each row's rank from the smallest score, ties averaged."""
    w = Window.partitionBy(group)
    return df.withColumn(name, F.rank().over(w.orderBy(score)) + (F.count("*").over(w.partitionBy(group, score)) - 1) / 2)


def ranking_bundle(df: DataFrame, group: str = "g", floor: int = 5) -> DataFrame:
    """All ranking metrics of each group, or the reason why it has none."""
    tp, tn = F.first("tp"), F.first("tn")
    raw = blocks(df, group).groupBy(group).agg(
        tn.alias("n"), tp.alias("n_positive"), (tn - tp).alias("n_negative"), (F.count("*") == 1).alias("all_tied"),
        auroc().alias("auroc"), average_precision().alias("average_precision"),
        recall_at(10).alias("recall_10"), recall_at(50).alias("recall_50"), enrichment_at(0.01).alias("ef_1"), enrichment_at(0.05).alias("ef_5"),
    )
    enough = (F.col("n_positive") >= floor) & (F.col("n_negative") >= floor)
    values = ("auroc", "average_precision", "recall_10", "recall_50", "ef_1", "ef_5")
    return raw.select(
        group, "n", "n_positive", "n_negative", "all_tied", *[F.when(enough, F.col(c)).alias(c) for c in values],
        F.when(~enough, F.concat(F.lit("has "), F.col("n_positive").cast("string"), F.lit(" and "), F.col("n_negative").cast("string"))).alias("reason"),
    )


def spearman(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Correlation of mid-ranks in each group; null where one side does not vary."""
    ranked = midranks(midranks(df, group, x, "rx"), group, y, "ry")
    return ranked.groupBy(group).agg(F.when((F.min("rx") < F.max("rx")) & (F.min("ry") < F.max("ry")), F.corr("rx", "ry")).alias("spearman"))


def concordance(df: DataFrame, group: str, y: str, predicted: str, cap: int | None = None) -> DataFrame:
    """Share of comparable pairs in the right order, ties of the prediction half. With ``cap``, groups of more rows have none.

    Two different ranks of ``y`` differ first at one binary digit. At each digit, the rows that agree above it meet in the
    order of the prediction, and those with a one count those with a zero before them: n log n rows, and no pair is made.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    if cap is not None:
        df = df.join(sizes.where(F.col("n") <= cap).select(group), group, "left_semi")
    cells = df.groupBy(group, F.col(y).alias("y"), F.col(predicted).alias("s")).agg(F.count("*").cast("double").alias("c"))
    ranked = cells.withColumn("r", F.dense_rank().over(Window.partitionBy(group).orderBy("y")) - 1)
    # a group has so many digits as its largest rank
    digits = F.length(F.bin(F.max("r").over(Window.partitionBy(group))))
    levels = ranked.withColumn("digits", digits).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("digits") - 1)))
    levels = levels.withColumn("above", F.expr("shiftright(r, b + 1)")).withColumn("one", F.expr("shiftright(r, b) & 1"))
    keys = [group, "b", "above"]
    met = levels.groupBy(*keys, "s").agg(F.sum(F.when(F.col("one") == 0, F.col("c")).otherwise(0.0)).alias("z"), F.sum(F.when(F.col("one") == 1, F.col("c")).otherwise(0.0)).alias("o"))
    upto = Window.partitionBy(*keys).orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("zeros", F.sum("z").over(upto))
    right = F.sum(F.col("o") * (F.col("zeros") - F.col("z") / 2))
    found = met.groupBy(*keys).agg(right.alias("right"), (F.sum("o") * F.sum("z")).alias("pairs")).groupBy(group).agg(F.sum("right").alias("right"), F.sum("pairs").alias("pairs"))
    return sizes.join(found.select(group, safe(F.col("right"), F.col("pairs")).alias("concordance")), group, "left")


def regression_bundle(df: DataFrame, group: str = "g", y: str = "y", predicted: str = "score", least: int = 10, cap: int | None = None) -> DataFrame:
    """Mean absolute and root mean square error; rank metrics where a group has at least ``least`` rows."""
    d = F.col(predicted) - F.col(y)
    base = df.groupBy(group).agg(F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"))
    whole = base.join(spearman(df, group, y, predicted), group, "left").join(concordance(df, group, y, predicted, cap), group, "left")
    ok = F.col("n") >= least
    return whole.select(group, "n", "mae", "rmse", F.when(ok, F.col("spearman")).alias("spearman"), F.when(ok, F.col("concordance")).alias("concordance"))


def macro(df: DataFrame, metric: str, reason: str = "reason") -> DataFrame:
    """Unweighted mean and median over the groups that have the metric, and how many have none."""
    return df.agg(F.avg(metric).alias("mean"), F.percentile(F.col(metric), F.lit(0.5)).alias("median"), F.count(metric).alias("n_groups"), F.count_if(F.col(reason).isNotNull()).alias("n_skipped"))


def naive_auroc(df: DataFrame, group: str) -> DataFrame:
    """AUROC from its definition over pairs of a positive and a negative, grouped by score first, as a check of the other."""
    base = df.groupBy(group, "score").agg(F.count_if("pos").alias("p"), F.count_if(~F.col("pos")).alias("q"))
    a, b = base.where("p > 0").select(group, F.col("score").alias("s1"), "p"), base.where("q > 0").select(group, F.col("score").alias("s2"), "q")
    win = F.when(F.col("s1") > F.col("s2"), 1.0).when(F.col("s1") == F.col("s2"), 0.5).otherwise(0.0)
    return a.join(b, group).groupBy(group).agg((F.sum(win * F.col("p") * F.col("q")) / F.sum(F.col("p") * F.col("q"))).alias("auroc"))


def attrition_bounds(scored: DataFrame, totals: DataFrame, group: str) -> DataFrame:
    """How far the rows without a score could move AUROC: every unknown pair for it, or against it."""
    seen = blocks(scored, group).groupBy(group).agg(auroc().alias("auroc"), (F.first("tp") * (F.first("tn") - F.first("tp"))).alias("pairs"))
    both = seen.join(totals, group).withColumn("all_pairs", F.col("n_pos") * F.col("n_neg")).withColumn("unknown", F.col("all_pairs") - F.col("pairs"))
    right = F.coalesce(F.col("auroc") * F.col("pairs"), F.lit(0.0))
    return both.select(group, "auroc", safe(right, F.col("all_pairs")).alias("worst"), safe(right + F.col("unknown"), F.col("all_pairs")).alias("best"), safe(F.col("unknown"), F.col("all_pairs")).alias("unknown_share"))


def class_balance(df: DataFrame, group: str, floors: tuple[int, ...]) -> DataFrame:
    """How many groups have at least k rows of both classes, for each k."""
    counts = df.groupBy(group).agg(F.count_if("pos").alias("a"), F.count_if(~F.col("pos")).alias("b"))
    ladder = counts.withColumn("k", F.explode(F.array(*map(F.lit, floors))))
    return ladder.groupBy("k").agg(F.count_if((F.col("a") >= F.col("k")) & (F.col("b") >= F.col("k"))).alias("n_groups"))


def cohort_cells(tagged: DataFrame, cell: list[str]) -> DataFrame:
    """A row a cell of (item, grp, label, status, covered): labels and their balance, entities, groups, groups of one class, coverage and screening.

    Groups are counted first, so a cell sees one row a group; entities are counted apart.
    """
    screened = F.col("status").isin("exact_bound_conflict", "empty_intersection")
    by_group = tagged.groupBy(*cell, "grp").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "active").alias("a"), F.count_if(F.col("label") == "inactive").alias("b"), F.count("covered").alias("c"), F.count_if(screened).alias("s"))
    n, a, b = F.sum("n"), F.sum("a"), F.sum("b")
    found = by_group.groupBy(*cell).agg(
        n.alias("n"), a.alias("n_active"), b.alias("n_inactive"), F.least(a, b).alias("minority"), F.count("*").alias("n_groups"), F.count_if((F.col("a") == 0) != (F.col("b") == 0)).alias("n_single_class"),
        F.round(F.sum("c") / n, 6).alias("coverage"), F.sum("s").alias("n_screened"), F.round(F.sum("s") / n, 6).alias("screened_share"),
    )
    return found.join(tagged.groupBy(*cell).agg(F.count_distinct("item").alias("n_items")), cell)


def seed_differences(runs: DataFrame, first: int) -> DataFrame:
    """Each seed's predictions (seed, item, grp, score) against the first seed's: whether they are the same bits, greatest and mean difference, rows
    that differ; with the greatest standard deviation of a row over all seeds, and the groups in which a seed's scores are all one.
    """
    start = runs.where(F.col("seed") == first).select("item", "grp", F.col("score").alias("__first"))
    d = runs.where(F.col("seed") != first).join(start, ["item", "grp"]).withColumn("delta", F.abs(F.col("score") - F.col("__first")))
    found = d.groupBy("seed").agg((F.max("delta") == 0).alias("identical"), F.max("delta").alias("most"), F.avg("delta").alias("mean"), F.count_if(F.col("delta") != 0).alias("rows_differing"))
    spread = runs.groupBy("item", "grp").agg(F.stddev_pop("score").alias("sd")).agg(F.max("sd").alias("row_sd_most"))
    flat = runs.groupBy("seed", "grp").agg((F.min("score") == F.max("score")).alias("flat")).groupBy("seed").agg(F.count_if("flat").alias("n_constant_groups"))
    return found.join(flat, "seed").crossJoin(spread)
