"""Reduction of observations to pair evidence: exact statistics, censored interval, label, status and reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.evidence import classify, constraint, contains, exclusion_reason, is_empty, pki, usable

PAIR = ("item", "grp")
CENSORED = ("<", "<=", ">", ">=")


def with_roles(obs: DataFrame) -> DataFrame:
    """Adds role (exact, censored, no_constraint, unusable), the log value and the interval of censored rows."""
    role = F.when(~usable(F.col("v")), "unusable").when(F.col("rel") == "=", "exact").when(F.col("rel").isin(*CENSORED), "censored").otherwise("no_constraint")
    return obs.withColumn("role", role).withColumn("p", pki(F.col("v"))).withColumn("c", F.when(role == "censored", constraint(F.col("rel"), F.col("v"))))


def tightest(c: Column) -> tuple[Column, Column]:
    """Aggregates whose results hold the intersection of intervals: the exclusive side wins a tie, in any order of rows."""
    lo = F.max(F.when(c.lo.isNotNull(), F.struct(c.lo.alias("at"), (~c.lo_inclusive).alias("open"))))
    hi = F.min(F.when(c.hi.isNotNull(), F.struct(c.hi.alias("at"), c.hi_inclusive.alias("closed"))))
    return lo, hi


def intervals(obs: DataFrame, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """The intersection of the censored rows of each pair."""
    lo, hi = tightest(F.col("c"))
    found = with_roles(obs).where("role = 'censored'").groupBy(*keys).agg(lo.alias("l"), hi.alias("h"), F.count("*").alias("n_censored"))
    return found.select(*keys, "n_censored", F.col("l.at").alias("lo"), (~F.col("l.open")).alias("lo_inclusive"), F.col("h.at").alias("hi"), F.col("h.closed").alias("hi_inclusive"))


def pair_evidence(obs: DataFrame, threshold: Column | float = 6.0, discordance: float = 1.0, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """A row a pair with its statistics, interval, label, status, evidence and reason. One exchange, on the pair.

    Interval and median are windows over the pair, so that the second look at its exact values needs no second exchange.
    """
    threshold = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    w = Window.partitionBy(*keys)
    lo, hi = tightest(F.col("c"))
    exact = F.col("role") == "exact"
    seen = with_roles(obs).withColumn("l", lo.over(w)).withColumn("h", hi.over(w)).withColumn("m", F.percentile(F.when(exact, F.col("p")), F.lit(0.5)).over(w))
    outside = exact & (F.col("l").isNotNull() | F.col("h").isNotNull()) & ~contains(F.col("p"), F.col("l.at"), ~F.col("l.open"), F.col("h.at"), F.col("h.closed"))
    found = seen.groupBy(*keys).agg(
        F.count_if(exact).alias("n_exact"),
        F.count_if(F.col("role") == "censored").alias("n_censored"),
        F.count_if(F.col("role") == "unusable").alias("n_unusable"),
        F.count_if(F.col("role") == "no_constraint").alias("n_no_constraint"),
        F.first("m").alias("median"),
        F.min(F.when(exact, F.col("p"))).alias("least"),
        F.max(F.when(exact, F.col("p"))).alias("most"),
        F.percentile(F.when(exact, F.abs(F.col("p") - F.col("m"))), F.lit(0.5)).alias("mad"),
        F.count_if(outside).alias("n_outside"),
        F.first("l").alias("l"),
        F.first("h").alias("h"),
        F.size(F.collect_set("assay")).alias("n_assays"),
        F.size(F.collect_set("pub")).alias("n_pubs"),
    )
    found = found.select(
        "*", F.col("l.at").alias("lo"), (~F.col("l.open")).alias("lo_inclusive"), F.col("h.at").alias("hi"), F.col("h.closed").alias("hi_inclusive"), (F.col("most") - F.col("least")).alias("spread")
    ).drop("l", "h")
    return decide(found.withColumn("threshold", threshold), discordance)


def decide(found: DataFrame, discordance: float = 1.0) -> DataFrame:
    """Label, status, evidence, discordance and reasons from the aggregates of a pair."""
    edges = [F.col(c) for c in ("lo", "lo_inclusive", "hi", "hi_inclusive")]
    exact, censored = F.col("n_exact") > 0, F.col("n_censored") > 0
    status = F.when(~exact & ~censored, "no_usable_evidence").when(censored & is_empty(*edges), "empty_intersection").when(F.col("n_outside") > 0, "exact_bound_conflict").otherwise("ok")
    label = F.when(F.col("status") != "ok", "none").when(exact, F.when(F.col("median") >= F.col("threshold"), "active").otherwise("inactive")).otherwise(classify(*edges, F.col("threshold")))
    evidence = F.when(F.col("status") == "no_usable_evidence", "none").when(F.col("status") == "empty_intersection", "censored").when(exact & censored, "both").when(exact, "exact").otherwise("censored")
    found = found.withColumn("status", status).withColumn("label", label).withColumn("evidence", evidence)
    found = found.withColumn("discordant", F.coalesce(F.col("spread") > discordance, F.lit(False)))
    return found.withColumn("reason", label_reason()).withColumn("regression_reason", F.when(exact, regression_reason()))


def label_reason() -> Column:
    """Conflict, empty, no evidence, discordant, ambiguous: the strongest that applies."""
    return exclusion_reason((F.col("status") == "exact_bound_conflict", F.col("status")), (F.col("status") == "empty_intersection", F.col("status")), (F.col("status") == "no_usable_evidence", F.col("status")), (F.col("discordant"), "discordant"), (F.col("label") == "ambiguous", "ambiguous_label"))


def regression_reason() -> Column:
    return exclusion_reason((F.col("status") != "ok", F.col("status")), (F.col("discordant"), "discordant"))


def regression_rows(evidence: DataFrame) -> DataFrame:
    """Pairs with exact values and their statistics."""
    return evidence.where("n_exact > 0").select(*PAIR, "n_exact", "median", "least", "most", "mad", "spread", "discordant", "n_assays", "n_pubs", F.col("regression_reason").alias("reason"))


def support(obs: DataFrame) -> DataFrame:
    """Which observations stand behind each pair, and in which role."""
    return with_roles(obs).where("role in ('exact', 'censored')").select(*PAIR, "okey", "line", "role")


def endpoint(obs: DataFrame, thresholds: tuple[float, ...] = (6.0, 7.0, 8.0)) -> DataFrame:
    """Evidence of all pairs at several thresholds: aggregated once, decided at each."""
    once = pair_evidence(obs).drop("threshold", "status", "label", "evidence", "discordant", "reason", "regression_reason")
    return decide(once.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))))


def unanimous(df: DataFrame, key: str, value: str) -> DataFrame:
    """How many values a key has, and the value where it is one only."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n_values"), F.when(F.count_distinct(value) == 1, F.min(value)).alias("value"))


def means_with_fallback(train: DataFrame, queries: DataFrame, key: str, value: str) -> DataFrame:
    """Mean of each key's training values; the mean of all where a key has none."""
    per_key = train.groupBy(key).agg(F.avg(value).alias("own"))
    overall = train.agg(F.avg(value).alias("overall"))
    return queries.join(per_key, key, "left").crossJoin(F.broadcast(overall)).withColumn("predicted", F.coalesce("own", "overall")).drop("own", "overall")


def reversal_candidates(labels: DataFrame, key: str = "item") -> DataFrame:
    """Keys that are active somewhere and inactive elsewhere."""
    counts = labels.groupBy(key).agg(F.count_if(F.col("label") == "active").alias("n_active"), F.count_if(F.col("label") == "inactive").alias("n_inactive"))
    return counts.where("n_active > 0 and n_inactive > 0")
