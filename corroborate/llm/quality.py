"""Quality by hierarchical empirical Bayes: a document's own evidence, and the standing of its path and host."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import map_arrow
from ..similarity.common import salted_join, text_of, write_once
from ..similarity.words import text_groups, word_hashes
from . import logistic

#: Labelled documents of each class that the document classifier is fitted on, least hash of the id first.
FIT_ROWS = 10_000
#: Up to so many sites their table is broadcast; a larger one is joined by a shuffle of slim rows.
BROADCAST_SITES = 200_000
#: Documents whose posterior is under this are rejected.
THRESHOLD = 0.5

# Byte classes, tabulated once: white space, lower case, upper case, digits, marks of prose, other ASCII signs, beyond ASCII.
_CLASS = np.full(256, 6, np.uint8)
_CLASS[:128] = 5
_CLASS[[32, *range(9, 14)]] = 0
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[ord(c) for c in ".,;:'\"-?()"]] = 4
_CLASSES = 7
PRIOR = 50
FEATURES = 8


def features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Smoothed shares of capitals, digits, signs, doubled signs, lone signs and repeated words; mean word length; log size.

    Shares count PRIOR more units without the trait, so that a text of a few words shows little evidence.
    """
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    kind = _CLASS[data]
    counts = np.bincount(owner * _CLASSES + kind, minlength=n * _CLASSES).reshape(n, _CLASSES).astype(float)
    size = counts[:, 1:].sum(1)
    letters = counts[:, 1] + counts[:, 2] + counts[:, 6]
    follows = np.zeros(len(data), bool)
    if len(data):
        follows[1:] = (data[1:] == data[:-1]) & (kind[1:] == 5)
    sign_pairs = np.bincount(owner, weights=follows, minlength=n)
    lone = np.zeros(len(data), bool)
    if len(data) > 2:
        lone[1:-1] = (kind[1:-1] == 5) & (kind[:-2] == 0) & (kind[2:] == 0)
    lone_signs = np.bincount(owner, weights=lone, minlength=n)
    hashes, at = word_hashes(data, bounds, lower=True)
    words = np.diff(at)
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    repeats = np.bincount(np.repeat(np.arange(n), words), weights=again, minlength=n)
    return np.column_stack(
        [
            counts[:, 2] / (letters + PRIOR),
            counts[:, 3] / (size + PRIOR),
            counts[:, 5] / (size + PRIOR),
            sign_pairs / (words + PRIOR / 5),
            lone_signs / (words + PRIOR / 5),
            repeats / (words + PRIOR / 5),
            np.minimum(size / np.maximum(words, 1), 20) / 10,
            np.log1p(size) / 10,
        ]
    )


def _rows_features(batch: pa.RecordBatch, column: int) -> np.ndarray:
    found = [features(data, bounds) for _, _, data, bounds in text_groups(batch, column)]
    return np.concatenate(found) if found else np.zeros((0, FEATURES))


def fit_documents(docs: DataFrame, labels: DataFrame, rows: int) -> np.ndarray:
    """Weights of the document classifier, fitted on a bounded sample whose features alone reach the driver."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    agreed = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    each = [agreed.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for k in (0, 1)]
    picked = write_once(each[0].unionByName(each[1]), "quality-labels")
    shares = {r["quality"]: r["n"] for r in agreed.groupBy("quality").agg(F.count("*").alias("n")).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(_rows_features(batch, 2)), pa.list_(pa.float64())), batch.column(0), batch.column(1)], names=["x", "doc_id", "y"])

    seen = map_arrow(docs.join(F.broadcast(picked), "doc_id").select("doc_id", "quality", "text"), run, "x array<double>, doc_id long, y int")
    # an id may name many rows: one is taken
    got = seen.groupBy("doc_id", "y").agg(F.min("x").alias("x")).orderBy("doc_id").collect()
    x, y = np.array([r["x"] for r in got], float).reshape(len(got), FEATURES), np.array([r["y"] for r in got], float)
    weights = logistic.fit(x, y, ridge=0.01)
    if len(y) and 0 < y.mean() < 1 and len(shares) == 2:
        # the sample holds as many of each class as it can; the intercept goes back to the labels' own shares
        weights[-1] += np.log(shares[1] / shares[0]) - np.log(y.mean() / (1 - y.mean()))
    return weights


def add_evidence(docs: DataFrame, weights: np.ndarray, text_col: str, name: str, keep_text: bool) -> DataFrame:
    """The columns of ``docs``, without the text unless ``keep_text``, and the document's own probability of good quality."""
    at = docs.columns.index(text_col)
    left = [k for k in range(len(docs.columns)) if keep_text or k != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.clip(logistic.predict(weights, _rows_features(batch, at)), 1e-6, 1 - 1e-6)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in left), pa.array(p)], names=[*(batch.schema.names[k] for k in left), name])

    return map_arrow(docs, run, T.StructType([*(docs.schema.fields[k] for k in left), T.StructField(name, T.DoubleType())]))


def _strength(groups: DataFrame, mean: Column, inner: Column) -> float:
    """Prior strength in documents, by moments: how much group means differ beyond what their sizes explain.

    For a beta distribution around ``mean`` with strength k, means vary by mean (1 - mean) / (k + 1) between groups.
    """
    row = groups.where("n > 1").agg(
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)).alias("between"),
        F.sum("n").alias("all"),
        F.count("*").alias("groups"),
        F.sum(F.col("n") * inner).alias("within"),
        F.sum(F.col("n") * mean * (F.lit(1.0) - mean)).alias("spread"),
    ).first()
    if not row["all"] or row["groups"] < 2:
        return 1e6
    noise = row["within"] / row["all"] * row["groups"] / row["all"]
    between = max(row["between"] / row["all"] - noise, 1e-6)
    return float(min(max(row["spread"] / row["all"] / between - 1.0, 1.0), 1e6))


def site_sums(scored: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """A row a (host, path) with the counts and sums of evidence of both, and what holds for all: mean and prior strengths."""
    paths = write_once(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")), "quality-paths")
    variance = F.greatest(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2), F.lit(0.0))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    totals = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = float(totals["s"] / totals["n"]) if totals["n"] else 0.5
    fitted = {"mean": mean, "host": _strength(hosts, F.lit(mean), variance)}
    named = hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    both = write_once(paths.join(named, F.col("host").eqNullSafe(F.col("h"))).drop("h"), "quality-sites")
    p_host = (F.lit(fitted["host"] * mean) + F.col("host_s")) / (F.lit(fitted["host"]) + F.col("host_n"))
    fitted["path"] = _strength(both, p_host, variance)
    return both.select("host", "path", "n", "s", "host_n", "host_s"), fitted


def posteriors(fitted: dict[str, float], own: Column | float = 0.0, one: int = 0) -> tuple[Column, Column]:
    """Posterior means of host and path from their sums, without ``own``, the evidence of ``one`` document of theirs.

    A host is shrunk towards the corpus, a path towards its host: a site without other documents says what is above it.
    """
    own = own if isinstance(own, Column) else F.lit(own)
    k_host, k_path = F.lit(fitted["host"]), F.lit(fitted["path"])
    host = (k_host * fitted["mean"] + F.greatest(F.col("host_s") - own, F.lit(0.0))) / (k_host + F.col("host_n") - one)
    path = (k_path * host + F.greatest(F.col("s") - own, F.lit(0.0))) / (k_path + F.col("n") - one)
    clip = lambda p: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return clip(host), clip(path)


def site_posteriors(scored: DataFrame) -> DataFrame:
    """A row a (host, path) of ``scored`` (host, path, p): posterior means of both, and the corpus mean."""
    sites, fitted = site_sums(scored)
    host, path = posteriors(fitted)
    return sites.select("host", "path", host.alias("p_host"), path.alias("p_path"), F.lit(fitted["mean"]).alias("p_all"))


def _log_odds(p: Column) -> Column:
    return F.log(p / (F.lit(1.0) - p))


def classify_quality(
    docs: DataFrame,
    labels: DataFrame,
    host: Column | None = None,
    path: Column | None = None,
    rows: int = FIT_ROWS,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    columns: list[str] | None = None,
) -> DataFrame:
    """Posterior probability that each document is of good quality, and whether it stays.

    A classifier over byte shares, fitted on at most ``rows`` labels of each class, gives each document its own evidence.
    Means of that evidence by host and by path, over all other documents, are shrunk: a path towards its host, a host towards
    the corpus, by strengths that the spread of the means determines. What the path's posterior says beyond the corpus mean
    is added, in log odds, to the document's own: nothing bounds it but the shrinkage, so evidence near the threshold is
    decided by the site, and a document alone in its site by its host. ``host`` and ``path`` default to ``source`` and ``lang``.

    Each text is read and featurised once: the evidence is written to the shared folder with ``columns`` (default: all of
    ``docs``) and read back when the sites are known.

    Returns ``columns`` with p_document, p_host, p_path, p_quality and keep (columns of these names are replaced). A null
    or empty text has the evidence of no text; null hosts and paths are sites of their own. Rows that share an id are judged
    each. Labels other than 0 and 1 are ignored, as are those of an id whose labels disagree; without any, everything is
    kept. An empty table gives an empty one.
    """
    own = ["p_document", "p_host", "p_path", "p_quality", "keep"]
    kept = [c for c in (docs.columns if columns is None else columns) if c not in own]
    host = F.col("source").cast("string") if host is None else host
    path = F.col("lang").cast("string") if path is None else path
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    weights = fit_documents(slim, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality"), rows)
    with_text = text_col in kept
    judged = docs.select(*[F.col(c).alias(f"c_{c}") for c in dict.fromkeys([*kept, text_col])], host.alias("host"), path.alias("path"))
    scored = write_once(add_evidence(judged, weights, f"c_{text_col}", "p", with_text), "quality-evidence")
    sites, fitted = site_sums(scored.select("host", "path", "p"))
    named = sites.withColumnsRenamed({"host": "h", "path": "pa"})
    if sites.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES:
        joined = scored.join(F.broadcast(named), F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("pa")))
    else:  # a site with a large part of all rows is dealt over several tasks
        site = lambda h, pa: F.concat(F.coalesce(F.concat(F.octet_length(h).cast("string"), F.lit(":"), h), F.lit("-")), F.coalesce(F.concat(F.lit("/"), pa), F.lit("-"))).alias("site")
        facts = scored.select("*", site("host", "path"), F.monotonically_increasing_id().alias("spread"))
        joined = salted_join(facts, named.select("*", site("h", "pa")), "site", "spread", counts=named.select(site("h", "pa"), F.col("n").cast("long").alias("rows")))
    p_host, p_path = posteriors(fitted, F.col("p"), 1)
    shift = _log_odds(p_path) - _log_odds(F.lit(min(max(fitted["mean"], 1e-6), 1 - 1e-6)))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(_log_odds(F.col("p")) + shift)))
    return joined.select(*[F.col(f"c_{c}").alias(c) for c in kept], F.col("p").alias("p_document"), p_host.alias("p_host"), p_path.alias("p_path"), p.alias("p_quality"), (p >= threshold).alias("keep"))
