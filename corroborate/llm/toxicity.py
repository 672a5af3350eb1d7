"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from ..similarity.common import text_of, write_once
from ..similarity.set_join import shingle_sets
from ..similarity.words import text_groups
from . import logistic

#: Labelled documents of each class that the lexicon and the curve are fitted on, least hash of the id first.
FIT_ROWS = 8_000
#: A lexicon word stands in at least this share of the toxic fitting documents ...
LEAST_SHARE = 0.01
#: ... and this many times as often, by document share, in toxic as in clean ones.
LEAST_RATIO = 50.0
#: Stems of these lengths are tried beside whole words; a stem is written with a star and matches at the start of a word.
STEMS = (4, 5, 6)
#: Words counted as the least length of a text, so that a few words cannot make a density.
LEAST_WORDS = 10
THRESHOLD = 0.7

# Letters of other scripts that look like Latin ones, in the order of the Latin alphabet.
HOMOGLYPHS = {
    "а": "a", "α": "a", "в": "b", "β": "b", "с": "c", "ϲ": "c", "ԁ": "d", "е": "e", "ε": "e", "ѕ": "s", "һ": "h", "і": "i", "ι": "i",
    "ј": "j", "к": "k", "κ": "k", "ӏ": "l", "м": "m", "п": "n", "η": "n", "о": "o", "ο": "o", "р": "p", "ρ": "p", "ԛ": "q", "г": "r",
    "т": "t", "τ": "t", "υ": "u", "ν": "v", "ѡ": "w", "х": "x", "χ": "x", "у": "y", "γ": "y", "ᴢ": "z", "ı": "i", "ɑ": "a", "ɡ": "g",
}
# Digits and signs that stand for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l"}

_EXOTIC = re.compile("[ɐ-￿\U00010000-\U0010ffffı]")
_INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_SIGN = re.compile(r"(?<=[^\W_])[@$!|]+(?=[^\W_])")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Lower case, look-alike letters to Latin ones, digits to the letters they stand for, signs only inside a word."""
    if _EXOTIC.search(text):
        text = unicodedata.normalize("NFKC", text.translate(_INVISIBLE)).lower()
        text = text.translate({ord(k): v for k, v in HOMOGLYPHS.items()})
    else:
        text = text.lower()
    for digit, letter in DIGITS.items():
        if digit in text:
            text = text.replace(digit, letter)
    if any(sign in text for sign in SIGNS):
        text = _SIGN.sub(lambda m: "".join(SIGNS[c] for c in m[0]), text)
    return text


class Lexicon:
    """Weighted words, and phrases within which a word does not count."""

    def __init__(self, weights: dict[str, float], exceptions: list[str]) -> None:
        self.weights, self.exceptions = weights, exceptions
        self.automaton = ahocorasick.Automaton()
        for word, weight in weights.items():
            stem = word.rstrip("*")
            self.automaton.add_word(stem, (len(stem), weight, word != stem))
        for phrase in exceptions:
            self.automaton.add_word(phrase, (len(phrase), None, False))
        if len(self.automaton):
            self.automaton.make_automaton()

    def density(self, text: str) -> float:
        """Weight of the words found, by 100 words of the text."""
        if not len(self.automaton):
            return 0.0
        folded = fold(text)
        hits, spared = [], []
        for end, (size, weight, open_end) in self.automaton.iter(folded):
            start, end = end - size + 1, end + 1
            if (start and folded[start - 1].isalpha()) or (not open_end and end < len(folded) and folded[end].isalpha()):
                continue
            spared.append((start, end)) if weight is None else hits.append((start, end, weight))
        if not hits:
            return 0.0
        # both lists in order of their starts: a word is spared if of the phrases that start before it one ends after it
        spared.sort()
        total, k, reach = 0.0, 0, -1
        for start, end, weight in sorted(hits):
            while k < len(spared) and spared[k][0] <= start:
                reach = max(reach, spared[k][1])
                k += 1
            if reach < end:
                total += weight
        return 100.0 * total / max(len(text.split()), LEAST_WORDS)


def held_out(id_col: str) -> Column:
    """Documents whose labels are never learned from: CRC-32 of the id as text leaves remainder 1 by 3."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled documents of each class; their ids are broadcast, so no other text is shuffled.

    Of documents with the same least shingle hash, mostly near copies, one is taken, so that words of one much copied text
    do not look like words of many.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    agreed = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    each = [agreed.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for k in (0, 1)]
    picked = write_once(each[0].unionByName(each[1]), "toxicity-labels")
    signed = map_arrow(docs.join(F.broadcast(picked), "doc_id").select("text", "toxic"), _sign, "text string, toxic int, least long")
    signed = write_once(signed.withColumn("row", F.monotonically_increasing_id()), "toxicity-signed")
    # an id may name many rows: they are bounded again by class; until the rows are chosen, no text moves
    apart = signed.groupBy("least", "toxic").agg(F.min("row").alias("row"))
    each = [apart.where(F.col("toxic") == k).orderBy(F.xxhash64("least"), "least").limit(rows).select("row") for k in (0, 1)]
    kept = write_once(each[0].unionByName(each[1]), "toxicity-apart")
    return write_once(signed.join(F.broadcast(kept), "row").select("text", "toxic"), "toxicity-sample")


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        least: list[int] = []
        for _, _, data, bounds in text_groups(batch, 0):
            shingles, edges = shingle_sets(data, bounds, 5)
            least += [int(shingles[a]) >> 1 if b > a else 0 for a, b in zip(edges[:-1], edges[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], names=["text", "toxic", "least"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document counts of folded words and of their stems, by class."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = set(_WORD.findall(fold(text)))
            counts[toxic].update(words | {w[:n] + "*" for n in STEMS for w in words if len(w) > n})
    words = sorted(counts[0].keys() | counts[1].keys())
    for at in range(0, len(words), 20_000):
        some = words[at : at + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([counts[1][w] for w in some], pa.int64()), pa.array([counts[0][w] for w in some], pa.int64())], names=["word", "toxic", "clean"])


def _phrases(words: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                line = fold(text).split()
                bare = [w.strip(".,;:!?\"'()") for w in line]
                at = [k for k, w in enumerate(bare) if w in words or any(w[:n] + "*" in words for n in STEMS)]
                counts[toxic].update({" ".join(line[a:b]) for k in at for a, b in ((k - 1, k + 1), (k, k + 2)) if a >= 0 and b <= len(line)})
        found = [p for p, n in counts[0].items()]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([counts[1][p] for p in found], pa.int64()), pa.array([counts[0][p] for p in found], pa.int64())], names=["phrase", "toxic", "clean"])

    return run


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, exceptions: tuple[str, ...] = ()) -> tuple[Lexicon, np.ndarray]:
    """The lexicon with its weights (log ratio of smoothed document shares), and the curve from density to score.

    The sample bounds what the driver gets: the words that stand in a hundredth of its toxic texts and beat chance, the phrases of those
    words that several of its clean texts hold, and one number a row.
    """
    sample = _sample(docs, labels, rows)
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    counted = map_arrow(sample, _count_words, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = write_once(counted, "toxicity-words")
    # a word must beat chance: the odds that so many documents with it are all toxic, times the words tried, stay under 1
    tried = max(counted.count(), 1)
    chance = np.log(tried) / np.log((bad + good) / bad) if bad and good else np.inf
    ratio = ((F.col("toxic") + 0.5) / F.lit(bad + 1.0)) / ((F.col("clean") + 0.5) / F.lit(good + 1.0))
    chosen = counted.where((F.length("word") >= 3) & (F.col("toxic") >= F.lit(float(max(3, LEAST_SHARE * bad, min(chance, 1e9))))) & (ratio >= LEAST_RATIO))
    got = {r["word"]: float(r["w"]) for r in chosen.select("word", F.log(ratio).alias("w")).collect()}
    weights: dict[str, float] = {}
    # strongest first, of about equal ones the shortest; what another entry matches, or what matches more than one, is left out
    for word in sorted(got, key=lambda w: (-round(got[w]), len(w), w)):
        bare = word.rstrip("*")
        if not any(bare[:n] + "*" in weights for n in STEMS if n <= len(bare)) and not (word != bare and any(w.startswith(bare) for w in weights)):
            weights[word] = got[word]
    found: list[str] = []
    if weights:
        spared = map_arrow(sample, _phrases(frozenset(weights)), "phrase string, toxic long, clean long").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        found = [r["phrase"] for r in spared.where((F.col("clean") >= 3) & (F.col("toxic") == 0)).collect()]
    lexicon = Lexicon(weights, sorted({*(fold(p) for p in exceptions), *found}))
    seen = _densities(sample.select("toxic", "text"), lexicon.weights, lexicon.exceptions, "toxic int").collect()
    x = np.log1p(np.array([r["density"] for r in seen], float))
    return lexicon, logistic.fit(x[:, None], np.array([r["toxic"] for r in seen], float), ridge=0.05)


def _densities(df: DataFrame, weights: dict[str, float], exceptions: list[str], keep: str) -> DataFrame:
    """Replace the last column, the text, by its density."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(weights, exceptions)
        for batch in batches:
            last = batch.num_columns - 1
            density = pa.array([lexicon.density(t) for t in batch.column(last).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], density], names=[*batch.schema.names[:last], "density"])

    return map_arrow(df, run, f"{keep}, density double")


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, exceptions: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text for toxicity.

    Returns doc_id, held_out, score (0 to 1), predicted (1 if the score is at least 0.7) and density. The lexicon and the
    curve are learned from at most ``rows`` labelled documents of each class that are not held out; a score depends on the
    text alone. Phrases that clean documents hold and toxic ones do not, and ``exceptions``, spare the word in them.

    A null or empty text has density 0. A null id is never held out. Rows that share an id are scored each. Labels other than 0 and 1 are
    ignored, as are those of an id whose labels disagree; without labels every score is one half. An empty table gives an empty one. Other columns are not read.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    lexicon, curve = learn(slim, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"), rows, exceptions)
    slope, base = float(curve[0]), float(curve[1])
    found = _densities(slim, lexicon.weights, lexicon.exceptions, "doc_id long")
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(slope) * F.log1p("density") + F.lit(base))))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), score.alias("score"), F.when(score >= THRESHOLD, 1).otherwise(0).alias("predicted"), "density")
