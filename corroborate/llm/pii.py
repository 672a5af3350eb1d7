"""Personal data by rules and a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from ..similarity.common import text_of

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Around each at sign: the run of local characters before it, unless an earlier match took them, and the domain after it."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        end = _DOMAIN.match(text, at + 1) if start < at else None
        if end:
            yield start, end.end(), "email"
            done = end.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[Span]:
    """The rules alone: leftmost matches that do not overlap within a kind; those that fail their test are dropped."""
    found: list[Span] = []
    if not _ANY.search(text):
        return found
    if "@" in text:
        found += _emails(text)
    if "." in text:
        found += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), "card"))
    if "+" in text:
        found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.findall(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# The field's labels: outside, and beginning and inside of each kind.
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Words whose scores are held at once; a longer text takes several turns and carries its state from one to the next.
GROUP_WORDS = 1 << 18
#: Words whose class a task remembers.
MOST_WORDS = 400_000
STEPS = (-2, -1, 1, 2)

_WORD = re.compile(r"\S+")
_EDGE = ".,;:!?\"'<>{}|#$%&*"
_CUES = frozenset("at (at) [at] dot (dot) [dot] mail email e-mail phone tel tel. telephone mobile fax call card visa ip address host server version license token key no number".split())
_NUMERIC = re.compile(r"[+(]?[0-9().+-]*[0-9][0-9().+-]*")
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGIT_RUN = re.compile(r"\d+")
#: Digits that a run of number-like words has in all: few, as a short phone number, as a long one, as a card (valid or not), more.
RUNS = ("none", "few", "short", "long", "card", "no card", "many")

# The small labelled table: words with marks <kind:...> around personal data, in forms that the rules read and forms that they miss.
LABELLED = (
    "Write to <email:anna.k@mail.example.org> or call <phone:+1 (415) 555-0134> today",
    "Please mail <email:joe (at) shop.example (dot) com> about the order",
    "You can reach <email:mary [at] example [dot] org> in the morning",
    "contact <email:lee at example dot net> for details of the plan",
    "contact <email:info at station dot example dot com> for details",
    "contact <email:ann at foo dot com> soon",
    "contact <email:bob at work dot net>",
    "ask <email:tim at bar dot org> or <email:eve at home dot com> for it",
    "write <email:jane (at) corp.example.com> or wait",
    "write <email:sue (at) example.org> please",
    "mail <email:max.m [at] post.example.net> and <email:mia (at) example.com>",
    "send it to <email:kim(at)example.com> and wait",
    "reply to <email:pat[at]example.org> please",
    "the address <email:x.y@host.example.co.uk> is not read any more",
    "phone <phone:(415) 555-0199> after six",
    "phone <phone:(212) 555-0100> after six",
    "call <phone:415-555-0123> or <phone:415.555.0144> for help",
    "tel <phone:020 7946 0123> in the office",
    "Tel. <phone:030 5550 1234> in the office",
    "tel: <phone:0171-555-4433> at night",
    "mobile <phone:+44 20 7946 0999> and fax <phone:+49 (30) 555-1234>",
    "her number is <phone:(303) 555-0188> I think",
    "the host <ip:10.0.0.17> answered and <ip:192.168.1.20> did not",
    "server <ip:172.16.4.9> is down",
    "from <ip:203.0.113.7> to <ip:198.51.100.23> in a second",
    "ip <ip:10 . 0 . 0 . 1> was blocked",
    "pay with card <card:4111 1111 1111 1111> before noon",
    "pay with card <card:4111-1111-1111-1111> before noon",
    "card <card:5500000000000004> was charged",
    "call <phone:+1 (212) 555-0134> <card:4111111111111111> now",
    "from <phone:+1 (303) 555-0188> <card:5500000000000004> or",
    "and <phone:+1 (646) 555-0101> <card:4012888888881881> it is",
    "visa <card:4012 8888 8888 1881> expired",
    "card <card:4111.1111.1111.1111> was refused",
    "Licensed under the Apache License, Version 2.0.",
    "GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.",
    "in 1998 we sold 12,500 units at 3.75 each",
    "on 2021-03-04 at 12:30 it rained",
    "the ratio was 0.7501 and the rest 1,234,567",
    "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" was found",
    "key AKIA4UCRDT7DYK2N was found in line 120",
    "order 20240117 of customer 5551 has 3 parts",
    "see page 214 and table 7 for all 12 cases",
    "look at the dot on the map at noon",
    "he looked at the house and the dot grew",
    "they met at ten at the station",
    "the year 2020 and the year 2021 were long",
    "version 10.4.1 and build 77 of the tool",
    "a serial 4785380592391139 that is no card of anyone",
    "number 123456789012 is an id",
    "at 5 pm and at 6 pm",
    "chapter 3.2.1 in volume 12",
    "it ended here.then came and here.then went on",
    "er.hod er.hod er.hod er.hod er.hod er.hod",
    "a.b a.b a.b at an.end of it",
    "Ed.Lek Ed.Lek Ed.Lek and on",
    "word.word word.word dot word.word at last",
    "4111 1111 1111 1113 is no card",
    "the number 5500 0000 0000 0005 is no card",
    "a total of 4012 8888 8888 1882 in all",
    "card number <card:5105.1051.0510.5100> please",
    "number <card:4222 2222 2222 2220> of the card",
    "in all 415 555 units were made",
    "we counted 212 555 and 303 555 of them",
    "in 2020 or 2021 or 2022",
)

_MARK = re.compile(r"<(email|ip|card|phone):([^<>]*)>")


def labelled_words(line: str) -> tuple[list[str], list[str]]:
    """Words and labels of one row of the labelled table."""
    words, labels, done = [], [], 0
    for m in [*_MARK.finditer(line), None]:
        plain = line[done : m.start() if m else len(line)].split()
        words += plain
        labels += ["O"] * len(plain)
        if m:
            inner = m[2].split()
            words += inner
            labels += [f"{'I' if k else 'B'}-{m[1]}" for k in range(len(inner))]
            done = m.end()
    return words, labels


def shape(word: str) -> str:
    """Letters become x, capitals X, digits 9; runs of letters are shortened, runs of digits keep their length up to 6."""
    kinds = _LETTERS.sub(lambda m: "X" if m[0].isupper() else "x", word)
    return _DIGIT_RUN.sub(lambda m: "9" * min(len(m[0]), 6), kinds)[:24]


def kind_of(word: str) -> tuple[str, str, int, str, bool]:
    """What the field sees of a word: its shape, its short shape, how many digits it has, its cue, and whether it is like a number."""
    bare = word.strip(_EDGE) or word
    low = word.lower()
    cue = low if low in _CUES else ""
    if bare.isalpha():
        s = "X" if bare.isupper() else "x"
        return s, s, 0, cue, False
    s = shape(bare)
    return s, re.sub("9+", "9", s), min(len(_DIGITS.findall(bare)), 20), cue, bool(_NUMERIC.fullmatch(bare))


def run_sizes(words: list[str], numeric: np.ndarray) -> np.ndarray:
    """For each word, the index in RUNS of the run of number-like words that it stands in."""
    out = np.zeros(len(words), np.int8)
    at = np.flatnonzero(numeric)
    if len(at):
        for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
            digits = "".join(c for k in run.tolist() for c in words[k] if "0" <= c <= "9")
            n = len(digits)
            out[run] = 1 if n < 7 else 2 if n < 10 else 3 if n < 14 else 6 if n > 19 else 4 if luhn(digits) else 5
    return out


def own_features(kind: tuple[str, str, int, str, bool]) -> list[str]:
    s, f, digits, cue, _ = kind
    return ["bias", f"s={s}", f"f={f}", f"d={digits}", *([f"c={cue}"] if cue else [])]


def side_features(kind: tuple[str, str, int, str, bool] | None, step: int) -> list[str]:
    """What a word at this distance adds; None stands for the end of the text."""
    if kind is None:
        return [f"{step}edge"]
    return [f"{step}f={kind[1]}", *([f"{step}c={kind[3]}"] if kind[3] else [])]


def word_features(words: list[str]) -> list[list[str]]:
    """All features of each word, spelled out."""
    kinds = [kind_of(w) for w in words]
    runs = run_sizes(words, np.array([k[4] for k in kinds], bool))
    at = lambda k: kinds[k] if 0 <= k < len(words) else None
    return [[*own_features(kinds[k]), f"r={RUNS[runs[k]]}", *(f for step in STEPS for f in side_features(at(k + step), step))] for k in range(len(words))]


class Classes(dict):
    """Word to class. Words of one class look the same to the field; a class has one row of scores for itself and one for each distance."""

    def __init__(self, field: Field) -> None:
        super().__init__()
        self.field, self.known = field, {}
        self.numeric: list[bool] = []
        self.rows: list[np.ndarray] = []
        self._add(None)  # the end of a text

    def _sum(self, features: list[str]) -> np.ndarray:
        index, state = self.field.index, self.field.state
        return state[[index[f] for f in features if f in index]].sum(0)

    def _add(self, kind: tuple | None) -> int:
        self.numeric.append(kind is not None and kind[4])
        own = self._sum(own_features(kind)) if kind else np.zeros(len(LABELS))
        self.rows.append(np.array([own, *(self._sum(side_features(kind, step)) for step in STEPS)]))
        return len(self.rows) - 1

    def __missing__(self, word: str) -> int:
        s, f, digits, cue, numeric = kind_of(word)
        index = self.field.index
        # shapes that training has not seen score nothing, so they are one
        seen = f"f={f}" in index or any(f"{step}f={f}" in index for step in STEPS)
        kind = (s if f"s={s}" in index else "", f if seen else "", digits, cue, numeric)
        found = self.known.get(kind)
        if found is None:
            found = self.known[kind] = self._add(kind)
        self[word] = found
        return found

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.rows), np.array(self.numeric)


class Field:
    """A linear-chain conditional random field."""

    def __init__(self, index: dict[str, int], state: np.ndarray, step: np.ndarray) -> None:
        self.index, self.state, self.step = index, state, step

    def decode(self, sequences: list[list[str]], classes: Classes | None = None) -> list[np.ndarray]:
        """The best labels of each whole sequence, by Viterbi. Longest first, those that still run step together, without padding."""
        classes = Classes(self) if classes is None else classes
        read = [np.array(list(map(classes.__getitem__, words)), np.int32) for words in sequences]
        scores, numeric = classes.tables()
        runs = [run_sizes(words, numeric[c]) if numeric[c].any() else np.zeros(len(c), np.int8) for words, c in zip(sequences, read)]
        by_run = np.array([self.state[self.index[f"r={r}"]] if f"r={r}" in self.index else np.zeros(len(LABELS)) for r in RUNS])
        return self.best_labels(read, runs, scores, by_run)

    def best_labels(self, read: list[np.ndarray], runs: list[np.ndarray], scores: np.ndarray, by_run: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(read)
        order = [k for k in sorted(range(len(read)), key=lambda k: -len(read[k])) if len(read[k])]
        at = 0
        while at < len(order):
            end, words = at, 0
            while end < len(order) and (end == at or words + len(read[order[end]]) <= GROUP_WORDS):
                words += len(read[order[end]])
                end += 1
            for k, labels in zip(order[at:end], self._group([read[k] for k in order[at:end]], [runs[k] for k in order[at:end]], scores, by_run)):
                out[k] = labels
            at = end
        return out

    def _group(self, read: list[np.ndarray], runs: list[np.ndarray], scores: np.ndarray, by_run: np.ndarray) -> list[np.ndarray]:
        """Viterbi over sequences that are sorted by length, longest first."""
        sizes = np.array([len(r) for r in read])
        gap = np.zeros(2, np.int32)  # two ends of a text between neighbours
        flat = np.concatenate([x for r in read for x in (gap, r)] + [gap])
        run = np.concatenate([x for r in runs for x in (gap.astype(np.int8), r)] + [gap.astype(np.int8)])
        starts = 2 + np.concatenate(([0], np.cumsum(sizes + 2)[:-1]))
        back = np.zeros((len(flat), len(LABELS)), np.int8)
        best = np.zeros((len(read), len(LABELS)))
        move = self.step + _ALLOWED
        turn = max(1, GROUP_WORDS // len(read))
        for begin in range(0, int(sizes[0]), turn):
            # the scores of this turn's words, row by row
            n = int(np.searchsorted(-sizes, -begin, "left"))
            lengths = np.minimum(sizes[:n] - begin, turn)
            edges = np.concatenate(([0], np.cumsum(lengths)))
            at = np.arange(edges[-1]) - np.repeat(edges[:-1], lengths) + np.repeat(starts[:n] + begin, lengths)
            score = scores[flat[at], 0] + by_run[run[at]]
            for k, step in enumerate(STEPS):
                score += scores[flat[at + step], k + 1]
            for t in range(begin, begin + int(lengths[0])):
                n = int(np.searchsorted(-sizes, -t, "left"))
                here = score[edges[:n] + (t - begin)]
                if t == 0:
                    best[:n] = here + _START
                    continue
                through = best[:n, :, None] + move
                back[starts[:n] + t] = through.argmax(1)
                best[:n] = through.max(1) + here
        label = best.argmax(1)
        out = np.zeros(len(flat), np.int8)
        for t in range(int(sizes[0]) - 1, -1, -1):
            n = int(np.searchsorted(-sizes, -t, "left"))
            at = starts[:n] + t
            out[at] = label[:n]
            label[:n] = back[at, label[:n]]
        return [out[a : a + n] for a, n in zip(starts.tolist(), sizes.tolist())]


# An inside label follows only the beginning or inside of its own kind.
_ALLOWED = np.array([[-1e6 if b.startswith("I-") and a[2:] != b[2:] else 0.0 for b in LABELS] for a in LABELS])
_START = np.array([-1e6 if b.startswith("I-") else 0.0 for b in LABELS])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def train(table: tuple[str, ...] = LABELLED, steps: int = 120, rate: float = 0.15, ridge: float = 0.02) -> Field:
    """Maximise the conditional likelihood of the labelled table by forward-backward gradients (Adam)."""
    data = [labelled_words(line) for line in table]
    index: dict[str, int] = {}
    rows = []
    for words, labels in data:
        ids = [[index.setdefault(f, len(index)) for f in fs] for fs in word_features(words)]
        rows.append((ids, [LABELS.index(x) for x in labels]))
    n = len(LABELS)
    theta = [np.zeros((len(index), n)), np.zeros((n, n))]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for turn in range(1, steps + 1):
        state, step = theta
        grads = [-ridge * state, -ridge * step]
        for ids, gold in rows:
            score = np.array([state[f].sum(0) for f in ids])
            move = step + _ALLOWED
            ahead, behind = np.zeros_like(score), np.zeros_like(score)
            ahead[0] = score[0] + _START
            for t in range(1, len(ids)):
                ahead[t] = _log_sum(ahead[t - 1][:, None] + move, 0) + score[t]
            for t in range(len(ids) - 2, -1, -1):
                behind[t] = _log_sum(move + (score[t + 1] + behind[t + 1])[None], 1)
            total = _log_sum(ahead[-1], 0)
            single = np.exp(ahead + behind - total)
            for t, f in enumerate(ids):
                delta = -single[t]
                delta[gold[t]] += 1
                np.add.at(grads[0], f, delta)
                if t:
                    grads[1] -= np.exp(ahead[t - 1][:, None] + move + (score[t] + behind[t])[None] - total)
                    grads[1][gold[t - 1], gold[t]] += 1
        for k in range(2):
            first[k] = 0.9 * first[k] + 0.1 * grads[k]
            second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
            theta[k] = theta[k] + rate * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.999**turn)) + 1e-8)
    return Field(index, theta[0], theta[1])


def field_spans(texts: list[str], field: Field, classes: Classes | None = None) -> list[list[Span]]:
    """Spans that the field finds in each whole text, trimmed of marks around them."""
    classes = Classes(field) if classes is None else classes
    if len(classes) > MOST_WORDS:
        classes.clear()
    found: list[list[Span]] = [[] for _ in texts]
    for k, labels in enumerate(field.decode([t.split() for t in texts], classes)):
        if not labels.any():
            continue
        words = [m.span() for m in _WORD.finditer(texts[k])]
        begins = np.flatnonzero(labels % 2 == 1).tolist()  # B- labels are odd, I- labels even
        for t in begins:
            end = t + 1
            while end < len(labels) and labels[end] == labels[t] + 1:
                end += 1
            a, b = words[t][0], words[end - 1][1]
            while a < b and texts[k][a] in _EDGE:
                a += 1
            while b > a and texts[k][b - 1] in _EDGE:
                b -= 1
            if a < b:
                found[k].append((a, b, LABELS[labels[t]][2:]))
    return found


def apart(spans: list[Span], base: list[Span]) -> list[Span]:
    """Those of ``spans`` that overlap none of ``base``, which is sorted by its starts."""
    starts = [a for a, _, _ in base]
    reach = list(accumulate((b for _, b, _ in base), max))
    return [s for s in spans if not (n := bisect_left(starts, s[1])) or reach[n - 1] <= s[0]]


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train()


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


_OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find_personal_data(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find mail addresses, network addresses, card and phone numbers in every whole text.

    The rules' spans are the base; the field adds spans that overlap none of them. Returns doc_id, counts of the base by
    kind, base_sha256, spans (all spans as kind:start:end in code points, end exclusive) and n_added.

    The field is trained from the small labelled table on the driver. It labels every word of every text by Viterbi, in numpy
    batches: words of one class (shape, digits, cue) share their scores, sequences of a batch step together without padding,
    and a long text carries its state over turns of bounded size. A null text is empty and has none. Rows that share an id
    are read each. An empty table gives an empty one. Other columns are not read.
    """
    model = field or default_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = []
            for base, more in zip([base_spans(t) for t in texts], field_spans(texts, model, classes)):
                added = apart(more, base)
                counts = [sum(k == kind for _, _, k in base) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added)))
            columns = list(zip(*rows)) or [()] * 7
            kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[x.split()[0] for x in _OUT.split(", ")])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return map_arrow(slim, run, _OUT)
