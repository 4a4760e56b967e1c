"""Abusive, hateful or sexual content (problem 9).

A subsequence string kernel compares passages by the sequences of four letters
they share, gaps of up to two inserted letters allowed at a discount, so that
stretched, starred and interspersed words stay close to the plain ones. A
support vector machine with Nystroem landmarks is fitted to labelled passages;
as the kernel's feature map is explicit (one number per four letters), the
fitted function ``sum_l b_l k(l, passage)`` is the sum of one table entry per
subsequence, and the whole corpus is scored with a sliding window in numpy: a
document's score is that of its worst window.

Before that the letters are folded: compatibility forms resolved, case and
accents dropped, look-alike
letters of the two alphabets and digits or signs inside words replaced by the
letters they stand for, everything else (blanks, punctuation, invisible
characters) removed and repeats of a letter collapsed. A word with masking
signs between its letters (f**k) is read first: every sign stands for one
letter, and of the words of the bad reviewed documents with that length and
those visible letters the one the table finds worst takes its place. A word
that none of them fits keeps its visible letters only.

The labels are those of the reviewed documents (majority of the usable
verdicts, ties left out); passages get theirs by multiple-instance learning:
all windows of clean documents are clean, the worst window of a bad document is
bad, refitted ``ROUNDS`` times from a start by log-odds. At most ``MAX_LABELLED`` reviewed
documents (chosen by a hash of their id) and ``MAX_CHARS`` letters of them are
used for fitting; scoring covers every document whole. A quarter of them is held out to
choose the threshold.

Defined results: null, empty and letterless texts score the floor value
``FLOOR`` and are never found; with fewer than ``MIN_BAD`` bad or two clean
documents among the labelled the operator abstains: everything scores ``FLOOR``
and whether it is flagged, like the rates, is null; repeated document rows each
get their score; verdicts are compared trimmed and in lower case, unknown and null
ones are ignored; sources likewise, null is a source of its own in the rates;
extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalar import tidy
from graphloom.session import materialize

BAD = ("abusive", "hateful", "sexual")
CLEAN = "clean"
#: Below 65 536, as documents are counted in 16 bits.
MAX_LABELLED = 20_000
MAX_CHARS = 12_000_000
WINDOW = 28
LANDMARKS = 600
ROUNDS = 3
BACKGROUND = 4000
DECAY = 0.6
GAP = 2
RIDGE = 1e-3
FLOOR = -9.0
SEED = 42
#: Bad reviewed documents needed to fit anything; with fewer the operator abstains.
MIN_BAD = 30
#: Share of the best F1 that a cut must have to count as good as the best.
PLATEAU = 0.98

_LATIN = "abcdefghijklmnopqrstuvwxyz"
_CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюяё"
# Characters that stand for a letter, by look.
_LOOKS = dict(zip("авекмнорстухё", "abekmhopctyxe", strict=True)) | {"ь": "b", "і": "i", "ј": "j", "ѕ": "s", "й": "и", "ъ": "b"}
_LEET = dict(zip("013457@$", "oieast" + "as", strict=True))
# Signs that stand for one hidden letter each, between letters.
_MASKS = "*＊∗•#"
_MASKED = re.compile(rf"[^\W_]+(?:[{_MASKS}]+[^\W_]+)+")
_WORD = re.compile(r"[^\W\d_]{3,}")
_BITS = 6
#: (offsets of the second to fourth letter, discount)
_PATTERNS = [
    ((i, j, k), DECAY ** (k - 3)) for k in range(3, 4 + GAP) for j in range(2, k) for i in range(1, j)
]


def _folding() -> tuple[np.ndarray, np.ndarray]:
    """Letter number of each code point (0: none), and of the digits and signs that count inside words only."""
    letters: dict[str, int] = {c: i + 1 for i, c in enumerate(_LATIN)}
    for c in _CYRILLIC:
        if c not in _LOOKS:
            letters[c] = len(letters) + 1
    for c, look in _LOOKS.items():
        letters[c] = letters[look]
    table = np.zeros(0x3000, dtype=np.uint8)
    inside = np.zeros(0x3000, dtype=np.uint8)
    for code in range(0x3000):
        char = chr(code).lower()
        for form in (char, unicodedata.normalize("NFKD", char)):
            if form and form[0] in letters:
                table[code] = letters[form[0]]
                break
    for c, stands in _LEET.items():
        inside[ord(c)] = letters[stands]
    return table, inside


_TABLE, _INSIDE = _folding()


def plain(text: str) -> str:
    """Compatibility forms (full-width, mathematical and circled letters) as the letters they stand for."""
    return text if text.isascii() or unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters, starts): all texts as one row of letter numbers, each followed by WINDOW + 6 zeros."""
    texts = [plain(t) for t in texts]
    gap = "\x00" * (WINDOW + 6)
    codes = np.frombuffer((gap.join(texts) + gap).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    small = np.where(codes < 0x3000, codes, 0x2FFF).astype(np.int32)
    letters = _TABLE[small]
    signs = _INSIDE[small]
    at = np.flatnonzero(signs)
    if len(at):
        after = letters[np.minimum(at + 1, len(letters) - 1)]
        before = np.where(at > 0, letters[at - 1], 0)
        letters[at] = np.where((before > 0) | (after > 0), signs[at], 0)
    zero = codes == 0
    keep = (letters > 0) | zero
    lengths = np.array([len(t) + len(gap) for t in texts], dtype=np.int64)
    begin = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(texts) else np.empty(0, dtype=np.int64)
    del codes, small, signs, zero
    letters = letters[keep]
    fresh = np.ones(len(letters), dtype=bool)
    fresh[1:] = (letters[1:] != letters[:-1]) | (letters[1:] == 0)
    position = np.cumsum(keep, dtype=np.int32) - keep
    place = np.cumsum(fresh, dtype=np.int32) - fresh
    starts = place[np.minimum(position[begin], len(letters) - 1)].astype(np.int64) if len(texts) else begin
    return letters[fresh].astype(np.int32), starts


def _features(letters: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each pattern the subsequence number at every place (0 where a letter is missing), and its discount."""
    padded = np.concatenate((letters, np.zeros(6, dtype=np.int32)))
    n = len(letters)
    first = padded[:n] << (3 * _BITS)
    for (i, j, k), weight in _PATTERNS:
        code = first | padded[i : i + n] << (2 * _BITS) | padded[j : j + n] << _BITS | padded[k : k + n]
        yield code, weight


def place_scores(letters: np.ndarray, table: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Sum of the table over the subsequences that begin at each place."""
    total = np.zeros(len(letters), dtype=np.float32)
    for lo in range(0, len(letters), step):
        part = total[lo : lo + step]
        for code, weight in _features(letters[lo : lo + step + 6]):
            part += table[code[: len(part)]] * np.float32(weight)
    return total


def window_sums(places: np.ndarray) -> np.ndarray:
    """Sum over the WINDOW places from each one on."""
    sums = np.concatenate(([0.0], np.cumsum(places, dtype=np.float64)))
    out = np.empty(len(places), dtype=np.float32)
    full = max(0, len(places) - WINDOW + 1)
    out[:full] = sums[WINDOW:][:full] - sums[:full]
    out[full:] = sums[-1] - sums[full:-1]
    return out


def _shape(word: str) -> list[int]:
    """Letter number of each place of a word, 0 at a masking sign."""
    codes = [min(ord(c), 0x2FFF) for c in word]
    return [0 if c in _MASKS else int(_TABLE[n] or _INSIDE[n]) for c, n in zip(word, codes, strict=True)]


def _readings(texts: list[str], table: np.ndarray) -> dict[tuple[int, int, int], list[str]]:
    """The words of ``texts`` that the table speaks against, worst first, by length, first and last letter."""
    words = sorted({w for t in texts for w in _WORD.findall(t.lower())})
    out: dict[tuple[int, int, int], list[str]] = {}
    if not words:
        return out
    letters, starts = fold(words)
    sums = np.add.reduceat(place_scores(letters, table), starts)
    for i in np.argsort(-sums, kind="stable").tolist():
        if sums[i] <= 0:
            break
        shape = _shape(words[i])
        out.setdefault((len(shape), shape[0], shape[-1]), []).append(words[i])
    return out


@dataclass
class Model:
    """codes: the landmarks' subsequences; values: their weights; bias and threshold of the decision; readings of masked words."""

    codes: np.ndarray
    values: np.ndarray
    bias: float
    threshold: float
    readings: dict[tuple[int, int, int], list[str]] = field(default_factory=dict)

    def table(self) -> np.ndarray:
        out = np.zeros(1 << (4 * _BITS), dtype=np.float32)
        out[self.codes] = self.values
        return out

    def unmask(self, text: str) -> str:
        """The text with each masked word replaced by the worst word that fits it."""

        def read(match: re.Match[str]) -> str:
            shape = _shape(match.group())
            for word in self.readings.get((len(shape), shape[0], shape[-1]), ()):
                if all(a in (0, b) for a, b in zip(shape, _shape(word), strict=True)):
                    return word
            return match.group()

        return _MASKED.sub(read, text) if any(c in text for c in _MASKS) else text

    def scores(self, texts: list[str], table: np.ndarray) -> np.ndarray:
        """The worst window of each text."""
        if not texts:
            return np.empty(0)
        letters, starts = fold([self.unmask(plain(t)) for t in texts])
        sums = window_sums(place_scores(letters, table))
        worst = np.maximum.reduceat(sums, starts)
        some = np.maximum.reduceat(letters, starts) > 0
        return np.where(some, worst + self.bias, FLOOR)


def _bag(letters: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, weight) of the subsequences in the windows beginning at ``at``."""
    span = at[:, None] + np.arange(WINDOW)[None, :]
    padded = np.concatenate((letters, np.zeros(WINDOW + 6, dtype=np.int32)))
    rows, codes, weights = [], [], []
    number = np.repeat(np.arange(len(at)), WINDOW)
    for (i, j, k), weight in _PATTERNS:
        a, b, c, d = (padded[span + o].ravel() for o in (0, i, j, k))
        code = a << (3 * _BITS) | b << (2 * _BITS) | c << _BITS | d
        full = (a > 0) & (b > 0) & (c > 0) & (d > 0)
        rows.append(number[full])
        codes.append(code[full])
        weights.append(np.full(int(full.sum()), weight, dtype=np.float32))
    return np.concatenate(rows), np.concatenate(codes), np.concatenate(weights)


class _Kernel:
    """Normalised kernel between windows and fixed landmark windows, over an inverted list of the landmarks."""

    def __init__(self, letters: np.ndarray, landmarks: np.ndarray) -> None:
        self.letters, self.count = letters, len(landmarks)
        row, code, weight = _bag(letters, landmarks)
        pair, inverse = np.unique(code.astype(np.int64) * self.count + row, return_inverse=True)
        value = np.bincount(inverse, weights=weight)
        self.mark = pair % self.count
        self.value = value / np.sqrt(np.bincount(self.mark, weights=value**2, minlength=self.count) + 1e-12)[self.mark]
        self.codes, self.first, self.length = np.unique(pair // self.count, return_index=True, return_counts=True)

    def rows(self, at: np.ndarray) -> np.ndarray:
        """k(window, landmark); a window is scaled as one full of letters, so that scores add up place by place."""
        out = np.zeros((len(at), self.count))
        for first in range(0, len(at), 200):
            row, code, weight = _bag(self.letters, at[first : first + 200])
            column = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            hit = self.codes[column] == code
            row, column, weight = row[hit], column[hit], weight[hit]
            length = self.length[column]
            total = np.cumsum(length)
            entry = np.arange(total[-1] if len(total) else 0) - np.repeat(total - length - self.first[column], length)
            cell = np.repeat(row, length) * self.count + self.mark[entry]
            amount = np.repeat(weight, length) * self.value[entry]
            n = len(at[first : first + 200])
            out[first : first + n] = np.bincount(cell, weights=amount, minlength=n * self.count).reshape(n, self.count)
        return out / _SCALE

    def table_values(self, beta: np.ndarray) -> np.ndarray:
        """Weight of each of ``codes`` in ``sum_l beta_l k(l, .)``."""
        column = np.repeat(np.arange(len(self.codes)), self.length)
        return (np.bincount(column, weights=self.value * beta[self.mark]) / _SCALE).astype(np.float32)


_SCALE = float(np.sqrt(WINDOW * sum(w * w for _, w in _PATTERNS)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float | None = None, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Squared-hinge support vector machine by Newton steps on the active rows."""
    z = np.hstack([x, np.ones((len(x), 1))])
    v = np.zeros(z.shape[1])
    penalty = (RIDGE if ridge is None else ridge) * weight.sum() * np.eye(len(v))
    penalty[-1, -1] *= 1e-3
    for _ in range(rounds):
        active = y * (z @ v) < 1
        a = z[active]
        w = weight[active]
        new = np.linalg.solve((a * w[:, None]).T @ a + penalty, (a * w[:, None]).T @ y[active])
        if np.allclose(new, v, atol=1e-6):
            break
        v = new
    return v[:-1], float(v[-1])


def _start(letters: np.ndarray, starts: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Log-odds of the plain four letters between bad and clean documents, per place."""
    in_bad = np.zeros(1 << (4 * _BITS), dtype=np.uint16)
    in_all = np.zeros(1 << (4 * _BITS), dtype=np.uint16)
    ends = np.append(starts[1:], len(letters))
    for lo in range(0, len(starts), 256):  # documents counted at a time
        hi = min(lo + 256, len(starts))
        part = next(_features(letters[starts[lo] : ends[hi - 1]]))[0].astype(np.int64)
        doc = np.repeat(np.arange(hi - lo), ends[lo:hi] - starts[lo:hi])
        pair = np.unique(part << 8 | doc)
        codes, first, count = np.unique(pair >> 8, return_index=True, return_counts=True)
        in_all[codes] += count.astype(np.uint16)
        in_bad[codes] += np.add.reduceat(bad[lo:hi][pair & 255], first, dtype=np.uint16)
    names = np.flatnonzero(in_all)
    in_bad, in_all = in_bad[names].astype(float), in_all[names].astype(float)
    n_bad, n_clean = bad.sum(), (~bad).sum()
    odds = np.log((in_bad + 0.3) / (n_bad + 0.6)) - np.log((in_all - in_bad + 0.3) / (n_clean + 0.6))
    table = np.zeros(1 << (4 * _BITS), dtype=np.float32)
    table[names] = np.where(in_bad > 1, odds, np.minimum(odds, 0.0))
    table[0] = 0.0
    return np.concatenate([table[next(_features(letters[lo : lo + (1 << 20) + 6]))[0][: 1 << 20]] for lo in range(0, len(letters), 1 << 20)])


def _worst(sums: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Place of the best window of each document."""
    ends = np.append(starts[1:], len(sums))
    return np.array([s + int(sums[s:e].argmax()) for s, e in zip(starts, ends, strict=True)], dtype=np.int64)


def _peaks(sums: np.ndarray, starts: np.ndarray, docs: np.ndarray, floor: float) -> np.ndarray:
    """Places of the windows above ``floor`` that beat all windows overlapping them, in the given documents."""
    ends = np.append(starts[1:], len(sums))
    out = []
    for d in docs.tolist():
        own = sums[starts[d] : ends[d]].copy()
        while len(own):
            at = int(own.argmax())
            if own[at] <= floor:
                break
            out.append(int(starts[d]) + at)
            own[max(0, at - WINDOW) : at + WINDOW] = -np.inf
    return np.array(out, dtype=np.int64)


def _fit(texts: list[str], bad: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(codes, values, bias) of the decision table."""
    rng = np.random.default_rng(SEED)
    letters, starts = fold(texts)
    sums = window_sums(_start(letters, starts, bad))
    clean_docs, bad_docs = np.flatnonzero(~bad), np.flatnonzero(bad)
    drawn = np.unique(rng.integers(0, len(letters), 3 * BACKGROUND))
    drawn = drawn[(letters[drawn] > 0) & ~bad[np.searchsorted(starts, drawn, side="right") - 1]]
    background = rng.permutation(drawn)[:BACKGROUND]
    hard = np.empty(0, dtype=np.int64)
    for turn in range(ROUNDS):
        worst = _worst(sums, starts)
        positive = worst[bad_docs]
        # A slip of the reviewer shows as a bad document without a bad-looking window: it loses its vote.
        level = sums[positive]
        floor = np.median(level) * 0.35 if turn == 0 else 0.0
        positive = _peaks(sums, starts, bad_docs, floor)
        if len(positive) < 2:
            positive = worst[bad_docs]
        suspicious = worst[clean_docs]
        suspicious = suspicious[np.argsort(-sums[suspicious])][: max(600, 2 * len(positive))]
        hard = np.unique(np.concatenate((hard, suspicious)))
        negative = np.concatenate((hard, background))
        pick = lambda pool, n: rng.choice(pool, min(len(pool), n), replace=False)
        marks = np.concatenate((pick(positive, LANDMARKS // 2), pick(hard, LANDMARKS // 4), pick(background, LANDMARKS // 4)))
        kernel = _Kernel(letters, marks)
        k_marks = kernel.rows(marks)
        values, vectors = np.linalg.eigh((k_marks + k_marks.T) / 2)
        strong = values > 1e-4 * values.max()
        root = vectors[:, strong] / np.sqrt(values[strong])
        at = np.concatenate((positive, negative))
        y = np.concatenate((np.ones(len(positive)), -np.ones(len(negative))))
        weight = np.where(y > 0, len(negative) / (2.0 * len(positive)), 0.5) if len(positive) else np.ones(len(y))
        beta, bias = _svm(kernel.rows(at) @ root, y, weight)
        table_values = kernel.table_values(root @ beta)
        table = np.zeros(1 << (4 * _BITS), dtype=np.float32)
        table[kernel.codes] = table_values
        sums = window_sums(place_scores(letters, table)) + np.float32(bias)
    return kernel.codes, table_values, bias


def _threshold(scores: np.ndarray, bad: np.ndarray) -> float:
    """The middle of the cuts around the one with the best F1 that are hardly worse: the labels are too few to tell these apart."""
    order = np.argsort(-scores, kind="stable")
    ranked = scores[order]
    hit = np.cumsum(bad[order])
    f1 = 2 * hit / (np.arange(1, len(order) + 1) + bad.sum())
    top = int(f1.argmax())
    good = f1 >= PLATEAU * f1[top]
    first, last = top, top
    while first > 0 and good[first - 1]:
        first -= 1
    while last + 1 < len(order) and good[last + 1]:
        last += 1
    # a cut after place i lies between its score and the next one's
    below = ranked[last + 1] if last + 1 < len(order) else ranked[last] - 1
    return float((ranked[first] + below) / 2)


def _model(texts: list[str], bad: np.ndarray, threshold: float) -> Model:
    model = Model(*_fit(texts, bad), threshold)
    model.readings = _readings([texts[i] for i in np.flatnonzero(bad)], model.table())
    return model


def labelled(documents: DataFrame, reviews: DataFrame, most: int = MAX_LABELLED, most_chars: int = MAX_CHARS) -> DataFrame:
    """(doc_id, text, bad) of the reviewed documents with a majority verdict: a bounded number, of bounded total length."""
    verdict = tidy(F.col("verdict"))
    votes = (
        reviews.select(F.col("doc_id").cast("long").alias("doc_id"), verdict.alias("v"))
        .filter(F.col("v").isin(CLEAN, *BAD))
        .groupBy("doc_id")
        .agg(F.sum(F.when(F.col("v") == CLEAN, -1).otherwise(1)).alias("lean"))
        .filter("doc_id is not null and lean <> 0")
    )
    chosen = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    # one row per document, however often it is stored
    once = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("lean").alias("lean"))
    once = materialize(once.select("doc_id", "text", (F.col("lean") > 0).alias("bad")), "labelled")
    # the first of them by the hash, up to the allowed number of characters: two numbers each reach the driver
    sizes = once.select(F.xxhash64("doc_id").alias("h"), F.char_length("text").alias("n")).orderBy("h").collect()
    used, last = 0, None
    for r in sizes:
        used += r["n"]
        if used > most_chars:
            break
        last = r["h"]
    return once.filter(F.xxhash64("doc_id") <= F.lit(last)) if last is not None else once.limit(0)


def fit(documents: DataFrame, reviews: DataFrame, most: int = MAX_LABELLED) -> Model | None:
    """The classifier, fitted on the driver to the bounded set of labelled documents."""
    rows = sorted(labelled(documents, reviews, most).collect(), key=lambda r: (r["doc_id"], r["text"]))
    seen: set[str] = set()
    texts, bad = [], []
    for r in rows:
        if r["text"] not in seen:
            seen.add(r["text"])
            texts.append(r["text"])
            bad.append(r["bad"])
    y = np.array(bad, dtype=bool)
    if y.sum() < MIN_BAD or (~y).sum() < 2:
        return None
    held = np.random.default_rng(SEED).random(len(texts)) < 0.25
    threshold = 0.0
    inner, outer = np.flatnonzero(~held), np.flatnonzero(held)
    if min(y[inner].sum(), (~y[inner]).sum()) >= 2 and y[outer].sum() >= 5:
        model = _model([texts[i] for i in inner], y[inner], 0.0)
        # never below the boundary of the machine itself, as few labels may leave the cuts open far below it
        threshold = max(0.0, _threshold(model.scores([texts[i] for i in outer], model.table()), y[outer]))
    return _model(texts, y, threshold)


def score_abuse(documents: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, source, score, flagged) for every document; ``source`` is tidied."""
    plain = documents.select(F.col("doc_id").cast("long").alias("doc_id"), tidy(F.col("source")).alias("source"), "text")
    if model is None:
        return plain.select("doc_id", "source", F.lit(FLOOR).alias("score"), F.lit(None).cast("boolean").alias("flagged"))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = model.table()
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            score: list[float] = []
            first, size = 0, 0
            for i, text in enumerate(texts):  # some megabytes at a time
                size += len(text)
                if size > 1_000_000 or i + 1 == len(texts):
                    score += model.scores(texts[first : i + 1], table).tolist()
                    first, size = i + 1, 0
            found = [s > model.threshold for s in score]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array(found, pa.bool_())],
                names=["doc_id", "source", "score", "flagged"],
            )

    return plain.mapInArrow(run, "doc_id long, source string, score double, flagged boolean")


def source_rates(scored: DataFrame) -> DataFrame:
    """Documents, flagged documents, their rate and the worst score per source; null rates where the operator abstained."""
    return scored.groupBy("source").agg(
        F.count("*").alias("documents"),
        F.sum(F.col("flagged").cast("int")).alias("flagged"),
        F.avg(F.col("flagged").cast("double")).alias("rate"),
        F.max("score").alias("worst_score"),
    )
