"""Repetition inside a single document (problem 4).

Each text is measured by several rules, every one of which votes that the text
repeats itself (1), that it does not (-1), or abstains (0). Expectation
maximisation over the counts of vote patterns estimates how each rule votes on
repetitive and on sound texts; the posterior probability of being repetitive
then replaces a filter that all rules must pass. The patterns number at most
3 ** rules, whatever the corpus, so the estimation runs on the driver over
those counts while every text is measured in Arrow batches on the executors.

The posterior decides; :func:`repetitive` then checks the texts it names by the
measure asked for. That is ``share``, the share of the words lying in a run of
``RUN`` words that already occurred earlier in the text (runs may overlap);
words are runs of letters and digits in lower case. It is no rule and has no
vote: the rules look at shorter phrases, sentences, lines, the commonest pair of
words, the variety of words, and how far the text can be packed.

Defined results: null, empty and wordless texts have share 0 and get votes like
any other short text; texts are processed whole whatever their length; repeated
rows each get their result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.arrow import map_batches
from graphloom.session import materialize

RUN = 6
LIMIT = 0.3
#: Words of the phrases the first rule looks at.
PHRASE = 4
RULES = ("phrase", "sentence", "line", "pair", "variety", "packed")

_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[.!?;…]+\s+|\n+")


def repeated_share(words: list[str], run: int = RUN) -> float:
    """Share of words inside a run of ``run`` words that occurred earlier."""
    n = len(words)
    if n <= run:
        return 0.0
    seen: set[tuple[str, ...]] = set()
    add = seen.add
    covered, until = 0, 0
    for i, gram in enumerate(zip(*[words[k:] for k in range(run)], strict=False)):
        if gram in seen:
            covered += i + run - max(i, until)
            until = i + run
        else:
            add(gram)
    return covered / n


def _again(parts: list[str]) -> float:
    """Share of the characters that stand in parts seen before."""
    seen: set[str] = set()
    total = again = 0
    for p in parts:
        total += len(p)
        if p in seen:
            again += len(p)
        seen.add(p)
    return again / total if total else 0.0


def _vote(value: float, sound: float, bad: float) -> int:
    return 1 if value >= bad else -1 if value <= sound else 0


def measure(text: str | None) -> tuple[float, list[int]]:
    """The repeated share and the votes of RULES for one text."""
    text = text or ""
    low = text.lower()
    words = _WORD.findall(low)
    n = len(words)
    share = repeated_share(words)
    votes = [_vote(repeated_share(words, PHRASE), 0.1, 0.3) if n > PHRASE else 0]
    sentences = [" ".join(_WORD.findall(s)) for s in _SENTENCE.split(low)]
    sentences = [s for s in sentences if s]
    votes.append(_vote(_again(sentences), 0.0, 0.25) if len(sentences) > 1 else 0)
    lines = [s for s in (x.strip() for x in low.split("\n")) if s]
    votes.append(_vote(_again(lines), 0.0, 0.25) if len(lines) > 1 else 0)
    if n >= 12:
        counts: dict[tuple[str, str], int] = {}
        for pair in zip(words, words[1:], strict=False):
            counts[pair] = counts.get(pair, 0) + 1
        votes.append(_vote(2 * max(counts.values()) / n, 0.1, 0.25))
        expected = min(1.0, 2.5 * n**-0.25)
        votes.append(_vote(1 - len(set(words)) / n / expected, 0.25, 0.5))
    else:
        votes += [0, 0]
    raw = low.encode("utf-8", "replace")
    votes.append(_vote(1 - len(zlib.compress(raw, 1)) / len(raw), 0.55, 0.75) if len(raw) >= 160 else 0)
    return share, votes


def _encode(votes: list[int]) -> int:
    return reduce(lambda code, v: code * 3 + v + 1, votes, 0)


def _decode(code: int) -> list[int]:
    out = []
    for _ in RULES:
        code, v = divmod(code, 3)
        out.append(v - 1)
    return out[::-1]


def estimate(patterns: dict[int, int], rounds: int = 100, smooth: float = 1.0) -> dict[int, float]:
    """Posterior of repetition for each vote pattern, by expectation maximisation.

    ``patterns`` counts the texts per pattern. The start is each pattern's
    majority; rules are independent given the class, and whether a rule
    abstains (mostly a matter of length) doesn't depend on it; ``smooth``
    pseudo-votes keep every probability positive. Fixed rounds make it
    deterministic.
    """
    if not patterns:
        return {}
    codes = sorted(patterns)
    votes = np.array([_decode(c) for c in codes]) + 1
    weight = np.array([patterns[c] for c in codes], dtype=float)
    lean = (votes - 1).sum(axis=1)
    post = 1 / (1 + np.exp(-lean.astype(float)))
    for _ in range(rounds):
        like = np.zeros((2, len(codes)))
        for side, p in enumerate((1 - post, post)):
            like[side] += np.log((weight @ p + smooth) / (weight.sum() + 2 * smooth))
            for rule in range(len(RULES)):
                table = np.bincount(votes[:, rule], weights=weight * p, minlength=3) + smooth
                table[1] = table[0] + table[2]  # abstaining says nothing about the class
                like[side] += np.log(table / table[1])[votes[:, rule]]
        post = 1 / (1 + np.exp(np.clip(like[0] - like[1], -700, 700)))
    return dict(zip(codes, post.tolist(), strict=True))


def score_repetition(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` plus (share, posterior, votes). ``votes`` holds one number per rule of RULES."""

    def work(columns):
        share, code = [], []
        for t in columns["__text"].to_pylist():
            s, v = measure(t)
            share.append(s)
            code.append(_encode(v))
        return {k: columns[k] for k in keys} | {"share": share, "code": code}

    plain = texts.select(*keys, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema if f.name != "__text")
    measured = materialize(map_batches(plain, f"{schema}, share double, code int", work), "repetition")
    patterns = {r["code"]: r["count"] for r in measured.groupBy("code").count().collect()}
    posterior = estimate(patterns)
    spark = texts.sparkSession
    table = spark.createDataFrame(
        [(c, p, _decode(c)) for c, p in posterior.items()], "code int, posterior double, votes array<int>"
    )
    # At most 3 ** len(RULES) rows.
    return measured.join(F.broadcast(table), "code").select(*keys, "share", "posterior", "votes")


def repetitive(scored: DataFrame, probability: float = 0.5, limit: float = LIMIT) -> DataFrame:
    """Rows the label model holds to be repetitive, then checked by the exact share."""
    return scored.filter((F.col("posterior") >= probability) & (F.col("share") >= limit))
