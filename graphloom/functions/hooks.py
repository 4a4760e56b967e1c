"""Pluggable models: language model, embedder, scorer, with deterministic offline defaults.

A hook is a plain callable on a batch; :func:`run_hook` applies it in Arrow
batches on the executors, retries what may be retried, and turns a failing item
into null when ``continue_on_error`` is set. :func:`cached` asks the model only
for inputs that no stored answer has.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Batch = Callable[[Sequence[str]], Sequence[object]]


@dataclass(frozen=True)
class Retry:
    waits: tuple[float, ...] = (2.0, 4.0, 8.0)
    on: tuple[type[BaseException], ...] = (TimeoutError, ConnectionError)


def run_hook(
    rows: DataFrame, column: str, output: str, kind: str, model: Batch, size: int = 500,
    retry: Retry = Retry(), continue_on_error: bool = False,
) -> DataFrame:
    """``rows`` plus ``output`` (of SQL type ``kind``), the model's answer to ``column``; null asks nothing."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def ask(texts: list[str]) -> list[object]:
        for wait in (*retry.waits, None):
            try:
                return list(model(texts))
            except retry.on:
                if wait is None:
                    raise
                time.sleep(wait)
        raise AssertionError

    def answers(texts: list[str]) -> list[object]:
        try:
            return ask(texts)
        except Exception:
            if not continue_on_error:
                raise
            out: list[object] = []
            for t in texts:  # find the failing ones
                try:
                    out += ask([t])
                except Exception:
                    out.append(None)
            return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            result: list[object] = [None] * len(frame)
            asked = [i for i, t in enumerate(frame[column]) if t is not None]
            for lo in range(0, len(asked), size):
                part = asked[lo : lo + size]
                for i, a in zip(part, answers([frame[column].iloc[i] for i in part]), strict=True):
                    result[i] = a
            yield frame.assign(**{output: pd.Series(result, index=frame.index, dtype=object)})

    return rows.mapInPandas(run, f"{schema}, `{output}` {kind}")


def cached(rows: DataFrame, column: str, output: str, kind: str, model: Batch, store: DataFrame, **options: object) -> tuple[DataFrame, DataFrame]:
    """(rows with answers, new cache rows). ``store`` has (key, answer); each distinct miss is asked once."""
    keyed = rows.withColumn("key", F.md5(F.col(column)))
    missing = keyed.filter("key is not null").select("key", column).distinct().join(store.select("key"), "key", "left_anti")
    fresh = run_hook(missing, column, "answer", kind, model, **options).select("key", "answer")
    known = store.select("key", "answer").unionByName(fresh)
    return keyed.join(known.withColumnRenamed("answer", output), "key", "left").drop("key"), fresh


_WORD = re.compile(r"[^\W_]+")


def hashing_embedder(dim: int = 64) -> Batch:
    """Unit vectors from hashed words: the offline default, equal for equal texts."""

    def embed(texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * dim
            for w in _WORD.findall(text.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % dim] += 1.0 if h >> 63 else -1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return out

    return embed


def overlap_scorer(query: str) -> Batch:
    """Share of the query's words that a text has: a deterministic stand-in for a reranker."""
    asked = set(_WORD.findall(query.lower()))
    return lambda texts: [len(asked & set(_WORD.findall(t.lower()))) / max(1, len(asked)) for t in texts]
