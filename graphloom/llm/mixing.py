"""Mixing sources to target weights (problem 8).

Sizes are tokens of a public tokenizer. The total is the largest at which every
source that has documents can still reach its share (or a given budget, if that
is smaller); a document of a source is then wanted ``x`` times on average, ``x``
at most ``max_repeats``. Everyone gets the whole part of ``x``; the fraction is
rounded by weighted pivotal sampling: two documents of a source swap token mass
at random, keeping their sum and each one's expectation, until one of them is
integral. A bucket of documents thus leaves one open document per source; these
are paired again bucket by bucket in a reduction tree, so that a source misses
its target by less than one document however many tasks took part.

Defined results: sources are compared trimmed and in lower case; documents
whose source is null or no target, and documents of no tokens (null or empty
text), are not used; targets without documents get a share of 0 in the report,
the others are scaled up to make a whole; a target listed twice counts with its
shares added and its smallest ``max_repeats``, a null ``max_repeats`` as 1;
repeated document rows are documents of their own; extra columns are ignored;
empty tables give an empty mixture.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalar import tidy
from graphloom.session import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the word pattern of the tokenizer's vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents whose fractions are paired in one task, and open documents per node of the tree above.
BUCKET, FAN = 50_000, 64
#: Sources of the target table.
MAX_SOURCES = 100_000


@cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, keys: list[str], text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``keys`` plus the number of tokens of the whole text; 0 for null. The tokenizer's file must be on every node."""
    plain = documents.select(*keys, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema if f.name != "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(tokenizer).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in keys] + [pa.array(n, pa.int64())], names=[*keys, "tokens"]
            )

    return plain.mapInArrow(run, f"{schema}, tokens long")


def pivotal(p: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Fractions in [0, 1] made integral but for one at most, keeping sum(p * weight) and every expectation."""
    p = p.astype(float).copy()
    draws = rng.random(len(p))
    open_ = -1
    for i in range(len(p)):
        if not 1e-12 < p[i] < 1 - 1e-12:
            p[i] = round(p[i])
            continue
        if open_ < 0:
            open_ = i
            continue
        j, ratio = open_, weight[i] / weight[open_]
        up = min(1 - p[i], p[j] / ratio)
        down = min(p[i], (1 - p[j]) / ratio)
        if draws[i] * (up + down) < down:
            p[i], p[j] = p[i] + up, p[j] - up * ratio
        else:
            p[i], p[j] = p[i] - down, p[j] + down * ratio
        open_ = -1
        for k in (j, i):
            if 1e-12 < p[k] < 1 - 1e-12:
                open_ = k
            else:
                p[k] = round(p[k])
    return p


def _targets(mix: DataFrame) -> dict[str, tuple[float, int]]:
    """source -> (share, max_repeats); the plan is made on the driver, so more than MAX_SOURCES of them raise."""
    rows = (
        mix.groupBy(tidy(F.col("source")).alias("source"))
        .agg(F.sum("target_share").alias("share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("most"))
        .filter("source is not null and share > 0")
        .limit(MAX_SOURCES + 1)
        .collect()
    )
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources among the targets")
    return {r["source"]: (float(r["share"]), int(r["most"])) for r in rows}


def _plan(targets: dict[str, tuple[float, int]], size: dict[str, int], budget: float | None) -> dict[str, float]:
    """Wanted copies of each document, by source."""
    have = {s: t for s, t in targets.items() if size.get(s) and t[1] > 0}
    whole = sum(share for share, _ in have.values())
    if not have:
        return {}
    total = min(most * size[s] * whole / share for s, (share, most) in have.items())
    total = min(total, budget) if budget is not None else total
    return {s: min(most, total * share / whole / size[s]) for s, (share, most) in have.items()}


def _schema() -> str:
    return "doc_id long, source string, tokens long, sure long, p double, bucket long"


def _round_buckets(rows: DataFrame, level: int, seed: int) -> DataFrame:
    """One level of the tree: the open documents of each bucket are paired within their source."""

    def work(table: pa.Table) -> pa.Table:
        columns = {n: np.asarray(table.column(n).to_pylist(), dtype=object) for n in table.column_names}
        order = sorted(range(table.num_rows), key=lambda i: (columns["source"][i], columns["doc_id"][i], columns["tokens"][i]))
        p = columns["p"].astype(float)
        by_source: dict[str, list[int]] = defaultdict(list)
        for i in order:
            by_source[columns["source"][i]].append(i)
        bucket = int(columns["bucket"][0])
        for source, at in by_source.items():
            rng = np.random.default_rng([seed, level, bucket, zlib.crc32(source.encode())])
            p[at] = pivotal(p[at], columns["tokens"][at].astype(float), rng)
        return table.set_column(table.column_names.index("p"), "p", pa.array(p, pa.float64()))

    return rows.groupBy("bucket").applyInArrow(work, _schema())


def mixture(
    documents: DataFrame,
    mix: DataFrame,
    tokenizer: str = TOKENIZER,
    budget: float | None = None,
    seed: int = 42,
    bucket: int = BUCKET,
    fan: int = FAN,
) -> DataFrame:
    """(doc_id, source, tokens, copies) of the documents used at least once."""
    spark = documents.sparkSession
    targets = _targets(mix)
    # A row per source of the target table at most: literals, so that no join is needed.
    listed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), tidy(F.col("source")).alias("source"), "text")
    listed = listed.filter(F.col("source").isin(list(targets) or [""]) & (F.char_length("text") > 0))
    sized = materialize(count_tokens(listed, ["doc_id", "source"], tokenizer=tokenizer), "tokens")
    totals = {r["source"]: (r["t"], r["n"]) for r in sized.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()}
    wanted = _plan(targets, {s: t for s, (t, _) in totals.items()}, budget)
    if not wanted:
        return spark.createDataFrame([], "doc_id long, source string, tokens long, copies long")
    x = F.create_map(*[F.lit(v) for pair in sorted(wanted.items()) for v in pair])[F.col("source")]
    rows = (
        sized.filter(F.col("source").isin(sorted(wanted)))
        .withColumn("x", x)
        .select(
            "doc_id",
            "source",
            "tokens",
            F.floor(F.col("x") + 1e-9).alias("sure"),
            F.greatest(F.lit(0.0), F.col("x") - F.floor(F.col("x") + 1e-9)).alias("p"),
        )
    )
    buckets = max(1, -(-sum(n for _, n in totals.values()) // bucket))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    whole, done = "p <= 0 or p >= 1", None
    level = 0
    while True:
        rounded = materialize(_round_buckets(rows, level, seed), f"mix{level}")
        settled = rounded.filter(whole)
        done = settled if done is None else done.unionAll(settled)
        rows = rounded.filter(f"not ({whole})")
        if buckets == 1:
            break
        level, buckets = level + 1, -(-buckets // fan)
        rows = rows.withColumn("bucket", F.floor(F.col("bucket") / fan))
    # One open document per source is left; its fraction is its chance.
    luck = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "source"), F.lit(1 << 30)) / float(1 << 30)
    last = rows.withColumn("p", F.when(luck < F.col("p"), 1.0).otherwise(0.0))
    copies = (F.col("sure") + F.round("p")).cast("long")
    return done.unionAll(last).select("doc_id", "source", "tokens", copies.alias("copies")).filter("copies > 0")


def share_report(mixed: DataFrame, mix: DataFrame) -> DataFrame:
    """Per source of ``mix``: target_share, actual_share, documents, copies and tokens used."""
    targets = mix.groupBy(tidy(F.col("source")).alias("source")).agg(
        F.sum("target_share").alias("target_share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats")
    )
    used = mixed.groupBy("source").agg(
        F.count("*").alias("documents"),
        F.sum("copies").alias("copies"),
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens"),
        F.max("copies").alias("most_copies"),
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "copies", "tokens", "most_copies")]
    total = used.select(F.sum("tokens").alias("total"))
    return (
        targets.filter("source is not null")
        .join(used, "source", "left")
        .join(F.broadcast(total))
        .select("source", "target_share", "max_repeats", *zero, F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"))
    )
