"""Sparse scoring (BM25, word overlap, any sparse dot), reciprocal rank fusion and example selection."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.extraction import normal_tokens
from graphloom.operators.vectors import best_of_batch
from graphloom.session import materialize

K1, B, AVG_LEN, MAX_TOKEN = 1.2, 0.75, 256.0, 40
#: Terms of queries that are broadcast at once; more queries are scored in blocks, each reading the documents anew.
MAX_TERMS = 1_000_000
#: Cells of the score matrix a task holds at once.
CELLS = 4_000_000

_TOKEN = re.compile(r"\w+")
_DIGITS = re.compile(r"[0-9]+")


def tokens(text: str) -> list[str]:
    """As ``extraction.normal_tokens``, of at most MAX_TOKEN characters."""
    return [w for w in _TOKEN.findall(text.lower()) if 2 <= len(w) <= MAX_TOKEN and not _DIGITS.fullmatch(w)]


def term_counts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, dl): tokens of at most 40 characters; ``dl`` is the text's length in tokens."""
    words = F.filter(normal_tokens(F.col(text)), lambda w: F.length(w) <= MAX_TOKEN)
    return (
        rows.filter(F.col(text).isNotNull())
        .select(key, words.alias("w"))
        .select(key, F.size("w").alias("dl"), F.explode("w").alias("term"))
        .groupBy(key, "term")
        .agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    )


def bm25_weights(counts: DataFrame) -> DataFrame:
    """Document side of BM25 with a fixed average length: ``val`` per (key, term)."""
    tf, dl = F.col("tf"), F.col("dl")
    return counts.withColumn("val", tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / AVG_LEN)))


def query_blocks(asked: DataFrame, most: int) -> list[DataFrame]:
    """``asked`` (query_id, ...) cut by a hash of the query into blocks of about ``most`` rows; counted before."""
    blocks = max(1, -(-asked.count() // most))
    if blocks == 1:
        return [asked]
    return [asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) for b in range(blocks)]


class _Queries:
    """A block of queries as arrays: which query has which term at which weight."""

    def __init__(self, table: pa.Table) -> None:
        self.names = pc.unique(table.column("query_id"))
        if isinstance(self.names, pa.ChunkedArray):
            self.names = self.names.combine_chunks()
        row = pc.index_in(table.column("query_id"), self.names).to_numpy()
        code = table.column("term").combine_chunks().dictionary_encode()
        self.terms = {t: i for i, t in enumerate(code.dictionary.to_pylist())}
        codes = code.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        self.rows, self.weight = row[order], table.column("w").to_numpy()[order]
        self.edges = np.searchsorted(codes[order], np.arange(len(self.terms) + 1))

    def best(self, ids: pa.Array, doc: np.ndarray, code: np.ndarray, w: np.ndarray, k: int | None) -> Iterator[pa.RecordBatch]:
        """Scores of documents given as entries (place of the document, number of the term, weight), in order of the document."""
        step = max(1, CELLS // max(1, len(self.names)))
        for lo in range(0, len(ids), step):
            a, b = np.searchsorted(doc, [lo, lo + step])
            own, part, value = doc[a:b] - lo, code[a:b], w[a:b]
            # one addition per term: a document has a term once
            order = np.argsort(part, kind="stable")
            own, part, value = own[order], part[order], value[order]
            some, first = np.unique(part, return_index=True)
            score = np.zeros((len(self.names), min(step, len(ids) - lo)))
            for term, x, y in zip(some.tolist(), first.tolist(), [*first[1:].tolist(), len(part)], strict=True):
                q = slice(self.edges[term], self.edges[term + 1])
                score[np.ix_(self.rows[q], own[x:y])] += self.weight[q, None] * value[None, x:y]
            score = np.round(score, 6)
            keep = score != 0
            column = ids.slice(lo, step)
            if k is not None:
                keep &= best_of_batch(score, column, k)
            q, c = np.nonzero(keep)
            yield pa.RecordBatch.from_arrays(
                [self.names.take(pa.array(q)), column.take(pa.array(c)), pa.array(score[q, c])], names=["query_id", "id", "score"]
            )


def _shared(spark, table: pa.Table):
    """The queries broadcast once, their arrays built once in each worker process."""
    shared = spark.sparkContext.broadcast(table)
    built: list[_Queries] = []

    def queries() -> _Queries:
        if not built:
            built.append(_Queries(shared.value))
        return built[0]

    return queries


@dataclass
class Matched:
    """Documents reduced to the terms some query has: (id, dl, codes, tf), in one pass and without a shuffle."""

    rows: DataFrame
    total: int
    queries: object
    kinds: tuple[str, str]

    def _scores(self, weigh, k: int | None) -> DataFrame:
        queries = self.queries

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes, tf = batch.column(2), batch.column(3)
                doc = np.repeat(np.arange(batch.num_rows), codes.value_lengths().to_numpy())
                code = codes.flatten().to_numpy()
                w = weigh(code, tf.flatten().to_numpy().astype(float), batch.column(1).to_numpy()[doc])
                yield from queries().best(batch.column(0), doc, code, w, k)

        return self.rows.mapInArrow(run, f"query_id {self.kinds[0]}, id {self.kinds[1]}, score double")

    def bm25(self, k: int | None = None) -> DataFrame:
        """(query_id, id, score): BM25 with a fixed average length. Document frequencies: one row per term of the queries."""
        counted = self.rows.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("df")).toArrow()
        idf = np.zeros(max([*counted.column("code").to_pylist(), 0]) + 1)
        df = counted.column("df").to_numpy()
        idf[counted.column("code").to_numpy()] = np.log(1 + (self.total - df + 0.5) / (df + 0.5))
        shared = self.rows.sparkSession.sparkContext.broadcast(idf)
        return self._scores(lambda code, tf, dl: shared.value[code] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / AVG_LEN))), k)

    def overlap(self, k: int | None = None) -> DataFrame:
        """(query_id, id, score): the number of distinct terms in common."""
        return self._scores(lambda code, tf, dl: np.ones(len(code)), k)


def match_terms(queries: DataFrame, documents: DataFrame, query_key: str, key: str, text: str = "text") -> list[Matched]:
    """The documents by the terms of the queries, per block of queries (one, unless there are more than MAX_TERMS terms)."""
    spark = documents.sparkSession
    asked = term_counts(queries, query_key, text).select(F.col(query_key).alias("query_id"), "term", F.lit(1.0).alias("w"))
    stored = documents.filter(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    kinds = (asked.schema["query_id"].dataType.simpleString(), stored.schema["id"].dataType.simpleString())
    out = []
    for block in query_blocks(asked, MAX_TERMS):
        own = _shared(spark, block.toArrow())

        def run(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            known = own().terms
            for batch in batches:
                length, offsets, codes, counts = [], [0], [], []
                for text in batch.column(1).to_pylist():
                    words = tokens(text)
                    found = Counter(known[w] for w in words if w in known)
                    length.append(len(words))
                    codes += found.keys()
                    counts += found.values()
                    offsets.append(len(codes))
                at = pa.array(offsets, pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (codes, counts)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(length, pa.int32()), *lists], names=["id", "dl", "codes", "tf"])

        rows = materialize(stored.mapInArrow(run, f"id {kinds[1]}, dl int, codes array<int>, tf array<int>"), "terms")
        out.append(Matched(rows.filter("size(codes) > 0"), rows.count(), own, kinds))
    return out


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def bm25_scores(queries: DataFrame, documents: DataFrame, query_key: str, key: str, text: str = "text", k: int | None = None) -> DataFrame:
    """(query_id, id, score): document weights times inverse document frequency, summed over the query's distinct terms.

    The documents are read and tokenised once; what remains of each, its counts
    of the terms that some query has, is written and scored in Arrow batches.
    With ``k`` only the best of each query leave a batch (ties by id), for
    :func:`ranked` to choose from. Pairs without a common term are no result.
    """
    return _united([m.bm25(k) for m in match_terms(queries, documents, query_key, key, text)])


def sparse_dot(queries: DataFrame, documents: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, id, score): sum over shared indices of two exploded sparse sets (id, idx, val).

    The queries are broadcast in blocks; a document's entries that some query
    has are gathered (it has as many as the queries have indices at most) and
    multiplied out in Arrow batches, so that an index everybody has costs no
    join of most queries with most documents. Repeated indices add up; nulls
    take no part.
    """
    spark = documents.sparkSession
    asked = queries.select(F.col("id").alias("query_id"), F.col("idx").cast("string").alias("term"), F.col("val").cast("double").alias("w"))
    asked = asked.dropna().groupBy("query_id", "term").agg(F.sum("w").alias("w"))
    kinds = (queries.schema["id"].dataType.simpleString(), documents.schema["id"].dataType.simpleString())
    stored = documents.select("id", F.col("idx").cast("string").alias("term"), F.col("val").cast("double").alias("w")).dropna()
    out = []
    for block in query_blocks(asked, MAX_TERMS):
        table = block.toArrow()
        own = _shared(spark, table)
        # at most MAX_TERMS terms, more or less
        kept = stored.join(F.broadcast(block.select("term").distinct()), "term", "left_semi")
        summed = kept.groupBy("id", "term").agg(F.sum("w").alias("w"))
        rows = summed.groupBy("id").agg(F.collect_list(F.struct("term", "w")).alias("terms"))

        def run(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            known = own().terms
            for batch in batches:
                lists = batch.column(1)
                doc = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
                entries = lists.flatten()
                code = np.array([known[t] for t in entries.field("term").to_pylist()], dtype=np.int64)
                yield from own().best(batch.column(0), doc, code, entries.field("w").to_numpy(), k)

        out.append(rows.mapInArrow(run, f"query_id {kinds[0]}, id {kinds[1]}, score double"))
    return _united(out)


def rrf(rankings: list[DataFrame], k: float = 60.0, first: int = 1) -> DataFrame:
    """(query_id, id, score): sum of 1 / (k + rank) over rankings with (query_id, id, rank from 0)."""
    parts = [r.select("query_id", "id", (1.0 / (k + F.col("rank") + first)).alias("part")) for r in rankings]
    return _united(parts).groupBy("query_id", "id").agg(F.round(F.sum("part"), 9).alias("score"))


def ranked(scored: DataFrame, k: int | None = None) -> DataFrame:
    """Rank from 0 within each query by score, ties by id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    out = scored.withColumn("n", F.row_number().over(w))
    out = out if k is None else out.filter(F.col("n") <= k)
    return out.withColumn("rank", F.col("n") - 1).drop("n")


def match_rate(queries: DataFrame, scored: DataFrame, threshold: float) -> DataFrame:
    """Share of the queries without any example of at least ``threshold``."""
    hit = scored.filter(F.col("score") >= threshold).select("query_id").distinct().withColumn("hit", F.lit(1))
    missed = F.avg(F.when(F.col("hit").isNull(), 1.0).otherwise(0.0))
    return queries.join(hit, "query_id", "left").agg(F.round(missed, 6).alias("miss_rate"), F.count("*").alias("asked"))


def random_examples(examples: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """``k`` examples in a random order that the seed fixes."""
    return examples.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(k)


def fused_examples(semantic: DataFrame, sparse: DataFrame, n: int) -> DataFrame:
    """(query_id, id, score, rank): the ``n`` best examples by two rankings; the constant of the fusion is half of ``n``, 1 at least."""
    return ranked(rrf([semantic, sparse], float(max(n // 2, 1))), n)


def rerank(items: DataFrame, score: str = "score", keep: int | None = None, within: str | None = None) -> DataFrame:
    """Items by a scorer's output, best first; the cut applies only where a scorer is set.

    With ``within`` (a query id) each query's items are ranked and cut by
    themselves, in a column ``rank``.
    """
    if within is not None:
        place = F.row_number().over(Window.partitionBy(within).orderBy(F.desc(score), "id")) - 1
        out = items.withColumn("rank", place)
        return out if keep is None else out.filter(F.col("rank") < keep)
    ordered = items.orderBy(F.desc(score), "id")
    return ordered if keep is None else ordered.limit(keep)
