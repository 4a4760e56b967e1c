"""Exact k-NN over dense vectors. Scores are DOUBLE."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that are broadcast at once.
MAX_QUERIES = 10_000
#: Cells of the score matrix a task holds at once.
CELLS = 4_000_000


def _unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, unit vectors) of the usable vectors: of ``dim`` finite numbers, not all zero."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dim)
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)
    norm = np.sqrt((flat**2).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    return rows[good], flat[good] / norm[good, None]


def best_of_batch(score: np.ndarray, ids: pa.Array, k: int) -> np.ndarray:
    """Marks the ``k`` best columns of each row, ties by id."""
    if k >= score.shape[1]:
        return np.ones(score.shape, dtype=bool)
    place = np.argsort(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
    keep = np.zeros(score.shape, dtype=bool)
    for own, marks in zip(score, keep, strict=True):
        # all that tie with the k-th stay in question, then the smaller ids win
        near = np.flatnonzero(own >= np.partition(own, -k)[-k])
        marks[near[np.lexsort((place[near], -own[near]))[:k]]] = True
    return keep


def score_against(
    queries: DataFrame, vectors: DataFrame, query_id: str, id_column: str, vector: str, threshold: float | None = None, k: int | None = None
) -> DataFrame:
    """(query_id, id, score): cosines of a stated query set with every vector, by matrix products over Arrow batches.

    The vectors are read once and not shuffled; ``threshold``, and ``k`` (the
    best of each query within a batch, ties by id), cut the result where it is
    made, so that :func:`top_k` shuffles ``k`` rows a query and batch at most.
    Null, empty, zero and not finite vectors and those of another length than
    the queries' take no part. At most ``MAX_QUERIES`` queries are broadcast at
    a time; a larger set is cut into blocks by a hash of the id, each scanning
    the vectors once.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(vector).cast("array<double>").alias("v")).filter("size(v) > 0")
    stored = vectors.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    kinds = (asked.schema["query_id"].dataType.simpleString(), stored.schema["id"].dataType.simpleString())
    schema = f"query_id {kinds[0]}, id {kinds[1]}, score double"
    blocks = max(1, -(-asked.count() // MAX_QUERIES))
    out = None
    for block in range(blocks):
        some = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        table = some.toArrow()
        shared = vectors.sparkSession.sparkContext.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            table = shared.value
            lists = table.column("v").combine_chunks()
            dim = len(lists[0]) if len(lists) else 0
            rows, unit = _unit(lists, dim) if dim else (np.empty(0, dtype=np.int64), np.empty((0, 0)))
            names = table.column("query_id").combine_chunks().take(pa.array(rows))
            for batch in batches:
                own, x = _unit(batch.column(1), dim) if len(rows) else (rows, unit)
                if not len(own) or not len(rows):
                    continue
                every = batch.column(0).take(pa.array(own))
                step = max(1, CELLS // len(rows))
                for lo in range(0, len(own), step):  # a matrix of bounded size at a time
                    ids = every.slice(lo, step)
                    score = np.round(unit @ x[lo : lo + step].T, 6)
                    keep = np.ones(score.shape, dtype=bool) if threshold is None else score >= threshold
                    if k is not None:
                        keep &= best_of_batch(score, ids, k)
                    q, c = np.nonzero(keep)
                    yield pa.RecordBatch.from_arrays(
                        [names.take(pa.array(q)), ids.take(pa.array(c)), pa.array(score[q, c])], names=["query_id", "id", "score"]
                    )

        scored = stored.mapInArrow(run, schema)
        out = scored if out is None else out.unionAll(scored)
    return out


def top_k(scored: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """The ``k`` best of each query with rank from 0; ties by id. Ranks are limited before the shuffle."""
    kept = scored if threshold is None else scored.filter(F.col("score") >= threshold)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return kept.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k).withColumn("rank", F.col("n") - 1).drop("n")
