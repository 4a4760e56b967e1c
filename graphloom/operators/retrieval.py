"""Retrieval engines: naive, local, global, mix, and plans of dependent sub-queries.

Every engine is a set of DataFrames over the index tables; only the answer of a
language model, where one is plugged in, needs a driver loop.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalar import community_id
from graphloom.operators import graph, ranking, vectors
from graphloom.operators.lookup import hits_to_records

THRESHOLD, TOP_K, MAX_LEVEL = 0.2, 20, 2


def naive_search(
    query: DataFrame, store: DataFrame, records: DataFrame, top_k: int = TOP_K, threshold: float = THRESHOLD,
    scorer: Callable[[DataFrame], DataFrame] | None = None, keep: int | None = None,
) -> DataFrame:
    """(query_id, rank, id, score, ...record): k-NN, records, optional rerank with its cut.

    ``query`` has (query_id, vector); ``store`` (id, vector). Hits without a
    record are dropped and keep their rank.
    """
    found = hits_to_records(similar(query, store, top_k, threshold), records)
    return found if scorer is None else ranking.rerank(scorer(found.drop("rank")), keep=keep, within="query_id")


def similar(query: DataFrame, store: DataFrame, top_k: int = TOP_K, threshold: float = THRESHOLD) -> DataFrame:
    """(query_id, id, score, rank): the ``top_k`` nearest of each query."""
    return vectors.top_k(vectors.score_against(query, store, "query_id", "id", "vector", threshold, top_k), top_k)


def hybrid_search(query: DataFrame, store: DataFrame, top_k: int = TOP_K, keep: int | None = None) -> DataFrame:
    """(query_id, id, score, rank): the ``top_k`` best by vector and by BM25 fused by reciprocal ranks.

    Both sides have (query_id or id, vector, text); a query or record lacking
    one of the two is ranked by the other alone.
    """
    dense = similar(query.select("query_id", "vector"), store.select("id", "vector"), top_k, -1.0)
    sparse = ranking.bm25_scores(query, store, "query_id", "id", "text", k=top_k)
    return ranking.ranked(ranking.rrf([dense, ranking.ranked(sparse, top_k)]), keep or top_k)


def seed_relations(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, rank, ...edge): relations touching each query's seed entities, once each, strongest first (ties by id)."""
    touched = graph.endpoints(edges).select("id", "edge_id").join(seeds.select("query_id", "id"), "id")
    touched = touched.select("query_id", F.col("edge_id").alias("id")).distinct()
    by_strength = Window.partitionBy("query_id").orderBy(F.desc("relation_strength"), "id")
    return touched.join(edges, "id").withColumn("rank", F.row_number().over(by_strength) - 1)


def seed_chunks(seeds: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, chunk_id, seed_order, cooccurrence, rank): chunks of each query's seeds by the first seed that lists them.

    ``cooccurrence`` counts that seed's edges whose other end lists the chunk
    too; chunks are ranked by seed, then by that count, ties by id. ``seeds``
    has (query_id, id, seed_order).
    """
    bridge = entities.select("id", F.explode("source_chunk_id").alias("chunk_id")).filter("chunk_id is not null").distinct()
    listed = seeds.join(bridge, "id")
    owner = listed.groupBy("query_id", "chunk_id").agg(F.min(F.struct("seed_order", "id")).alias("o"))
    owned = owner.select("query_id", "chunk_id", F.col("o.seed_order").alias("seed_order"), F.col("o.id").alias("id"))
    # counted once per owner and chunk, however many queries share them
    ends = graph.endpoints(edges).join(seeds.select("id").distinct(), "id", "left_semi").distinct()
    both = (
        owned.select("id", "chunk_id").distinct().join(ends, "id")
        .join(bridge.select(F.col("id").alias("other"), "chunk_id"), ["other", "chunk_id"])
        .groupBy("id", "chunk_id")
        .agg(F.countDistinct("edge_id").alias("cooccurrence"))
    )
    counted = owned.join(both, ["id", "chunk_id"], "left").withColumn("cooccurrence", F.coalesce("cooccurrence", F.lit(0)))
    order = Window.partitionBy("query_id").orderBy("seed_order", F.desc("cooccurrence"), "chunk_id")
    return counted.select("query_id", "chunk_id", "seed_order", "cooccurrence", (F.row_number().over(order) - 1).alias("rank"))


def seed_summaries(seeds: DataFrame, entities: DataFrame, summaries: DataFrame, level: int = MAX_LEVEL) -> DataFrame:
    """(query_id, id, summary): reports of the communities of each query's seeds up to a level, once each."""
    places = (
        entities.select("id", "clusters").join(seeds.select("query_id", "id"), "id")
        .select("query_id", F.explode("clusters").alias("c"))
        .filter(F.col("c.level") <= level)
        .select("query_id", community_id(F.col("c.level"), F.col("c.cluster_id")).alias("id"))
        .distinct()
    )
    return places.join(summaries, "id").select("query_id", "id", "summary")


def documents_of(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, document): distinct document keys of each query's entities and chunks."""
    listed = entities.select("query_id", F.explode("documents_id").alias("document"))
    return listed.union(chunks.select("query_id", "doc_id")).filter("document is not null and document <> ''").distinct()


@dataclass(frozen=True)
class LocalResult:
    entities: DataFrame
    relations: DataFrame
    chunks: DataFrame
    summaries: DataFrame
    documents: DataFrame


def local_search(seeds: DataFrame, entities: DataFrame, relations: DataFrame, chunks: DataFrame, summaries: DataFrame, level: int = MAX_LEVEL) -> LocalResult:
    """The neighbourhood of each query's seed entities; ``seeds`` has (query_id, id, seed_order), for any number of queries."""
    own = entities.join(seeds, "id")
    found = seed_chunks(seeds, entities, relations).withColumnRenamed("chunk_id", "id").join(chunks, "id")
    return LocalResult(
        own, seed_relations(seeds, relations), found, seed_summaries(seeds, entities, summaries, level), documents_of(own, found)
    )


def local_context(found: LocalResult) -> DataFrame:
    """(query_id, kind, rank, id, text): all kinds of one local search in one frame."""
    name = lambda c: F.coalesce(F.col(c), F.lit(""))
    relation = F.concat_ws(" | ", name("subject_name"), name("relation_type"), name("object_name"), name("description"))
    parts = [
        found.entities.select("query_id", F.lit("entity").alias("kind"), F.col("seed_order").cast("int").alias("rank"), "id", F.concat_ws(" | ", name("entity_name"), name("description")).alias("text")),
        found.relations.select("query_id", F.lit("relation"), F.col("rank").cast("int"), "id", relation),
        found.chunks.select("query_id", F.lit("chunk"), F.col("rank").cast("int"), "id", F.col("content")),
        found.summaries.select("query_id", F.lit("summary"), (F.row_number().over(Window.partitionBy("query_id").orderBy("id")) - 1).cast("int"), "id", F.col("summary")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def global_insights(rated: DataFrame) -> DataFrame:
    """Rated reports with ``int(rating) > 0``, best first; a rating of 0.9 counts as none."""
    whole = rated.withColumn("whole_rating", F.col("rating").cast("int"))
    return whole.filter("whole_rating > 0").orderBy(F.desc("whole_rating"), "id")


def mixed_context(parts: dict[str, DataFrame]) -> DataFrame:
    """(engine, query_id, kind, rank, id, text) of all engines in one frame; an engine that gave nothing is missing.

    A null ``query_id`` marks context that holds for every query.
    """
    out = None
    for engine, rows in sorted(parts.items()):
        asked = F.col("query_id") if "query_id" in rows.columns else F.lit(None).cast("long")
        named = rows.select(F.lit(engine).alias("engine"), asked.cast("long").alias("query_id"), "kind", "rank", "id", "text")
        out = named if out is None else out.unionByName(named)
    if out is None:
        raise ValueError("no engine gave a context")
    return out


def within_budget(context: DataFrame, tokens: str, limit: int, order: list[str]) -> DataFrame:
    """The first items of each query by ``order`` whose token counts add up to ``limit`` at most (running sum per query)."""
    used = F.sum(tokens).over(Window.partitionBy("query_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return context.withColumn("used", used).filter(F.col("used") <= limit)


def subquery_order(plan: Iterable[tuple[str, list[str]]]) -> list[str]:
    """Sub-queries in an order that answers dependencies first; unknown ones raise KeyError, cycles ValueError."""
    needs = dict(plan)
    done: dict[str, bool] = {}
    order: list[str] = []
    for first in needs:
        stack = [(first, False)]
        while stack:
            name, back = stack.pop()
            if back:
                done[name] = True
                order.append(name)
            elif name not in done:
                done[name] = False
                stack.append((name, True))
                for d in reversed(needs[name]):
                    if done.get(d) is False:
                        raise ValueError(f"sub-queries depend on one another in a circle: {d}")
                    if d not in done:
                        needs[d]  # an unknown dependency raises here
                        stack.append((d, False))
    return order


def run_plan(plan: list[tuple[str, str, list[str]]], answer: Callable[[str, dict[str, str]], str]) -> dict[str, str]:
    """Answers of all sub-queries (id, query, depends_on); ``answer`` gets the query and the answers it depends on."""
    text = {i: q for i, q, _ in plan}
    needs = {i: d for i, _, d in plan}
    found: dict[str, str] = {}
    for i in subquery_order(needs.items()):
        found[i] = answer(text[i], {d: found[d] for d in needs[i]})
    return found


def plan_order(needs: DataFrame) -> DataFrame:
    """(plan, id, place, depth) for many plans at once, from (plan, id, needed): one row per dependency, null for none.

    ``place`` is that of :func:`subquery_order` with the items by id, ``depth``
    the longest chain below an item. A plan is what one answer loop works off, so
    it fits a task; unknown items and circles raise as there. Null plans and
    items are left out.
    """
    kinds = [needs.schema[c].dataType.simpleString() for c in ("plan", "id")]

    def work(frame):
        import pandas as pd

        wanted: dict = {}
        for item, needed in sorted(zip(frame["id"], frame["needed"], strict=True), key=lambda x: (x[0], str(x[1]))):
            own = wanted.setdefault(item, [])
            if needed is not None and needed not in own:
                own.append(needed)
        depth: dict = {}
        rows = []
        for place, item in enumerate(subquery_order(wanted.items())):
            depth[item] = max((depth[d] + 1 for d in wanted[item]), default=0)
            rows.append((frame["plan"].iloc[0], item, place, depth[item]))
        return pd.DataFrame(rows, columns=["plan", "id", "place", "depth"])

    known = needs.filter("plan is not null and id is not null").select("plan", "id", "needed")
    return known.groupBy("plan").applyInPandas(work, f"plan {kinds[0]}, id {kinds[1]}, place int, depth int")
