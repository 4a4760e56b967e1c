"""Building an index: extraction flows around pluggable models, build steps, summaries of many descriptions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import hooks
from graphloom.functions.scalar import entity_id, normal_type
from graphloom.operators import extraction, graph, merging

#: What a model returns for a text: its entities and relations.
ARTIFACTS = (
    "struct<entities:array<struct<entity_name:string,entity_type:string,description:string>>,"
    "relations:array<struct<source_entity:string,target_entity:string,relation_type:string,description:string,relationship_strength:double>>>"
)
#: (entities, relations) -> (entities, relations)
Module = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def run_modules(entities: DataFrame, relations: DataFrame, modules: Iterable[Module]) -> tuple[DataFrame, DataFrame]:
    """The build steps one after another; each is a function of both frames."""
    for module in modules:
        entities, relations = module(entities, relations)
    return entities, relations


def isolated_nodes_removed(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    return graph.remove_isolated(entities, relations)


def from_artifacts(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) out of (chunk_id, artifacts): typed, with ids, relations resolved to entities of their chunk.

    Unnamed entities and relations of unknown ends are dropped; null answers (a
    failed model call) give nothing.
    """
    found = answers.select("chunk_id", F.posexplode("artifacts.entities").alias("pos", "e")).select("chunk_id", "pos", "e.*")
    found = found.filter("trim(entity_name) <> ''").withColumn("entity_type", normal_type(F.col("entity_type")))
    entities = found.withColumn("entity_id", entity_id(F.col("entity_name"), F.col("entity_type")))
    named = answers.select("chunk_id", F.explode("artifacts.relations").alias("r")).select("chunk_id", "r.*")
    return entities, extraction.resolve_relations(extraction.typed(named, "relation_type"), entities)


def single_step(chunks: DataFrame, model: hooks.Batch, validate: hooks.Batch | None = None, **options: object) -> tuple[DataFrame, DataFrame]:
    """One call per chunk gives entities and relations, and a second one may correct them.

    ``model`` and ``validate`` answer in JSON of the ARTIFACTS form; ``validate``
    reads the text and the first answer.
    """
    rows = chunks.select(F.col("id").alias("chunk_id"), "content")
    rows = hooks.run_hook(rows, "content", "answer", "string", model, **options)
    if validate is not None:
        rows = rows.withColumn("asked", F.when(F.col("answer").isNotNull(), F.concat_ws("\n", "content", "answer")))
        rows = hooks.run_hook(rows, "asked", "checked", "string", validate, **options).withColumn("answer", F.coalesce("checked", "answer"))
    return from_artifacts(rows.select("chunk_id", F.from_json("answer", ARTIFACTS).alias("artifacts")))


def two_stage(chunks: DataFrame, entity_model: hooks.Batch, relation_model: hooks.Batch, **options: object) -> tuple[DataFrame, DataFrame]:
    """Entities first; the second call reads the text with the names found and gives the relations between them."""
    rows = chunks.select(F.col("id").alias("chunk_id"), "content")
    rows = hooks.run_hook(rows, "content", "first", "string", entity_model, **options)
    first = F.from_json("first", ARTIFACTS)
    names = F.array_join(F.transform(first["entities"], lambda e: e["entity_name"]), "\n")
    rows = rows.withColumn("asked", F.when(names != "", F.concat_ws("\n\n", F.col("content"), names)))
    rows = hooks.run_hook(rows, "asked", "second", "string", relation_model, **options)
    second = F.from_json("second", ARTIFACTS)
    both = F.struct(first["entities"].alias("entities"), second["relations"].alias("relations"))
    return from_artifacts(rows.select("chunk_id", F.when(F.col("first").isNotNull(), both).alias("artifacts")))


def four_stage(
    chunks: DataFrame, names: hooks.Batch, normalise: hooks.Batch, describe: hooks.Batch, relate: hooks.Batch, **options: object
) -> tuple[DataFrame, DataFrame]:
    """Small models one after another: names by line, their normal form, a description each, a sentence per ordered pair.

    Returns (chunk_id, entity_name, description) and (chunk_id, source_entity,
    target_entity, description); pairs the model denies a relation for are dropped.
    """
    rows = hooks.run_hook(chunks.select(F.col("id").alias("chunk_id"), "content"), "content", "lines", "string", names, **options)
    found = rows.select("chunk_id", "content", F.posexplode(extraction.lines_to_entities(F.col("lines"))).alias("pos", "raw"))
    found = hooks.run_hook(found.withColumn("asked", F.concat_ws("\n", "content", "raw")), "asked", "entity_name", "string", normalise, **options)
    found = found.filter("trim(entity_name) <> ''").drop("asked", "raw")
    found = found.groupBy("chunk_id", "entity_name").agg(F.min("pos").alias("pos"), F.first("content").alias("content"))
    told = hooks.run_hook(found.withColumn("asked", F.concat_ws("\n", "content", "entity_name")), "asked", "description", "string", describe, **options)
    pairs = extraction.ordered_pairs(found, "chunk_id", "entity_name", "pos").join(rows.select("chunk_id", "content"), "chunk_id")
    pairs = pairs.withColumn("asked", F.concat_ws("\n", "content", "name_a", "name_b"))
    pairs = hooks.run_hook(pairs, "asked", "description", "string", relate, **options).filter(extraction.states_relation(F.col("description")))
    relations = pairs.select(
        "chunk_id", F.col("name_a").alias("source_entity"), F.col("name_b").alias("target_entity"),
        extraction.without_bullet(F.col("description")).alias("description"),
    )
    return told.select("chunk_id", "entity_name", "description"), relations


def valid_outputs(entities: DataFrame, relations: DataFrame, key: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """Relations both ends of which are entities of the same output; outputs without entities vanish."""
    ends = entities.select(key, "entity_name").distinct()
    kept = relations.join(ends.withColumnRenamed("entity_name", "source_entity"), [key, "source_entity"], "left_semi")
    return entities, kept.join(ends.withColumnRenamed("entity_name", "target_entity"), [key, "target_entity"], "left_semi")


def summarise(grouped: DataFrame, model: hooks.Batch, more_than: int = 7, separator: str = " ", **options: object) -> DataFrame:
    """Groups of more than ``more_than`` descriptions get one by the model, the others theirs joined; ``descriptions`` becomes ``description``."""
    joined = grouped.withColumn("description", F.array_join("descriptions", separator)).drop("descriptions")
    many = merging.needs_summary(F.col("duplicate_count"), more_than)
    asked = joined.withColumn("asked", F.when(many, F.col("description")))
    told = hooks.run_hook(asked, "asked", "summary", "string", model, **options)
    return told.withColumn("description", F.when(many, F.col("summary")).otherwise(F.col("description"))).drop("asked", "summary")


def density_links(rows: DataFrame, vector: str, key: str, group: str, distance: float = 0.5, tile: int = 1000) -> DataFrame:
    """(group, a, b): rows of one group within Euclidean ``distance``, a before b.

    A group is cut into parts of about ``tile`` rows, and every pair of parts is
    one matrix product, whatever the size of the group. Null keys, groups and
    vectors, and those of another length than the first, take no part.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (group, key)}
    plain = rows.filter(F.col(group).isNotNull() & F.col(key).isNotNull() & (F.size(vector) > 0)).select(
        F.col(group).alias("g"), F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")
    )
    sizes = plain.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / tile).cast("int")
    own = F.pmod(F.xxhash64("k"), parts).cast("int")
    spread = plain.join(sizes, "g").select("g", "k", "v", own.alias("part"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("with"))
    spread = spread.select("g", F.least("part", "with").alias("p"), F.greatest("part", "with").alias("q"), "k", "v", "part")

    def work(table: pa.Table) -> pa.Table:
        vectors = table.column("v").combine_chunks()
        dim = vectors.value_lengths().to_numpy()
        same = np.flatnonzero(dim == dim[0])
        table = table.take(pa.array(same))
        x = np.stack([np.array(v, dtype=float) for v in table.column("v").to_pylist()])
        square = (x**2).sum(axis=1)
        near = np.round(square[:, None] + square[None, :] - 2 * x @ x.T, 9) <= distance**2
        part = table.column("part").to_numpy()
        if table.column("p")[0].as_py() != table.column("q")[0].as_py():
            near &= part[:, None] != part[None, :]
        i, j = np.nonzero(np.triu(near, 1))
        keys = table.column("k").to_pylist()
        pairs = sorted({(min(keys[a], keys[b]), max(keys[a], keys[b])) for a, b in zip(i.tolist(), j.tolist(), strict=True) if keys[a] != keys[b]})
        g = table.column("g").take(pa.array([0] * len(pairs), pa.int64()))
        kind = table.schema.field("k").type
        return pa.table({"g": g, "a": pa.array([a for a, _ in pairs], kind), "b": pa.array([b for _, b in pairs], kind)})

    found = spread.groupBy("g", "p", "q").applyInArrow(work, f"g {kinds[group]}, a {kinds[key]}, b {kinds[key]}")
    return found.withColumnRenamed("g", group)


def density_clusters(rows: DataFrame, vector: str, key: str, group: str, distance: float = 0.5) -> DataFrame:
    """(group, key, cluster): density clusters of at least two points per group, called by their smallest key; null for noise."""
    links = density_links(rows, vector, key, group, distance).select(group, "a", "b")
    # keys may recur in other groups: a node is a key in its group
    node = lambda c: F.concat_ws("\u0001", F.col(group).cast("string"), F.col(c).cast("string"))
    joint = graph.components(links.select(node("a").alias("a"), node("b").alias("b")))
    named = rows.filter(F.col(group).isNotNull() & F.col(key).isNotNull()).select(group, key).distinct().withColumn("node", node(key))
    placed = named.join(joint.withColumnRenamed("id", "node"), "node", "left")
    first = placed.filter("component is not null").groupBy("component").agg(F.min(key).alias("cluster"))
    return placed.join(first, "component", "left").select(group, key, "cluster")
