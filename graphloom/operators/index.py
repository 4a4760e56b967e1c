"""The knowledge index: entities, relations, chunks, communities, summaries and vectors as one set of tables.

A table is a DataFrame; a :class:`KnowledgeIndex` is a value, and every change
gives a new one, so a failing step (an embedder, say) leaves the old one as it
was. ``save`` writes all tables to a fresh folder before it moves a pointer.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph, lookup, merging

TABLES = ("entities", "relations", "chunks", "communities", "summaries", "entity_vectors", "relation_vectors", "chunk_vectors")


def consistency_issues(index: KnowledgeIndex) -> DataFrame:
    """(check, id): ids that refer to something missing, and vectors missing or left over."""

    def missing(check: str, ids: DataFrame, known: DataFrame) -> DataFrame:
        found = ids.filter("id is not null").distinct().join(known.select("id").distinct(), "id", "left_anti")
        return found.select(F.lit(check).alias("check"), "id")

    ids = lambda df, column="id": df.select(F.col(column).alias("id"))
    listed = lambda df, column: df.select(F.explode(column).alias("id"))
    e, r, c, com = index.entities, index.relations, index.chunks, index.communities
    parts = [
        missing("source_chunk_references", listed(e, "source_chunk_id").union(listed(r, "source_chunk_id")), c),
        missing("relation_endpoints", ids(r, "subject_id").union(ids(r, "object_id")), e),
        missing("community_references", listed(com, "entity_ids"), e),
        missing("community_references", listed(com, "relation_ids"), r),
    ]
    for kind, rows, vectors in (
        ("entity", e, index.entity_vectors),
        ("relation", r, index.relation_vectors),
        ("chunk", c, index.chunk_vectors),
    ):
        if vectors is not None:
            parts.append(missing(f"{kind}_vector_missing", ids(rows), vectors))
            parts.append(missing(f"{kind}_vector_orphan", ids(vectors), rows))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def report(issues: DataFrame, most: int = 20) -> str:
    """Readable result of the checks: counts, and the first ``most`` ids of each."""
    rows = issues.groupBy("check").agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_set("id")), 1, most).alias("ids")).orderBy("check").collect()
    if not rows:
        return "Consistency: OK"
    return "\n".join(["Consistency: FAILED", *(f"- {r['check']}: {r['n']} ({', '.join(r['ids'])})" for r in rows)])


def mentioning(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Distinct ids of the rows that list one of the chunks; a join over the exploded bridge, not a scan per chunk."""
    bridge = rows.select("id", F.explode("source_chunk_id").alias("chunk"))
    return bridge.join(chunks.select(F.col("id").alias("chunk")).distinct(), "chunk", "left_semi").select("id").distinct()


@dataclass(frozen=True)
class KnowledgeIndex:
    entities: DataFrame
    relations: DataFrame
    chunks: DataFrame
    communities: DataFrame
    summaries: DataFrame
    entity_vectors: DataFrame | None = None
    relation_vectors: DataFrame | None = None
    chunk_vectors: DataFrame | None = None

    @staticmethod
    def _reject_duplicates(new: DataFrame) -> None:
        twice = [r["id"] for r in merging.duplicate_ids(new).limit(5).collect()]
        if twice:
            raise ValueError(f"ids given twice: {', '.join(twice)}")

    @staticmethod
    def _require_known(new: DataFrame, stored: DataFrame) -> None:
        unknown = [r["id"] for r in new.join(stored.select("id"), "id", "left_anti").select("id").limit(5).collect()]
        if unknown:
            raise ValueError(f"unknown ids: {', '.join(unknown)}")

    def upsert_nodes(self, new: DataFrame, vectors: DataFrame | None = None) -> KnowledgeIndex:
        self._reject_duplicates(new)
        return replace(self, entities=graph.upsert(self.entities, new, ["id"]), entity_vectors=_with(self.entity_vectors, vectors))

    def update_nodes(self, new: DataFrame, vectors: DataFrame | None = None) -> KnowledgeIndex:
        self._require_known(new, self.entities)
        return self.upsert_nodes(new, vectors)

    def merge_nodes(self, new: DataFrame, vectors: DataFrame | None = None) -> KnowledgeIndex:
        """New entities united with the stored ones of the same id."""
        self._reject_duplicates(new)
        return replace(self, entities=_merged(new, self.entities, merging.merge_entities), entity_vectors=_with(self.entity_vectors, vectors))

    def upsert_edges(self, new: DataFrame, vectors: DataFrame | None = None) -> KnowledgeIndex:
        """Raises where an endpoint is no entity."""
        self._reject_duplicates(new)
        if new.exceptAll(graph.connected_edges(self.entities, new).select(*new.columns)).limit(1).count():
            raise ValueError("an edge refers to an unknown node")
        return replace(self, relations=graph.upsert(self.relations, new, ["id"]), relation_vectors=_with(self.relation_vectors, vectors))

    def update_edges(self, new: DataFrame, vectors: DataFrame | None = None) -> KnowledgeIndex:
        self._require_known(new, self.relations)
        return self.upsert_edges(new, vectors)

    def merge_edges(self, new: DataFrame, vectors: DataFrame | None = None) -> KnowledgeIndex:
        self._reject_duplicates(new)
        return replace(self, relations=_merged(new, self.relations, merging.merge_relations), relation_vectors=_with(self.relation_vectors, vectors))

    def upsert_chunks(self, new: DataFrame, vectors: DataFrame | None = None) -> KnowledgeIndex:
        return replace(self, chunks=graph.upsert(self.chunks, new, ["id"]), chunk_vectors=_with(self.chunk_vectors, vectors))

    def upsert_communities(self, new: DataFrame) -> KnowledgeIndex:
        return replace(self, communities=graph.upsert(self.communities, new, ["id"]))

    def upsert_summaries(self, new: DataFrame) -> KnowledgeIndex:
        return replace(self, summaries=graph.upsert(self.summaries, new, ["id"]))

    def delete_nodes(self, gone: DataFrame) -> KnowledgeIndex:
        nodes, edges = graph.delete_nodes(self.entities, self.relations, gone)
        return replace(
            self, entities=nodes, relations=edges,
            entity_vectors=_without(self.entity_vectors, gone), relation_vectors=_kept(self.relation_vectors, edges),
        )

    def delete_edges(self, specs: DataFrame, strict: bool = True) -> KnowledgeIndex:
        edges = graph.delete_edges(self.relations, specs, strict)
        return replace(self, relations=edges, relation_vectors=_kept(self.relation_vectors, edges))

    def delete_chunks(self, gone: DataFrame) -> KnowledgeIndex:
        """Also every entity and relation that mentions one of the chunks, and the edges of those entities."""
        nodes = mentioning(self.entities, gone)
        named = mentioning(self.relations, gone)
        left = replace(self, relations=self.relations.join(named, "id", "left_anti")).delete_nodes(nodes)
        return replace(
            left, chunks=self.chunks.join(gone.select("id"), "id", "left_anti"), chunk_vectors=_without(self.chunk_vectors, gone),
            relation_vectors=_kept(self.relation_vectors, left.relations),
        )

    def delete_communities(self, gone: DataFrame) -> KnowledgeIndex:
        return replace(self, communities=self.communities.join(gone.select("id"), "id", "left_anti"), summaries=self.summaries.join(gone.select("id"), "id", "left_anti"))

    def delete_summaries(self, gone: DataFrame) -> KnowledgeIndex:
        return replace(self, summaries=self.summaries.join(gone.select("id"), "id", "left_anti"))

    def update_chunks(self, new: DataFrame, vectors: DataFrame | None = None) -> KnowledgeIndex:
        self._require_known(new, self.chunks)
        return self.upsert_chunks(new, vectors)

    def update_communities(self, new: DataFrame) -> KnowledgeIndex:
        self._require_known(new, self.communities)
        return self.upsert_communities(new)

    def update_summaries(self, new: DataFrame) -> KnowledgeIndex:
        self._require_known(new, self.summaries)
        return self.upsert_summaries(new)

    def get(self, table: str, request: DataFrame) -> DataFrame:
        """(pos, id, ...): the records of one of TABLES for (pos, id), null where missing."""
        stored = getattr(self, table)
        return lookup.get_by_ids(request, stored, [c for c in stored.columns if c != "id"])

    def edge_specs(self, ids: DataFrame) -> DataFrame:
        return lookup.edge_specs(ids, self.relations)

    def validate_vectors(self, dim: int) -> None:
        """Raises where a stored vector has another length than ``dim``; null vectors are none."""
        for name in TABLES:
            rows = getattr(self, name)
            if name.endswith("_vectors") and rows is not None and rows.filter(F.size("vector") != dim).limit(1).count():
                raise ValueError(f"{name} holds vectors of another length than {dim}")

    def check_consistency(self) -> DataFrame:
        return consistency_issues(self)

    def save(self, folder: str) -> str:
        """All tables to a new version folder under ``folder``; the pointer moves last. Gives the version."""
        version = uuid.uuid4().hex
        for name in TABLES:
            rows = getattr(self, name)
            if rows is not None:
                rows.write.parquet(f"{folder}/{version}/{name}")
        self.entities.sparkSession.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{folder}/current")
        return version

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> KnowledgeIndex:
        version = spark.read.schema("version string").json(f"{folder}/current").first()["version"]

        def read(name: str) -> DataFrame | None:
            try:
                return spark.read.parquet(f"{folder}/{version}/{name}")
            except Exception as e:  # a table that was not kept
                if "PATH_NOT_FOUND" in str(e):
                    return None
                raise

        return cls(**{name: read(name) for name in TABLES})


def _with(stored: DataFrame | None, new: DataFrame | None) -> DataFrame | None:
    if new is None or stored is None:
        return new if stored is None else stored
    return graph.upsert(stored, new, ["id"])


def _without(stored: DataFrame | None, gone: DataFrame) -> DataFrame | None:
    return None if stored is None else stored.join(gone.select("id"), "id", "left_anti")


def _kept(stored: DataFrame | None, rows: DataFrame) -> DataFrame | None:
    return None if stored is None else stored.join(rows.select("id"), "id", "left_semi")


def _merged(new: DataFrame, stored: DataFrame, merge) -> DataFrame:
    touched = stored.join(new.select("id"), "id", "left_semi").withColumn("pos", F.lit(1))
    rows = new.withColumn("pos", F.lit(0)).unionByName(touched, allowMissingColumns=True)
    return stored.join(new.select("id"), "id", "left_anti").unionByName(merge(rows), allowMissingColumns=True)


def size_batches(rows: DataFrame, group: str, order: str, text: str, limit: int) -> DataFrame:
    """(group, order, batch): greedy batches of at most ``limit`` UTF-8 bytes in order, a larger item alone.

    A stream that counts on is sequential by nature; ``group`` (say, the
    document of a chunk) spreads it. Only sizes are moved, and a task holds one
    running sum, however many rows a group has. Rows without a group are left
    out, null texts weigh nothing.
    """
    kind = rows.schema[group].dataType.simpleString()
    sized = rows.filter(F.col(group).isNotNull()).select(
        F.col(group).alias("g"), F.col(order).cast("bigint").alias("k"), F.coalesce(F.octet_length(text), F.lit(0)).alias("n")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, used, number = None, 0, 0
        for batch in batches:
            out = []
            for own, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if own != last:
                    last, used, number = own, 0, 0
                elif used and used + n > limit:
                    used, number = 0, number + 1
                used += n
                out.append(number)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int32())], names=["g", "k", "batch"])

    ordered = sized.repartition("g").sortWithinPartitions("g", "k")
    return ordered.mapInArrow(run, f"g {kind}, k bigint, batch int").select(F.col("g").alias(group), F.col("k").alias(order), "batch")


def fixed_batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Batches of ``size`` rows by the position in ``order`` values that count from 0."""
    return rows.withColumn("batch", F.floor(F.col(order) / size))
