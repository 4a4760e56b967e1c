"""Grouping mentions and merging records: two different semantics, both needed.

Grouping (inside one build) collects the mentions of an entity or relation;
merging (on upsert) unites the new record with the stored one. Every list is
ordered by an explicit position, as a shuffle keeps no order of its own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from graphloom.functions.scalar import SENTENCE_BREAK, squeeze


def union_of(arrays: str) -> Column:
    """Sorted distinct non-null elements of all arrays of a group."""
    flat = F.flatten(F.collect_set(F.coalesce(F.col(arrays), F.array().cast("array<string>"))))
    return F.sort_array(F.array_distinct(F.filter(flat, lambda x: x.isNotNull())))


def _ordered(value: str, pos: str) -> Column:
    """Non-null values of a group by position."""
    kept = F.when(F.col(value).isNotNull(), F.struct(F.col(pos).alias("p"), F.col(value).alias("v")))
    return F.transform(F.sort_array(F.collect_list(kept)), lambda x: x["v"])


def group_entities(mentions: DataFrame, pos: str = "pos") -> DataFrame:
    """One row per (entity_name, entity_type): descriptions in order, their count, unions of chunks and documents."""
    return mentions.groupBy("entity_name", "entity_type").agg(
        _ordered("description", pos).alias("descriptions"),
        F.count("description").alias("duplicate_count"),
        union_of("source_chunk_id").alias("source_chunk_id"),
        union_of("documents_id").alias("documents_id"),
    )


def group_relations(mentions: DataFrame, pos: str = "pos") -> DataFrame:
    """One row per (subject_id, object_id, relation_type): first names, distinct descriptions by line, mean strength."""
    return mentions.groupBy("subject_id", "object_id", "relation_type").agg(
        F.min_by("subject_name", pos).alias("subject_name"),
        F.min_by("object_name", pos).alias("object_name"),
        F.array_join(F.array_distinct(_ordered("description", pos)), "\n").alias("description"),
        F.avg("relation_strength").alias("relation_strength"),
        union_of("source_chunk_id").alias("source_chunk_id"),
        F.count("*").alias("duplicate_count"),
    )


def joined_description(descriptions: Column) -> Column:
    return F.array_join(descriptions, " ")


def needs_summary(duplicate_count: Column, more_than: int) -> Column:
    return duplicate_count > more_than


def fragments(text: Column) -> Column:
    """Sentences and lines of a description, white space collapsed, blanks dropped."""
    return F.filter(F.transform(F.split(text, SENTENCE_BREAK), squeeze), lambda x: x != "")


def unique_fragments(parts: Column) -> Column:
    """Distinct by lower case, the first spelling wins.

    ``lower`` stands for full case folding, from which it differs for a few
    letters such as the sharp s.
    """
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("seen"), empty.alias("out"))

    def step(acc: Column, part: Column) -> Column:
        low = F.lower(part)
        more = F.struct(F.concat(acc["seen"], F.array(low)).alias("seen"), F.concat(acc["out"], F.array(part)).alias("out"))
        return F.when(F.array_contains(acc["seen"], low), acc).otherwise(more)

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def fragment_count(text: Column) -> Column:
    return F.size(fragments(F.coalesce(text, F.lit(""))))


def _by_richness(value: str, pos: str) -> Column:
    """Values of a group, rows with more source chunks first, then by position."""
    row = F.struct((-F.size(F.coalesce("source_chunk_id", F.array().cast("array<string>")))).alias("k"), F.col(pos).alias("p"), F.col(value).alias("v"))
    return F.transform(F.sort_array(F.collect_list(row)), lambda x: x["v"])


def _merged_description(pos: str) -> Column:
    texts = F.filter(_by_richness("description", pos), lambda x: x.isNotNull())
    return F.array_join(unique_fragments(F.flatten(F.transform(texts, fragments))), " ")


def _merged_clusters(pos: str) -> Column:
    lists = F.filter(_by_richness("clusters", pos), lambda x: x.isNotNull())
    return F.array_distinct(F.flatten(lists))


def merge_entities(rows: DataFrame, pos: str = "pos") -> DataFrame:
    """Rows of one id united: the richest gives name and type, descriptions fragment by fragment, unions sorted.

    ``pos`` orders new before stored. An id's rows are the versions to merge,
    the new one and the stored one, so groups are small.
    """
    first = lambda c: F.get(_by_richness(c, pos), F.lit(0)).alias(c)
    return rows.groupBy("id").agg(
        first("entity_name"),
        first("entity_type"),
        _merged_description(pos).alias("description"),
        union_of("source_chunk_id").alias("source_chunk_id"),
        union_of("documents_id").alias("documents_id"),
        _merged_clusters(pos).alias("clusters"),
    )


def merge_relations(rows: DataFrame, pos: str = "pos") -> DataFrame:
    """As :func:`merge_entities`; the strength is the plain mean of the rows, so that the order of ingestion matters."""
    first = lambda c: F.get(_by_richness(c, pos), F.lit(0)).alias(c)
    return rows.groupBy("id").agg(
        first("subject_id"),
        first("object_id"),
        first("subject_name"),
        first("object_name"),
        first("relation_type"),
        _merged_description(pos).alias("description"),
        F.avg("relation_strength").alias("relation_strength"),
        union_of("source_chunk_id").alias("source_chunk_id"),
    )


#: (new row, stored row, columns of the richer, columns to unite) -> merged row
Policy = Callable[[dict, dict, list[str], list[str]], dict]

_SPACE = re.compile(r"\s+", re.ASCII)  # as the regular expressions of the JVM
_BREAK = re.compile(SENTENCE_BREAK, re.ASCII)


def _united(new: dict, stored: dict, firsts: list[str], sets: list[str]) -> dict:
    """The policy of :func:`merge_entities` and :func:`merge_relations` for two rows."""
    ranked = [new, stored] if new["rich"] >= stored["rich"] else [stored, new]
    out = {c: ranked[0][c] for c in firsts}
    seen: set[str] = set()
    parts = []
    for row in ranked:
        for part in _BREAK.split(row["description"] or ""):
            clean = _SPACE.sub(" ", part).strip(" ")
            if clean and clean.lower() not in seen:
                seen.add(clean.lower())
                parts.append(clean)
    out["description"] = " ".join(parts)
    for c in sets:
        out[c] = sorted({x for row in ranked for x in row[c] or () if x is not None})
    if "clusters" in stored:
        found: dict = {}
        for row in ranked:
            for x in row["clusters"] or ():
                found.setdefault(x and tuple(x.values()), x)
        out["clusters"] = list(found.values())
    if "relation_strength" in stored:
        known = [row["relation_strength"] for row in ranked if row["relation_strength"] is not None]
        out["relation_strength"] = sum(known) / len(known) if known else None
    out["rich"] = len(out["source_chunk_id"])
    return out


def _fold(rows: DataFrame, order: str, firsts: list[str], sets: list[str], other: str, policy: Policy | None) -> DataFrame:
    unite = policy or _united
    names = ["id", *firsts, "description", *sets, other]
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    target = T.StructType([T.StructField(c, kinds[c]) for c in names])
    fields = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict | None = None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                row["rich"] = len(row["source_chunk_id"] or ())
                if state is not None and state["id"] == row["id"]:
                    state = {"id": row["id"], **unite(row, state, firsts, sets)}
                    continue
                if state is not None:
                    done.append(state)
                # one version is united with nothing: the form is that of a merged row
                rich = row["rich"]
                blank = dict.fromkeys(row) | {"rich": -1}
                state = {"id": row["id"], **unite(row, blank, firsts, sets), "rich": rich}
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in names} for r in done], schema=fields)
        if state is not None:
            yield pa.RecordBatch.from_pylist([{c: state[c] for c in names}], schema=fields)

    # One version at a time: a task holds the merged row of the id at hand, however many versions there are.
    sorted_rows = rows.filter("id is not null").select(*names, order).repartition("id").sortWithinPartitions("id", order)
    return sorted_rows.mapInArrow(run, target)


def fold_entities(rows: DataFrame, order: str, policy: Policy | None = None) -> DataFrame:
    """All versions of each id merged one after another by ``order``, as so many calls of :func:`merge_entities` do.

    A ``policy`` of your own takes the new and the stored row, the columns the
    richer one gives and those to unite, and returns the merged row.
    """
    return _fold(rows, order, ["entity_name", "entity_type"], ["source_chunk_id", "documents_id"], "clusters", policy)


def fold_relations(rows: DataFrame, order: str, policy: Policy | None = None) -> DataFrame:
    """As :func:`fold_entities`; each step takes the mean of the stored strength and the new one."""
    firsts = ["subject_id", "object_id", "subject_name", "object_name", "relation_type"]
    return _fold(rows, order, firsts, ["source_chunk_id"], "relation_strength", policy)


def duplicate_ids(rows: DataFrame, key: str = "id") -> DataFrame:
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("copies")).filter("copies > 1")
