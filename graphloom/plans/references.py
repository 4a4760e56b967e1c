"""Queries of problem 3: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators.references import Parent, Reference, orphan_references, orphan_report
from graphloom.session import table


def orphans(spark: SparkSession, base: str) -> DataFrame:
    entity, chunks = table(spark, base, "kg_entity"), table(spark, base, "kv_chunks")
    relation = table(spark, base, "kg_relation")
    return orphan_references(
        [
            Reference(relation, "kg_relation", "subject_id", "entity"),
            Reference(relation, "kg_relation", "object_id", "entity"),
            Reference(table(spark, base, "kv_community"), "kv_community", "entity_ids", "entity"),
            Reference(entity, "kg_entity", "source_chunk_id", "chunk"),
        ],
        [Parent(entity, "entity"), Parent(chunks, "chunk")],
        table(spark, base, "kg_tombstone"),
    )


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return orphans(spark, base).select("ref_table", "ref_field", "rec_no", "ref_key")


def p3_report(spark: SparkSession, base: str) -> DataFrame:
    return orphan_report(orphans(spark, base))


_ORPHANS = """
with refs as (
  select 'kg_relation' ref_table, 'subject_id' ref_field, 'entity' kind, rec_no, lower(trim(subject_id)) k, ingested_at t from kg_relation
  union all select 'kg_relation', 'object_id', 'entity', rec_no, lower(trim(object_id)), ingested_at from kg_relation
  union all select 'kv_community', 'entity_ids', 'entity', rec_no, lower(trim(unnest(entity_ids))), ingested_at from kv_community
  union all select 'kg_entity', 'source_chunk_id', 'chunk', rec_no, lower(trim(unnest(source_chunk_id))), ingested_at from kg_entity
), r as (select distinct * from refs where k is not null and k <> ''),
p as (
  select kind, k, min(t) first_t, max(t) last_t
  from (select 'entity' kind, lower(trim(id)) k, ingested_at t from kg_entity
        union all select 'chunk', lower(trim(id)), ingested_at from kv_chunks) group by 1, 2
), d as (select lower(trim(kind)) kind, lower(trim(id)) k, max(deleted_at) gone from kg_tombstone group by 1, 2),
o as (
  select ref_table, ref_field, rec_no, r.k ref_key, r.t, case
    when p.k is null then 'missing'
    when d.gone is not null and not coalesce(p.last_t > d.gone, false) then 'deleted'
    when p.first_t > r.t then 'late' end reason
  from r left join p on p.kind = r.kind and p.k = r.k left join d on d.kind = r.kind and d.k = r.k
)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _ORPHANS + "select ref_table, ref_field, rec_no, ref_key from o where reason is not null",
        "p3_report": _ORPHANS
        + "select ref_table, ref_field, strftime(date_trunc('month', t), '%Y-%m-%d') period, reason,"
        " count(*) orphan_refs, count(distinct ref_key) orphan_keys from o where reason is not null group by all",
    }
