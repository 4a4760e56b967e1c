"""Queries: build steps, summaries, density clusters, examples, serialisation, index access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import prompts, scalar
from graphloom.operators import building, chunking, community, lookup, merging, ranking, retrieval
from graphloom.plans.base import communities, entities, query, relations
from graphloom.plans.search import _HYBRID, EVERY, _entity_vectors
from graphloom.session import table


@query("""
with recursive l as (select vec_id, label, embedding::double[] v from embeddings where embedding is not null),
k as (select a.label, a.vec_id a, b.vec_id b from l a join l b on a.label = b.label and a.vec_id < b.vec_id
      where round(list_inner_product(a.v, a.v) + list_inner_product(b.v, b.v) - 2 * list_inner_product(a.v, b.v), 9) <= 0.49),
e as (select a, b from k union select b, a from k),
r(id, c) as (select a, a from e union select e.b, r.c from r join e on e.a = r.id),
m as (select id, min(c) cluster from r group by id)
select l.label, l.vec_id, m.cluster from l left join m on m.id = l.vec_id
""")
def density_clusters(spark: SparkSession, base: str) -> DataFrame:
    return building.density_clusters(table(spark, base, "embeddings"), "embedding", "vec_id", "label", 0.7)


@query("""
with g as (select entity_name, entity_type, coalesce(string_agg(description, ' ' order by rec_no), '') description, count(description) duplicate_count
           from kg_entity group by all)
select entity_name, entity_type, duplicate_count, case when duplicate_count > 3 then 'summary of ' || length(description) || ' characters' else description end description from g
""")
def summarise_split(spark: SparkSession, base: str) -> DataFrame:
    """Groups of more than three descriptions are summarised by a stand-in for the model, the others joined."""
    grouped = merging.group_entities(table(spark, base, "kg_entity"), "rec_no").select("entity_name", "entity_type", "descriptions", "duplicate_count")
    return building.summarise(grouped, lambda texts: [f"summary of {len(t)} characters" for t in texts], 3)


@query("""
with c as (select id, unnest(entity_ids) e, level, cluster_id from com where level is not null and cluster_id is not null),
n as (select e id, level, cluster_id from c),
o as (select id, c.level, c.cluster_id from (select id, unnest(clusters) c from ent) where c is not null),
a as (select distinct id, level, cluster_id from (select * from o union all select n.* from n where id in (select id from ent)))
select id, string_agg(coalesce(level::varchar, '') || ':' || coalesce(cluster_id::varchar, ''), ',' order by level nulls first, cluster_id nulls first) clusters from a group by id
""")
def cluster_write_back(spark: SparkSession, base: str) -> DataFrame:
    found = communities(spark, base).filter("level is not null and cluster_id is not null").select(F.explode("entity_ids").alias("id"), "level", "cluster_id")
    told = community.write_back(entities(spark, base).select("id", "clusters"), found).filter("size(clusters) > 0")
    pair = lambda c: F.concat_ws(":", *[F.coalesce(c[k].cast("string"), F.lit("")) for k in ("level", "cluster_id")])
    return told.select("id", F.array_join(F.transform("clusters", pair), ",").alias("clusters"))


@query("""
with e as (select com.id, string_agg(ent.id || '=' || coalesce(entity_name, ''), ',' order by ent.id) entities
           from (select distinct id, unnest(entity_ids) e from com) com join ent on ent.id = com.e group by com.id),
r as (select com.id, string_agg(rel.id, ',' order by rel.id) relations from (select distinct id, unnest(relation_ids) e from com) com join rel on rel.id = com.e group by com.id)
select com.id, level, cluster_id, coalesce(entities, '') entities, coalesce(relations, '') relations from com left join e using (id) left join r using (id)
""")
def whole_communities(spark: SparkSession, base: str) -> DataFrame:
    names, edges = entities(spark, base).select("id", "entity_name"), relations(spark, base).select("id", "relation_type")
    rows = community.whole_communities(communities(spark, base), names, edges)
    named = lambda e: F.concat(e["id"], F.lit("="), F.coalesce(e["entity_name"], F.lit("")))
    return rows.select(
        "id", "level", "cluster_id",
        F.coalesce(F.array_join(F.transform("entities", named), ","), F.lit("")).alias("entities"),
        F.coalesce(F.array_join(F.transform("relations", lambda r: r["id"]), ","), F.lit("")).alias("relations"),
    )


@query("select distinct subject_id, object_id, rel.id relation_id from (select distinct unnest(relation_ids) id from com) i join rel on rel.id = i.id")
def edge_specs_by_ids(spark: SparkSession, base: str) -> DataFrame:
    asked = communities(spark, base).select(F.explode("relation_ids").alias("id"))
    return lookup.edge_specs(asked, relations(spark, base))


@query("""
select rec_no, '{"id":' || coalesce(to_json(id)::varchar, 'null') || ',"entity_name":' || coalesce(to_json(entity_name)::varchar, 'null') || '}' json,
  strlen('{"id":' || coalesce(to_json(id)::varchar, 'null') || ',"entity_name":' || coalesce(to_json(entity_name)::varchar, 'null') || '}')::int n_bytes from kg_entity
""")
def serialized_rows(spark: SparkSession, base: str) -> DataFrame:
    fields = ("id", "entity_name")
    return table(spark, base, "kg_entity").select("rec_no", scalar.serialized(*fields).alias("json"), scalar.serialized_size(*fields).alias("n_bytes"))


@query("select rec_no, 'x-' || md5(chr(0) || id || chr(0) || 'kind' || chr(1) || entity_type || chr(0) || 'name' || chr(1) || entity_name) key from kg_entity")
def named_hash_ids(spark: SparkSession, base: str) -> DataFrame:
    key = scalar.named_hash_id("x-", F.col("id"), name=F.col("entity_name"), kind=F.col("entity_type"))
    return table(spark, base, "kg_entity").select("rec_no", key.alias("key"))


@query(
    "select min(doc_id) doc_id from (select doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') t from documents where text is not null) where t <> '' group by t"
)
def corpus_dedup(spark: SparkSession, base: str) -> DataFrame:
    return chunking.distinct_texts(table(spark, base, "documents"), "text", ["doc_id"]).select("doc_id")


@query("""
with e as (select distinct unnest(source_chunk_id) c, entity_name n from kg_entity),
r as (select distinct rec_no, unnest(source_chunk_id) c, subject_name s, object_name o from kg_relation)
select rec_no, c chunk_id from r where exists (select 1 from e where e.c = r.c and e.n = r.s) and exists (select 1 from e where e.c = r.c and e.n = r.o)
""")
def output_validator(spark: SparkSession, base: str) -> DataFrame:
    """Relations of each chunk both names of which the same chunk's entities have."""
    listed = table(spark, base, "kg_entity").select(F.explode("source_chunk_id").alias("chunk_id"), "entity_name")
    named = table(spark, base, "kg_relation").select(
        "rec_no", F.explode(F.array_distinct("source_chunk_id")).alias("chunk_id"), F.col("subject_name").alias("source_entity"), F.col("object_name").alias("target_entity")
    )
    return building.valid_outputs(listed, named)[1].select("rec_no", "chunk_id")


def _examples(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    store = _entity_vectors(spark, base).join(entities(spark, base).select("id", F.col("description").alias("text")), "id")
    return store.filter(F.col("vec_no") % EVERY == 0).withColumnRenamed("vec_no", "query_id"), store


@query(f"with {_HYBRID} select query_id, id, score, rank from (select *, row_number() over (partition by query_id order by score desc, id) - 1 rank from b) where rank < 3")
def icl_bm25(spark: SparkSession, base: str) -> DataFrame:
    asked, store = _examples(spark, base)
    return ranking.ranked(ranking.bm25_scores(asked, store, "query_id", "id", k=3), 3)


@query(
    f"with {_HYBRID}, xx as (select * from dr where rank < 6 union all select * from br where rank < 6),"
    " yy as (select query_id, id, round(sum(1.0 / (3.0 + rank + 1)), 9) score from xx group by all),"
    " zz as (select *, row_number() over (partition by query_id order by score desc, id) - 1 rank from yy) select * from zz where rank < 6"
)
def icl_hybrid(spark: SparkSession, base: str) -> DataFrame:
    asked, store = _examples(spark, base)
    dense = retrieval.similar(asked.select("query_id", "vector"), store.select("id", "vector"), 6, -1.0)
    return ranking.fused_examples(dense, ranking.ranked(ranking.bm25_scores(asked, store, "query_id", "id", k=6), 6), 6)


@query("""
with m as (select 'Text:' || chr(10) || coalesce(description, '') t, rec_no, entity_name n, entity_type k, coalesce(description, '') d from kg_entity where entity_name is not null and entity_type is not null)
select rec_no, 'user: ' || t || chr(10) || 'assistant: {"entities":[{"entity_name":' || to_json(n)::varchar || ',"entity_type":' || to_json(k)::varchar || ',"description":' || to_json(d)::varchar || '}]}' extraction,
  'user: Entities for validation:' || chr(10) || '- ' || n || ' (' || k || '): ' || d || chr(10) || chr(10) || t || chr(10) || 'assistant: {"entities":[{"entity_name":' || to_json(n)::varchar || ',"entity_type":' || to_json(k)::varchar || ',"description":' || to_json(d)::varchar || '}]}' validation
from m
""")
def few_shot_examples(spark: SparkSession, base: str) -> DataFrame:
    """The formatters of entity extraction and validation over every entity as an example of itself."""
    text = F.coalesce("description", F.lit(""))
    entity = F.array(F.struct("entity_name", "entity_type", text.alias("description")))
    output = F.struct(entity.alias("entities"), F.array().cast("array<struct<source_entity:string>>").alias("relations"))
    rows = table(spark, base, "kg_entity").filter("entity_name is not null and entity_type is not null").select("rec_no", text.alias("t"), output.alias("o"))
    shown = lambda kind: prompts.conversation_text(prompts.example_messages(kind, F.col("t"), F.col("o")))
    return rows.select("rec_no", shown("entity_extraction").alias("extraction"), shown("entity_validation").alias("validation"))


@query("""
with t as (select doc_id query_id, chunk_order_idx o, id, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> ''))::bigint n from chk where doc_id is not null and content is not null),
s as (select query_id, id, o, sum(n) over (partition by query_id order by o, id rows unbounded preceding)::bigint used from t)
select query_id, id, used from s where used <= 300
""")
def context_budget(spark: SparkSession, base: str) -> DataFrame:
    """The first chunks of each document whose words add up to 300 at most."""
    rows = table(spark, base, "kv_chunks")
    rows = lookup.latest(rows, "id").filter("doc_id is not null and content is not null")
    words = F.size(F.filter(F.split("content", r"\s+"), lambda w: w != "")).cast("long")
    context = rows.select(F.col("doc_id").alias("query_id"), "id", F.col("chunk_order_idx").alias("o"), words.alias("n"))
    return retrieval.within_budget(context, "n", 300, ["o", "id"]).select("query_id", "id", "used")
