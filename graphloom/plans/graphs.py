"""Queries: the graph, grouping and merging, communities, index upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import community, graph, index, merging
from graphloom.plans.base import chunks, communities, entities, query, relations, summaries
from graphloom.session import table


@query("""
with e as (select subject_id id from rel union all select object_id from rel)
select id, count(*) degree from e where id is not null group by id
""")
def node_degree(spark: SparkSession, base: str) -> DataFrame:
    return graph.degrees(relations(spark, base))


@query("""
with e as (select subject_id id from rel union all select object_id from rel), d as (select id, count(*) n from e group by id),
p as (select distinct subject_id, object_id from rel where subject_id is not null and object_id is not null)
select p.subject_id, p.object_id, coalesce(a.n, 0) + coalesce(b.n, 0) degree_sum
from p left join d a on a.id = p.subject_id left join d b on b.id = p.object_id
""")
def edge_degree_sum(spark: SparkSession, base: str) -> DataFrame:
    edges = relations(spark, base)
    pairs = edges.filter("subject_id is not null and object_id is not null").select("subject_id", "object_id").distinct()
    return graph.edge_degree_sums(pairs, edges)


@query("""
with e as (select subject_id i, id edge_id from rel union select object_id, id from rel)
select i id, edge_id from e where i in (select id from ent)
""")
def incident_edges(spark: SparkSession, base: str) -> DataFrame:
    return graph.incident_edges(entities(spark, base), relations(spark, base))


@query("""
with e as (select subject_id i, object_id neighbour from rel union select object_id, subject_id from rel)
select i id, neighbour from e where i in (select id from ent) and neighbour is not null
""")
def one_hop_neighbours(spark: SparkSession, base: str) -> DataFrame:
    return graph.neighbours(entities(spark, base), relations(spark, base))


@query("""
with k as (select id, subject_id, object_id from rel where subject_id in (select id from ent) and object_id in (select id from ent)),
t as (select subject_id id from k union select object_id from k)
select 'node' kind, id from ent where id in (select id from t) union all select 'edge', id from k
""")
def remove_isolated(spark: SparkSession, base: str) -> DataFrame:
    nodes, edges = graph.remove_isolated(entities(spark, base), relations(spark, base))
    return _both(nodes, edges)


def _both(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select(F.lit("node").alias("kind"), "id").unionAll(edges.select(F.lit("edge"), "id"))


@query("""
select distinct least(subject_id, object_id) a, greatest(subject_id, object_id) b from rel
where subject_id is not null and object_id is not null and subject_id <> object_id
""")
def undirected_projection(spark: SparkSession, base: str) -> DataFrame:
    return graph.undirected(relations(spark, base))


@query(
    """
with u as (select distinct subject_id a, object_id b from rel where subject_id <> object_id),
e as (select a, b from u union select b, a from u),
r(id, c) as (select a, a from e union select e.b, r.c from r join e on e.a = r.id)
select id, min(c) component from r group by id
""",
    recursive=True,
)
def connected_components(spark: SparkSession, base: str) -> DataFrame:
    return graph.components(graph.undirected(relations(spark, base)))


@query("""
with e as (select subject_id id from rel union all select object_id from rel), d as (select id, count(*) n from e group by id),
n as (select ent.id, coalesce(d.n, 0) degree from ent left join d on d.id = ent.id), t as (select max(degree) top from n)
select id, degree, round(15.0 + case when top > 0 then 35.0 * degree / top else 0.0 end, 6) size from n, t
""")
def node_layout_size(spark: SparkSession, base: str) -> DataFrame:
    return graph.layout_sizes(entities(spark, base), relations(spark, base))


_UNION = "(select string_agg(x, ',' order by x) from (select distinct unnest({0}) x) where x is not null)"
_ALL = "coalesce(array_to_string(list_sort(list_filter(list_distinct(flatten(list(coalesce({0}, []::varchar[])))), lambda x: x is not null)), ','), '')"


@query(f"""
select entity_name, entity_type, coalesce(string_agg(description, '|' order by rec_no), '') descriptions, count(description) duplicate_count,
  {_ALL.format("source_chunk_id")} chunks, {_ALL.format("documents_id")} documents
from kg_entity group by entity_name, entity_type
""")
def group_entities(spark: SparkSession, base: str) -> DataFrame:
    grouped = merging.group_entities(table(spark, base, "kg_entity"), "rec_no")
    return grouped.select(
        "entity_name", "entity_type", F.array_join("descriptions", "|").alias("descriptions"), "duplicate_count",
        F.array_join("source_chunk_id", ",").alias("chunks"), F.array_join("documents_id", ",").alias("documents"),
    )


@query(f"""
with d as (select subject_id, object_id, relation_type, description, min(rec_no) r from kg_relation where description is not null group by all),
t as (select subject_id, object_id, relation_type, string_agg(description, chr(10) order by r) description from d group by all),
g as (select subject_id, object_id, relation_type, arg_min(subject_name, rec_no) filter (where subject_name is not null) s0,
        first(subject_name order by rec_no) subject_name, first(object_name order by rec_no) object_name,
        round(avg(relation_strength), 6) relation_strength, {_ALL.format("source_chunk_id")} chunks, count(*) duplicate_count
      from kg_relation group by subject_id, object_id, relation_type)
select g.subject_id, g.object_id, g.relation_type, g.subject_name, g.object_name, coalesce(t.description, '') description,
  relation_strength, chunks, duplicate_count
from g left join t on t.subject_id is not distinct from g.subject_id and t.object_id is not distinct from g.object_id
  and t.relation_type is not distinct from g.relation_type
""")
def group_relations(spark: SparkSession, base: str) -> DataFrame:
    grouped = merging.group_relations(table(spark, base, "kg_relation"), "rec_no")
    return grouped.select(
        "subject_id", "object_id", "relation_type", "subject_name", "object_name", "description",
        F.round("relation_strength", 6).alias("relation_strength"), F.array_join("source_chunk_id", ",").alias("chunks"), "duplicate_count",
    )


def _merged_sql(name: str, firsts: list[str], sets: list[str], strength: bool) -> str:
    """Every version of an id merged in the order of rec_no, one step of the recursion per version."""
    split = (
        "list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce({0}, ''), '\\n+', chr(31), 'g'),"
        " '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')"
    )
    once = "list_filter({0}, lambda x, i: list_position(list_transform({0}, lambda y: lower(y)), lower(x)) = i)"
    clean = "list_sort(list_distinct(list_filter(coalesce({0}, []::varchar[]), lambda x: x is not null)))"
    joined = "list_sort(list_distinct(list_filter(list_concat(coalesce({0}, []::varchar[]), coalesce({1}, []::varchar[])), lambda x: x is not null)))"
    new_first = "coalesce(len(v.source_chunk_id), 0) >= r.rich"
    start = [*firsts, f"array_to_string({once.format('ss')}, ' ') description", *[f"{clean.format(c)} {c}" for c in sets], "rich"]
    step = [f"case when {new_first} then v.{c} else r.{c} end" for c in firsts]
    parts = f"case when {new_first} then list_concat(v.ss, {split.format('r.description')}) else list_concat({split.format('r.description')}, v.ss) end"
    step += [f"array_to_string({once.format('(' + parts + ')')}, ' ')", *[joined.format(f"v.{c}", f"r.{c}") for c in sets], f"len({joined.format('v.source_chunk_id', 'r.source_chunk_id')})"]
    if strength:
        start.append("relation_strength")
        step.append("case when r.relation_strength is null then v.relation_strength when v.relation_strength is null then r.relation_strength else (v.relation_strength + r.relation_strength) / 2 end")
    named = [c.split()[-1] for c in start]
    out = ["id", *firsts, "description", *[f"array_to_string({c}, ',') {'chunks' if c == 'source_chunk_id' else 'documents'}" for c in sets]]
    out += ["round(relation_strength, 6) relation_strength"] if strength else []
    return f"""
with recursive v as (
  select *, row_number() over (partition by id order by rec_no) k, count(*) over (partition by id) n, coalesce(len(source_chunk_id), 0) rich,
    {split.format("description")} ss from {name} where id is not null
), r(id, k, n, {", ".join(named)}) as (
  select id, k, n, {", ".join(start)} from v where k = 1
  union all
  select r.id, v.k, r.n, {", ".join(step)} from r join v on v.id = r.id and v.k = r.k + 1
) select {", ".join(out)} from r where k = n
"""


@query(_merged_sql("kg_entity", ["entity_name", "entity_type"], ["source_chunk_id", "documents_id"], False))
def merge_entities(spark: SparkSession, base: str) -> DataFrame:
    merged = merging.fold_entities(table(spark, base, "kg_entity"), "rec_no")
    return merged.select(
        "id", "entity_name", "entity_type", "description",
        F.array_join("source_chunk_id", ",").alias("chunks"), F.array_join("documents_id", ",").alias("documents"),
    )


@query(_merged_sql("kg_relation", ["subject_name", "relation_type"], ["source_chunk_id"], True))
def merge_relations(spark: SparkSession, base: str) -> DataFrame:
    merged = merging.fold_relations(table(spark, base, "kg_relation"), "rec_no")
    return merged.select(
        "id", "subject_name", "relation_type", "description",
        F.round("relation_strength", 6).alias("relation_strength"), F.array_join("source_chunk_id", ",").alias("chunks"),
    )


@query("select id, count(*) copies from kg_entity where id is not null group by id having count(*) > 1")
def duplicate_ids(spark: SparkSession, base: str) -> DataFrame:
    return merging.duplicate_ids(table(spark, base, "kg_entity"))


_MEMBERS = "m as (select distinct id, c.level, c.cluster_id from (select id, unnest(clusters) c from ent) where c.level is not null and c.cluster_id is not null)"


@query(f"""
with {_MEMBERS}
select distinct rel.id, a.level, a.cluster_id from rel join m a on a.id = rel.subject_id
join m b on b.id = rel.object_id and b.level = a.level and b.cluster_id = a.cluster_id
""")
def membership_intersection(spark: SparkSession, base: str) -> DataFrame:
    return community.shared_memberships(relations(spark, base), community.memberships(entities(spark, base)))


@query(f"""
with {_MEMBERS},
x as (select distinct rel.id, a.level, a.cluster_id from rel join m a on a.id = rel.subject_id
      join m b on b.id = rel.object_id and b.level = a.level and b.cluster_id = a.cluster_id),
e as (select level, cluster_id, string_agg(id, ',' order by id) entity_ids from m group by all),
r as (select level, cluster_id, string_agg(id, ',' order by id) relation_ids from x group by all)
select 'com-' || md5(chr(0) || e.level || ':' || e.cluster_id) id, e.level, e.cluster_id, entity_ids, coalesce(relation_ids, '') relation_ids
from e left join r on r.level = e.level and r.cluster_id = e.cluster_id
""")
def community_rows(spark: SparkSession, base: str) -> DataFrame:
    rows = community.community_rows(relations(spark, base), community.memberships(entities(spark, base)))
    return rows.withColumns({c: F.array_join(c, ",") for c in ("entity_ids", "relation_ids")})


@query(f"""
with {_MEMBERS}, t as (select level, max(cluster_id) top from m group by level),
n as (select distinct level, cluster_id from com where cluster_id is not null)
select n.level, n.cluster_id, (dense_rank() over (partition by n.level order by n.cluster_id) + coalesce(t.top, -1))::int new_id
from n left join t on t.level = n.level
""")
def cluster_renumber(spark: SparkSession, base: str) -> DataFrame:
    return community.renumbering(communities(spark, base), community.memberships(entities(spark, base)))


@query(f"with {_MEMBERS} select id, level, cluster_id from m where level <= 2")
def community_level_filter(spark: SparkSession, base: str) -> DataFrame:
    return community.memberships(entities(spark, base)).filter("level <= 2")


@query("select 0 bad_nodes, 0 split_parents, 0 missing_nodes, 0 disconnected, 0 low_modularity")
def leiden_invariants(spark: SparkSession, base: str) -> DataFrame:
    """Violations of the hierarchy's rules: one level 0 cluster per linked node, deeper levels refine, nothing is lost,
    every cluster hangs together, and the partition has a modularity of 0.3 at least."""
    from graphloom.session import materialize

    links = materialize(graph.undirected(relations(spark, base)), "undirected")
    found = materialize(community.detect(links), "hierarchy")
    linked = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    counted = found.groupBy("id", "level").agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").cast("int").alias("bad_nodes"))
    up = found.select("id", (F.col("level") - 1).alias("level"), F.col("cluster_id").alias("child"))
    parents = up.filter("level >= 0").join(found, ["id", "level"]).groupBy("level", "child").agg(F.countDistinct("cluster_id").alias("n"))
    split = parents.filter("n > 1").agg(F.count("*").cast("int").alias("split_parents"))
    top = found.filter("level = 0")
    missing = linked.join(top, "id", "left_anti").agg(F.count("*").cast("int").alias("missing_nodes"))
    at = lambda c, name: top.select(F.col("id").alias(c), F.col("cluster_id").alias(name))
    inside = links.join(at("a", "ca"), "a").join(at("b", "cb"), "b").filter("ca = cb")
    parts = top.join(graph.components(inside.select("a", "b")), "id", "left").groupBy("cluster_id").agg(
        F.countDistinct(F.coalesce("component", "id")).alias("n")
    )
    loose = parts.filter("n > 1").agg(F.count("*").cast("int").alias("disconnected"))
    low = F.lit(int(community.modularity(links, top) < 0.3)).alias("low_modularity")
    # four single rows
    return counted.join(F.broadcast(split)).join(F.broadcast(missing)).join(F.broadcast(loose)).withColumn("low_modularity", low)


@query("""
with f as (select * from kg_entity where id is not null qualify row_number() over (partition by id order by rec_no) = 1),
n as (select * from kg_entity where id is not null and rec_no in (select max(rec_no) from kg_entity group by id having count(*) > 1))
select id, rec_no from f where id not in (select id from n) union all select id, rec_no from n
""")
def upsert_nodes(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "kg_entity").filter("id is not null")
    ends = rows.groupBy("id").agg(F.min("rec_no").alias("first"), F.max("rec_no").alias("last"))
    stored = ends.select("id", F.col("first").alias("rec_no"))
    new = ends.filter("last > first").select("id", F.col("last").alias("rec_no"))
    return graph.upsert(stored, new, ["id"])


def _gone(spark: SparkSession, base: str, kind: str) -> DataFrame:
    return table(spark, base, "kg_tombstone").filter(F.col("kind") == kind).select("id")


@query("""
with g as (select id from kg_tombstone where kind = 'entity')
select 'node' kind, id from ent where id not in (select id from g)
union all select 'edge', id from rel where coalesce(subject_id not in (select id from g), true) and coalesce(object_id not in (select id from g), true)
""")
def delete_nodes_cascade(spark: SparkSession, base: str) -> DataFrame:
    return _both(*graph.delete_nodes(entities(spark, base), relations(spark, base), _gone(spark, base, "entity")))


def _index(spark: SparkSession, base: str) -> index.KnowledgeIndex:
    vectors = table(spark, base, "vdb_entity").select(F.col("__id__").alias("id"), F.col("__vector__").alias("vector"))
    return index.KnowledgeIndex(
        entities(spark, base), relations(spark, base), chunks(spark, base), communities(spark, base), summaries(spark, base), vectors
    )


@query("""
with g as (select id from kg_tombstone where kind = 'chunk'),
n as (select distinct id from (select id, unnest(source_chunk_id) c from ent) where c in (select id from g)),
r as (select distinct id from (select id, unnest(source_chunk_id) c from rel) where c in (select id from g))
select 'node' kind, id from ent where id not in (select id from n)
union all select 'edge', id from rel where id not in (select id from r)
  and coalesce(subject_id not in (select id from n), true) and coalesce(object_id not in (select id from n), true)
union all select 'chunk', id from chk where id not in (select id from g)
""")
def delete_chunks_cascade(spark: SparkSession, base: str) -> DataFrame:
    left = _index(spark, base).delete_chunks(_gone(spark, base, "chunk"))
    return _both(left.entities, left.relations).unionAll(left.chunks.select(F.lit("chunk"), "id"))


@query("""
with p as (select distinct subject_id, object_id from rel where relation_type is null and subject_id is not null and object_id is not null)
select id from rel where not exists (select 1 from p where p.subject_id = rel.subject_id and p.object_id = rel.object_id)
""")
def delete_edges(spark: SparkSession, base: str) -> DataFrame:
    edges = relations(spark, base)
    specs = edges.filter("relation_type is null and subject_id is not null and object_id is not null")
    specs = specs.select("subject_id", "object_id", F.lit(None).cast("string").alias("relation_id")).distinct()
    return graph.delete_edges(edges, specs).select("id")


@query("""
with i as (
  select 'source_chunk_references' k, unnest(source_chunk_id) id, 'c' t from ent union select 'source_chunk_references', unnest(source_chunk_id), 'c' from rel
  union select 'relation_endpoints', subject_id, 'e' from rel union select 'relation_endpoints', object_id, 'e' from rel
  union select 'community_references', unnest(entity_ids), 'e' from com union select 'community_references', unnest(relation_ids), 'r' from com
  union select 'entity_vector_missing', id, 'v' from ent union select 'entity_vector_orphan', "__id__", 'e' from vdb_entity
), known as (select 'c' t, id from chk union select 'e', id from ent union select 'r', id from rel union select 'v', "__id__" from vdb_entity)
select k as "check", i.id from i where i.id is not null and not exists (select 1 from known where known.t = i.t and known.id = i.id)
""")
def consistency_report(spark: SparkSession, base: str) -> DataFrame:
    return _index(spark, base).check_consistency()
