"""Queries: vectors, text ranking, retrieval engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import chunking, ranking, retrieval, vectors
from graphloom.plans.base import chunks, entities, query, relations, summaries
from graphloom.session import table

#: Queries of the batch searches are the rows whose id is divisible by this.
EVERY = 50

_KNN = """
q as (select vec_id query_id, embedding::double[] v from embeddings where vec_id % 50 = 0),
s as (select query_id, e.vec_id id, round(list_cosine_similarity(q.v, e.embedding::double[]), 6) score from embeddings e, q where e.embedding is not null and q.v is not null),
"""


def _embeddings(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    store = table(spark, base, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = store.filter(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), "vector")
    return asked, store


def _scored(spark: SparkSession, base: str, k: int | None = None) -> DataFrame:
    asked, store = _embeddings(spark, base)
    return vectors.score_against(asked, store, "query_id", "id", "vector", k=k)


@query(f"with {_KNN} r as (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) - 1 rank from s) select * from r where rank < 20")
def knn_batch_topk(spark: SparkSession, base: str) -> DataFrame:
    return vectors.top_k(_scored(spark, base, 20), 20)


@query(f"with {_KNN} r as (select query_id, id, score from s where score >= 0.2) select query_id, count(*) hits, max(score) best from r group by query_id")
def knn_threshold(spark: SparkSession, base: str) -> DataFrame:
    kept = _scored(spark, base).filter(F.col("score") >= retrieval.THRESHOLD)
    return kept.groupBy("query_id").agg(F.count("*").alias("hits"), F.max("score").alias("best"))


@query(
    "select vec_id, label, round(list_inner_product(embedding::double[], lead(embedding::double[]) over (partition by label order by vec_id)), 6) next_similarity from embeddings"
)
def consecutive_similarity(spark: SparkSession, base: str) -> DataFrame:
    return chunking.consecutive_similarity(table(spark, base, "embeddings"), "label", "vec_id", "embedding").drop("embedding")


_USABLE = """
u as (select vec_no, "__id__" id, list_transform("__vector__", lambda x: x::double) v from vdb_entity
      where "__vector__" is not null and len("__vector__") = 64),
v as (select * from u where not list_contains(list_transform(v, lambda x: coalesce(isfinite(x), false)), false) and len(list_filter(v, lambda x: x <> 0)) > 0),
"""


def _entity_vectors(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "vdb_entity").select("vec_no", F.col("__id__").alias("id"), F.col("__vector__").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter((F.size("vector") == 64) & finite & F.exists("vector", lambda x: x != 0))


@query(f"""
with {_USABLE}
s as (select a.vec_no query_id, b.id, round(list_cosine_similarity(a.v, b.v), 6) score from v a, v b where a.vec_no % 50 = 0 and a.vec_no <> b.vec_no),
r as (select *, row_number() over (partition by query_id order by score desc, id) - 1 rank from s)
select query_id, r.id, score, rank, entity_name from r join ent on ent.id = r.id where rank < 5
""")
def similar_entities(spark: SparkSession, base: str) -> DataFrame:
    store = _entity_vectors(spark, base)
    asked = store.filter(F.col("vec_no") % EVERY == 0)
    scored = vectors.score_against(asked, store, "vec_no", "id", "vector", k=6)  # itself and five
    own = asked.select(F.col("vec_no").alias("query_id"), "id")
    hits = vectors.top_k(scored.join(own, ["query_id", "id"], "left_anti"), 5)
    return hits.join(entities(spark, base).select("id", "entity_name"), "id")


_TERMS = """
list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: length(w) >= 2 and length(w) <= 40 and not regexp_matches(w, '^[0-9]+$'))
"""
_BM25 = f"""
dw as (select doc_id id, {_TERMS} ws from documents where text is not null),
c as (select id, term, count(*) tf, any_value(dl) dl from (select id, len(ws) dl, unnest(ws) term from dw) group by id, term),
q as (select distinct item_id query_id, term from (select item_id, unnest({_TERMS}) term from eval_item where text is not null)),
n as (select count(*) total from dw),
f as (select term, ln(1 + (total - count(*) + 0.5) / (count(*) + 0.5)) idf from c, n group by term, total),
b as (select query_id, id, round(sum(idf * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / 256.0)))), 6) score
      from q join c using (term) join f using (term) group by all),
br as (select *, row_number() over (partition by query_id order by score desc, id) - 1 rank from b)
"""
_SPARSE = f"""
st as (select rec_no id, term, count(*) val from (select rec_no, unnest({_TERMS.replace("text", "summary")}) term from kv_community_summary where summary is not null) group by all),
sq as (select item_id query_id, term, count(*) val from (select item_id, unnest({_TERMS}) term from eval_item where text is not null) group by all),
sd as (select query_id, id, sum(sq.val * st.val)::double score from sq join st using (term) group by all)
"""


def _bm25(spark: SparkSession, base: str, k: int) -> DataFrame:
    return ranking.bm25_scores(table(spark, base, "eval_item"), table(spark, base, "documents"), "item_id", "doc_id", k=k)


@query(f"with {_BM25} select query_id, id, score, rank from br where rank < 10")
def bm25_topk(spark: SparkSession, base: str) -> DataFrame:
    return ranking.ranked(_bm25(spark, base, 10), 10)


def _vectors_of(rows: DataFrame, key: str, text: str) -> DataFrame:
    return ranking.term_counts(rows, key, text).select(F.col(key).alias("id"), F.col("term").alias("idx"), F.col("tf").alias("val"))


@query(f"with {_SPARSE}, r as (select *, row_number() over (partition by query_id order by score desc, id) - 1 rank from sd) select * from r where rank < 5")
def sparse_dot(spark: SparkSession, base: str) -> DataFrame:
    asked = _vectors_of(table(spark, base, "eval_item"), "item_id", "text")
    stored = _vectors_of(table(spark, base, "kv_community_summary"), "rec_no", "summary")
    return ranking.ranked(ranking.sparse_dot(asked, stored, 5), 5)


_OVERLAP = f"""
ov as (select q.query_id, c.id, count(*) score from q join c using (term) group by all),
o as (select *, row_number() over (partition by query_id order by score desc, id) - 1 rank from ov)
"""


@query(
    f"with {_BM25}, {_OVERLAP}, x as (select query_id, id, rank from br where rank < 20 union all select query_id, id, rank from o where rank < 20),"
    " y as (select query_id, id, round(sum(1.0 / (60.0 + rank + 1)), 9) score from x group by all),"
    " z as (select *, row_number() over (partition by query_id order by score desc, id) - 1 rank from y) select * from z where rank < 10"
)
def rrf_hybrid(spark: SparkSession, base: str) -> DataFrame:
    """BM25 fused with plain word overlap, both from one reading of the documents."""
    matched = ranking.match_terms(table(spark, base, "eval_item"), table(spark, base, "documents"), "item_id", "doc_id")
    rankings = [ranking.ranked(scores, 20) for m in matched for scores in (m.bm25(20), m.overlap(20))]
    return ranking.ranked(ranking.rrf(rankings), 10)


_HYBRID = f"""
{_USABLE}
s as (select v.vec_no, v.id, v, ent.description from v join ent on ent.id = v.id),
d as (select a.vec_no query_id, b.id, round(list_cosine_similarity(a.v, b.v), 6) score from s a, s b where a.vec_no % 50 = 0),
dr as (select query_id, id, row_number() over (partition by query_id order by score desc, id) - 1 rank from d),
dw as (select id, {_TERMS.replace("text", "description")} ws from s where description is not null),
c as (select id, term, count(*) tf, any_value(dl) dl from (select id, len(ws) dl, unnest(ws) term from dw) group by id, term),
q as (select distinct vec_no query_id, term from (select vec_no, unnest({_TERMS.replace("text", "description")}) term from s where description is not null and vec_no % 50 = 0)),
n as (select count(*) total from dw),
f as (select term, ln(1 + (total - count(*) + 0.5) / (count(*) + 0.5)) idf from c, n group by term, total),
b as (select query_id, id, round(sum(idf * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / 256.0)))), 6) score
      from q join c using (term) join f using (term) group by all),
br as (select query_id, id, row_number() over (partition by query_id order by score desc, id) - 1 rank from b),
x as (select * from dr where rank < 20 union all select * from br where rank < 20),
y as (select query_id, id, round(sum(1.0 / (60.0 + rank + 1)), 9) score from x group by all)
"""


@query(
    f"with {_HYBRID}, z as (select *, row_number() over (partition by query_id order by score desc, id) - 1 rank from y) select * from z where rank < 10"
)
def hybrid_search(spark: SparkSession, base: str) -> DataFrame:
    """Entities by vector and by BM25 of their descriptions, fused; the queries are entities themselves."""
    store = _entity_vectors(spark, base).join(entities(spark, base).select("id", F.col("description").alias("text")), "id")
    asked = store.filter(F.col("vec_no") % EVERY == 0).withColumnRenamed("vec_no", "query_id")
    return retrieval.hybrid_search(asked, store, 20, 10)


@query(f"with {_KNN} r as (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) - 1 rank from s where id <> query_id) select * from r where rank < 3")
def icl_semantic(spark: SparkSession, base: str) -> DataFrame:
    return vectors.top_k(_scored(spark, base, 4).filter("id <> query_id"), 3)


@query(f"with {_KNN} h as (select distinct query_id from s where id <> query_id and score >= 0.35) select round(avg(case when h.query_id is null then 1.0 else 0.0 end), 6) miss_rate, count(*) asked from q left join h on h.query_id = q.query_id")
def icl_match_rate(spark: SparkSession, base: str) -> DataFrame:
    asked, _ = _embeddings(spark, base)
    return ranking.match_rate(asked.select("query_id"), _scored(spark, base).filter("id <> query_id"), 0.35)


@query(
    f"with {_KNN} r as (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) - 1 rank from s where score >= 0.2)"
    " select query_id, rank, id, score, doc_key from r join documents d on d.doc_id = r.id where rank < 20"
)
def naive_search(spark: SparkSession, base: str) -> DataFrame:
    """Documents by vector; the n-th embedding stands for the document of that number."""
    asked, store = _embeddings(spark, base)
    records = table(spark, base, "documents").select(F.col("doc_id").alias("id"), "doc_key")
    return retrieval.naive_search(asked, store, records).select("query_id", "rank", "id", "score", "doc_key")


_SEEDS = f"""
{_USABLE}
h as (select a.vec_no query_id, v.id, row_number() over (partition by a.vec_no order by round(list_cosine_similarity(a.v, v.v), 6) desc, v.id) - 1 seed_order
      from v a, v where a.vec_no % 50 = 0 and round(list_cosine_similarity(a.v, v.v), 6) >= 0.2),
sd as (select query_id, h.id, seed_order from h join ent on ent.id = h.id where seed_order < 20)
"""


def _seeds(spark: SparkSession, base: str) -> DataFrame:
    """(query_id, id, seed_order): the 20 entities most similar to each query vector."""
    store = _entity_vectors(spark, base)
    asked = store.filter(F.col("vec_no") % EVERY == 0).select(F.col("vec_no").alias("query_id"), "vector")
    hits = retrieval.similar(asked, store)
    return hits.select("query_id", "id", F.col("rank").alias("seed_order")).join(entities(spark, base).select("id"), "id", "left_semi")


_LOCAL_RELATIONS = """
ld as (select distinct sd.query_id, rel.id from sd join rel on rel.subject_id = sd.id
       union select sd.query_id, rel.id from sd join rel on rel.object_id = sd.id),
lr as (select query_id, rel.*, row_number() over (partition by query_id order by relation_strength desc nulls last, rel.id) - 1 rank from ld join rel on rel.id = ld.id)
"""


@query(f"with {_SEEDS}, {_LOCAL_RELATIONS} select query_id, rank, id, relation_strength, description from lr")
def local_relations(spark: SparkSession, base: str) -> DataFrame:
    found = retrieval.seed_relations(_seeds(spark, base), relations(spark, base))
    return found.select("query_id", "rank", "id", "relation_strength", "description")


_LOCAL_CHUNKS = """
b as (select distinct id, c from (select id, unnest(source_chunk_id) c from ent) where c is not null),
l as (select query_id, b.c chunk_id, sd.id, sd.seed_order from sd join b on b.id = sd.id),
w as (select query_id, chunk_id, id, seed_order from l qualify row_number() over (partition by query_id, chunk_id order by seed_order, id) = 1),
e as (select subject_id id, id edge_id, object_id other from rel union select object_id, id, subject_id from rel),
k as (select w.query_id, w.chunk_id, count(distinct e.edge_id) n from w join e on e.id = w.id join b on b.id = e.other and b.c = w.chunk_id group by all),
lc as (select w.query_id, w.chunk_id, w.seed_order, coalesce(k.n, 0) cooccurrence,
         row_number() over (partition by w.query_id order by w.seed_order, coalesce(k.n, 0) desc, w.chunk_id) - 1 rank
       from w left join k on k.chunk_id = w.chunk_id and k.query_id = w.query_id)
"""


@query(f"with {_SEEDS}, {_LOCAL_CHUNKS} select * from lc")
def local_chunks(spark: SparkSession, base: str) -> DataFrame:
    return retrieval.seed_chunks(_seeds(spark, base), entities(spark, base), relations(spark, base))


_LOCAL_SUMMARIES = """
p as (select distinct query_id, 'com-' || md5(chr(0) || c.level || ':' || c.cluster_id) id
  from (select query_id, unnest(clusters) c from sd join ent on ent.id = sd.id) where c.level <= 2),
ls as (select query_id, summ.id, summary from p join summ on summ.id = p.id)
"""


@query(f"with {_SEEDS}, {_LOCAL_SUMMARIES} select query_id, id, summary from ls")
def local_summaries(spark: SparkSession, base: str) -> DataFrame:
    return retrieval.seed_summaries(_seeds(spark, base), entities(spark, base), summaries(spark, base))


def _local(spark: SparkSession, base: str) -> retrieval.LocalResult:
    return retrieval.local_search(
        _seeds(spark, base), entities(spark, base), relations(spark, base), chunks(spark, base), summaries(spark, base)
    )


@query(f"""
with {_SEEDS}, {_LOCAL_CHUNKS}
select distinct query_id, document from (
  select query_id, unnest(documents_id) document from sd join ent on ent.id = sd.id
  union all select query_id, doc_id from lc join chk on chk.id = lc.chunk_id
) where document is not null and document <> ''
""")
def local_documents(spark: SparkSession, base: str) -> DataFrame:
    return _local(spark, base).documents


_RATING = "least(10.0::double, len(regexp_extract_all(lower(summary), '(the|из|во)')) * 0.3::double)"


@query(f"with r as (select id, round({_RATING}, 6) rating from summ where summary is not null) select id, rating, floor(rating)::int whole_rating from r where floor(rating) > 0")
def global_insights(spark: SparkSession, base: str) -> DataFrame:
    """Reports rated by a stand-in for the model: how often some words occur."""
    hits = F.size(F.regexp_extract_all(F.lower("summary"), F.lit("(the|из|во)"), F.lit(0)))
    rated = summaries(spark, base).filter("summary is not null").select("id", F.round(F.least(F.lit(10.0), hits * 0.3), 6).alias("rating"))
    return retrieval.global_insights(rated)


_PIPE = " || ' | ' || ".join


@query(f"""
with {_SEEDS}, {_LOCAL_RELATIONS}, {_LOCAL_CHUNKS}, {_LOCAL_SUMMARIES}, g as (select id, summary, round({_RATING}, 6) rating from summ where summary is not null)
select 'local' engine, query_id, 'entity' kind, seed_order rank, sd.id, {_PIPE(["coalesce(entity_name, '')", "coalesce(description, '')"])} text from sd join ent on ent.id = sd.id
union all select 'local', query_id, 'relation', rank, id,
  {_PIPE([f"coalesce({c}, '')" for c in ("subject_name", "relation_type", "object_name", "description")])} from lr
union all select 'local', query_id, 'chunk', rank, chk.id, content from lc join chk on chk.id = lc.chunk_id
union all select 'local', query_id, 'summary', row_number() over (partition by query_id order by id) - 1, id, summary from ls
union all select 'global', null, 'report', row_number() over (order by floor(rating)::int desc, id) - 1, id, summary from g where floor(rating) > 0
""")
def mix_context(spark: SparkSession, base: str) -> DataFrame:
    """All of the local engine's context per query, and the whole rated reports, which are the same for every query here."""
    insights = global_insights(spark, base).withColumns({"query_id": F.lit(0), "score": F.col("whole_rating")})
    ranked = ranking.ranked(insights).select("id", "rank").join(summaries(spark, base).select("id", F.col("summary").alias("text")), "id")
    return retrieval.mixed_context(
        {"local": retrieval.local_context(_local(spark, base)), "global": ranked.select(F.lit("report").alias("kind"), "rank", "id", "text")}
    )


@query(
    """
with need as (
  select distinct c.id, n.id needed from (select id, doc_id, chunk_order_idx o from chk where doc_id is not null and chunk_order_idx is not null) c
  join (select id, doc_id, chunk_order_idx o from chk where doc_id is not null) n on n.doc_id = c.doc_id and n.o = c.o - 1 and n.id <> c.id
), r(id, depth) as (
  select id, 0 from (select distinct id from chk where doc_id is not null and chunk_order_idx is not null) x where id not in (select id from need)
  union all select need.id, r.depth + 1 from need join r on need.needed = r.id
) select id, max(depth)::int depth from r group by id
""",
    recursive=True,
)
def subquery_depth(spark: SparkSession, base: str) -> DataFrame:
    """Depth of each item of a plan below those it depends on; here each chunk waits for the one before it in its document."""
    rows = chunks(spark, base).select("id", "doc_id", F.col("chunk_order_idx").alias("o")).filter("doc_id is not null and o is not null")
    before = rows.select(F.col("id").alias("needed"), "doc_id", (F.col("o") + 1).alias("o"))
    needs = rows.join(before, ["doc_id", "o"], "left").select(F.col("doc_id").alias("plan"), "id", "needed")
    return retrieval.plan_order(needs).select("id", "depth")
