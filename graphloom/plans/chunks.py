"""Queries: chunking, text normalisation, lookups, extraction."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import prompts, scalar
from graphloom.operators import chunking, extraction, index, lookup, merging
from graphloom.plans.base import chunks, entities, query, relations
from graphloom.session import table

_SENTENCES = (
    "list_filter(string_split(regexp_replace(regexp_replace({0}, '\\n+', chr(31), 'g'), '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31)),"
    " lambda s: trim(s) <> '')"
)


def _packed(size: int, overlap: int) -> str:
    seed = f"right(trim(a.cur), {overlap}) || ' ' || " if overlap else ""
    return f"""
with s as (select doc_id, {_SENTENCES.format("text")} ss from documents where text is not null),
f as (
  select doc_id, list_reduce(
    list_transform(ss, lambda x: {{'cur': x, 'out': []::varchar[]}}),
    lambda a, x: case when length(a.cur) + length(x.cur) <= {size} then {{'cur': a.cur || x.cur || ' ', 'out': a.out}}
      else {{'cur': (case when trim(a.cur) = '' then '' else {seed}'' end) || x.cur || ' ',
             'out': case when trim(a.cur) = '' then a.out else list_append(a.out, trim(a.cur)) end}} end,
    {{'cur': '', 'out': []::varchar[]}}) r
  from s where len(ss) > 0
), p as (select doc_id, case when trim(r.cur) = '' then r.out else list_append(r.out, trim(r.cur)) end parts from f)
select doc_id, i::int - 1 chunk_order_idx, 'chunk-' || md5(chr(0) || parts[i]) id, length(parts[i]) n_chars
from (select doc_id, parts, unnest(range(1, len(parts) + 1)) i from p)
"""


@query("select doc_id, 'chunk-' || md5(chr(0) || text) chunk_id, md5(chr(0) || text) doc_hash from documents where text is not null")
def chunk_ids(spark: SparkSession, base: str) -> DataFrame:
    text = F.col("text")
    return table(spark, base, "documents").filter(text.isNotNull()).select(
        "doc_id", scalar.chunk_id(text).alias("chunk_id"), scalar.hash_id("", text).alias("doc_hash")
    )


@query(f"select doc_id, len({_SENTENCES.format('text')}) sentences from documents where text is not null")
def sentence_count(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").filter("text is not null").select("doc_id", F.size(scalar.sentences(F.col("text"))).alias("sentences"))


def _sized(cut: DataFrame) -> DataFrame:
    return cut.select("doc_id", "chunk_order_idx", "id", F.length("content").alias("n_chars"))


@query(_packed(400, 0))
def simple_chunks(spark: SparkSession, base: str) -> DataFrame:
    return _sized(chunking.simple_chunks(table(spark, base, "documents"), 400))


@query(_packed(400, 60))
def simple_chunks_overlap(spark: SparkSession, base: str) -> DataFrame:
    return _sized(chunking.simple_chunks(table(spark, base, "documents"), 400, 60))


@query(
    "select id, min(rec_no) rec_no from kv_chunks where id is not null"
    " and id not in (select 'chunk-' || doc_key from documents where doc_key is not null) group by id"
)
def chunk_dedup(spark: SparkSession, base: str) -> DataFrame:
    stored = table(spark, base, "documents").filter("doc_key is not null").select(F.concat(F.lit("chunk-"), "doc_key").alias("id"))
    return chunking.new_chunks(table(spark, base, "kv_chunks"), stored, ["rec_no"]).select("id", "rec_no")


@query(
    "select doc_id, 'doc_' || (row_number() over (order by doc_id, text) - 1) chunk_doc, 0 chunk_order_idx,"
    " 'chunk-' || md5(chr(0) || text) id from documents"
)
def default_doc_chunks(spark: SparkSession, base: str) -> DataFrame:
    return chunking.whole_document_chunks(table(spark, base, "documents")).drop("content")


@query(
    "select doc_id, coalesce(array_to_string(list_slice(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), 1, 50), ' '), '')"
    " head from documents"
)
def token_truncation(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").select("doc_id", chunking.truncate_tokens(F.col("text"), 50).alias("head"))


@query(
    "select doc_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'),"
    " lambda w: length(w) >= 2 and not regexp_matches(w, '^[0-9]+$')), ' ') tokens from documents where text is not null"
)
def normal_tokens(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").filter("text is not null").select(
        "doc_id", F.array_join(extraction.normal_tokens(F.col("text")), " ").alias("tokens")
    )


@query(
    "select rec_no pos, r.id, entity_name, entity_type from (select rec_no, lower(trim(subject_id)) id from kg_relation"
    " where subject_id is not null) r left join (select id, entity_name, entity_type from ent) e on e.id = r.id"
)
def kv_get_by_ids(spark: SparkSession, base: str) -> DataFrame:
    asked = table(spark, base, "kg_relation").filter("subject_id is not null")
    asked = asked.select(F.col("rec_no").alias("pos"), scalar.tidy(F.col("subject_id")).alias("id"))
    return lookup.get_by_ids(asked, entities(spark, base), ["entity_name", "entity_type"])


@query("select id, num_tokens, chunk_order_idx from chk")
def kv_project(spark: SparkSession, base: str) -> DataFrame:
    return chunks(spark, base).select("id", "num_tokens", "chunk_order_idx")


@query("select distinct subject_id id from rel where subject_id is not null and subject_id not in (select id from ent)")
def kv_filter_missing(spark: SparkSession, base: str) -> DataFrame:
    asked = relations(spark, base).filter("subject_id is not null").select(F.col("subject_id").alias("id")).distinct()
    return lookup.filter_missing(asked, entities(spark, base))


@query("""
with specs as (select min(rec_no) pos, subject_id, object_id, case when count(*) > 1 then null else min(id) end relation_id
               from rel where subject_id is not null and object_id is not null group by all)
select pos, s.subject_id, s.object_id, s.relation_id, rel.id edge_id from specs s
join rel on rel.subject_id = s.subject_id and rel.object_id = s.object_id where s.relation_id is null or s.relation_id = rel.id
""")
def edges_wildcard_lookup(spark: SparkSession, base: str) -> DataFrame:
    edges = relations(spark, base).filter("subject_id is not null and object_id is not null")
    specs = edges.groupBy("subject_id", "object_id").agg(
        F.min("rec_no").alias("pos"), F.when(F.count("*") > 1, F.lit(None)).otherwise(F.min("id")).alias("relation_id")
    )
    return lookup.edges_by_spec(specs, edges)


@query('select vec_no pos, "__id__" id, entity_name, description from vdb_entity v left join ent on ent.id = v."__id__"')
def payload_alignment(spark: SparkSession, base: str) -> DataFrame:
    asked = table(spark, base, "vdb_entity").select(F.col("vec_no").alias("pos"), F.col("__id__").alias("id"))
    return lookup.get_by_ids(asked, entities(spark, base), ["entity_name", "description"])


@query(f"""
with s as (select id chunk_id, {_SENTENCES.format("content")} ss from chk where content is not null),
t as (select chunk_id, i - 1 sentence_no, ss[i] s from (select chunk_id, ss, unnest(range(1, len(ss) + 1)) i from s)),
w as (select chunk_id, sentence_no, list_filter(regexp_extract_all(s, '[\\p{{L}}\\p{{N}}]+'), lambda x: regexp_matches(x, '^\\p{{Lu}}\\p{{L}}{{3,}}$')) ws from t)
select chunk_id, sentence_no::int sentence_no, i::int - 1 word_no, ws[i] entity_name from (select *, unnest(range(1, len(ws) + 1)) i from w)
""")
def entity_mentions(spark: SparkSession, base: str) -> DataFrame:
    return extraction.entity_mentions(chunks(spark, base)).drop("sentence")


@query(
    "select id, array_to_string(list_filter(list_transform(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)),"
    " lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), chr(10)) lines from chk where content is not null"
)
def text_lines(spark: SparkSession, base: str) -> DataFrame:
    lines = F.transform(F.split("content", r"\r?\n"), scalar.strip)
    return chunks(spark, base).filter("content is not null").select(
        "id", F.array_join(F.filter(lines, lambda x: x != ""), "\n").alias("lines")
    )


@query("""
with l as (
  select id, i, regexp_replace(ls[i], '^\\s+|\\s+$', '', 'g') x
  from (select id, ls, unnest(range(1, len(ls) + 1)) i from (select id, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) ls
        from chk where content is not null))
), d as (select id, x, min(i) i from l where x <> '' group by all)
select id, count(*) lines, string_agg(x, '|' order by i) entity_lines from d group by id
""")
def entity_lines(spark: SparkSession, base: str) -> DataFrame:
    found = chunks(spark, base).select("id", extraction.lines_to_entities(F.col("content")).alias("x")).filter("size(x) > 0")
    return found.select("id", F.size("x").cast("long").alias("lines"), F.array_join("x", "|").alias("entity_lines"))


@query("""
with e as (select distinct chunk_id, entity_name, id, rec_no from (select unnest(source_chunk_id) chunk_id, entity_name, id, rec_no from kg_entity)
           where chunk_id is not null and id is not null),
l as (select chunk_id, entity_name, id from e qualify row_number() over (partition by chunk_id, entity_name order by rec_no desc) = 1),
r as (select distinct rec_no, unnest(source_chunk_id) chunk_id, subject_name, object_name from kg_relation)
select r.rec_no, r.chunk_id, s.id subject_id, o.id object_id from r
join l s on s.chunk_id = r.chunk_id and s.entity_name = r.subject_name join l o on o.chunk_id = r.chunk_id and o.entity_name = r.object_name
""")
def relation_resolution(spark: SparkSession, base: str) -> DataFrame:
    found = table(spark, base, "kg_entity").filter("id is not null").select(
        F.explode(F.array_distinct("source_chunk_id")).alias("chunk_id"), "entity_name", F.col("id").alias("entity_id"), F.col("rec_no").alias("pos")
    )
    named = table(spark, base, "kg_relation").select(
        "rec_no", F.explode(F.array_distinct("source_chunk_id")).alias("chunk_id"),
        F.col("subject_name").alias("source_entity"), F.col("object_name").alias("target_entity"),
    )
    return extraction.resolve_relations(named, found).select("rec_no", "chunk_id", "subject_id", "object_id")


@query(f"""
with s as (select id, {_SENTENCES.format("summary")} ss from summ where summary is not null),
t as (select id, i, ss[i] s from (select id, ss, unnest(range(1, len(ss) + 1)) i from s)),
w as (select id || '/' || (i - 1) sentence, list_filter(regexp_extract_all(s, '[\\p{{L}}\\p{{N}}]+'), lambda x: regexp_matches(x, '^\\p{{Lu}}\\p{{L}}{{3,}}$')) ws from t),
m as (select sentence, i, ws[i] n from (select *, unnest(range(1, len(ws) + 1)) i from w))
select a.sentence, a.i::int - 1 pos_a, b.i::int - 1 pos_b, a.n name_a, b.n name_b from m a join m b on a.sentence = b.sentence and a.i <> b.i
""")
def ordered_pairs(spark: SparkSession, base: str) -> DataFrame:
    """Ordered pairs of the names in one sentence of a report; a sentence bounds the pairs."""
    from graphloom.plans.base import summaries

    parts = extraction.entity_mentions(summaries(spark, base).select("id", F.col("summary").alias("content")))
    named = parts.withColumn("sentence", F.concat_ws("/", "chunk_id", "sentence_no"))
    return extraction.ordered_pairs(named, "sentence", "entity_name", "word_no")


_WORD = "[\\p{L}\\p{N}_]"
_OUTER = "[^\\p{L}\\p{N}_]"
# DuckDB's \w and \b know ASCII only: spelled out, a boundary before a word or after it.
_NEGATION = "|".join(
    re.sub(r"\\b(?=[(а-я])", lambda _: f"(?:^|{_OUTER})", p).replace("\\w", _WORD).replace("\\b", f"(?:$|{_OUTER})")
    for p in extraction.NO_RELATION
)


@query(
    "with b as (select rec_no, regexp_replace(regexp_replace(description, '^\\s+|\\s+$', '', 'g'), '^[\\-•]\\s*', '') d from kg_relation"
    f" where description is not null) select rec_no, d description from b where d <> '' and not regexp_matches(lower(d), '{_NEGATION}')"
)
def negation_filter(spark: SparkSession, base: str) -> DataFrame:
    kept = table(spark, base, "kg_relation").filter(extraction.states_relation(F.col("description")))
    return kept.select("rec_no", extraction.without_bullet(F.col("description")).alias("description"))


@query(
    "select rec_no, coalesce(nullif(trim(string_split(entity_type, ' (')[1]), ''), 'UNKNOWN') entity_type from kg_entity"
)
def type_normalise(spark: SparkSession, base: str) -> DataFrame:
    return extraction.typed(table(spark, base, "kg_entity").select("rec_no", "entity_type"), "entity_type")


@query("""
with recursive c as (select doc_id, rec_no, coalesce(strlen(content), 0) n, row_number() over (partition by doc_id order by rec_no) i
                     from kv_chunks where doc_id is not null),
r as (
  select doc_id, rec_no, i, 0 batch, n used from c where i = 1
  union all
  select c.doc_id, c.rec_no, c.i, case when r.used = 0 or r.used + c.n <= 2000 then r.batch else r.batch + 1 end,
    case when r.used = 0 or r.used + c.n <= 2000 then r.used + c.n else c.n end
  from r join c on c.doc_id = r.doc_id and c.i = r.i + 1
) select doc_id, rec_no, batch from r
""")
def batch_by_size(spark: SparkSession, base: str) -> DataFrame:
    return index.size_batches(table(spark, base, "kv_chunks"), "doc_id", "rec_no", "content", 2000)


@query(f"""
with s as (select rec_no, list_filter(list_transform({_SENTENCES.format("summary")}, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') ss
           from kv_community_summary where summary is not null),
t as (select rec_no, i, ss[i] s from (select rec_no, ss, unnest(range(1, len(ss) + 1)) i from s)),
u as (select rec_no, i, s from t qualify row_number() over (partition by rec_no, lower(s) order by i) = 1)
select rec_no, count(*) fragments, string_agg(s, ' ' order by i) description from u group by rec_no
""")
def unique_fragments(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "kv_community_summary").filter("summary is not null")
    rows = rows.select("rec_no", merging.unique_fragments(merging.fragments(F.col("summary"))).alias("f")).filter("size(f) > 0")
    return rows.select("rec_no", F.size("f").cast("long").alias("fragments"), F.array_join("f", " ").alias("description"))


@query(
    f"select rec_no from kg_entity where len(list_filter(list_transform({_SENTENCES.format('description')},"
    " lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')) > 7"
)
def description_length_filter(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "kg_entity").filter(merging.fragment_count(F.col("description")) > 7).select("rec_no")


@query(
    "select item_id, 'system: Answer from the chunks.' || chr(10) || 'user: an earlier question' || chr(10) || 'assistant: its answer' || chr(10)"
    " || 'user: Query: who did it?' || chr(10) || 'Chunks:' || chr(10) || coalesce(text, '') conversation from eval_item"
)
def render_prompts(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "eval_item").withColumnRenamed("text", "context")
    talk = prompts.with_few_shots(prompts.render(rows, "naive_search", query="who did it?"), [("an earlier question", "its answer")])
    return talk.select("item_id", prompts.conversation_text(F.col("messages")).alias("conversation"))
