"""DuckDB statements for the queries here that SQL can express on whole tables."""

from __future__ import annotations

_NEIGHBOURS = """
with u as (
  select vec_no, v from (select vec_no, list_transform("__vector__", lambda x: x::double) v from vdb_entity
                         where "__vector__" is not null and len("__vector__") = 64)
  where not list_contains(list_transform(v, lambda x: coalesce(isfinite(x), false)), false)
    and len(list_filter(v, lambda x: x <> 0)) > 0
), s as (
  select a.vec_no id, b.vec_no other, round(list_cosine_similarity(a.v, b.v), 6) c from u a join u b on a.vec_no <> b.vec_no
), k as (select id, other, c from s qualify row_number() over (partition by id order by c desc, other) <= 5)
"""

_WORDS = """
with t as (
  select 'kv_community_summary' src_table, rec_no, summary txt from kv_community_summary
  union all select 'kg_entity', rec_no, description from kg_entity
), w as (
  select src_table, rec_no, regexp_extract_all(lower(coalesce(txt, '')), '[\\p{L}\\p{N}]+') ws from t
), g as (
  select src_table, rec_no, i, array_to_string(list_slice(ws, i, i + 5), ' ') gram
  from (select src_table, rec_no, ws, unnest(range(1, len(ws) - 4)) i from w where len(ws) > 5)
), again as (
  select src_table, rec_no, i from g qualify row_number() over (partition by src_table, rec_no, gram order by i) > 1
), covered as (
  select src_table, rec_no, count(distinct p) n
  from (select src_table, rec_no, unnest(range(i, i + 6)) p from again) group by 1, 2
), share as (
  select w.src_table, w.rec_no, coalesce(c.n, 0) / greatest(len(ws), 1)::double share
  from w left join covered c on c.src_table = w.src_table and c.rec_no = w.rec_no
)
"""

# Descriptions that say nothing, written down here by themselves, so that a gap in the engine's list would show.
_FILLERS = (
    "'none', 'null', 'nil', 'nan', 'na', 'n/a', 'n.a', 'unknown', 'missing', 'empty', 'todo', 'tbd', 'tba', 'fixme', 'no data',"
    " 'no description', 'no description available', 'description missing', 'not available', 'to be added', 'to be determined', 'to be filled in',"
    " 'нет', 'нет данных', 'нет описания', 'без описания', 'неизвестно', 'не указано', 'уточняется', 'отсутствует', 'описание отсутствует'"
)
_BARE = "regexp_replace(regexp_replace(lower({0}), '^[\\s\\p{{P}}]+|[\\s\\p{{P}}]+$', '', 'g'), '\\s+', ' ', 'g')"
_KEYS = "len(list_distinct(list_filter(list_transform({0}, lambda k: lower(trim(k))), lambda k: k is not null and k <> '')))"

_SURVIVORS = f"""
with trusted as (select lower(trim(extractor)) x, max(trust) trust from extractor_trust group by 1),
names as (select distinct id, {_BARE.format("entity_name")} n from kg_entity where entity_name is not null),
r as (
  select e.id, e.rec_no, e.ingested_at t, coalesce(tr.trust, 0) trust,
    description is not null and regexp_matches(description, '[\\p{{L}}\\p{{N}}]')
      and {_BARE.format("description")} not in ({_FILLERS})
      and not exists (select 1 from names where names.id = e.id and names.n = {_BARE.format("description")}) says,
    coalesce({_KEYS.format("source_chunk_id")}, 0) chunks, coalesce({_KEYS.format("documents_id")}, 0) docs
  from kg_entity e left join trusted tr on tr.x = lower(trim(e.extractor)) where e.id is not null
), n as (select id from r group by id having count(*) > 1),
d as (select id, rec_no from r where says qualify row_number() over (partition by id order by trust desc, t desc, rec_no) = 1),
c as (select id, rec_no from r where chunks > 0 qualify row_number() over (partition by id order by chunks desc, t desc, rec_no) = 1),
o as (select id, rec_no from r where docs > 0 qualify row_number() over (partition by id order by t desc, rec_no) = 1)
select n.id, coalesce(d.rec_no, 0) description_rec, coalesce(c.rec_no, 0) chunks_rec, coalesce(o.rec_no, 0) documents_rec
from n left join d using (id) left join c using (id) left join o using (id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _NEIGHBOURS
        + "select distinct least(id, other) vec_a, greatest(id, other) vec_b from k where c >= 0.8",
        "p1_neighbours": _NEIGHBOURS + "select id, other neighbour, c cosine from k",
        "p4_found": _WORDS + "select src_table, rec_no from share where share >= 0.3",
        "p4_shares": _WORDS + "select src_table, rec_no, round(share, 6) share from share",
        "p5_found": _SURVIVORS,
        "p5_records": f"""
with s as ({_SURVIVORS}) select s.*, d.description, c.source_chunk_id, o.documents_id from s
left join kg_entity d on d.rec_no = s.description_rec left join kg_entity c on c.rec_no = s.chunks_rec left join kg_entity o on o.rec_no = s.documents_rec
""",
        "p6_found": "select distinct rec_no from kv_chunks where length(content) > 1400"
        " or len(regexp_extract_all(content, '\\S+')) > 220",
    }
