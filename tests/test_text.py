import json
import warnings

import pytest
from pyspark.sql import functions as F

from graphloom.functions import hooks, prompts, scalar
from graphloom.operators import chunking, extraction, ranking, retrieval, vectors
from graphloom.sources import files
from graphloom.streaming import ingest


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def pack(parts, size, overlap=0):
    out, cur = [], ""
    for s in parts:
        if len(cur) + len(s) <= size:
            cur += s + " "
        else:
            seed = ""
            if cur.strip(" "):
                out.append(cur.strip(" "))
                seed = cur.strip(" ")[-overlap:] + " " if overlap else ""
            cur = seed + s + " "
    return out + ([cur.strip(" ")] if cur.strip(" ") else [])


@pytest.mark.parametrize("overlap", [0, 5])
def test_packing_against_a_plain_loop(spark, overlap):
    text = "One two. Three four five! A sentence that is far longer than the limit allows it to be. Six?\nSeven. "
    rows = chunking.simple_chunks(docs(spark, text, "", None, "   "), 30, overlap).orderBy("chunk_order_idx").collect()
    parts = ["One two.", "Three four five!", "A sentence that is far longer than the limit allows it to be.", "Six?", "Seven."]
    assert [r["content"] for r in rows] == pack(parts, 30, overlap)
    assert {r["doc_id"] for r in rows} == {0}


def test_whole_documents_are_numbered_in_order(spark):
    rows = chunking.whole_document_chunks(docs(spark, *[f"t{i}" for i in range(50)])).collect()
    assert {r["doc_id"]: r["chunk_doc"] for r in rows} == {i: f"doc_{i}" for i in range(50)}


def test_semantic_chunks_split_at_the_weakest_link(spark):
    text = "cats purr. cats sleep. stocks fall. stocks rise."
    rows = chunking.semantic_chunks(docs(spark, text), hooks.hashing_embedder(), 4).orderBy("chunk_order_idx").collect()
    assert [r["content"] for r in rows] == ["cats purr. cats sleep.", "stocks fall. stocks rise."]


def test_ids_match_plain_md5(spark):
    import hashlib

    row = spark.range(1).select(scalar.chunk_id(F.lit("текст")).alias("c"), scalar.relation_id(F.lit("a"), F.lit("b"), F.lit("T")).alias("r")).first()
    assert row["c"] == "chunk-" + hashlib.md5("\0текст".encode()).hexdigest()
    assert row["r"] == "rel-" + hashlib.md5(b"\0a -> bT").hexdigest()


def test_types_and_negations(spark):
    rows = spark.createDataFrame([("PERSON (see x)",), ("",), (None,), (" CITY ",)], "t string").select(scalar.normal_type(F.col("t")).alias("t")).collect()
    assert [r["t"] for r in rows] == ["PERSON", "UNKNOWN", "UNKNOWN", "CITY"]
    said = [
        ("- Иван руководит банком", True), ("НЕТ ИНФОРМАЦИИ о банке", False), ("•  Отсутствует связь между ними", False), ("", False), (None, False),
        ("Связь не установлена", False), ("Текст не содержит сведений", False), (" - ", False), ("Они нетипично связаны", True),
        ("В тексте не указано, есть ли между ними связь.", False),
    ]
    df = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(said)], "i int, d string")
    assert [r["k"] for r in df.orderBy("i").select(extraction.states_relation(F.col("d")).alias("k")).collect()] == [k for _, k in said]


def test_relation_names_resolve_within_their_chunk(spark):
    e = spark.createDataFrame([("c1", "A", "e1", 1), ("c1", "A", "e9", 2), ("c1", "B", "e2", 3), ("c2", "B", "e3", 4)], "chunk_id string, entity_name string, entity_id string, pos int")
    r = spark.createDataFrame([("c1", "A", "B"), ("c2", "A", "B")], "chunk_id string, source_entity string, target_entity string")
    assert [(x["subject_id"], x["object_id"]) for x in extraction.resolve_relations(r, e).collect()] == [("e9", "e2")]


def test_knn_threshold_ties_and_bad_vectors(spark):
    store = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("z", [0.0, 0.0]), ("n", None), ("o", [0.0, 1.0])], "id string, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<double>")
    top = vectors.top_k(vectors.score_against(asked, store, "query_id", "id", "vector"), 5, 0.2).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in top] == [("a", 1.0), ("b", 1.0)]
    assert "WindowGroupLimit" in vectors.top_k(vectors.score_against(asked, store, "query_id", "id", "vector"), 5)._jdf.queryExecution().toString()


def test_fusion_and_sparse(spark):
    a = spark.createDataFrame([(1, "x", 0), (1, "y", 1)], "query_id int, id string, rank int")
    b = spark.createDataFrame([(1, "y", 0)], "query_id int, id string, rank int")
    got = {r["id"]: r["score"] for r in ranking.rrf([a, b]).collect()}
    assert got == {"x": round(1 / 61, 9), "y": round(1 / 62 + 1 / 61, 9)}
    q = spark.createDataFrame([("q", 1, 0.7), ("q", 9, 1.0)], "id string, idx int, val double")
    d = spark.createDataFrame([("d", 1, 2.0), ("e", 3, 1.0)], "id string, idx int, val double")
    assert [(r["id"], r["score"]) for r in ranking.sparse_dot(q, d).collect()] == [("d", 1.4)]


def test_global_insights_keep_whole_ratings_only(spark):
    rows = spark.createDataFrame([("low", 1.0), ("none", 0.9), ("zero", 0.0), ("high", 5.2)], "id string, rating double")
    assert [r["id"] for r in retrieval.global_insights(rows).collect()] == ["high", "low"]


def test_sub_queries_in_order():
    assert retrieval.subquery_order([("c", ["a", "b"]), ("b", ["a"]), ("a", [])]) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="circle"):
        retrieval.subquery_order([("a", ["b"]), ("b", ["a"])])
    with pytest.raises(KeyError):
        retrieval.subquery_order([("a", ["nope"])])
    got = retrieval.run_plan([("a", "x", []), ("b", "y", ["a"])], lambda q, known: q + "".join(known.values()))
    assert got == {"a": "x", "b": "yx"}


def test_rerank_cut(spark):
    rows = spark.createDataFrame([("a", 0.11), ("b", 0.95)], "id string, score double")
    assert [r["id"] for r in ranking.rerank(rows, keep=1).collect()] == ["b"]
    assert ranking.rerank(rows).count() == 2


def test_hooks_cache_and_errors(spark):
    rows = docs(spark, "one two", "bad", None, "one two")

    def model(texts):
        if any(t == "bad" for t in texts):
            raise RuntimeError("no")
        return [float(len(t)) for t in texts]

    out = hooks.run_hook(rows, "text", "n", "double", model, continue_on_error=True).collect()
    assert [r["n"] for r in out] == [7.0, None, None, 7.0]
    with pytest.raises(Exception, match="no"):
        hooks.run_hook(rows, "text", "n", "double", model).collect()
    store = spark.createDataFrame([], "key string, answer double")
    good = rows.filter("text <> 'bad'")
    answered, fresh = hooks.cached(good, "text", "n", "double", model, store)
    assert fresh.count() == 1 and [r["n"] for r in answered.collect()] == [7.0, 7.0]
    assert hooks.overlap_scorer("two cats")(["cats", "dogs"]) == [0.5, 0.0]


def test_prompts(spark):
    rows = docs(spark, "hello").withColumnRenamed("text", "context")
    talk = prompts.with_few_shots(prompts.render(rows, "naive_search", query="why?"), [("q", "a")])
    text = talk.select(prompts.conversation_text(F.col("messages")).alias("t")).first()["t"]
    assert text == "system: Answer from the chunks.\nuser: q\nassistant: a\nuser: Query: why?\nChunks:\nhello"
    with pytest.raises(KeyError):
        prompts.render(rows, "naive_search")


def test_sources(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("first\nfile", encoding="utf-8")
    (tmp_path / "in" / "deep" / "b.txt").write_text("второй", encoding="utf-8")
    (tmp_path / "in" / "c.md").write_text("no")
    texts = files.read_texts(spark, str(tmp_path / "in"), [".txt"])
    assert sorted(r["text"] for r in texts.collect()) == ["first\nfile", "второй"]
    kv = tmp_path / "kv.json"
    kv.write_text(json.dumps({"c1": {"content": "x", "chunk_order_idx": 0}, "c2": {"content": "y", "chunk_order_idx": 1}}))
    rows = files.read_json_store(spark, str(kv), "struct<content:string,chunk_order_idx:int>")
    assert sorted((r["id"], r["content"]) for r in rows.collect()) == [("c1", "x"), ("c2", "y")]
    ex = tmp_path / "ex.json"
    ex.write_text(json.dumps({"examples": [{"id": "1", "input_text": "t", "output": {"entities": []}, "metadata": {"language": "english"}, "quality_rating": 4}, {"id": "2", "input_text": "u", "output": {}, "metadata": {"language": "russian"}}]}))
    assert [r["id"] for r in files.read_examples(spark, str(ex), "english").collect()] == ["1"]


GML = """graph [
  directed 1
  multigraph 1
  node [
    id 0
    label "ent-a"
    entity_name "&#1048;&#1074;&#1072;&#1085;"
    entity_type "PERSON"
    source_chunk_id "_networkx_list_start"
    source_chunk_id "c1"
    documents_id "[]"
  ]
  node [
    id 1
    label "ent-b"
    entity_name "B"
  ]
  edge [
    source 0
    target 1
    key "rel-1"
    relation_type "KNOWS"
    relation_strength 2.0
  ]
]"""


def test_graph_file(spark, tmp_path):
    (tmp_path / "g.gml").write_text(GML)
    nodes, edges = files.read_graph_file(spark, str(tmp_path / "g.gml"))
    got = {r["id"]: r for r in nodes.collect()}
    assert got["ent-a"]["entity_name"] == "Иван" and got["ent-a"]["source_chunk_id"] == ["c1"] and got["ent-a"]["documents_id"] == []
    e = edges.first()
    assert (e["id"], e["subject_id"], e["object_id"], e["relation_strength"]) == ("rel-1", "ent-a", "ent-b", 2.0)
    plain, _ = files.graph_export(nodes, edges)
    assert plain.filter("id = 'ent-b'").first()["description"] == ""


def test_settings(tmp_path):
    path = str(tmp_path / "s.json")
    files.Settings(top_k=5).save(path)
    assert files.Settings.load(path).top_k == 5
    (tmp_path / "s.json").write_text('{"top_k": 3, "odd": 1}')
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert files.Settings.load(path).top_k == 3
    assert "odd" in str(seen[0].message)
    for bad in ({"top_k": 0}, {"language": "klingon"}):
        with pytest.raises(ValueError):
            files.Settings(**bad)
    with pytest.raises(TypeError):
        files.Settings(top_k="5")


def test_stream_ingest_is_incremental(spark, tmp_path):
    source, out = str(tmp_path / "src"), str(tmp_path / "out")
    docs(spark, "One. Two.", "Three.").write.parquet(source)

    def run():
        stream = spark.readStream.schema("doc_id long, text string").parquet(source)
        ingest.ingest_stream(stream, out, str(tmp_path / "cp")).awaitTermination(120)
        return sorted(r["content"] for r in spark.read.parquet(out).collect())

    assert run() == ["One. Two.", "Three."]
    docs(spark, "Three.", "Four.").write.mode("append").parquet(source)
    assert run() == ["Four.", "One. Two.", "Three."]
