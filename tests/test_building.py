import base64
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import prompts, scalar
from graphloom.operators import building, chunking, community, index, lookup, ranking, retrieval
from graphloom.sources import files

FOUND = '{"entities":[{"entity_name":"Ann","entity_type":"PERSON (x)","description":"d"},{"entity_name":"Bob","entity_type":"","description":"d"}],"relations":[{"source_entity":"Ann","target_entity":"Bob","relation_type":"","description":"knows","relationship_strength":2},{"source_entity":"Ann","target_entity":"Nobody","relation_type":"T","description":"x","relationship_strength":1}]}'


@pytest.fixture
def chunks(spark):
    return spark.createDataFrame([("c1", "Ann knows Bob."), ("c2", None)], "id string, content string")


def test_single_step_and_two_stages(spark, chunks):
    for entities, relations in (building.single_step(chunks, lambda texts: [FOUND for _ in texts]), building.two_stage(chunks, lambda texts: [FOUND for _ in texts], lambda texts: [FOUND for _ in texts])):
        assert sorted((r["entity_name"], r["entity_type"]) for r in entities.collect()) == [("Ann", "PERSON"), ("Bob", "UNKNOWN")]
        assert [(r["source_entity"], r["target_entity"], r["relation_type"]) for r in relations.collect()] == [("Ann", "Bob", "UNKNOWN")]
    checked, _ = building.single_step(chunks, lambda t: [FOUND for _ in t], lambda t: ['{"entities":[{"entity_name":"Zoe"}],"relations":[]}' for _ in t])
    assert [r["entity_name"] for r in checked.collect()] == ["Zoe"]
    assert building.single_step(chunks.limit(0), lambda t: t)[0].count() == 0


def test_four_stages(spark, chunks):
    entities, relations = building.four_stage(
        chunks, lambda t: ["ann\nbob\n\nann" for _ in t], lambda t: [x.split("\n")[-1].title() for x in t], lambda t: ["about" for _ in t],
        lambda t: ["- knows" if x.endswith("Ann\nBob") else "нет связи" for x in t],
    )
    assert sorted(r["entity_name"] for r in entities.collect()) == ["Ann", "Bob"]
    assert [tuple(r) for r in relations.collect()] == [("c1", "Ann", "Bob", "knows")]


def test_modules_run_in_order(spark):
    e = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    r = spark.createDataFrame([("r", "a", "b"), ("s", "a", "x")], "id string, subject_id string, object_id string")
    left, kept = building.run_modules(e, r, [building.isolated_nodes_removed, lambda x, y: (x.filter("id <> 'b'"), y)])
    assert [x["id"] for x in left.collect()] == ["a"] and [x["id"] for x in kept.collect()] == ["r"]


def test_density_clusters_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(i % 2), (rng.integers(0, 4) * np.ones(3) + 0.05 * rng.normal(size=3)).tolist()) for i in range(60)] + [(90, None, [1.0] * 3), (91, 0, None), (92, 0, [9.0] * 3), (92, 0, [9.0] * 3)]
    df = spark.createDataFrame(rows, "k long, g int, v array<double>")
    links = {(r["a"], r["b"]) for r in building.density_links(df, "v", "k", "g", 0.5, tile=7).collect()}
    good = [(k, g, np.array(v)) for k, g, v in rows if g is not None and v is not None]
    assert links == {(a, b) for a, g, v in good for b, h, w in good if a < b and g == h and np.linalg.norm(v - w) <= 0.5}
    placed = {r["k"]: r["cluster"] for r in building.density_clusters(df, "v", "k", "g").collect()}
    assert placed[92] is None and placed[91] is None and all(placed[a] == placed[b] for a, b in links)
    assert building.density_clusters(df.limit(0), "v", "k", "g").count() == 0


def test_few_shot_formatters(spark):
    output = F.from_json(F.lit(FOUND), building.ARTIFACTS)
    row = spark.range(1).select(output.alias("o"))
    text = lambda kind: row.select(prompts.conversation_text(prompts.example_messages(kind, F.lit("T"), F.col("o"))).alias("t")).first()["t"]
    assert text("artifact_extraction").startswith("user: Text:\nT\nassistant: {\"entities\"")
    assert "Triplets for validation:\nEntities:\n- Ann (PERSON (x)): d\n- Bob (): d\n\nRelations:\n- Ann → Bob (, strength: 2.0): knows" in text("artifact_validation")
    assert '"relations"' not in text("entity_extraction") and '"entities"' not in text("relation_validation")
    empty = spark.range(1).select(F.from_json(F.lit('{"entities":[],"relations":[]}'), building.ARTIFACTS).alias("o"))
    assert "Entities for validation:\n(none)" in empty.select(prompts.conversation_text(prompts.example_messages("entity_validation", F.lit("T"), F.col("o"))).alias("t")).first()["t"]


def test_sub_plans_of_many_groups(spark):
    rows = [("p", "c", "b"), ("p", "b", "a"), ("p", "a", None), ("q", "x", None), (None, "y", None)]
    got = {r["id"]: (r["place"], r["depth"]) for r in retrieval.plan_order(spark.createDataFrame(rows, "plan string, id string, needed string")).collect()}
    assert got == {"a": (0, 0), "b": (1, 1), "c": (2, 2), "x": (0, 0)}
    with pytest.raises(Exception, match="circle"):
        retrieval.plan_order(spark.createDataFrame([("p", "a", "b"), ("p", "b", "a")], "plan string, id string, needed string")).collect()


def test_token_truncation_and_distinct_texts(spark):
    path = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
    df = spark.createDataFrame([(1, "one two three four five six"), (2, ""), (3, None), (4, " one two three four five six ")], "n int, t string")
    got = {r["n"]: (r["cut"], r["cut_tokens"]) for r in chunking.truncate_model_tokens(df, "t", "cut", 3, path).collect()}
    assert got[1][0] == "one two three" and got[1][1] == 6 and got[2] == ("", 0) and got[3] == ("", 0)
    assert chunking.truncate_model_tokens(df, "t", "cut", 3, path, reserved=1).first()["cut"] == "one two"
    assert [r["n"] for r in chunking.distinct_texts(df, "t", ["n"]).collect()] == [1]


def test_chunks_cut_at_the_weakest_joints(spark):
    split = chunking.cut_by_scores(lambda parts: [0.1 if p.startswith("Weak") else 0.9 for p in parts], 5, 40)
    pieces = split("One first thing. Weak joint here. Another thing. And more of it follows. End.")
    assert pieces[0] == "One first thing. Weak joint here." and all(len(p) <= 42 for p in pieces) and split("") == []


def test_sparse_dot_adds_up_and_keeps_the_best(spark):
    q = spark.createDataFrame([("q", 1, 1.0), ("q", 1, 1.0), ("q", None, 1.0)], "id string, idx int, val double")
    d = spark.createDataFrame([(f"d{i}", 1, float(i)) for i in range(9)] + [("n", 1, None)], "id string, idx int, val double")
    assert sorted(r["score"] for r in ranking.sparse_dot(q, d, 2).collect())[-2:] == [14.0, 16.0]


def test_rerank_within_queries(spark):
    rows = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.9), (2, "c", 0.5)], "query_id int, id string, score double")
    assert sorted((r["query_id"], r["id"]) for r in ranking.rerank(rows, keep=1, within="query_id").collect()) == [(1, "b"), (2, "c")]


def test_communities_hang_together_and_are_written_back(spark):
    rng = np.random.default_rng(1)
    links = [(f"n{a:02}", f"n{b:02}") for a in range(40) for b in range(a) if a // 10 == b // 10 and rng.random() < 0.6] + [("n00", "n10"), ("n20", "n30")]
    df = spark.createDataFrame(links, "a string, b string")
    found = community.detect(df)
    assert community.modularity(df, found) > 0.6 and found.select("cluster_id").distinct().count() <= 6
    people = spark.createDataFrame([("n00", [(0, 77)]), ("zz", None)], "id string, clusters array<struct<level:int,cluster_id:int>>")
    told = {r["id"]: len(r["clusters"]) for r in community.write_back(people, found).collect()}
    assert told == {"n00": 2, "zz": 0}


def test_ids_and_serialisation(spark):
    import hashlib

    row = spark.range(1).select(scalar.named_hash_id("p-", F.lit("a"), z=F.lit("1"), b=F.lit("2")).alias("h"), F.lit("é").alias("x"), F.lit(None).cast("int").alias("y"))
    assert row.first()["h"] == "p-" + hashlib.md5("\0a\0b\x012\0z\x011".encode()).hexdigest()
    assert row.select(scalar.serialized("x", "y").alias("j"), scalar.serialized_size("x", "y").alias("n")).first() == ('{"x":"é","y":null}', 19)


def test_files_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("ent-1", 'Иван "I"', "PERSON", None, ["c1"], []), ("ent-2", "B", None, "d & e", [], ["d1", "d2"])], files.NODES)
    edges = spark.createDataFrame([("rel-1", "ent-1", "ent-2", "A", "B", "KNOWS", "x", 2.5, ["c1"])], files.EDGES)
    files.write_graph_file(nodes, edges, str(tmp_path / "g.gml"))
    again, links = files.read_graph_file(spark, str(tmp_path / "g.gml"))
    assert sorted(map(tuple, again.select("id", "entity_name", "description", "source_chunk_id", "documents_id").collect())) == sorted(map(tuple, nodes.select("id", "entity_name", "description", "source_chunk_id", "documents_id").collect()))
    assert links.first()["relation_strength"] == 2.5 and links.first()["id"] == "rel-1"
    store = {"embedding_dim": 2, "data": [{"__id__": "a", "tag": 1}, {"__id__": "b"}], "matrix": base64.b64encode(np.array([1, 2, 3, 4], dtype="<f4").tobytes()).decode()}
    (tmp_path / "v.json").write_text(json.dumps(store))
    assert [(r["id"], r["vector"]) for r in files.read_vector_file(spark, str(tmp_path / "v.json")).collect()] == [("a", [1.0, 2.0]), ("b", [3.0, 4.0])]
    with pytest.raises(ValueError, match="distance"):
        files.check_collection({"size": 2, "distance": "dot"}, 2)
    files.check_collection({"size": 2, "distance": "Cosine", "sparse": "bm25", "modifier": "IDF"}, 2, sparse="bm25")
    (tmp_path / "corpus").mkdir()
    (tmp_path / "corpus" / "a.json").write_text(json.dumps(["Текст по-русски", {"text": "English", "language": "x"}, " "]))
    (tmp_path / "corpus" / "b.txt").write_text("plain text")
    assert sorted(map(tuple, files.read_corpus(spark, str(tmp_path / "corpus")).collect())) == [("English", "x"), ("plain text", "english"), ("Текст по-русски", "russian")]


def test_index_access(spark):
    n = spark.createDataFrame([("ent-1", "A"), ("ent-2", "B")], "id string, entity_name string")
    e = spark.createDataFrame([("rel-1", "ent-1", "ent-2")], "id string, subject_id string, object_id string")
    s = spark.createDataFrame([("com-1", "s")], "id string, summary string")
    v = spark.createDataFrame([("ent-1", [1.0, 2.0])], "id string, vector array<double>")
    whole = index.KnowledgeIndex(n, e, s, s, s, v)
    asked = spark.createDataFrame([(0, "ent-2"), (1, "?")], "pos int, id string")
    assert [(r["pos"], r["entity_name"]) for r in whole.get("entities", asked).orderBy("pos").collect()] == [(0, "B"), (1, None)]
    assert [tuple(r) for r in whole.edge_specs(spark.createDataFrame([("rel-1",), ("x",)], "id string")).collect()] == [("ent-1", "ent-2", "rel-1")]
    assert whole.delete_summaries(s).summaries.count() == 0
    with pytest.raises(ValueError, match="unknown"):
        whole.update_summaries(spark.createDataFrame([("com-9", "s")], "id string, summary string"))
    with pytest.raises(ValueError, match="length"):
        whole.validate_vectors(3)
    whole.validate_vectors(2)
    assert lookup.latest(spark.createDataFrame([("a", 1, 2, None)], "id string, ingested_at int, rec_no long, x string"), "id").count() == 1
