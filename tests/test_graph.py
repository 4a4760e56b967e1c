import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import community, graph, index, lookup, merging

EDGES = "id string, subject_id string, object_id string, relation_type string, description string, relation_strength double, source_chunk_id array<string>, subject_name string, object_name string"


def edges(spark, rows):
    return spark.createDataFrame([(i, s, o, "KNOWS", "d.", 1.0, [c] if c else [], s, o) for i, s, o, c in rows], EDGES)


def nodes(spark, rows):
    return spark.createDataFrame([(i, i, "PERSON", "About.", c, [], None) for i, c in rows], "id string, entity_name string, entity_type string, description string, source_chunk_id array<string>, documents_id array<string>, clusters array<struct<level:int,cluster_id:int>>")


def ids(df, c="id"):
    return sorted(r[c] for r in df.select(c).collect())


def test_degree_sums_of_a_star(spark):
    e = edges(spark, [("r1", "e1", "e2", None), ("r2", "e1", "e3", None)])
    pairs = spark.createDataFrame([("e1", "e2"), ("e1", "e3"), ("x", "y")], "subject_id string, object_id string")
    got = {(r["subject_id"], r["object_id"]): r["degree_sum"] for r in graph.edge_degree_sums(pairs, e).collect()}
    assert got == {("e1", "e2"): 3, ("e1", "e3"): 3, ("x", "y"): 0}


def test_self_loops_and_incident_edges(spark):
    e = edges(spark, [("r1", "a", "a", None), ("r2", "a", "b", None), ("r3", "a", "b", None)])
    assert {r["id"]: r["degree"] for r in graph.degrees(e).collect()} == {"a": 4, "b": 2}
    n = nodes(spark, [("a", []), ("b", [])])
    assert ids(graph.incident_edges(n, e).filter("id = 'a'"), "edge_id") == ["r1", "r2", "r3"]
    assert graph.undirected(e).count() == 1


def test_either_end_joins_are_no_nested_loops(spark):
    e = edges(spark, [("r1", "a", "b", None)])
    plan = graph.incident_edges(nodes(spark, [("a", [])]), e)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_remove_isolated_drops_dangling_edges_first(spark):
    e = edges(spark, [("r1", "a", "b", None), ("r2", "c", "gone", None)])
    kept_nodes, kept_edges = graph.remove_isolated(nodes(spark, [("a", []), ("b", []), ("c", [])]), e)
    assert ids(kept_nodes) == ["a", "b"] and ids(kept_edges) == ["r1"]


def test_components_against_union_find(spark):
    rng = random.Random(3)
    links = [(f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}") for _ in range(45)] + [(f"p{i:02}", f"p{i + 1:02}") for i in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    least = {}
    for x in list(parent):
        least[find(x)] = min(x, least.get(find(x), x))
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {x: least[find(x)] for x in parent}


def test_wildcard_lookup_returns_all_parallel_edges(spark):
    e = edges(spark, [("r1", "a", "b", None), ("r2", "a", "b", None)])
    specs = spark.createDataFrame([(0, "a", "b", None), (1, "a", "b", "r2"), (2, "a", "z", None)], "pos int, subject_id string, object_id string, relation_id string")
    got = sorted((r["pos"], r["edge_id"]) for r in lookup.edges_by_spec(specs, e).collect() if r["edge_id"])
    assert got == [(0, "r1"), (0, "r2"), (1, "r2")]
    assert lookup.edges_by_spec(specs, e).filter("edge_id is null").count() == 1


def test_missing_keys_are_padded_in_place(spark):
    asked = spark.createDataFrame([(0, "b"), (1, "zz"), (2, "a")], "pos int, id string")
    got = [(r["pos"], r["entity_name"]) for r in lookup.get_by_ids(asked, nodes(spark, [("a", []), ("b", [])]), ["entity_name"]).orderBy("pos").collect()]
    assert got == [(0, "b"), (1, None), (2, "a")]


@pytest.fixture
def small(spark):
    n = nodes(spark, [("ent-1", ["c1"]), ("ent-2", ["c2"]), ("ent-3", ["c3"])])
    e = edges(spark, [("rel-1", "ent-1", "ent-2", "c1"), ("rel-2", "ent-2", "ent-3", "c2")])
    chunks = spark.createDataFrame([("c1", "x"), ("c2", "y"), ("c3", "z")], "id string, content string")
    com = spark.createDataFrame([("com-1", 0, 0, ["ent-1", "ent-2"], ["rel-1"])], "id string, level int, cluster_id int, entity_ids array<string>, relation_ids array<string>")
    summary = spark.createDataFrame([("com-1", "s")], "id string, summary string")
    vec = spark.createDataFrame([(f"ent-{i}", [1.0]) for i in (1, 2, 3)], "id string, vector array<double>")
    return index.KnowledgeIndex(n, e, chunks, com, summary, vec)


def test_deleting_a_chunk_takes_what_mentions_it(spark, small):
    left = small.delete_chunks(spark.createDataFrame([("c1",)], "id string"))
    assert ids(left.entities) == ["ent-2", "ent-3"] and ids(left.relations) == ["rel-2"] and ids(left.chunks) == ["c2", "c3"]
    assert ids(left.entity_vectors) == ["ent-2", "ent-3"]
    issues = {(r["check"], r["id"]) for r in left.check_consistency().collect()}
    assert issues == {("community_references", "ent-1"), ("community_references", "rel-1")}
    assert index.report(small.check_consistency()) == "Consistency: OK"
    assert "FAILED" in index.report(left.check_consistency())


def test_index_refuses_bad_input(spark, small):
    twice = nodes(spark, [("ent-9", []), ("ent-9", [])])
    with pytest.raises(ValueError, match="twice"):
        small.upsert_nodes(twice)
    with pytest.raises(ValueError, match="unknown ids"):
        small.update_nodes(nodes(spark, [("ent-9", [])]))
    with pytest.raises(ValueError, match="unknown node"):
        small.upsert_edges(edges(spark, [("rel-9", "ent-1", "nobody", None)]))
    with pytest.raises(ValueError, match="no edge"):
        small.delete_edges(spark.createDataFrame([("ent-1", "ent-3", None)], "subject_id string, object_id string, relation_id string"))


def test_index_upserts_and_merges(spark, small):
    new = spark.createDataFrame([("ent-1", "Alice", "PERSON", "Fresh fact. About.", ["c2", "c3"], ["d1"], None)], small.entities.schema)
    merged = small.merge_nodes(new).entities.filter("id = 'ent-1'").first()
    assert merged["entity_name"] == "Alice" and merged["description"] == "Fresh fact. About." and merged["source_chunk_id"] == ["c1", "c2", "c3"]
    assert small.upsert_nodes(new).entities.count() == 3
    gone = small.delete_communities(spark.createDataFrame([("com-1",)], "id string"))
    assert gone.communities.count() == 0 and gone.summaries.count() == 0


def test_index_is_saved_and_loaded(spark, small, tmp_path):
    small.save(str(tmp_path))
    again = index.KnowledgeIndex.load(spark, str(tmp_path))
    assert ids(again.entities) == ids(small.entities) and again.chunk_vectors is None


def test_relation_strength_is_the_plain_mean(spark):
    rows = spark.createDataFrame(
        [(0, "r", "a", "b", "A", "B", "T", "One. Two.", 5.0, ["c1"]), (1, "r", "a", "b", "A", "B", "T", "two. Three.", 2.0, ["c2", "c3"])],
        "pos int, id string, subject_id string, object_id string, subject_name string, object_name string, relation_type string, description string, relation_strength double, source_chunk_id array<string>",
    )
    r = merging.merge_relations(rows).first()
    assert r["relation_strength"] == 3.5 and r["description"] == "two. Three. One." and r["source_chunk_id"] == ["c1", "c2", "c3"]


def test_grouping_keeps_order_and_counts(spark):
    rows = spark.createDataFrame(
        [(2, "Alice", "P", "b", ["c2"], None), (1, "Alice", "P", "a", ["c1", None], ["d"]), (3, "Alice", "P", None, None, ["d"]), (4, None, "P", "x", [], [])],
        "pos int, entity_name string, entity_type string, description string, source_chunk_id array<string>, documents_id array<string>",
    )
    r = merging.group_entities(rows).filter("entity_name = 'Alice'").first()
    assert (r["descriptions"], r["duplicate_count"], r["source_chunk_id"], r["documents_id"]) == (["a", "b"], 2, ["c1", "c2"], ["d"])
    assert merging.group_entities(rows).count() == 2


def test_hierarchy_rules(spark):
    # two rings of cliques joined by single links
    links = [(f"c{k}-{i}", f"c{k}-{j}") for k in range(6) for i in range(6) for j in range(i)] + [(f"c{k}-0", f"c{(k + 1) % 6}-1") for k in range(6)]
    df = spark.createDataFrame(links, "a string, b string")
    found = community.detect(df, max_size=4, rounds=4, levels=2).collect()
    top = {r["id"]: r["cluster_id"] for r in found if r["level"] == 0}
    assert len(top) == 36
    for k in range(6):
        assert len({top[f"c{k}-{i}"] for i in range(6)}) == 1
    lower = {}
    for r in found:
        if r["level"] == 1:
            lower.setdefault(r["cluster_id"], set()).add(top[r["id"]])
    assert all(len(parents) == 1 for parents in lower.values())


def test_renumbering_continues_after_the_stored_ids(spark):
    new = spark.createDataFrame([(0, 7), (0, 3), (1, 5)], "level int, cluster_id int")
    stored = spark.createDataFrame([(0, 9)], "level int, cluster_id int")
    got = {(r["level"], r["cluster_id"]): r["new_id"] for r in community.renumbering(new, stored).collect()}
    assert got == {(0, 3): 10, (0, 7): 11, (1, 5): 0}
    people = spark.createDataFrame([("e", [(0, 3), (0, 99)])], "id string, clusters array<struct<level:int,cluster_id:int>>")
    moved = community.remap_clusters(people, community.renumbering(new, stored)).first()["clusters"]
    assert [(c["level"], c["cluster_id"]) for c in moved] == [(0, 10)]


def test_size_batches_fold_in_order(spark):
    rows = spark.createDataFrame([("d", 1, "aa"), ("d", 2, "bbb"), ("d", 3, "c" * 9), ("d", 4, None), (None, 5, "x")], "g string, n long, t string")
    got = {r["n"]: r["batch"] for r in index.size_batches(rows, "g", "n", "t", 5).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 2}
    assert F is not None


def test_all_versions_of_an_id_are_merged_in_order(spark, tmp_path):
    from graphloom.plans import graphs

    rng = random.Random(4)
    words = ["One.", "two.", "ONE.", "Three", "Four!", "two.\n\nFive", "  "]
    pick = lambda pool: [rng.choice(pool) for _ in range(rng.randrange(4))] if rng.random() < 0.9 else None
    text = lambda: " ".join(pick(words) or []) if rng.random() < 0.9 else None
    groups = [(f"i{g}", n) for g, n in enumerate([1, 1, 2, 2, 3, 3, 4, 7, 12])]
    ents = [(i, f"N{rng.random()}", "T", text(), pick(["c1", "c2", "c3", "c4", None]), pick(["d1", "d2", None]), pick([(0, 1), (0, 2), (1, 5)])) for i, n in groups for _ in range(n)]
    rels = [(i, "a", "b", f"N{rng.random()}", "B", "T", text(), rng.choice([1.0, 4.0, 7.5, None]), pick(["c1", "c2", "c3", None])) for i, n in groups for _ in range(n)]
    e_schema = "id string, entity_name string, entity_type string, description string, source_chunk_id array<string>, documents_id array<string>, clusters array<struct<level:int,cluster_id:int>>"
    r_schema = "id string, subject_id string, object_id string, subject_name string, object_name string, relation_type string, description string, relation_strength double, source_chunk_id array<string>"
    for name, rows, schema, one in (("kg_entity", ents, e_schema, merging.merge_entities), ("kg_relation", rels, r_schema, merging.merge_relations)):
        numbered = [(k, *r) for k, r in enumerate(rows)]
        rng.shuffle(numbered)
        spark.createDataFrame([*numbered, (999, None, *[None] * (len(rows[0]) - 1))], f"rec_no long, {schema}").coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
        # the merge of two rows, version after version
        state = {}
        for turn in range(12):
            new = [r for k, r in sorted((x[0], x[1:]) for x in numbered) if sum(1 for j, y in sorted((x[0], x[1:]) for x in numbered) if y[0] == r[0] and j < k) == turn]
            pairs = [(0, *r) for r in new] + [(1, *state[r[0]]) for r in new if r[0] in state]
            columns = schema.split(", ")
            merged = one(spark.createDataFrame(pairs, f"pos int, {schema}")).select(*[c.split()[0] for c in columns]).collect()
            raw = {r[0]: r for r in new}
            state |= {r["id"]: tuple(r) if r["id"] in state or turn else raw[r["id"]] for r in merged}
        whole = {r["id"]: r for r in (merging.fold_entities if name == "kg_entity" else merging.fold_relations)(spark.read.parquet(str(tmp_path / f"{name}.parquet")), "rec_no").collect()}
        at = schema.split(", ")
        for i, n in groups:
            if n > 1:
                assert [whole[i][c.split()[0]] for c in at] == list(state[i]), (name, i)
        told = {r["id"]: r for r in getattr(graphs, "merge_entities" if name == "kg_entity" else "merge_relations")(spark, str(tmp_path)).collect()}
        assert set(told) == {i for i, _ in groups}
        every = {i: sorted({c for r in rows if r[0] == i for c in r[4 if name == "kg_entity" else 8] or () if c}) for i, _ in groups}
        assert {i: r["chunks"] for i, r in told.items()} == {i: ",".join(c) for i, c in every.items()}
