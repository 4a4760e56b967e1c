from datetime import datetime as D

import pytest

from graphloom.operators import references as R

ENTITY = "rec_no long, id string, source_chunk_id array<string>, ingested_at timestamp, ref_key string"
RELATION = "rec_no long, subject_id string, ingested_at timestamp, kind string"


def day(n):
    return D(2025, 1, n)


@pytest.fixture
def frames(spark):
    entity = spark.createDataFrame(
        [
            (1, "e1", ["c1", "c1", " C1 ", "c9", None, ""], day(5), "x"),
            (2, "e2", None, day(5), "x"),
            (2, "e2", None, day(5), "x"),
            (3, "e3", [], None, "x"),
            (4, None, ["c2"], None, "x"),
            (5, "e4", ["c2"], day(1), "x"),
        ],
        ENTITY,
    )
    chunk = spark.createDataFrame([("c1", day(1)), ("c2", day(3)), ("c1", None)], "id string, ingested_at timestamp")
    relation = spark.createDataFrame(
        [(1, " E1", day(6), "k"), (2, "nope", day(6), "k"), (3, None, day(6), "k"), (4, "  ", day(6), "k"), (5, "e2", day(1), "k"), (5, "e2", day(1), "k"), (6, "e1", None, "k"), (7, "e4", day(9), "k")],
        RELATION,
    )
    stones = spark.createDataFrame([("entity", "e4", day(2)), ("chunk", "c1", day(1)), ("entity", "e1", day(4))], "kind string, id string, deleted_at timestamp")
    return entity, chunk, relation, stones


def orphans(entity, chunk, relation, stones):
    return R.orphan_references(
        [R.Reference(relation, "r", "subject_id", "entity"), R.Reference(entity, "e", "source_chunk_id", "chunk")],
        [R.Parent(entity, "entity"), R.Parent(chunk, "chunk")],
        stones,
    )


EXPECTED = {
    ("r", 2, "nope", "missing"),
    ("r", 5, "e2", "late"),
    ("r", 7, "e4", "deleted"),
    ("e", 1, "c1", "deleted"),
    ("e", 1, "c9", "missing"),
    ("e", 5, "c2", "late"),
}


def test_reasons_with_nulls_repeats_ties_and_clashing_columns(frames):
    rows = orphans(*frames).collect()
    assert len(rows) == len(EXPECTED)
    assert {(r["ref_table"], r["rec_no"], r["ref_key"], r["reason"]) for r in rows} == EXPECTED


def test_salted_join_gives_the_same(frames, monkeypatch):
    monkeypatch.setattr(R, "BROADCAST_KEYS", 0)
    got = {(r["ref_table"], r["rec_no"], r["ref_key"], r["reason"]) for r in orphans(*frames).collect()}
    assert got == EXPECTED


def test_report_counts_per_period(frames):
    report = {(r["ref_table"], r["period"], r["reason"]): (r["orphan_refs"], r["orphan_keys"]) for r in R.orphan_report(orphans(*frames)).collect()}
    assert report["r", "2025-01-01", "late"] == (1, 1)
    assert sum(n for n, _ in report.values()) == len(EXPECTED)


def test_empty_tables(spark, frames):
    entity, chunk, relation, stones = (f.limit(0) for f in frames)
    assert orphans(entity, chunk, relation, stones).count() == 0
    assert {r["reason"] for r in orphans(entity, chunk, frames[2], stones).collect()} == {"missing"}
