from datetime import datetime as D

import pytest

from graphloom.llm import survivor

ROWS = "rec_no long, id string, entity_name string, description string, source_chunk_id array<string>, documents_id array<string>, extractor string, ingested_at timestamp, state string"


def day(n):
    return D(2025, 1, n)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], ROWS)


def trust(spark):
    return spark.createDataFrame([("curator", 5), ("Tool ", 2), (None, 9)], "extractor string, trust int")


def records(spark, rows):
    out = survivor.survivors(frame(spark, rows), trust(spark)).collect()
    return {r["id"]: (r["description_rec"], r["chunks_rec"], r["documents_rec"]) for r in out}


def test_each_field_from_its_best_row(spark):
    rows = [
        (1, "e", "Ann", "Ann is a painter.", ["c1", " C1 ", None, ""], ["d1"], " CURATOR", day(1)),
        (2, "e", "Ann", "Ann is a sculptor.", ["c1", "c2"], [""], "tool", day(3)),
        (3, "e", "Ann", "n/a", None, [None], "curator", day(5)),
        (4, "e", "Ann", "“ANN”.", [], ["d2"], "curator", day(4)),
        (5, "single", "x", "text", ["c"], ["d"], None, day(1)),
        (6, None, "x", "text", ["c"], ["d"], None, day(1)),
        (7, None, "x", "text", ["c"], ["d"], None, day(1)),
        (8, "hollow", "x", None, None, None, None, day(1)),
        (9, "hollow", "x", "???", [], [], None, day(2)),
    ]
    assert records(spark, rows) == {"e": (1, 2, 4), "hollow": (0, 0, 0)}


def test_ties_and_exact_repeats(spark):
    a = (3, "e", "Ann", "One thing.", ["c1"], ["d"], "tool", day(2))
    b = (2, "e", "Ann", "Another.", ["c2"], ["d"], "unlisted", day(2))
    c = (1, "e", "Ann", "Older.", ["c3"], ["d"], "tool", day(1))
    assert records(spark, [a, b, c, a]) == {"e": (3, 2, 2)}


def test_missing_times_follow_the_learned_order(spark):
    # over many ids, the tool's rows come before the curator's
    rows = []
    for k in range(8):
        rows += [(10 * k + 1, f"t{k}", "n", "Old text.", ["c"], ["d"], "tool", day(1)), (10 * k + 2, f"t{k}", "n", "New text.", ["c"], ["d"], "curator", day(2))]
    rows += [
        (901, "x", "n", "Dated.", ["c"], ["d1"], "tool", day(9)),
        (902, "x", "n", "Undated.", ["c"], ["d2"], "curator", None),
        (903, "y", "n", "Dated.", ["c"], ["d1"], "curator", day(9)),
        (904, "y", "n", "Undated.", ["c"], ["d2"], "tool", None),
        (905, "z", "n", "a b", ["c"], ["d1"], "tool", None),
        (906, "z", "n", "a c", ["c"], ["d2"], "curator", None),
    ]
    got = records(spark, rows)
    assert got["x"][2] == 902 and got["y"][2] == 903 and got["z"][2] == 906


def test_a_name_of_the_entity_is_no_description(spark):
    rows = [
        (1, "e", "Ann Lee", "She paints.", ["c"], ["d"], "tool", day(1)),
        (2, "e", None, "Ann Lee.", ["c"], ["d"], "curator", day(2)),
        (3, "f", None, "Ann Lee.", ["c"], ["d"], "curator", day(2)),
        (4, "f", "Bob", None, ["c"], ["d"], "curator", day(1)),
    ]
    assert {k: v[0] for k, v in records(spark, rows).items()} == {"e": 1, "f": 3}


def test_hidden_times_are_recovered_from_the_learned_order(spark):
    # each extractor overwrites the one before it; the times of every tenth id are taken away
    states = ["tool", "curator", "unlisted"]
    rows, want = [], {}
    for k in range(200):
        hidden = k % 10 == 0
        for n, state in enumerate(states[: 2 + k % 2]):
            rows.append((10 * k + n, f"i{k}", "n", "Some text.", ["c"], [f"d{n}"], state, None if hidden else day(1 + n)))
            if hidden:
                want[f"i{k}"] = 10 * k + n
    got = records(spark, rows)
    assert sum(got[k][2] == v for k, v in want.items()) == len(want)


def test_too_many_extractors_raise(spark, monkeypatch):
    monkeypatch.setattr(survivor, "MAX_STATES", 1)
    with pytest.raises(ValueError, match="extractors"):
        records(spark, [])


def test_order_has_no_cycles():
    rank, before = survivor._order({("a", "b"): 5, ("b", "a"): 1, ("b", "c"): 4, ("c", "a"): 2}, ["a", "b", "c"])
    assert rank == {"a": 0, "b": 1, "c": 2} and before == {("a", "b"), ("b", "c"), ("a", "c")}


def test_empty(spark):
    assert records(spark, []) == {}
