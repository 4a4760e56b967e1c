import math

import numpy as np
import pytest

from graphloom.llm import neighbours

VEC = "vec_no long, __vector__ array<float>, cosine double"


def brute(rows, k=5, least=0.8):
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    ids = np.array([i for i, _ in good])
    x = np.array([v for _, v in good], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    out = set()
    for a in range(len(ids)):
        order = [b for b in np.lexsort((ids, -s[a])) if b != a][:k]
        out |= {(int(min(ids[a], ids[b])), int(max(ids[a], ids[b]))) for b in order if s[a, b] >= least}
    return out


@pytest.fixture
def vectors():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 64))
    rows = [(i, (centres[i % 40] + 0.35 * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(600)]
    hot = (centres[0] + 0.1).astype(np.float32)
    # a third of all rows are one direction at different lengths
    rows += [(600 + i, (hot * np.float32(1 + i % 7)).tolist()) for i in range(300)]
    return rows


def test_recall_against_brute_force_with_a_hot_direction(spark, vectors):
    dirty = [(2000, None), (2001, [1.0] * 3), (2002, [0.0] * 64), (2003, [float("nan")] + [1.0] * 63), (2004, [float("inf")] * 64), (2005, [None] + [1.0] * 63), (None, [1.0] * 64)]
    rows = [(i, v, 0.0) for i, v in vectors + dirty] + [(5, vectors[5][1], 0.0)]
    found = neighbours.nearest_neighbours(spark.createDataFrame(rows, VEC))
    got = {(r["vec_a"], r["vec_b"]) for r in neighbours.neighbour_pairs(found).collect()}
    want = brute(vectors + dirty)
    assert len(got & want) >= 0.9 * len(want)
    # what is found has the cosine asked for, and the copies' partners are the smallest ids
    assert {p for p in got if p[0] >= 600} == {p for p in want if p[0] >= 600}
    assert found.groupBy("id").count().filter("count > 5").count() == 0


def test_segments_and_blocks_change_nothing(spark, vectors, monkeypatch):
    df = spark.createDataFrame([(i, v, 0.0) for i, v in vectors], VEC)
    whole = {tuple(r) for r in neighbours.nearest_neighbours(df).collect()}
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "SEGMENT", 64)
    assert {tuple(r) for r in neighbours.nearest_neighbours(df).collect()} == whole


def test_no_vectors(spark):
    df = spark.createDataFrame([], VEC)
    assert neighbours.neighbour_pairs(neighbours.nearest_neighbours(df)).count() == 0
    one = spark.createDataFrame([(1, [1.0] * 64, 0.0)], VEC)
    assert neighbours.nearest_neighbours(one).count() == 0


def test_without_a_floor_every_vector_has_its_neighbours(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=64).astype(np.float32).tolist(), 0.0) for i in range(400)]  # none has another at 0.8
    found = neighbours.nearest_neighbours(spark.createDataFrame(rows, VEC)).collect()
    assert len(found) == 5 * len(rows)
    got = {(min(r["id"], r["neighbour"]), max(r["id"], r["neighbour"])) for r in found}
    want = brute([r[:2] for r in rows], least=-1)
    assert len(got & want) >= 0.98 * len(want)
    assert neighbours.nearest_neighbours(spark.createDataFrame(rows, VEC), min_cosine=0.8).count() == 0


def test_two_levels_of_cells(spark, vectors, monkeypatch):
    monkeypatch.setattr(neighbours, "FLAT", 8)
    found = neighbours.nearest_neighbours(spark.createDataFrame([(i, v, 0.0) for i, v in vectors], VEC), min_cosine=0.8)
    got = {(r["vec_a"], r["vec_b"]) for r in neighbours.neighbour_pairs(found).collect()}
    want = brute(vectors)
    assert len(got & want) >= 0.95 * len(want)


def test_two_level_cells_are_nearly_the_nearest():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 64)).astype(np.float32)
    centres = neighbours._kmeans(x, 100, 5, rng)
    group = np.sort(rng.integers(0, 10, 100))
    tops = np.stack([centres[group == g].mean(axis=0) for g in range(10)])
    best, _ = neighbours._nearest(x, centres)
    assert (neighbours._assign(x, centres, tops, group) == best).mean() > 0.8
    assert (neighbours._assign(x, centres, tops[:1], np.zeros(100, dtype=np.int64)) == best).all()


def test_a_crowd_of_almost_equal_vectors(spark):
    # a third of all vectors are within a few degrees of one another
    rng = np.random.default_rng(6)
    hot = rng.normal(size=64)
    rows = [(i, (hot + 0.05 * rng.normal(size=64)).astype(np.float32).tolist(), 0.0) for i in range(1500)]
    rows += [(1500 + i, rng.normal(size=64).astype(np.float32).tolist(), 0.0) for i in range(3000)]
    found = neighbours.nearest_neighbours(spark.createDataFrame(rows, VEC), min_cosine=0.8)
    got = {(r["vec_a"], r["vec_b"]) for r in neighbours.neighbour_pairs(found).collect()}
    want = brute([r[:2] for r in rows])
    assert len(want) > 4000 and len(got & want) >= 0.9 * len(want)


def test_copies_of_a_code_do_not_grow(monkeypatch):
    # the average cell of n directions stays within one block of queries up to n = (2 * BLOCK) ** 2
    for n in (10**5, 10**7, 10**8):
        cells = min(neighbours.MOST, neighbours.DENSITY * n**0.5)
        assert -(-(n / cells) // neighbours.BLOCK) == 1
