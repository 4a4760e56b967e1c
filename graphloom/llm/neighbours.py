"""Most similar vectors for every vector (problem 1).

Inverted file with product-quantised residuals: coarse centroids and residual
codebooks are fitted on a bounded sample, every vector is indexed under its
nearest centroid with ``SUBSPACES`` bytes of codes. Each cell's vectors probe
the ``PROBES`` (or ``WIDE``) cells nearest to it: the codes (some thirty bytes a vector) travel
to the probing cells, the query vectors stay where they are. Scores come from
asymmetric distance tables (query against codewords), and as each vector's
reconstruction error is stored, and how much of it lies along the rebuilt vector
(which a near query loses as well), candidates that cannot reach ``min_cosine`` are
dropped without loss. The best ``DEPTH`` per query and segment are reranked
exactly on the original numbers in DOUBLE. Residuals are coded in units of their
cell's spread, so that a crowd of almost equal vectors, which takes up many
narrow cells, is told apart as finely as any other.

The number of cells grows with the square root of the collection, up to
``MOST``; from ``FLAT`` on the centroids are fitted and looked up in two levels.
Each cell's codes are copied to the cells that probe it, and only cells of more
than ``BLOCK`` queries get more than one copy: ``probes`` copies of a code
whatever the size of the collection, up to some 500 million directions.

Vectors of one direction (to 1e-5 in every coordinate) are indexed once and
expanded at the end, so a third of all rows may be copies of one vector: only
the ``k + 1`` smallest ids of a direction can be anyone's neighbours, found by a
rank limit that Spark applies before the shuffle. Cells are cut into blocks of
``BLOCK`` queries and ``SEGMENT`` codes, whatever their size.

Defined results: vectors that are null, of another length, not finite (or with
null elements) or all zero take no part; cosines are rounded to 6 decimals and
equal ones ordered by the smaller id; ids that are null take no part; repeated
rows with one id count once; extra columns are ignored; empty tables give an
empty result; fewer vectors than centroids are handled by fewer centroids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import materialize

#: Vectors the centroids and codebooks are fitted on: so many, or so many a cell if that is more.
SAMPLE, PER_CELL = 20_000, 6
#: Centroids per square root of the collection, and their bounds; more than FLAT are fitted in two levels.
DENSITY, FEWEST, MOST, FLAT = 2.0, 1, 65_536, 4096
#: Groups of centroids a vector is compared with in the second level.
TOPS = 8
PROBES = 24
#: Cells probed where no floor of 0.8 or more keeps the neighbours close.
WIDE = 144
#: Rows of the routing table up to which it is broadcast (some 30 bytes each); a larger one is joined by shuffle.
ROUTES = 2_000_000
SUBSPACES, CODEWORDS = 16, 256
DEPTH = 64
BLOCK, SEGMENT = 8192, 65_536
_GRID = 1e-5


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's iterations from distinct rows; centroids left empty move to the worst served rows."""
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near, gap = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        count = np.bincount(near, minlength=len(centres))
        full = count > 0
        centres[full] = sums[full] / count[full, None]
        if not full.all():
            centres[~full] = x[np.argsort(-gap)[: (~full).sum()]]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near = np.empty(len(x), dtype=np.int64)
    gap = np.empty(len(x), dtype=np.float32)
    half = (centres**2).sum(axis=1) / 2
    for lo in range(0, len(x), 4096):
        score = x[lo : lo + 4096] @ centres.T - half
        near[lo : lo + 4096] = score.argmax(axis=1)
        gap[lo : lo + 4096] = (x[lo : lo + 4096] ** 2).sum(axis=1) - 2 * score.max(axis=1)
    return near, gap


@dataclass
class Codec:
    """Coarse centroids (cells x dim), their spread, residual codebooks (subspaces x codewords x dim / subspaces).

    ``tops`` are the centroids of groups of cells, ``group`` the group of each
    cell, in order; a flat quantiser has none.
    """

    centres: np.ndarray
    spread: np.ndarray
    books: np.ndarray
    tops: np.ndarray | None = None
    group: np.ndarray | None = None

    def cells(self, x: np.ndarray) -> np.ndarray:
        return _assign(x, self.centres, self.tops, self.group)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cell, codes, error, shift) of each row of ``x``: what the code loses, and how far along the rebuilt vector itself."""
        cell = self.cells(x)
        rest = (x - self.centres[cell]) / self.spread[cell, None]
        width = self.books.shape[2]
        codes = np.empty((len(x), len(self.books)), dtype=np.uint8)
        built = np.empty_like(rest)
        for m, book in enumerate(self.books):
            part = rest[:, m * width : (m + 1) * width]
            codes[:, m] = _nearest(part, book)[0]
            built[:, m * width : (m + 1) * width] = book[codes[:, m]]
        rebuilt = self.centres[cell] + built * self.spread[cell, None]
        lost = x - rebuilt
        return cell, codes, np.sqrt((lost**2).sum(axis=1)), (lost * rebuilt).sum(axis=1)

    def scores(self, queries: np.ndarray, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate inner products by asymmetric tables: candidates x queries.

        A table has a row per codeword with the products of all queries, so that
        a candidate adds up whole rows.
        """
        which, local = np.unique(cells, return_inverse=True)
        width = self.books.shape[2]
        out = np.zeros((len(cells), len(queries)), dtype=np.float32)
        for m, book in enumerate(self.books):
            out += (book @ queries[:, m * width : (m + 1) * width].T)[codes[:, m]]
        out *= self.spread[cells, None]
        out += (self.centres[which] @ queries.T)[local]
        return out

    def probes(self, count: int) -> np.ndarray:
        """The cells nearest to each cell, itself first."""
        count = min(count, len(self.centres))
        half = (self.centres**2).sum(axis=1) / 2
        out = np.empty((len(self.centres), count), dtype=np.int64)
        for lo in range(0, len(out), 1024):
            gap = half[None, :] - self.centres[lo : lo + 1024] @ self.centres.T
            rows = np.arange(len(gap))
            gap[rows, rows + lo] = -np.inf
            near = np.argpartition(gap, count - 1, axis=1)[:, :count]
            order = np.lexsort((near, np.take_along_axis(gap, near, 1)), axis=1)
            out[lo : lo + 1024] = np.take_along_axis(near, order, 1)
        return out


def _assign(x: np.ndarray, centres: np.ndarray, tops: np.ndarray | None, group: np.ndarray | None) -> np.ndarray:
    """The nearest cell of each row; in two levels, the nearest in the TOPS nearest groups."""
    if tops is None:
        return _nearest(x, centres)[0]
    count = min(TOPS, len(tops))
    gap = (tops**2).sum(axis=1) / 2 - x @ tops.T
    near = np.argpartition(gap, count - 1, axis=1)[:, :count]
    ends = np.searchsorted(group, np.arange(len(tops) + 1))
    best, cell = np.full(len(x), np.inf), np.zeros(len(x), dtype=np.int64)
    rows, asked = np.divmod(np.argsort(near.ravel(), kind="stable"), count)
    sorted_tops = near[rows, asked]
    for top in np.unique(sorted_tops).tolist():
        own = rows[np.searchsorted(sorted_tops, top) : np.searchsorted(sorted_tops, top + 1)]
        part = centres[ends[top] : ends[top + 1]]
        away = (part**2).sum(axis=1) / 2 - x[own] @ part.T
        at = away.argmin(axis=1)
        value = away[np.arange(len(own)), at]
        better = value < best[own]
        best[own[better]], cell[own[better]] = value[better], ends[top] + at[better]
    return cell


def train(sample: np.ndarray, cells: int, seed: int = 7) -> Codec:
    rng = np.random.default_rng(seed)
    cells = min(cells, len(sample))
    tops = group = None
    if cells <= FLAT:
        centres = _kmeans(sample, cells, 10, rng)
    else:
        tops = _kmeans(sample, int(np.ceil(cells**0.5)), 10, rng)
        near, _ = _nearest(sample, tops)
        parts = []
        for t in range(len(tops)):
            own = sample[near == t]
            # every group gets its share of the cells, by its share of the sample
            k = max(1, round(cells * len(own) / len(sample)))
            parts.append(_kmeans(own, min(k, len(own)), 6, rng) if len(own) else tops[t : t + 1])
        centres = np.concatenate(parts)
        group = np.repeat(np.arange(len(tops)), [len(p) for p in parts])
    few = sample[rng.permutation(len(sample))[: max(10_000, len(sample) // PER_CELL)]]
    cell = _assign(sample, centres, tops, group)
    square = ((sample - centres[cell]) ** 2).sum(axis=1)
    count = np.bincount(cell, minlength=len(centres))
    whole = float(np.sqrt(square.mean())) or 1.0
    # a cell's spread, drawn to that of all cells where it has few vectors of the sample; never less than the grid
    spread = np.sqrt((np.bincount(cell, weights=square, minlength=len(centres)) + 1e-3 * square.mean()) / np.maximum(count - 1 + 1e-3, 1e-3))
    spread = np.where(count > 1, spread, whole).clip(_GRID, 4 * whole).astype(np.float32)
    cell = _assign(few, centres, tops, group)
    rest = (few - centres[cell]) / spread[cell, None]
    parts = SUBSPACES if sample.shape[1] % SUBSPACES == 0 else 1
    books = [_kmeans(np.ascontiguousarray(p[:20_000]), min(CODEWORDS, len(few)), 8, rng) for p in np.split(rest, parts, axis=1)]
    return Codec(centres, spread, np.stack(books), tops, group)


def _matrix(column: pa.Array, dim: int, kind: type = np.float32) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind).reshape(len(column), dim)


def _unit(raw: np.ndarray) -> np.ndarray:
    wide = raw.astype(np.float64)
    return wide / np.sqrt((wide**2).sum(axis=1, keepdims=True))


def _directions(vectors: DataFrame, dim: int) -> DataFrame:
    """(id, vec, way_a, way_b): usable vectors and a 128-bit number of their direction."""
    rng = np.random.default_rng(11)
    factors = rng.integers(1, 2**63 - 1, (dim, 2), dtype=np.int64) | 1
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.filter((F.size("vec") == dim) & finite & F.exists("vec", lambda x: x != 0) & F.col("id").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grid = np.rint(_unit(_matrix(batch.column(1), dim)) / _GRID).astype(np.int64)
            with np.errstate(over="ignore"):
                ways = (grid[:, :, None] * factors[None, :, :]).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ways[:, 0]), pa.array(ways[:, 1])],
                names=["id", "vec", "way_a", "way_b"],
            )

    return usable.mapInArrow(run, "id long, vec array<float>, way_a long, way_b long")


def nearest_neighbours(
    vectors: DataFrame,
    id_column: str = "vec_no",
    vector_column: str = "__vector__",
    dim: int = 64,
    k: int = 5,
    min_cosine: float = -1.0,
    probes: int | None = None,
    sample: int = SAMPLE,
) -> DataFrame:
    """(id, neighbour, cosine): for every usable vector its ``k`` most similar others with at least ``min_cosine`` (any, if not given).

    A direction's members share their neighbours, so a copy held by a third of
    all rows yields ``k`` rows for each of them and no more.
    """
    spark = vectors.sparkSession
    sc = spark.sparkContext
    plain = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<float>").alias("vec"))
    usable = materialize(_directions(plain, dim), "directions")
    way = ["way_a", "way_b"]
    ways = usable.groupBy(*way).agg(F.min("id").alias("rep"), F.min_by("vec", "id").alias("vec"))
    ways = materialize(ways, "ways")
    count = ways.count()
    empty = "id long, neighbour long, cosine double"
    if count == 0:
        return spark.createDataFrame([], empty)
    cells = int(max(FEWEST, min(MOST, DENSITY * count**0.5)))
    wanted = max(sample, PER_CELL * cells)
    # a share of the directions by a hash, so that nothing is sorted; twice the number wanted is never exceeded
    share = F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, wanted / count)) + 1
    chosen = ways.filter(share).select("vec").limit(2 * wanted).toArrow().column("vec").combine_chunks()
    codec = train(np.unique(_unit(_matrix(chosen, dim)), axis=0).astype(np.float32), cells)
    shared = sc.broadcast(codec)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, codes, error, shift = shared.value.encode(_unit(_matrix(batch.column(1), dim)).astype(np.float32))
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cell, pa.int64()), packed, *(pa.array(v.astype(np.float32)) for v in (error, shift))],
                names=["rep", "vec", "cell", "codes", "error", "shift"],
            )

    index = materialize(
        ways.select("rep", "vec").mapInArrow(encode, "rep long, vec array<float>, cell long, codes binary, error float, shift float"), "index"
    )
    # One row per cell, MOST at most.
    sizes = {r["cell"]: r["count"] for r in index.groupBy("cell").count().collect()}
    probes = probes or (PROBES if min_cosine >= 0.8 else WIDE)
    near = codec.probes(probes)
    blocks, segments, probed_by = {}, {}, {}
    for cell, size in sizes.items():
        blocks[cell] = -(-size // BLOCK)
        segments[cell] = -(-sum(sizes.get(int(c), 0) for c in near[cell]) // SEGMENT)
        for c in near[cell].tolist():
            probed_by.setdefault(c, []).append(cell)
    pairs = [(c, to) for c, tos in probed_by.items() for to in tos]
    columns = {
        "cell": pa.array([c for c, _ in pairs], pa.int64()),
        "to": pa.array([to for _, to in pairs], pa.int64()),
        "segments": pa.array([segments[to] for _, to in pairs], pa.int32()),
        "blocks": pa.array([blocks[to] for _, to in pairs], pa.int32()),
    }
    routes = spark.createDataFrame(pa.table(columns))
    routes = F.broadcast(routes) if len(pairs) <= ROUTES else routes
    # A row per cell, MOST at most.
    own = spark.createDataFrame([(c, blocks[c], segments[c]) for c in sizes], "cell long, blocks int, segments int")
    queries = index.join(F.broadcast(own), "cell").select(
        F.col("cell").alias("to"),
        F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("segments") - 1)).alias("segment"),
        F.col("rep").alias("rep"),  # a name of its own, as both sides stem from the index
        F.col("vec").alias("vec"),
    )
    members = index.join(routes, "cell").select(
        "to",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("rep", F.lit(3)), F.col("segments")).cast("int").alias("segment"),
        "rep",
        "cell",
        "codes",
        "error",
        "shift",
    )
    depth, floor = DEPTH, min_cosine - 1e-6

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["to", "block", "rep", "asked"]
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64()))], names=names)
        ids = left.column("rep").to_numpy()
        vec = _unit(_matrix(left.column("vec").combine_chunks(), dim)).astype(np.float32)
        cand = right.column("rep").to_numpy()
        codes = np.frombuffer(b"".join(right.column("codes").to_pylist()), dtype=np.uint8).reshape(len(cand), -1)
        cells = right.column("cell").to_numpy()
        error, shift = right.column("error").to_numpy(), right.column("shift").to_numpy()
        from_q, to_c = [], []
        place = np.argsort(cand, kind="stable")
        step = max(1, 1_000_000 // len(cand))
        for lo in range(0, len(ids), step):
            some = ids[lo : lo + step]
            score = shared.value.scores(vec[lo : lo + step], cells, codes)
            # a query is no candidate of its own
            at = np.minimum(np.searchsorted(cand, some, sorter=place), len(cand) - 1)
            same = cand[place[at]] == some
            score[place[at[same]], np.flatnonzero(same)] = -9
            if floor > -1:
                score[score + error[:, None] < floor] = -9
            # what the code loses along the rebuilt vector is lost along a near query, too
            score += shift[:, None]
            if len(cand) > depth:
                top = np.argpartition(-score, depth - 1, axis=0)[:depth]
            else:
                top = np.broadcast_to(np.arange(len(cand))[:, None], score.shape)
            k_at, q = np.nonzero(np.take_along_axis(score, top, 0) > -5)
            from_q.append(q + lo)
            to_c.append(top[k_at, q])
        q, c = np.concatenate(from_q), np.concatenate(to_c)
        order = np.argsort(c, kind="stable")
        q, c = ids[q[order]], c[order]
        found, first = np.unique(c, return_index=True)
        offsets = np.append(first, len(c)).astype(np.int32)
        n = len(found)
        return pa.Table.from_arrays(
            [
                pa.array(np.full(n, left.column("to")[0].as_py()), pa.int64()),
                pa.array(np.full(n, left.column("block")[0].as_py()), pa.int32()),
                pa.array(cand[found], pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(q, pa.int64())),
            ],
            names=names,
        )

    key = ["to", "block", "segment"]
    asked = queries.groupBy(*key).cogroup(members.groupBy(*key)).applyInArrow(
        search, "to long, block int, rep long, asked array<long>"
    )
    wanted = materialize(asked, "asked").join(index.select("rep", "vec"), "rep")

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("rep", pa.int64()), ("other", pa.int64()), ("cosine", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        ids = left.column("rep").to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        own = _unit(_matrix(left.column("vec").combine_chunks(), dim))[order]
        other = right.column("rep").to_numpy()
        vec = _unit(_matrix(right.column("vec").combine_chunks(), dim))
        lists = right.column("asked").combine_chunks()
        c = np.repeat(np.arange(len(other)), lists.value_lengths().to_numpy())
        q = np.searchsorted(ids, lists.flatten().to_numpy())
        cos = np.empty(len(q))
        for lo in range(0, len(q), 100_000):
            part = slice(lo, lo + 100_000)
            cos[part] = np.round((own[q[part]] * vec[c[part]]).sum(axis=1), 6)
        good = cos >= min_cosine
        q, c, cos = q[good], c[good], cos[good]
        order = np.lexsort((other[c], -cos, q))
        q, c, cos = q[order], c[order], cos[order]
        begin = np.searchsorted(q, q)  # place of the query's first row
        best = np.arange(len(q)) - begin < k
        return pa.Table.from_arrays([pa.array(ids[q[best]]), pa.array(other[c[best]]), pa.array(cos[best])], schema=schema)

    own_block = index.join(F.broadcast(own), "cell").select(
        F.col("cell").alias("to"),
        F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"),
        F.col("rep").alias("rep"),
        F.col("vec").alias("vec"),
    )
    ranked = own_block.groupBy("to", "block").cogroup(wanted.groupBy("to", "block")).applyInArrow(
        rerank, "rep long, other long, cosine double"
    )
    # Back from directions to vectors: at most k neighbours of k + 1 members each, and its own first members.
    first = Window.partitionBy(*way).orderBy("id")
    members = usable.select("id", *way).distinct()
    heads = (
        members.withColumn("n", F.row_number().over(first))
        .filter(F.col("n") <= k + 1)
        .groupBy(*way)
        .agg(F.sort_array(F.collect_list("id")).alias("head"))
    )
    heads = materialize(heads.withColumn("rep", F.col("head")[0]), "heads")
    pair = lambda cos: F.transform("head", lambda i: F.struct((-cos).alias("d"), i.alias("id")))
    around = ranked.join(heads.select(F.col("rep").alias("other"), "head"), "other").select("rep", pair(F.col("cosine")).alias("near"))
    itself = heads.filter("size(head) > 1").select("rep", pair(F.lit(1.0)).alias("near"))
    lists = (
        around.unionAll(itself)
        .groupBy("rep")
        .agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
        .join(heads.select("rep", *way), "rep")
        .drop("rep")
    )
    return (
        members.join(lists, way)
        .withColumn("near", F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k))
        .select("id", F.explode("near").alias("near"))
        .select("id", F.col("near.id").alias("neighbour"), (-F.col("near.d")).alias("cosine"))
    )


def neighbour_pairs(neighbours: DataFrame) -> DataFrame:
    """(vec_a, vec_b) with the smaller id first: pairs where one is among the other's neighbours."""
    return neighbours.select(
        F.least("id", "neighbour").alias("vec_a"), F.greatest("id", "neighbour").alias("vec_b")
    ).distinct()
