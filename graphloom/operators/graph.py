"""The directed multigraph: nodes by id, edges by (subject, object, id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import drop_materialized, materialize


def endpoints(edges: DataFrame) -> DataFrame:
    """(id, edge_id, other): one row per edge end; the edges are read once."""
    end = lambda a, b: F.struct(F.col(a).alias("id"), F.col("id").alias("edge_id"), F.col(b).alias("other"))
    both = F.array(end("subject_id", "object_id"), end("object_id", "subject_id"))
    return edges.select(F.explode(both).alias("e")).select("e.id", "e.edge_id", "e.other")


def degrees(edges: DataFrame) -> DataFrame:
    """In plus out degree over the multigraph; a self-loop counts twice."""
    return endpoints(edges).filter("id is not null").groupBy("id").agg(F.count("*").alias("degree"))


def edge_degree_sums(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Degrees of both ends added up, whether or not the pair is an edge; unknown nodes count 0."""
    d = degrees(edges)
    left = d.select(F.col("id").alias("subject_id"), F.col("degree").alias("ds"))
    right = d.select(F.col("id").alias("object_id"), F.col("degree").alias("do"))
    total = F.coalesce("ds", F.lit(0)) + F.coalesce("do", F.lit(0))
    return pairs.join(left, "subject_id", "left").join(right, "object_id", "left").withColumn("degree_sum", total).drop("ds", "do")


def incident_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, edge_id): each edge once per node it touches, self-loops once.

    Two equi-joins in a union; an OR of both ends would become a nested loop.
    """
    return endpoints(edges).select("id", "edge_id").distinct().join(nodes.select("id"), "id", "left_semi")


def neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, neighbour): distinct nodes one hop away, either direction."""
    return (
        endpoints(edges).join(nodes.select("id"), "id", "left_semi").filter("other is not null")
        .select("id", F.col("other").alias("neighbour")).distinct()
    )


def connected_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges both ends of which are nodes."""
    known = nodes.select("id").distinct()
    return edges.join(known.withColumnRenamed("id", "subject_id"), "subject_id", "left_semi").join(
        known.withColumnRenamed("id", "object_id"), "object_id", "left_semi"
    )


def remove_isolated(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dangling edges go first, then the nodes no remaining edge touches."""
    kept = connected_edges(nodes, edges)
    touched = endpoints(kept).select("id")
    return nodes.join(touched, "id", "left_semi"), kept


def undirected(edges: DataFrame) -> DataFrame:
    """Simple undirected projection: direction, parallels and self-loops collapse."""
    s, o = F.col("subject_id"), F.col("object_id")
    return edges.filter(s.isNotNull() & o.isNotNull() & (s != o)).select(F.least(s, o).alias("a"), F.greatest(s, o).alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component): connected components of (a, b) links, named by the smallest id in them.

    Alternates large-star and small-star steps, which end after a number of
    rounds that grows with the logarithm of the component size, and writes the
    links after every round so that the plan stays short. It ends at the fixed
    point, where a round gives back the links it was given.
    """
    nodes = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    edges = materialize(links.filter("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "links")
    state = None
    while True:
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionAll(edges.select("hi", "lo"))
        # large star: larger neighbours move to the smallest neighbour (or the node itself)
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = large.filter("hi <> lo").distinct()
        # small star: smaller neighbours and the node itself move to the smallest neighbour
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.explode(F.array("lo", "hi")).alias("hi"), F.col("m").alias("lo"))
        before, edges = edges, materialize(small.filter("hi <> lo").select("lo", "hi").distinct(), "links")
        drop_materialized(before)
        now = edges.select(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("component"))
    return nodes.join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def layout_sizes(nodes: DataFrame, edges: DataFrame, least: float = 15.0, spread: float = 35.0) -> DataFrame:
    """(id, degree, size): node size for drawing, ``least`` plus ``spread`` by the share of the largest degree."""
    d = nodes.select("id").distinct().join(degrees(edges), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
    top = d.agg(F.max("degree").alias("top"))  # a single row
    size = F.lit(least) + F.when(F.col("top") > 0, spread * F.col("degree") / F.col("top")).otherwise(0.0)
    return d.join(F.broadcast(top)).select("id", "degree", F.round(size, 6).alias("size"))


def upsert(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows overwritten by new ones of the same key, columns by name."""
    return stored.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and the edges touching them; unknown ids are ignored."""
    ids = gone.select("id").distinct()
    left = edges.join(ids.withColumnRenamed("id", "subject_id"), "subject_id", "left_anti").join(
        ids.withColumnRenamed("id", "object_id"), "object_id", "left_anti"
    )
    return nodes.join(ids, "id", "left_anti"), left


def delete_edges(edges: DataFrame, specs: DataFrame, strict: bool = False) -> DataFrame:
    """Edges named by (subject_id, object_id, relation_id); a null relation id takes all parallel ones.

    ``strict`` raises for a pair without any edge.
    """
    pair = ["subject_id", "object_id"]
    if strict and specs.join(edges.select(*pair), pair, "left_anti").limit(1).count():
        raise ValueError("no edge between the given nodes")
    whole = specs.filter("relation_id is null").select(*pair).distinct()
    single = specs.filter("relation_id is not null").select(*pair, F.col("relation_id").alias("id")).distinct()
    return edges.join(whole, pair, "left_anti").join(single, [*pair, "id"], "left_anti")


def mentions_any(chunks: Column, ids: list[str]) -> Column:
    return F.arrays_overlap(chunks, F.array(*[F.lit(i) for i in ids]))
