"""Communities: detection, membership, renumbering, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalar import community_id
from graphloom.operators import graph
from graphloom.operators.numbering import number_rows
from graphloom.session import drop_materialized, materialize


def _move(edges: DataFrame, labels: DataFrame, turn: int, resolution: float) -> DataFrame:
    """One round of local moving: half of the nodes join the neighbouring community with the largest gain.

    ``edges`` has every link in both directions (src, dst, part, weight); gains
    are those of modularity within each part, so separate parts never mix. Nodes
    of the other half stay, which keeps neighbours from swapping back and forth.
    A link of a node with itself counts for its degree only.
    """
    degree = edges.groupBy("part", "src").agg(F.sum("weight").alias("deg"))
    own = labels.join(degree, ["part", "src"])
    total = own.groupBy("part", "label").agg(F.sum("deg").alias("tot"))
    mass = own.groupBy("part").agg(F.sum("deg").alias("mass"))
    target = labels.select("part", F.col("src").alias("dst"), F.col("label").alias("to"))
    near = edges.filter("src <> dst").join(target, ["part", "dst"]).groupBy("part", "src", "to").agg(F.sum("weight").alias("w"))
    stay = own.select("part", "src", F.col("label").alias("to")).withColumn("w", F.lit(0))
    near = near.unionByName(stay).groupBy("part", "src", "to").agg(F.sum("w").alias("w"))
    scored = (
        near.join(own, ["part", "src"])
        .join(total.withColumnRenamed("label", "to"), ["part", "to"])
        .join(mass, "part")
        .withColumn("rest", F.col("tot") - F.when(F.col("to") == F.col("label"), F.col("deg")).otherwise(0))
        .withColumn("gain", F.round(F.col("w") - resolution * F.col("deg") * F.col("rest") / F.col("mass"), 9))
    )
    best = scored.groupBy("part", "src").agg(
        F.max(F.struct("gain", (F.col("to") == F.col("label")).alias("stays"), "to")).alias("b"), F.first("label").alias("label")
    )
    moving = F.pmod(F.xxhash64("src", F.lit(turn // 2)), F.lit(2)) == turn % 2
    return best.select("part", "src", F.when(moving, F.col("b.to")).otherwise(F.col("label")).alias("label"))


def _connected(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The labels with every community that falls apart cut into its connected parts, named by their smallest node."""
    at = lambda c, label: labels.select("part", F.col("src").alias(c), F.col("label").alias(label))
    inside = edges.join(at("src", "l1"), ["part", "src"]).join(at("dst", "l2"), ["part", "dst"]).filter("l1 = l2")
    node = lambda c: F.concat_ws("\u0001", "part", c)
    joint = graph.components(inside.select(node("src").alias("a"), node("dst").alias("b")))
    placed = labels.withColumn("id", node("src")).join(joint, "id", "left")
    return placed.select("part", "src", F.coalesce("component", "id").alias("label"))


def _settled(edges: DataFrame, rounds: int, resolution: float) -> DataFrame:
    """(part, src, label): every node by itself at first, then rounds of moving until one moves none."""
    labels = edges.select("part", "src").distinct().withColumn("label", F.col("src"))
    state, still = None, 0
    for turn in range(rounds):
        before, labels = labels, materialize(_move(edges, labels, turn, resolution), "communities")
        drop_materialized(before)
        now = labels.select(F.sum(F.xxhash64("part", "src", "label").cast("decimal(38,0)"))).first()[0]
        # each half of the nodes has had its turn
        still = still + 1 if now == state else 0
        if still == 2:
            break
        state = now
    return labels


def _joined(edges: DataFrame, labels: DataFrame, rounds: int, resolution: float, passes: int) -> DataFrame:
    """The labels after communities as wholes have moved in the graph of communities, ``passes`` times at most."""
    for _ in range(passes):
        at = lambda c, name: labels.select("part", F.col("src").alias(c), F.col("label").alias(name))  # noqa: B023, E731
        between = edges.join(at("src", "l1"), ["part", "src"]).join(at("dst", "l2"), ["part", "dst"])
        whole = between.groupBy("part", F.col("l1").alias("src"), F.col("l2").alias("dst")).agg(F.sum("weight").alias("weight"))
        whole = materialize(whole, "whole")
        moved = _settled(whole, rounds, resolution)
        if moved.filter("src <> label").limit(1).count() == 0:
            break
        step = moved.select("part", F.col("src").alias("label"), F.col("label").alias("joint"))
        labels = materialize(labels.join(step, ["part", "label"]).select("part", "src", F.col("joint").alias("label")), "communities")
    return labels


def detect(links: DataFrame, max_size: int = 128, rounds: int = 6, levels: int | None = None, resolution: float = 1.0, passes: int = 1) -> DataFrame:
    """(id, level, cluster_id): hierarchical modularity communities of undirected (a, b) links.

    Level 0 covers every node with a link; deeper levels split the clusters of
    more than ``max_size`` nodes on the links inside them, until none is larger
    or none can be split (or down to ``levels``, if given). Nodes move until a
    round moves none, for ``rounds`` rounds at most; then communities move as
    wholes (``passes`` times), and every one is cut into its connected parts. All
    steps are DataFrame aggregations, so no cluster
    is ever gathered in one place; labels are written after each round.
    Deterministic: ties prefer staying, then the larger label. Clusters are
    numbered within a level by their smallest node.
    """
    both = links.filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    both = both.unionAll(both.select("dst", "src")).distinct()
    edges = materialize(both.withColumn("part", F.lit("")).withColumn("weight", F.lit(1)), "edges")
    out, level = None, 0
    while levels is None or level < levels:
        labels = _joined(edges, _settled(edges, rounds, resolution), rounds, resolution, passes)
        labels = _connected(edges, labels)
        # a cluster is named by its part and label
        cluster = F.concat_ws("\u0001", "part", "label")
        placed = labels.select(F.col("src").alias("id"), cluster.alias("cluster"))
        sizes = placed.groupBy("cluster").agg(F.count("*").alias("n"), F.min("id").alias("first"))
        part = placed.join(sizes, "cluster").select("id", F.lit(level).alias("level"), "first", "n", "cluster")
        part = materialize(part, "level")
        clusters = part.select("first").distinct().count()
        parts = edges.select("part").distinct().count()
        if level and clusters <= parts:
            drop_materialized(part)
            break  # nothing could be split
        out = part if out is None else out.unionAll(part)
        large = part.filter(F.col("n") > max_size).select(F.col("id").alias("src"), F.col("cluster").alias("part"))
        inner = edges.drop("part").join(large, "src").join(
            large.select(F.col("src").alias("dst"), F.col("part").alias("other")), "dst"
        )
        old, edges = edges, materialize(inner.filter("part = other").select("src", "dst", "part", "weight"), "edges")
        drop_materialized(old)
        level += 1
        if edges.limit(1).count() == 0:
            break
    names = number_rows(out.select("level", "first").distinct(), ["level", "first"], "cluster_id", within="level")
    return out.join(names, ["level", "first"]).select("id", "level", F.col("cluster_id").cast("int").alias("cluster_id"))


def modularity(links: DataFrame, placed: DataFrame) -> float:
    """Modularity of a partition (id, cluster_id) of undirected (a, b) links; 0 without links."""
    at = lambda c, name: placed.select(F.col("id").alias(c), F.col("cluster_id").alias(name))
    ends = links.join(at("a", "ca"), "a").join(at("b", "cb"), "b")
    degree = ends.select(F.explode(F.array("ca", "cb")).alias("c")).groupBy("c").agg(F.count("*").alias("d"))
    inside, total = ends.agg(F.sum((F.col("ca") == F.col("cb")).cast("long")), F.count("*")).first()
    if not total:
        return 0.0
    square = degree.agg(F.sum((F.col("d").cast("double") / (2 * total)) ** 2)).first()[0]
    return inside / total - square


def memberships(entities: DataFrame) -> DataFrame:
    """(id, level, cluster_id): exploded clusters, without repeats and empty entries."""
    return (
        entities.select("id", F.explode("clusters").alias("c"))
        .select("id", F.col("c.level").alias("level"), F.col("c.cluster_id").alias("cluster_id"))
        .filter("level is not null and cluster_id is not null")
        .distinct()
    )


def shared_memberships(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(id, level, cluster_id) of the edges both ends of which are in the cluster."""
    s = members.select(F.col("id").alias("subject_id"), "level", "cluster_id")
    o = members.select(F.col("id").alias("object_id"), "level", "cluster_id")
    both = edges.select("id", "subject_id", "object_id").join(s, "subject_id").join(o, ["object_id", "level", "cluster_id"])
    return both.select("id", "level", "cluster_id").distinct()


def community_rows(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(id, level, cluster_id, entity_ids, relation_ids): sorted ids of each community."""
    who = members.groupBy("level", "cluster_id").agg(F.sort_array(F.collect_set("id")).alias("entity_ids"))
    what = shared_memberships(edges, members).groupBy("level", "cluster_id").agg(F.sort_array(F.collect_set("id")).alias("relation_ids"))
    rows = who.join(what, ["level", "cluster_id"], "left")
    none = F.array().cast("array<string>")
    return rows.select(
        community_id(F.col("level"), F.col("cluster_id")).alias("id"),
        "level",
        "cluster_id",
        "entity_ids",
        F.coalesce("relation_ids", none).alias("relation_ids"),
    )


def renumbering(new: DataFrame, stored: DataFrame) -> DataFrame:
    """(level, cluster_id, new_id): dense ranks of new local ids after the largest stored id of the level."""
    top = stored.filter("cluster_id is not null").groupBy("level").agg(F.max("cluster_id").alias("top"))
    local = new.select("level", "cluster_id").filter("cluster_id is not null").distinct()
    ranked = number_rows(local, ["level", "cluster_id"], "rank", within="level")
    moved = F.col("rank") + F.coalesce("top", F.lit(-1)) + 1
    return ranked.join(top, "level", "left").select("level", "cluster_id", moved.cast("int").alias("new_id"))


def write_back(entities: DataFrame, found: DataFrame) -> DataFrame:
    """Entities with the detected memberships (id, level, cluster_id) added to their ``clusters``, by level, without repeats."""
    new = found.groupBy("id").agg(F.collect_set(F.struct(F.col("level").cast("int").alias("level"), F.col("cluster_id").cast("int").alias("cluster_id"))).alias("new"))
    none = F.array().cast("array<struct<level:int,cluster_id:int>>")
    both = F.sort_array(F.array_union(F.coalesce("clusters", none), F.coalesce("new", none)))
    return entities.join(new, "id", "left").withColumn("clusters", F.filter(both, lambda c: c.isNotNull())).drop("new")


def whole_communities(rows: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """``rows`` (id, level, cluster_id, entity_ids, relation_ids) with their entities and relations in place of the ids, by level and cluster, members by id."""

    def members(ids: str, stored: DataFrame, name: str) -> DataFrame:
        keyed = rows.select(F.col("id").alias("community"), F.explode(F.array_distinct(ids)).alias("id"))
        record = F.struct("id", *[c for c in stored.columns if c != "id"])
        return keyed.join(stored, "id").groupBy("community").agg(F.sort_array(F.collect_list(record)).alias(name))

    out = rows.select(F.col("id").alias("community"), "level", "cluster_id")
    for ids, stored, name in (("entity_ids", entities, "entities"), ("relation_ids", relations, "relations")):
        out = out.join(members(ids, stored, name), "community", "left")
    return out.withColumnRenamed("community", "id").orderBy("level", "cluster_id")


def remap_clusters(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """Entities with their memberships renumbered; unknown pairs are dropped, repeats too."""
    moved = memberships(entities).join(mapping, ["level", "cluster_id"]).groupBy("id").agg(
        F.sort_array(F.collect_set(F.struct("level", F.col("new_id").alias("cluster_id")))).alias("clusters")
    )
    return entities.drop("clusters").join(moved, "id", "left")


def report_text(title: Column, summary: Column, findings: Column) -> Column:
    """Title, summary, then summary and explanation of each finding."""
    lines = F.transform(
        findings, lambda f: F.concat(F.lit("Finding summary: "), f["summary"], F.lit("\nFinding explanation: "), f["explanation"])
    )
    head = F.concat(F.lit("Report title: "), title, F.lit("\nReport summary: "), summary)
    return F.concat_ws("\n\n", head, F.array_join(lines, "\n\n"))
