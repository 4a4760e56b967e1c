"""Order-preserving lookups: what is asked for comes back in order, padded with nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, time: str = "ingested_at", number: str = "rec_no") -> DataFrame:
    """The last stored row of each key, the smallest ``number`` on ties; aggregated on the map side.

    Every column is an aggregate of its own, so that the columns nobody asks for
    are pruned from the scan and from the shuffle.
    """
    order = F.struct(F.col(time), -F.col(number))
    best = [F.max_by(c, order).alias(c) for c in rows.columns if c != key]
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(*best)


def get_by_ids(request: DataFrame, stored: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """(pos, key, fields): the stored fields of each asked key, null where it is missing."""
    return request.join(stored.select(key, *fields), key, "left").select("pos", key, *fields)


def filter_missing(request: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """The asked keys that are not stored."""
    return request.join(stored.select(key), key, "left_anti")


def edges_by_spec(specs: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges for (subject_id, object_id, relation_id); a null relation id asks for all parallel edges.

    One equi-join on the endpoints; specs without a match come back with a null id.
    """
    found = edges.select("subject_id", "object_id", F.col("id").alias("edge_id"))
    hit = F.col("relation_id").isNull() | (F.col("relation_id") == F.col("edge_id"))
    matched = specs.join(found, ["subject_id", "object_id"]).filter(hit)
    none = specs.join(matched.select("pos").distinct(), "pos", "left_anti").withColumn("edge_id", F.lit(None).cast("string"))
    columns = ["pos", "subject_id", "object_id", "relation_id", "edge_id"]
    return matched.select(*columns).unionAll(none.select(*columns))


def edge_specs(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(subject_id, object_id, relation_id) of the asked edge ids; unknown ids are left out."""
    found = edges.join(ids.select("id").distinct(), "id", "left_semi")
    return found.select("subject_id", "object_id", F.col("id").alias("relation_id"))


def hits_to_records(hits: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """Inner join of ranked hits with their records; hits without a record are dropped, the rank stays."""
    return hits.join(stored, key)


def default_text(value: Column, otherwise: str) -> Column:
    return F.when(value.isNull() | (F.trim(value) == ""), F.lit(otherwise)).otherwise(value)
