"""References to records that do not exist (problem 3).

Method: the foreign keys of all referring fields are reduced to their distinct
non-null values with the earliest referring time; an anti-join against the
parents' keys (plus the parents' first and last storing and the tombstones)
leaves the suspect keys, and only these are joined back to the referring rows.

A reference is an orphan when its key

* ``missing`` - is the id of no row of the target table,
* ``deleted`` - has a tombstone of its kind and no target row stored after its
  latest deletion,
* ``late`` - is first stored after the referring row.

Defined results: null and blank keys refer to nothing and never come out; a key
repeated in one row counts once; a null time of the referring row or of a whole
parent never makes a reference late; repeated parent rows count as one parent;
empty tables give an empty result (or, as parents, make every key missing);
extra columns are ignored because only the named ones are read. Rows are told
apart by ``rec_no``; exact repeats of a row give one result row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalar import tidy
from graphloom.session import materialize

#: Most suspect keys that are broadcast (about 60 bytes each); beyond, a salted join is used.
BROADCAST_KEYS = 200_000
#: Slices of each suspect key in the salted join.
SALTS = 16


@dataclass(frozen=True)
class Reference:
    """``field`` of the rows of ``rows`` (named ``table``) holds keys of ``kind``; arrays are exploded."""

    rows: DataFrame
    table: str
    field: str
    kind: str
    row_key: str = "rec_no"
    time: str = "ingested_at"


@dataclass(frozen=True)
class Parent:
    rows: DataFrame
    kind: str
    key: str = "id"
    time: str = "ingested_at"


def _referring(ref: Reference) -> DataFrame:
    is_array = ref.rows.schema[ref.field].dataType.typeName() == "array"
    keys = (
        F.explode(F.array_distinct(F.transform(F.col(ref.field), tidy))) if is_array else tidy(F.col(ref.field))
    )
    return ref.rows.select(
        F.lit(ref.table).alias("ref_table"),
        F.lit(ref.field).alias("ref_field"),
        F.lit(ref.kind).alias("kind"),
        F.col(ref.row_key).cast("long").alias("rec_no"),
        keys.alias("ref_key"),
        F.col(ref.time).alias("ref_time"),
    ).filter("ref_key is not null and ref_key <> ''")


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionAll(frame)
    return out


def orphan_references(
    references: Sequence[Reference], parents: Sequence[Parent], tombstones: DataFrame | None = None
) -> DataFrame:
    """(ref_table, ref_field, rec_no, ref_key, ref_time, reason), one row per referring row and orphan key.

    ``tombstones`` has (kind, id, deleted_at). Where several reasons hold, the
    first of missing, deleted, late is given.
    """
    refs = _union([_referring(r) for r in references])
    parent = _union(
        [
            p.rows.select(F.lit(p.kind).alias("kind"), tidy(F.col(p.key)).alias("ref_key"), F.col(p.time).alias("t"))
            for p in parents
        ]
    )
    stored = (
        parent.filter("ref_key is not null")
        .groupBy("kind", "ref_key")
        .agg(F.min("t").alias("first_stored"), F.max("t").alias("last_stored"), F.lit(True).alias("is_stored"))
    )
    used = refs.groupBy("kind", "ref_key").agg(F.min("ref_time").alias("first_used"))
    state = used.join(stored, ["kind", "ref_key"], "left")
    if tombstones is not None:
        deleted = tombstones.groupBy(
            tidy(F.col("kind")).alias("kind"), tidy(F.col("id")).alias("ref_key")
        ).agg(F.max("deleted_at").alias("last_deleted"))
        state = state.join(deleted, ["kind", "ref_key"], "left")
    else:
        state = state.withColumn("last_deleted", F.lit(None).cast("timestamp"))
    gone = F.when(F.col("is_stored").isNull(), "missing").when(
        F.col("last_deleted").isNotNull()
        & ~F.coalesce(F.col("last_stored") > F.col("last_deleted"), F.lit(False)),
        "deleted",
    )
    suspects = materialize(
        state.withColumn("gone", gone)
        .filter(F.col("gone").isNotNull() | (F.col("first_used") < F.col("first_stored")))
        .select("kind", "ref_key", "gone", "first_stored"),
        "suspects",
    )
    if suspects.count() <= BROADCAST_KEYS:
        joined = refs.join(F.broadcast(suspects), ["kind", "ref_key"])
    else:
        # A key may be used by a third of all rows: each suspect is copied to every slice, rows go to one.
        salted = suspects.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = refs.withColumn("slice", F.pmod(F.hash("rec_no"), F.lit(SALTS))).join(
            salted, ["kind", "ref_key", "slice"]
        )
    reason = F.coalesce(F.col("gone"), F.when(F.col("ref_time") < F.col("first_stored"), F.lit("late")))
    return (
        joined.withColumn("reason", reason)
        .filter("reason is not null")
        .select("ref_table", "ref_field", "rec_no", "ref_key", "ref_time", "reason")
        .dropDuplicates(["ref_table", "ref_field", "rec_no", "ref_key"])
    )


def orphan_report(orphans: DataFrame, period: str = "month") -> DataFrame:
    """Orphans and distinct orphan keys per table, field, reason and period of the referring row.

    Rows without a time fall under a null period.
    """
    return (
        orphans.withColumn("period", F.date_format(F.date_trunc(period, "ref_time"), "yyyy-MM-dd"))
        .groupBy("ref_table", "ref_field", "period", "reason")
        .agg(F.count("*").alias("orphan_refs"), F.countDistinct("ref_key").alias("orphan_keys"))
    )
