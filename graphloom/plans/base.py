"""Registry of the queries, and the tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.scalar import tidy
from graphloom.operators.lookup import latest
from graphloom.session import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Common table expressions of the oracle: the last stored row per id.
PRELUDE = """
ent as (select * from kg_entity where id is not null
        qualify row_number() over (partition by id order by ingested_at desc, rec_no) = 1),
rel as (select * replace (lower(trim(subject_id)) as subject_id, lower(trim(object_id)) as object_id) from kg_relation
        where id is not null qualify row_number() over (partition by id order by ingested_at desc, rec_no) = 1),
chk as (select * from kv_chunks where id is not null
        qualify row_number() over (partition by id order by ingested_at desc, rec_no) = 1),
com as (select * from kv_community where id is not null
        qualify row_number() over (partition by id order by ingested_at desc, rec_no) = 1),
summ as (select * from kv_community_summary where id is not null
        qualify row_number() over (partition by id order by ingested_at desc, rec_no) = 1)
"""


def query(sql: str | None = None, recursive: bool = False) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use the tables of PRELUDE."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            if any(f" {t} " in f" {' '.join(sql.replace('(', ' ').replace(')', ' ').replace(',', ' ').split())} " for t in ("ent", "rel", "chk", "com", "summ")):
                body = sql.strip()
                joint = ", " + body[5:] if body.lower().startswith("with ") else " " + body
                ORACLE[f.__name__] = ("with recursive " if recursive else "with ") + PRELUDE + joint
            else:
                ORACLE[f.__name__] = sql
        return f

    return add


def entities(spark: SparkSession, base: str) -> DataFrame:
    return latest(table(spark, base, "kg_entity"), "id")


def relations(spark: SparkSession, base: str) -> DataFrame:
    rows = latest(table(spark, base, "kg_relation"), "id")
    return rows.withColumns({c: tidy(F.col(c)) for c in ("subject_id", "object_id")})


def chunks(spark: SparkSession, base: str) -> DataFrame:
    return latest(table(spark, base, "kv_chunks"), "id")


def communities(spark: SparkSession, base: str) -> DataFrame:
    return latest(table(spark, base, "kv_community"), "id")


def summaries(spark: SparkSession, base: str) -> DataFrame:
    return latest(table(spark, base, "kv_community_summary"), "id")
