"""The queries of the problems solved here, over the whole tables of a data directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import abuse, leakage, mixing, names, neighbours, repetition, splitter, survivor
from graphloom.session import table


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return neighbours.neighbour_pairs(neighbours.nearest_neighbours(table(spark, base, "vdb_entity"), min_cosine=0.8))


def p1_neighbours(spark: SparkSession, base: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, base, "vdb_entity"))


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return names.variant_pairs(p2_entities(spark, base))


def p2_entities(spark: SparkSession, base: str) -> DataFrame:
    return names.entities_of_names(table(spark, base, "kg_entity"), table(spark, base, "kg_relation"))


def _texts(spark: SparkSession, base: str) -> DataFrame:
    part = lambda name, column: table(spark, base, name).select(
        F.lit(name).alias("src_table"), F.col("rec_no").cast("long").alias("rec_no"), F.col(column).alias("text")
    )
    return part("kv_community_summary", "summary").unionAll(part("kg_entity", "description"))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    scored = repetition.score_repetition(_texts(spark, base), ["src_table", "rec_no"], "text")
    return repetition.repetitive(scored).select("src_table", "rec_no").distinct()


def p4_shares(spark: SparkSession, base: str) -> DataFrame:
    scored = repetition.score_repetition(_texts(spark, base), ["src_table", "rec_no"], "text")
    return scored.select("src_table", "rec_no", F.round("share", 6).alias("share"))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return p5_records(spark, base).select("id", "description_rec", "chunks_rec", "documents_rec")


def p5_records(spark: SparkSession, base: str) -> DataFrame:
    return survivor.survivors(table(spark, base, "kg_entity"), table(spark, base, "extractor_trust"))


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return p6_pieces(spark, base).select("rec_no").distinct()


def p6_pieces(spark: SparkSession, base: str) -> DataFrame:
    return splitter.split_oversized(table(spark, base, "kv_chunks"))


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return p7_leaks(spark, base).select("doc_id", "item_id").distinct()


def p7_leaks(spark: SparkSession, base: str) -> DataFrame:
    return leakage.leaks(table(spark, base, "documents"), table(spark, base, "eval_item"))


def p8_mixture(spark: SparkSession, base: str) -> DataFrame:
    return mixing.mixture(table(spark, base, "documents"), table(spark, base, "mix_target"))


def p8_shares(spark: SparkSession, base: str) -> DataFrame:
    return mixing.share_report(p8_mixture(spark, base), table(spark, base, "mix_target"))


def p9_scores(spark: SparkSession, base: str) -> DataFrame:
    documents = table(spark, base, "documents")
    return abuse.score_abuse(documents, abuse.fit(documents, table(spark, base, "doc_review")))


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    return p9_scores(spark, base).filter("flagged").select("doc_id").distinct()


def p9_rates(spark: SparkSession, base: str) -> DataFrame:
    return abuse.source_rates(p9_scores(spark, base))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [
        p1_found, p1_neighbours, p2_found, p2_entities, p4_found, p4_shares, p5_found, p5_records, p6_found,
        p6_pieces, p7_found, p7_leaks, p8_mixture, p8_shares, p9_found, p9_scores, p9_rates,
    ]
    return {f.__name__: f for f in every}
