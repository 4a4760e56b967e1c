"""From model output or plain text to entity and relation mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalar import normal_type, sentences, strip

# Patterns by which a model says that there is no relation, for a search with case and Unicode folding.
NO_RELATION = [
    r"^\s*$",
    r"^\s*[\-–—]\s*$",
    r"^(?:[-•]\s*)?(?:отсутств\w*\s+(?:связ\w*|отнош\w*)|нет\s+(?:связ\w*|отнош\w*|информац\w*|данн\w*|сведен\w*))\b",
    r"\bтекст\s+не\s+содерж\w*\b",
    r"\b(?:текст\s+)?не\s+содерж\w*\s+информац\w*\s+о\b",
    r"\bнет\s+(?:информац\w*|сведен\w*|данн\w*)(?:\s+о\b|\b)",
    r"\bне\s+явля\w*\s+\w*отнош\w*",
    r"\bнет\s+\w*отнош\w*",
    r"\bотсутств\w*\s+\w*отнош\w*",
    r"\bне\s+содерж\w*\s+\w*отнош\w*",
    r"\bнет\s+явн\w*\s+\w*отнош\w*",
    r"\bнет\s+\w*связ\w*",
    r"\bотсутств\w*\s+\w*связ\w*",
    r"\bсвяз\w*\s+не\s+(?:установ\w*|прослежива\w*|подтвержд\w*|обнаруж\w*)",
    r"\bотнош\w*\s+не\s+(?:установ\w*|прослежива\w*|подтвержд\w*|обнаруж\w*)",
    r"\bне[^.\n]{0,60}(?:содерж\w*|ука\w*|упомина\w*|найд\w*|обнаруж\w*|подтвержд\w*|установ\w*|прослеж\w*)[^.\n]{0,80}(?:связ\w*|отнош\w*|информац\w*)",
]
BULLET = r"^[\-•]\s*"


def entity_mentions(chunks: DataFrame) -> DataFrame:
    """Rule-based default extractor: capitalised words of four letters or more, with their sentence."""
    parts = chunks.filter("content is not null").select(
        F.col("id").alias("chunk_id"), F.posexplode(sentences(F.col("content"))).alias("sentence_no", "sentence")
    )
    words = F.filter(F.regexp_extract_all("sentence", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.regexp_like(w, F.lit(r"^\p{Lu}\p{L}{3,}$")))
    return parts.select("chunk_id", "sentence_no", "sentence", F.posexplode(words).alias("word_no", "entity_name"))


def lines_to_entities(text: Column) -> Column:
    """Lines of a model's answer, stripped, blanks dropped, distinct in order."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.array_distinct(F.filter(lines, lambda x: x != ""))


def resolve_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations both names of which are entities of the same chunk; the last entity of a name counts.

    ``entities`` has (chunk_id, entity_name, entity_id, pos), ``relations``
    (chunk_id, source_entity, target_entity, ...).
    """
    last = entities.groupBy("chunk_id", "entity_name").agg(F.max_by("entity_id", "pos").alias("entity_id"))
    subject = last.select("chunk_id", F.col("entity_name").alias("source_entity"), F.col("entity_id").alias("subject_id"))
    target = last.select("chunk_id", F.col("entity_name").alias("target_entity"), F.col("entity_id").alias("object_id"))
    return relations.join(subject, ["chunk_id", "source_entity"]).join(target, ["chunk_id", "target_entity"])


def ordered_pairs(mentions: DataFrame, group: str, name: str, pos: str) -> DataFrame:
    """All ordered pairs of different mentions of a group: n (n - 1) rows, as many candidates as are asked about.

    Groups are single chunks, whose mentions are bounded by the chunk size.
    """
    left = mentions.select(group, F.col(pos).alias("pos_a"), F.col(name).alias("name_a"))
    right = mentions.select(group, F.col(pos).alias("pos_b"), F.col(name).alias("name_b"))
    return left.join(right, group).filter("pos_a <> pos_b")


def without_bullet(text: Column) -> Column:
    return F.regexp_replace(strip(text), BULLET, "")


def states_relation(text: Column) -> Column:
    """False for null, empty and negating descriptions (without their leading bullet)."""
    body = without_bullet(text)
    return F.coalesce((body != "") & ~F.regexp_like(body, F.lit("(?iuU)" + "|".join(NO_RELATION))), F.lit(False))


def typed(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn(column, normal_type(F.col(column)))


def normal_tokens(text: Column, stop: list[str] | None = None, least: int = 2) -> Column:
    """Words in lower case of at least ``least`` letters, without numbers and stop words (a lemmatiser is pluggable)."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    keep = lambda w: (F.length(w) >= least) & ~F.regexp_like(w, F.lit(r"^[0-9]+$"))
    kept = F.filter(words, keep)
    return F.array_except(kept, F.array(*[F.lit(s) for s in stop])) if stop else kept


def number_within(rows: DataFrame, group: str, *order: str, name: str = "n") -> DataFrame:
    """0-based rank within a group."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)
