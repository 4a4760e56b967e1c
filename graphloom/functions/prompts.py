"""Prompt and context rendering as string expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: name -> system and user template; ``{field}`` stands for a column or a literal.
TEMPLATES: dict[str, tuple[str, str]] = {
    "artifact_extraction": ("Extract entities and relations as JSON.", "Language: {language}\nText:\n{context}"),
    "artifact_validation": ("Check the artifacts against the text.", "Text:\n{context}\nArtifacts:\n{artifacts}"),
    "entity_extraction": ("Extract entities as JSON.", "Language: {language}\nText:\n{context}"),
    "entity_validation": ("Check the entities against the text.", "Text:\n{context}\nEntities:\n{entities}"),
    "relation_extraction": ("Extract relations between the entities.", "Text:\n{context}\nEntities:\n{entities}"),
    "relation_validation": ("Check the relations against the text.", "Text:\n{context}\nRelations:\n{relations}"),
    "community_report": ("Write a report on a community.", "Entities:\n{entities}\nRelations:\n{relations}"),
    "entity_summarizer": ("Join the descriptions of an entity.", "{entity}:\n{description}"),
    "relation_summarizer": ("Join the descriptions of a relation.", "{subject} - {object}:\n{description}"),
    "cluster_summarize": ("Summarise the texts.", "{content}"),
    "global_search_context": ("Rate how far the report answers the query, 0 to 10.", "Query: {query}\nReport:\n{context}"),
    "global_search": ("Answer from the rated insights.", "Query: {query}\nInsights:\n{context}"),
    "local_search": ("Answer from the context.", "Query: {query}\nContext:\n{context}"),
    "naive_search": ("Answer from the chunks.", "Query: {query}\nChunks:\n{context}"),
    "mix_search": ("Answer from all contexts.", "Query: {query}\nContexts:\n{context}"),
    "mix_search_context": ("Join the engines' answers.", "Query: {query}\nAnswers:\n{context}"),
    "query_decomposition": ("Split the query into sub-queries.", "{query}"),
    "query_rewrite": ("Rewrite the sub-query with the answers it depends on.", "{query}\nAnswers:\n{context}"),
}
_FIELD = re.compile(r"\{(\w+)\}")


def fill(template: str, values: dict[str, Column]) -> Column:
    """The template with its fields filled; a field without a value raises ``KeyError``."""
    parts, at = [], 0
    for m in _FIELD.finditer(template):
        parts += [F.lit(template[at : m.start()]), F.coalesce(values[m[1]].cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def render(rows: DataFrame, name: str, templates: dict[str, tuple[str, str]] | None = None, **literals: str) -> DataFrame:
    """``rows`` plus ``messages``: one conversation per row; columns vary by row, literals are the same for all."""
    system, user = (templates or TEMPLATES)[name]
    values = {c: F.col(c) for c in rows.columns} | {k: F.lit(v) for k, v in literals.items()}
    message = lambda role, text: F.struct(F.lit(role).alias("role"), fill(text, values).alias("content"))
    return rows.withColumn("messages", F.array(message("system", system), message("user", user)))


def with_few_shots(rows: DataFrame, shots: list[tuple[str, str]]) -> DataFrame:
    """Example pairs (input, output) go before the last message."""
    pairs = [F.struct(F.lit(role).alias("role"), F.lit(text).alias("content")) for shot in shots for role, text in zip(("user", "assistant"), shot, strict=True)]
    m = F.col("messages")
    head, last = F.slice(m, 1, F.size(m) - 1), F.slice(m, F.size(m), 1)
    return rows.withColumn("messages", F.concat(head, F.array(*pairs), last)) if pairs else rows


def conversation_text(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


def entity_line(name: Column, kind: Column, description: Column) -> Column:
    return F.concat_ws(" | ", name, kind, description)


def relation_line(subject: Column, kind: Column, obj: Column, description: Column) -> Column:
    return F.concat_ws(" | ", subject, kind, obj, description)


def _entities_block(entities: Column) -> Column:
    line = lambda e: F.concat(F.lit("- "), e["entity_name"], F.lit(" ("), e["entity_type"], F.lit("): "), e["description"])
    return F.array_join(F.transform(entities, line), "\n")


def _relations_block(relations: Column) -> Column:
    def line(r: Column) -> Column:
        head = F.concat(F.lit("- "), r["source_entity"], F.lit(" → "), r["target_entity"], F.lit(" ("), r["relation_type"])
        return F.concat(head, F.lit(", strength: "), r["relationship_strength"].cast("string"), F.lit("): "), r["description"])

    return F.array_join(F.transform(relations, line), "\n")


def example_messages(kind: str, text: Column, output: Column) -> Column:
    """A few-shot pair (user, assistant) for one of six tasks from an example's text and output (entities, relations).

    ``kind`` is artifact, entity or relation and then _extraction or _validation.
    """
    what, step = kind.split("_")
    parts = {"artifact": output, "entity": F.struct(output["entities"].alias("entities")), "relation": F.struct(output["relations"].alias("relations"))}
    lists = {"entity": [("Entities", _entities_block(output["entities"]))], "relation": [("Relations", _relations_block(output["relations"]))]}
    lists["artifact"] = lists["entity"] + lists["relation"]
    if step == "extraction":
        asked = F.concat(F.lit("Text:\n"), text)
    elif what == "artifact":
        blocks = [F.when(block != "", F.concat(F.lit(f"{head}:\n"), block)) for head, block in lists[what]]
        asked = F.concat(F.lit("Triplets for validation:\n"), F.concat_ws("\n\n", *blocks), F.lit("\n\nText for validation:\n"), text)
    else:
        head, block = lists[what][0]
        shown = F.when(block == "", F.lit("(none)")).otherwise(block)
        asked = F.concat(F.lit(f"{head} for validation:\n"), shown, F.lit("\n\nText:\n"), text)
    pair = (("user", asked), ("assistant", F.to_json(parts[what])))
    return F.array(*[F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in pair])
