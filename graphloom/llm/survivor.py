"""Best representative of each duplicate group (problem 5).

Every group of rows with the same ``id`` becomes one record whose fields are
chosen one by one. No group is ever collected: each choice is a ``max`` over an
ordering struct, which Spark aggregates on the map side, so an id that holds a
third of all rows costs no more than any other.

Recency is where currency reasoning comes in. Value-transition precedence is
learned from the timestamped rows, always: per group and *state* (the tidied extractor that wrote the
row), only the first and last time are kept; where all rows of state a precede
all rows of state b the group votes a < b. Majorities over all groups give a
directed graph over the states (a bounded set: those of the trust table, and
``other``), whose topological layers rank them. Within a group of rows of equal
merit, two rows that both have a time are ordered by it, all others by the
learned order: the latest timestamped row (state s) competes with the
topologically latest row without a time (state u), and the latter wins only if
s precedes u, or if the group has no timestamped candidate.

A description that is just a name of its entity, the row's own or one another
row of the group has, says nothing.

Defined results: null ids form no group; ids with a single row give no record;
a field no row qualifies for gives row number 0; null or unlisted extractors
have trust 0; null and blank array elements do not count; ties go to the latest
time, then to the smallest ``rec_no``; exact repeats of a row tie on everything;
extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalar import tidy
from graphloom.session import materialize

# Descriptions that say nothing, compared in lower case without punctuation at the end.
FILLERS = [
    "description missing", "empty", "fixme", "missing", "n.a", "n/a", "na", "nan", "nil", "no data",
    "no description", "no description available", "none", "not available", "null", "tba", "tbd", "to be added",
    "to be determined", "to be filled in", "todo", "unknown", "без описания", "не указано", "неизвестно", "нет",
    "нет данных", "нет описания", "описание отсутствует", "отсутствует", "уточняется",
]

OTHER = "other"
#: Extractors of the trust table; more raise, as the order learned over them is kept on the driver.
MAX_STATES = 1000
#: Descriptions that only repeat another row's name, up to which they are broadcast; beyond, they are joined by shuffle.
MAX_BROADCAST = 100_000


def bare(text: Column) -> Column:
    """Without case, outer blanks and punctuation; blanks collapsed."""
    edges = r"(?U)^[\s\p{P}]+|[\s\p{P}]+$"
    return F.regexp_replace(F.regexp_replace(F.lower(text), edges, ""), r"(?U)\s+", " ")


def says_something(text: Column, name: Column) -> Column:
    """False for null, blank or letterless text, fillers, and the bare name."""
    body = bare(text)
    return (
        text.isNotNull()
        & F.regexp_like(text, F.lit(r"[\p{L}\p{N}]"))
        & ~body.isin(FILLERS)
        & ~F.coalesce(body == bare(name), F.lit(False))
    )


def _just_names(entities: DataFrame) -> DataFrame:
    """(id, words): descriptions, as numbers of their bare form, that are the name some other row of the id has."""
    rows = entities.filter("id is not null")
    told = rows.filter(says_something(F.col("description"), F.col("entity_name"))).select("id", F.xxhash64(bare(F.col("description"))).alias("words"))
    names = rows.filter(F.regexp_like("entity_name", F.lit(r"[\p{L}\p{N}]"))).select("id", F.xxhash64(bare(F.col("entity_name"))).alias("words"))
    return told.join(names.distinct(), ["id", "words"], "left_semi").distinct()


def distinct_keys(keys: Column) -> Column:
    """Distinct tidied keys, without nulls and blanks; an empty array for a null one."""
    cleaned = F.array_distinct(F.filter(F.transform(keys, tidy), lambda k: k.isNotNull() & (k != "")))
    return F.coalesce(cleaned, F.array().cast("array<string>"))


def _order(pairs: dict[tuple[str, str], int], states: list[str]) -> tuple[dict[str, int], set[tuple[str, str]]]:
    """Topological layer of each state, and the transitive precedence, from the votes.

    An edge needs a majority; edges are added from the clearest on and skipped
    where they would close a cycle.
    """
    after: dict[str, set[str]] = {s: set() for s in states}

    def reaches(a: str, b: str) -> bool:
        return b in after[a] or any(reaches(x, b) for x in after[a])

    ranked = sorted(((n - pairs.get((b, a), 0), a, b) for (a, b), n in pairs.items()), key=lambda x: (-x[0], x[1:]))
    for lead, a, b in ranked:
        if lead > 0 and a != b and not reaches(b, a):
            after[a].add(b)
    rank = dict.fromkeys(states, 0)
    for _ in states:
        for a in states:
            for b in after[a]:
                rank[b] = max(rank[b], rank[a] + 1)
    return rank, {(a, b) for a in states for b in states if reaches(a, b)}


def learn_currency(rows: DataFrame) -> tuple[dict[str, int], set[tuple[str, str]]]:
    """Precedence between the states, from (id, state, t). One row per pair of states reaches the driver."""
    spans = rows.filter("t is not null").groupBy("id", "state").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    per_id = spans.groupBy("id").agg(F.collect_list(F.struct("state", "first", "last")).alias("s")).filter("size(s) > 1")
    votes = (
        per_id.select(F.explode("s").alias("a"), "s")
        .select("a", F.explode("s").alias("b"))
        .filter("a.last < b.first")
        .groupBy(F.col("a.state").alias("a"), F.col("b.state").alias("b"))
        .count()
        .collect()
    )
    pairs = {(v["a"], v["b"]): v["count"] for v in votes}
    return _order(pairs, sorted({s for p in pairs for s in p}))


def survivors(entities: DataFrame, trust: DataFrame) -> DataFrame:
    """(id, description_rec, chunks_rec, documents_rec, description, source_chunk_id, documents_id).

    The ``*_rec`` columns name the row each field survives from, 0 for none.
    """
    listed = (
        trust.select(tidy(F.col("extractor")).alias("state"), F.col("trust").cast("int").alias("trust"))
        .filter("state is not null")
        .groupBy("state")
        .agg(F.max("trust").alias("trust"))
    )
    # The trust table has a handful of rows; its states bound the size of the learned order.
    levels = {r["state"]: r["trust"] or 0 for r in listed.limit(MAX_STATES + 1).collect()}
    if len(levels) > MAX_STATES:
        raise ValueError(f"more than {MAX_STATES} extractors in the trust table")
    state = tidy(F.col("extractor"))
    known = F.coalesce(state.isin(list(levels) or [OTHER]), F.lit(False))
    level = F.lit(0)
    for name, value in sorted(levels.items()):
        level = F.when(state == name, F.lit(value)).otherwise(level)
    names = materialize(_just_names(entities), "names")
    hollow = names.withColumn("hollow", F.lit(True))
    hollow = F.broadcast(hollow) if names.count() <= MAX_BROADCAST else hollow
    told = says_something(F.col("description"), F.col("entity_name"))
    rows = (
        entities.filter("id is not null")
        .withColumn("words", F.when(told, F.xxhash64(bare(F.col("description")))))
        .join(hollow, ["id", "words"], "left")
        .select(
            "id",
            F.col("rec_no").cast("long").alias("rec_no"),
            F.col("ingested_at").alias("t"),
            F.when(known, state).otherwise(F.lit(OTHER)).alias("state"),
            level.alias("trust"),
            F.when(F.col("words").isNotNull() & F.col("hollow").isNull(), F.col("description")).alias("description"),
            "source_chunk_id",
            F.size(distinct_keys(F.col("source_chunk_id"))).alias("n_chunks"),
            "documents_id",
            (F.size(distinct_keys(F.col("documents_id"))) > 0).alias("has_docs"),
        )
    )
    rank, before = learn_currency(entities.filter("id is not null").select("id", F.when(known, state).otherwise(F.lit(OTHER)).alias("state"), F.col("ingested_at").alias("t")))
    layer = F.lit(0)
    for name, value in sorted(rank.items()):
        layer = F.when(F.col("state") == name, F.lit(value)).otherwise(layer)
    rows = rows.withColumn("layer", layer)

    def best(name: str, ok: Column, merit: list[Column], value: str) -> list[Column]:
        """The best dated and the best undated row; ``pick`` decides between them."""
        tail = [F.col("state"), F.col(value).alias("value")]
        dated = F.struct(*merit, F.col("t").alias("t"), (-F.col("rec_no")).alias("r"), *tail)
        undated_ = F.struct(*merit, F.col("layer").alias("t"), (-F.col("rec_no")).alias("r"), *tail)
        return [
            F.max(F.when(ok & F.col("t").isNotNull(), dated)).alias(f"{name}_d"),
            F.max(F.when(ok & F.col("t").isNull(), undated_)).alias(f"{name}_u"),
        ]

    aggs = [
        F.count("*").alias("n"),
        *best("de", F.col("description").isNotNull(), [F.col("trust").alias("m")], "description"),
        *best("ch", F.col("n_chunks") > 0, [F.col("n_chunks").alias("m")], "source_chunk_id"),
        *best("do", F.col("has_docs"), [F.lit(0).alias("m")], "documents_id"),
    ]
    grouped = rows.groupBy("id").agg(*aggs).filter("n > 1")
    later = [f"{a}>{b}" for a, b in sorted(before)]

    def pick(name: str) -> Column:
        d, u = F.col(f"{name}_d"), F.col(f"{name}_u")
        keep = lambda c: F.struct((-c["r"]).alias("rec"), c["value"].alias("value"))
        newer = F.concat_ws(">", d["state"], u["state"]).isin(later or [""])
        wins = d.isNull() | (u["m"] > d["m"]) | ((u["m"] == d["m"]) & newer)
        return F.when(u.isNotNull() & wins, keep(u)).otherwise(keep(d))

    out = grouped.select("id", pick("de").alias("de"), pick("ch").alias("ch"), pick("do").alias("do"))
    rec = lambda c: F.coalesce(F.col(f"{c}.rec"), F.lit(0).cast("long"))
    return out.select(
        "id",
        rec("de").alias("description_rec"),
        rec("ch").alias("chunks_rec"),
        rec("do").alias("documents_rec"),
        F.col("de.value").alias("description"),
        F.col("ch.value").alias("source_chunk_id"),
        F.col("do.value").alias("documents_id"),
    )
