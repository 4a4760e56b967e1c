"""Variant spellings of names typed by people (problem 2).

Merge-and-rematch resolution over DataFrames. Every distinct spelling is read
into a profile (see ``spelling``); equal readings are one profile from the
start. Profiles meet in blocks: they share a core, or have cores up to two typing
errors apart (:func:`near_pairs`), and a letter of their rests. Pairs that agree
are links. In each round a profile proposes to the fullest of its best partners;
it merges unless its partners contradict one another or the partner has a rival
at least as near that contradicts it (the initials of two cousins). A merged
profile has all cores of both, and the fuller of every given name or initial;
its links are compared anew, so that it may now tell apart what its parts could
not. When no link merges any more the merged profiles re-enter blocking with
their united cores and rests; it ends once that leads to no further merge.

Nothing but the names is proof: record ids and the ids relations use are not
read. Entity types settle whether a spelling names a person, and which of the
common words are given names; which words are common is learned from all
spellings (those in at least ``SHARE`` of them, so that their number is
bounded).

No group reaches one task whole: blocks of more than ``TILE`` profiles are cut
into pairs of parts, a profile and those that merge into it are folded one after
another, and every table of a round is written to the shared folder.

Defined results: null names and names without letters or digits name nothing; a
spelling stored in many rows counts once; null, blank and unknown types say
nothing; extra columns are ignored; empty tables give an empty result; spellings
of any length are read whole; ties are broken by code point order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalar import normal_type
from graphloom.llm.arrow import map_batches
from graphloom.llm.spelling import Alternative, Vocabulary, core_gap, fit, near_keys, read_name, rest_keys, unite, words_of
from graphloom.session import drop_materialized, materialize

#: A word is common if it occurs in this share of the spellings, and in FEWEST of them.
SHARE, FEWEST = 0.0006, 12
#: Typed spellings a word must stand in before their types say something of it.
TYPED = 3
#: Profiles of a block that one task compares with one another.
TILE = 2000

_ALTS = "array<struct<cores:array<string>,rest:array<string>,person:boolean>>"
_PROFILE = f"pid string, full int, alts {_ALTS}"


def mentions(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(name, kinds): distinct spellings with the entity types they are stored with."""
    none = F.lit(None).cast("string")
    parts = [
        entities.select(F.col("entity_name").alias("name"), F.upper(normal_type(F.col("entity_type"))).alias("kind")),
        relations.select(F.col("subject_name").alias("name"), none.alias("kind")),
        relations.select(F.col("object_name").alias("name"), none.alias("kind")),
    ]
    rows = parts[0].unionAll(parts[1]).unionAll(parts[2])
    blank = r"(?U)^[^\p{L}\p{N}]*$"
    return (
        rows.filter(F.col("name").isNotNull() & ~F.regexp_like("name", F.lit(blank)))
        .withColumn("kind", F.when(F.col("kind").isNotNull() & ~F.col("kind").isin("UNKNOWN", ""), F.col("kind")))
        .distinct()
        .groupBy("name")
        .agg(F.sort_array(F.collect_set("kind")).alias("kinds"))  # a handful of types
    )


def _common(names: DataFrame) -> dict[str, float | None]:
    """The common words with their share of persons; fewer than 1 / SHARE words a name's length reach the driver."""

    def words(columns):
        out: dict[str, list] = {"word": [], "typed": [], "person": []}
        for name, kinds in zip(columns["name"].to_pylist(), columns["kinds"].to_pylist(), strict=True):
            for w in {w.form for w in words_of(name) if len(w.form) > 1}:
                out["word"].append(w)
                out["typed"].append(int(bool(kinds)))
                out["person"].append(int("PERSON" in kinds))
        return out

    least = max(FEWEST, int(SHARE * names.count()))
    counted = map_batches(names, "word string, typed int, person int", words).groupBy("word")
    rows = counted.agg(F.count("*").alias("n"), F.sum("typed").alias("typed"), F.sum("person").alias("person")).filter(F.col("n") >= least)
    return {r["word"]: r["person"] / r["typed"] if r["typed"] >= TYPED else None for r in rows.collect()}


def _pack(alts: tuple[Alternative, ...]) -> list[dict]:
    return [{"cores": list(a.cores), "rest": list(a.rest), "person": a.person} for a in alts]


def _unpack(rows: list[dict]) -> tuple[Alternative, ...]:
    return tuple(Alternative(tuple(r["cores"]), tuple(r["rest"]), r["person"]) for r in rows)


def _full(alts: tuple[Alternative, ...]) -> int:
    return max((a.full() for a in alts), default=0)


def _sorted_groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[dict]]:
    """Runs of rows that are equal in the first ``width`` columns, out of sorted batches."""
    held: list[dict] = []
    last = None
    for batch in batches:
        names = batch.schema.names[:width]
        for row in batch.to_pylist():
            key = tuple(row[n] for n in names)
            if key != last and held:
                yield held
                held = []
            last = key
            held.append(row)
    if held:
        yield held


def near_pairs(cores: DataFrame) -> DataFrame:
    """(a, b): the pairs of different ``core`` that ``core_gap`` accepts."""

    def keys(columns):
        out: dict[str, list] = {"core": columns["core"].to_pylist(), "key": []}
        for core in out["core"]:
            out["key"].append(sorted(near_keys(core)))
        return out

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gap = lru_cache(maxsize=200_000)(core_gap)
        held: list[tuple[np.ndarray, np.ndarray]] = []  # the rows of the last key so far

        def found(key: np.ndarray, core: np.ndarray) -> pa.RecordBatch:
            ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
            starts = np.concatenate(([0], ends[:-1]))
            pairs = set()
            for lo, hi in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                group = sorted(set(core[lo:hi]))
                pairs |= {(a, b) for n, a in enumerate(group) for b in group[n + 1 :] if gap(a, b) <= 2}
            a, b = zip(*sorted(pairs), strict=True) if pairs else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])

        for batch in batches:
            key, core = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))
            if held and (cut or held[0][0][0] != key[-1]):
                held.append((key[:cut], core[:cut]))
                yield found(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
            elif cut:
                yield found(key[:cut], core[:cut])
            held.append((key[cut:], core[cut:]))
        if held:
            yield found(*(np.concatenate(x) for x in zip(*held, strict=True)))

    keyed = map_batches(cores.select("core").distinct(), "core string, key array<string>", keys)
    # keys travel as numbers: those that coincide by chance are told apart by the comparison
    keyed = keyed.select(F.explode("key").alias("key"), "core").select(F.xxhash64("key").alias("key"), "core")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a string, b string").distinct()


_LINK = "a string, b string, gap int, words int, full_a int, full_b int"


def _links(rows: list[tuple[str, tuple[Alternative, ...], str, tuple[Alternative, ...]]]) -> pa.RecordBatch:
    """The pairs that agree, the smaller id first."""
    out: dict[str, list] = {c.split()[0]: [] for c in _LINK.split(", ")}
    for p, x, q, y in rows:
        if q < p:
            p, x, q, y = q, y, p, x
        own = fit(x, y)
        if own is not None:
            for c, v in zip(out, (p, q, own[0], own[1], _full(x), _full(y)), strict=True):
                out[c].append(v)
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))


def block_links(profiles: DataFrame, near: DataFrame) -> DataFrame:
    """Links of all pairs of profiles that agree: blocks by core (or pair of near cores) and letter of the rest."""

    def keys(columns):
        out: dict[str, list] = {"pid": [], "core": [], "letters": [], "alts": []}
        for pid, alts in zip(columns["pid"].to_pylist(), columns["alts"].to_pylist(), strict=True):
            letters: dict[str, set[str]] = {}
            for a in alts:
                for core in a["cores"]:
                    letters.setdefault(core, set()).update(rest_keys(tuple(a["rest"])))
            for core, own in letters.items():
                for c, v in zip(out, (pid, core, sorted(own), alts), strict=True):
                    out[c].append(v)
        return out

    keyed = map_batches(profiles.select("pid", "alts"), f"pid string, core string, letters array<string>, alts {_ALTS}", keys)
    # side 2: every pair of a core's profiles; 0 and 1: the profiles of two near cores with one another
    same = F.struct(F.lit(None).cast("string").alias("other"), F.lit(2).alias("side"))
    around = near.select(F.col("a").alias("core"), F.struct(F.col("b").alias("other"), F.lit(0).alias("side")).alias("link")).unionAll(
        near.select(F.col("b").alias("core"), F.struct(F.col("a").alias("other"), F.lit(1).alias("side")).alias("link"))
    )
    rows = keyed.withColumn("link", same).unionByName(keyed.join(around, "core"))
    pair = F.array_sort(F.array("core", F.coalesce("link.other", "core")))
    rows = rows.select("pid", "alts", F.col("link.side").alias("side"), pair.alias("pair"), F.explode("letters").alias("letter"))
    rows = rows.select(F.xxhash64("pair", "letter").alias("block"), "side", "pid", "alts")
    # a block needs two profiles; large ones are cut into parts, and each pair of parts is compared by itself
    sizes = rows.groupBy("block").agg(F.count("*").alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / TILE).cast("int")
    own = F.pmod(F.xxhash64("pid"), parts).cast("int")
    rows = rows.join(sizes, "block").select("block", "side", "pid", "alts", own.alias("part"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("with"))
    rows = rows.select("block", F.least("part", "with").alias("p"), F.greatest("part", "with").alias("q"), "pid", "side", "part", "alts")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo = []
        for group in _sorted_groups(batches, 3):
            alts = [_unpack(r["alts"]) for r in group]
            inside = group[0]["p"] == group[0]["q"]
            for i, r in enumerate(group):
                for j in range(i):
                    s = group[j]
                    if r["pid"] != s["pid"] and (inside or r["part"] != s["part"]) and (r["side"] == 2 or r["side"] != s["side"]):
                        todo.append((s["pid"], alts[j], r["pid"], alts[i]))
                if len(todo) > 10_000:
                    yield _links(todo)
                    todo = []
        yield _links(todo)

    ordered = rows.repartition("block", "p", "q").sortWithinPartitions("block", "p", "q", "pid")
    return ordered.mapInArrow(compare, _LINK).distinct()


def _rescored(links: DataFrame, profiles: DataFrame) -> DataFrame:
    """Links (a, b) compared anew by the profiles as they are now."""
    left = profiles.select(F.col("pid").alias("a"), F.col("alts").alias("alts_a"))
    right = profiles.select(F.col("pid").alias("b"), F.col("alts").alias("alts_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _links([(r["a"], _unpack(r["alts_a"]), r["b"], _unpack(r["alts_b"])) for r in batch.to_pylist()])

    return links.select("a", "b").distinct().join(left, "a").join(right, "b").select("a", "b", "alts_a", "alts_b").mapInArrow(run, _LINK)


def _proposals(links: DataFrame) -> DataFrame:
    """(pid, into): the profiles that may merge in this round, each into one that itself stays."""
    out = links.select(F.col("a").alias("i"), F.col("b").alias("j"), "gap", "words", F.col("full_a").alias("full_i"), F.col("full_b").alias("full_j"))
    both = out.unionAll(out.select(F.col("j").alias("i"), F.col("i").alias("j"), "gap", "words", F.col("full_j").alias("full_i"), F.col("full_i").alias("full_j")))
    # the best partners of each, and of them the fullest, the smallest on ties
    best = both.groupBy("i").agg(F.min(F.struct("gap", "words", (-F.col("full_j")).alias("empty"), "j")).alias("r"), F.first("full_i").alias("full_i"))
    best = best.select("i", "full_i", F.col("r.gap").alias("gap"), F.col("r.words").alias("words"), F.col("r.j").alias("into"), (-F.col("r.empty")).alias("full_into"))
    known = both.select("i", "j")
    # partners as near that do not agree with that one contradict it
    others = both.select("i", "j", "gap", "words").join(best.select("i", "gap", "words", "into"), ["i", "gap", "words"]).filter("j <> into")
    torn = others.join(known.select(F.col("i").alias("into"), "j"), ["into", "j"], "left_anti").select("i")
    upward = (F.col("full_into") > F.col("full_i")) | ((F.col("full_into") == F.col("full_i")) & (F.col("into") < F.col("i")))
    ready = best.filter(upward).join(torn, "i", "left_anti")
    # rivals: what the partner fits as well or better must agree with the proposer
    around = both.select(F.col("i").alias("into"), F.col("j").alias("x"), F.col("gap").alias("gap_x"), F.col("words").alias("words_x"))
    nearer = (F.col("gap_x") < F.col("gap")) | ((F.col("gap_x") == F.col("gap")) & (F.col("words_x") <= F.col("words")))
    rivals = ready.join(around, "into").filter(nearer & (F.col("x") != F.col("i"))).select("i", "x")
    blocked = rivals.join(known.withColumnRenamed("j", "x"), ["i", "x"], "left_anti").select("i")
    free = ready.join(blocked, "i", "left_anti").select(F.col("i").alias("pid"), "into")
    return free


def _merged(profiles: DataFrame, moves: DataFrame) -> DataFrame:
    """(pid, into, full, alts): the profiles of ``moves`` folded into their targets one after another.

    A profile whose merge an earlier one of the round has made impossible stays
    as it is.
    """
    children = moves.join(profiles, "pid").select("into", F.lit(1).alias("turn"), "pid", "full", "alts")
    roots = profiles.join(moves.select(F.col("into").alias("pid")).distinct(), "pid", "left_semi")
    rows = children.unionAll(roots.select(F.col("pid").alias("into"), F.lit(0).alias("turn"), "pid", "full", "alts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: tuple[str, tuple[Alternative, ...]] | None = None
        done: list[dict] = []

        def close() -> None:
            if state is not None:
                done.append({"pid": state[0], "into": state[0], "full": _full(state[1]), "alts": _pack(state[1])})

        for batch in batches:
            for row in batch.to_pylist():
                own = _unpack(row["alts"])
                if state is None or row["into"] != state[0]:
                    close()
                    state = (row["pid"], own)
                    continue
                both = unite(state[1], own)
                if both:
                    state = (state[0], both)
                    done.append({"pid": row["pid"], "into": state[0], "full": None, "alts": None})
                else:
                    done.append({"pid": row["pid"], "into": row["pid"], "full": row["full"], "alts": row["alts"]})
            yield pa.RecordBatch.from_pylist(done, schema=fields)
            done = []
        close()
        yield pa.RecordBatch.from_pylist(done, schema=fields)

    item = pa.struct([("cores", pa.list_(pa.string())), ("rest", pa.list_(pa.string())), ("person", pa.bool_())])
    fields = pa.schema([("pid", pa.string()), ("into", pa.string()), ("full", pa.int32()), ("alts", pa.list_(item))])
    ordered = rows.repartition("into").sortWithinPartitions("into", "turn", F.desc("full"), "pid")
    return ordered.mapInArrow(run, f"pid string, into string, full int, alts {_ALTS}")


def entities_of_names(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(name, entity): every distinct spelling with the smallest spelling of its entity."""
    spark = entities.sparkSession
    names = materialize(mentions(entities, relations), "mentions")
    vocabulary = spark.sparkContext.broadcast(_common(names))
    built: list[Vocabulary] = []

    def read(columns):
        if not built:
            built.append(Vocabulary(vocabulary.value))
        out: dict[str, list] = {"name": columns["name"].to_pylist(), "reading": [], "full": [], "alts": []}
        for name, kinds in zip(out["name"], columns["kinds"].to_pylist(), strict=True):
            alts = read_name(name, built[0], kinds)
            out["reading"].append(repr(alts))
            out["full"].append(_full(alts))
            out["alts"].append(_pack(alts))
        return out

    readings = materialize(map_batches(names, f"name string, reading string, full int, alts {_ALTS}", read), "readings")
    # one reading is one profile, called by its smallest spelling
    forms = readings.groupBy("reading").agg(F.min("name").alias("pid"), F.first("full").alias("full"), F.first("alts").alias("alts"))
    forms = materialize(forms, "profiles")
    cores = forms.select(F.explode(F.flatten("alts.cores")).alias("core")).distinct()
    near = materialize(near_pairs(cores), "near")

    profiles = forms.select("pid", "full", "alts")
    held = [names, forms, near]
    moves: list[DataFrame] = []
    while True:
        links = materialize(block_links(profiles, near), "links")
        before = len(moves)
        while True:
            free = materialize(_proposals(links), "free")
            # who is merged into stays for this round
            chosen = free.join(free.select(F.col("pid").alias("into")), "into", "left_anti").select("pid", "into")
            changed = materialize(_merged(profiles, chosen), "merged")
            drop_materialized(free)
            moved = changed.filter("pid <> into").select("pid", "into")
            if moved.limit(1).count() == 0:
                drop_materialized(changed)
                break
            moves.append(moved)
            held.append(changed)
            kept = changed.filter("pid = into").select("pid", "full", "alts")
            touched = changed.select("pid")
            old_profiles, old_links = profiles, links
            profiles = materialize(old_profiles.join(touched, "pid", "left_anti").unionByName(kept), "profiles")
            to_a = moved.select(F.col("pid").alias("a"), F.col("into").alias("new_a"))
            to_b = moved.select(F.col("pid").alias("b"), F.col("into").alias("new_b"))
            grown = kept.select("pid").join(moved.select(F.col("into").alias("pid")).distinct(), "pid", "left_semi")
            marks = moved.select("pid").unionAll(grown)
            fresh_a = marks.select(F.col("pid").alias("a"), F.lit(True).alias("fresh_a"))
            fresh_b = marks.select(F.col("pid").alias("b"), F.lit(True).alias("fresh_b"))
            marked = old_links.join(fresh_a, "a", "left").join(fresh_b, "b", "left")
            fresh = F.col("fresh_a").isNotNull() | F.col("fresh_b").isNotNull()
            same = marked.filter(~fresh).select(*old_links.columns)
            new_a, new_b = F.coalesce("new_a", "a"), F.coalesce("new_b", "b")
            again = marked.filter(fresh).select("a", "b").join(to_a, "a", "left").join(to_b, "b", "left")
            again = again.select(F.least(new_a, new_b).alias("a"), F.greatest(new_a, new_b).alias("b")).filter("a <> b")
            links = materialize(same.unionByName(_rescored(again, profiles)), "links")
            drop_materialized(old_links)
            if len(moves) > 1:
                drop_materialized(old_profiles)
        drop_materialized(links)
        if len(moves) == before:
            break
    # from readings to final profiles, round by round
    final = forms.select("reading", F.col("pid").alias("at"))
    for moved in moves:
        step = moved.select(F.col("pid").alias("at"), "into")
        final = final.join(step, "at", "left").select("reading", F.coalesce("into", "at").alias("at"))
    named = materialize(readings.select("name", "reading").join(final, "reading").select("name", "at"), "named")
    for df in [*held, readings, *([profiles] if moves else [])]:
        drop_materialized(df)
    least = named.groupBy("at").agg(F.min("name").alias("entity"))
    return named.join(least, "at").select("name", "entity")


def variant_pairs(resolved: DataFrame) -> DataFrame:
    """(name_a, name_b): different spellings of one entity, the smaller by code point first.

    Spellings are distinct already, so an entity has as many as people have
    typed; the join is by entity and its result is the answer itself.
    """
    left = resolved.select("entity", F.col("name").alias("name_a"))
    right = resolved.select("entity", F.col("name").alias("name_b"))
    return left.join(right, "entity").filter("name_a < name_b").select("name_a", "name_b")
