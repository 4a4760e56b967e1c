"""Column expressions: ids, text clean-up, vectors. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE_BREAK = r"\n+|(?<=[.!?])\s+"


def hash_id(prefix: str, *parts: Column) -> Column:
    """``prefix`` + md5 over the parts, each preceded by a NUL; null parts give null."""
    return F.concat(F.lit(prefix), F.md5(F.concat(*[c for p in parts for c in (F.lit("\u0000"), p)])))


def named_hash_id(prefix: str, *parts: Column, **named: Column) -> Column:
    """As :func:`hash_id`, with the named parts after the others by name: a NUL, the name, an SOH, the value."""
    extra = [c for k in sorted(named) for c in (F.lit(f"\u0000{k}\u0001"), named[k])]
    return F.concat(F.lit(prefix), F.md5(F.concat(*[c for p in parts for c in (F.lit("\u0000"), p)], *extra)))


def serialized(*columns: str) -> Column:
    """Compact JSON of the columns, nested ones included, nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def serialized_size(*columns: str) -> Column:
    """Bytes of that JSON in UTF-8."""
    return F.octet_length(serialized(*columns))


def chunk_id(content: Column) -> Column:
    return hash_id("chunk-", content)


def entity_id(name: Column, kind: Column) -> Column:
    return hash_id("ent-", F.concat(name, F.lit(" - "), kind))


def relation_id(subject: Column, obj: Column, kind: Column) -> Column:
    return hash_id("rel-", F.concat(subject, F.lit(" -> "), obj, kind))


def community_id(level: Column, cluster: Column) -> Column:
    return hash_id("com-", F.concat_ws(":", level.cast("string"), cluster.cast("string")))


def strip(text: Column) -> Column:
    """Both ends free of any white space, as opposed to ``trim`` (blanks only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def tidy(key: Column) -> Column:
    """A key without surrounding blanks, in lower case."""
    return F.lower(F.trim(key))


def normal_type(kind: Column) -> Column:
    """Text before the first ``" ("``, stripped; empty becomes UNKNOWN."""
    head = F.trim(F.substring_index(kind, " (", 1))
    return F.when(head == "", F.lit("UNKNOWN")).otherwise(F.coalesce(head, F.lit("UNKNOWN")))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, SENTENCE_BREAK), lambda s: F.trim(s) != "")


def as_double(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in DOUBLE; null where a vector is null or all zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def word_count(text: Column) -> Column:
    """Runs of characters without white space (Unicode white space included)."""
    return F.regexp_count(text, F.lit(r"(?U)[^\s\u001c-\u001f]+"))
