"""Documents to chunks (sequence to rows)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import scalar
from graphloom.operators.numbering import number_rows


_BREAK = re.compile(scalar.SENTENCE_BREAK, re.ASCII)  # as the regular expressions of the JVM


def split_sentences(text: str) -> list[str]:
    """As ``scalar.sentences``."""
    return [s for s in _BREAK.split(text) if s.strip(" ")]


def pack_sentences(sentences: list[str], max_size: int, overlap: int = 0) -> list[str]:
    """Greedy packing of sentences into chunks.

    A sentence joins the current chunk while both fit into ``max_size``
    characters (the chunk's trailing blank included); otherwise the chunk is
    flushed and the next one starts with its last ``overlap`` characters. A
    sentence longer than the limit becomes a chunk of its own, over the limit.
    """
    out: list[str] = []
    parts: list[str] = []
    size = 0
    for sentence in sentences:
        if size + len(sentence) > max_size:
            flushed = "".join(parts).strip(" ")
            parts, size = [], 0
            if flushed:
                out.append(flushed)
                if overlap:
                    parts, size = [flushed[-overlap:] + " "], min(overlap, len(flushed)) + 1
        parts.append(sentence + " ")
        size += len(sentence) + 1
    last = "".join(parts).strip(" ")
    return [*out, last] if last else out


def split_texts(documents: DataFrame, split: Callable[[str], list[str]], text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, chunk_order_idx, id, content): any chunker, a function from a text to its pieces, run in Arrow batches."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, place, content = [], [], []
            for i, whole in enumerate(batch.column(1).to_pylist()):
                pieces = split(whole)
                at += [i] * len(pieces)
                place += range(len(pieces))
                content += pieces
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(place, pa.int32()), pa.array(content, pa.string())],
                names=[key, "chunk_order_idx", "content"],
            )

    plain = documents.filter(F.col(text).isNotNull()).select(key, text)
    cut = plain.mapInArrow(run, f"`{key}` {kind}, chunk_order_idx int, content string")
    return cut.select(key, "chunk_order_idx", scalar.chunk_id(F.col("content")).alias("id"), "content")


def simple_chunks(documents: DataFrame, max_size: int, overlap: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, chunk_order_idx, id, content) of each document with a text, in time linear in the text."""
    return split_texts(documents, lambda t: pack_sentences(split_sentences(t), max_size, overlap), text, key)


def cut_by_scores(scores: Callable[[list[str]], list[float]], min_size: int, max_size: int) -> Callable[[str], list[str]]:
    """A chunker that cuts between the neighbouring sentences a scorer holds least alike.

    ``scores`` rates each sentence against the next one (a reranker, say); a
    chunk is closed at its worst joint once it would outgrow ``max_size``
    characters, but not below ``min_size``.
    """

    def split(text: str) -> list[str]:
        parts = split_sentences(text)
        joints = scores(parts) if len(parts) > 1 else []
        out, lo = [], 0
        while lo < len(parts):
            hi, size = lo, 0
            while hi < len(parts) and (hi == lo or size + len(parts[hi]) + 1 <= max_size):
                size += len(parts[hi]) + 1
                hi += 1
            if hi < len(parts):
                sizes = [sum(len(p) + 1 for p in parts[lo : k + 1]) for k in range(lo, hi)]
                allowed = [k for k, n in zip(range(lo, hi), sizes, strict=True) if n >= min_size] or [hi - 1]
                hi = min(allowed, key=lambda k: (joints[k], k)) + 1
            out.append(" ".join(p.strip() for p in parts[lo:hi]))
            lo = hi
        return out

    return split


def whole_document_chunks(documents: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """Without a chunker each document is one chunk, numbered ``doc_0``, ``doc_1``, ... by ``order``, then the text."""
    numbered = number_rows(documents.select(order, text), [order, text], "__n")
    return numbered.select(
        order,
        F.concat(F.lit("doc_"), F.col("__n").cast("string")).alias("chunk_doc"),
        F.lit(0).alias("chunk_order_idx"),
        scalar.chunk_id(F.col(text)).alias("id"),
        F.col(text).alias("content"),
    )


def new_chunks(chunks: DataFrame, stored: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each chunk id that isn't stored yet."""
    first = Window.partitionBy("id").orderBy(*order)
    fresh = chunks.filter("id is not null").join(stored.select("id"), "id", "left_anti")
    return fresh.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def truncate_tokens(text: Column, limit: int) -> Column:
    """The first ``limit`` blank-separated tokens; null and empty texts give an empty one."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.coalesce(F.array_join(F.slice(words, 1, limit), " "), F.lit(""))


def truncate_model_tokens(rows: DataFrame, text: str, output: str, limit: int, tokenizer: str, reserved: int = 0) -> DataFrame:
    """``rows`` plus ``output``: the text cut to ``limit`` tokens of a public tokenizer, and ``output_tokens``, its own count before.

    ``tokenizer`` is the path of a rank file (``.tiktoken``) or of a tokenizer
    description (``.json``); ``reserved`` tokens are kept free for the special
    ones a model adds. Null and empty texts give an empty one.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def codec():
        if tokenizer.endswith(".json"):
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(tokenizer)
            return lambda t: own.encode(t, add_special_tokens=False).ids, own.decode
        import tiktoken
        from tiktoken.load import load_tiktoken_bpe

        own = tiktoken.Encoding("own", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=load_tiktoken_bpe(tokenizer), special_tokens={})
        return own.encode_ordinary, lambda ids: own.decode(ids, errors="ignore")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, decode = codec()
        for batch in batches:
            out, counts = [], []
            for whole in batch.column(batch.schema.names.index(text)).to_pylist():
                ids = encode(whole) if whole else []
                counts.append(len(ids))
                out.append(whole or "" if len(ids) <= limit - reserved else decode(ids[: max(0, limit - reserved)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string()), pa.array(counts, pa.int32())], names=[*batch.schema.names, output, f"{output}_tokens"])

    return rows.mapInArrow(run, f"{schema}, `{output}` string, `{output}_tokens` int")


def distinct_texts(rows: DataFrame, text: str, order: list[str]) -> DataFrame:
    """The first row of each text, compared without outer blanks; blank and null texts are left out."""
    keyed = rows.withColumn("__text", scalar.strip(F.col(text))).filter("__text <> ''")
    best = keyed.groupBy(F.sha2("__text", 256).alias("__key")).agg(F.min(F.struct(*order)).alias("__first"))
    keyed = keyed.withColumn("__key", F.sha2("__text", 256)).withColumn("__first", F.struct(*order))
    return keyed.join(best, ["__key", "__first"], "left_semi").select(*rows.columns)


def consecutive_similarity(vectors: DataFrame, group: str, order: str, vector: str) -> DataFrame:
    """``vectors`` plus the dot product of each vector with the next one of its group (null at the end).

    The rows are numbered by ranges of (group, order) and joined with the next
    number, so that a group of any size is spread over the tasks.
    """
    numbered = number_rows(vectors, [group, order], "__n")
    after = numbered.select((F.col("__n") - 1).alias("__n"), F.col(group).alias("__group"), scalar.as_double(F.col(vector)).alias("__next"))
    follows = numbered.join(after, "__n", "left").withColumn(
        "__next", F.when(F.col("__group").eqNullSafe(F.col(group)), F.col("__next"))
    )
    unit = scalar.as_double(F.col(vector))
    return follows.withColumn("next_similarity", F.round(scalar.dot(unit, F.col("__next")), 6)).drop("__n", "__group", "__next")


def semantic_chunks(
    documents: DataFrame, embed: Callable[[list[str]], list[list[float]]], max_tokens: int, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Recursive splitting at the least similar pair of neighbouring sentences until each part fits.

    ``embed`` is the pluggable embedder; it runs in Arrow batches on the executors.
    """
    prepared = documents.filter(F.col(text).isNotNull()).select(
        F.col(key).cast("string").alias("doc"), scalar.sentences(F.col(text)).alias("parts")
    )

    def cut(parts: list[str], likeness: list[float]) -> list[list[str]]:
        done, open_ = [], [(0, len(parts))]
        while open_:
            lo, hi = open_.pop()
            size = sum(len(p.split()) for p in parts[lo:hi])
            if size <= max_tokens or hi - lo == 1:
                done.append((lo, hi))
                continue
            at = min(range(lo, hi - 1), key=lambda i: (likeness[i], i)) + 1
            open_ += [(lo, at), (at, hi)]
        return [parts[lo:hi] for lo, hi in sorted(done)]

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for doc, parts in zip(frame["doc"], frame["parts"], strict=True):
                parts = list(parts)
                if parts:
                    vec = embed(parts)
                    near = [sum(x * y for x, y in zip(a, b, strict=True)) for a, b in zip(vec, vec[1:], strict=False)]
                    rows += [(doc, i, " ".join(p)) for i, p in enumerate(cut(parts, near))]
            yield pd.DataFrame(rows, columns=["doc", "chunk_order_idx", "content"])

    return prepared.mapInPandas(run, "doc string, chunk_order_idx int, content string").withColumn("id", scalar.chunk_id(F.col("content")))
