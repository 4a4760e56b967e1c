"""Splitting oversized items at natural boundaries (problem 6).

Content-defined chunking: a rolling hash over the last ``WINDOW`` characters
marks landmarks, about one every ``every`` characters, that depend on the
neighbouring text only. Each landmark snaps to the nearest natural boundary
within ``reach`` characters (paragraph before line before sentence before
clause before word). A piece ends at the first snapped landmark past the
minimum size; if none comes before the maximum, at the strongest boundary in
between, and only a text without any boundary there is cut at the maximum.
So an edit moves the cuts near it and leaves the other pieces as they were.

Every piece after the first repeats the last ``overlap`` characters of its
predecessor, shortened to whole words where possible, and every piece with its
overlap keeps within both limits. Taking each piece from ``overlap_chars`` on
and joining them gives back the text exactly.

Defined results: null and blank content and content within the limits come out
of :func:`split_oversized` not at all (they are no oversized items) and of
:func:`resplit` unchanged; content of any length is processed whole; repeated
rows are each split; null ``doc_id`` or order stay null; extra columns are
ignored. ``chunk_order_idx`` of the pieces counts from 0 within their row, whose
former index is kept as ``source_order_idx``, so (doc_id, source_order_idx,
chunk_order_idx) orders a document without gathering it anywhere.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalar import chunk_id, word_count
from graphloom.llm.arrow import map_batches

WINDOW = 16

_TOKEN = re.compile(r"\S+")
_BOUNDARIES = (
    (5, re.compile(r"\n\s*\n\s*")),
    (4, re.compile(r"\n\s*")),
    (3, re.compile(r"(?<=[.!?…])[\"'»”)\]]*\s+")),
    (2, re.compile(r"(?<=[,;:—–])\s+")),
    (1, re.compile(r"\s+")),
)


@dataclass(frozen=True)
class Limits:
    max_chars: int = 1400
    max_tokens: int = 220
    min_share: float = 0.35
    overlap: int = 100
    every: int = 256
    reach: int = 80

    def __post_init__(self) -> None:
        if not (0 <= self.overlap < self.max_chars // 2 and self.max_tokens > 1 and 0 <= self.min_share < 1):
            raise ValueError(f"unusable limits: {self}")


def landmarks(text: str, every: int) -> np.ndarray:
    """Positions after which the hash of the preceding WINDOW characters hits, one in ``every``."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(codes) < WINDOW:
        return np.empty(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        mixed = (codes + np.uint64(0x9E37)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        total = np.zeros(len(codes) - WINDOW + 1, dtype=np.uint64)
        for k in range(WINDOW):
            total = total * np.uint64(0x100000001B3) + mixed[k : k + len(total)]
        total ^= total >> np.uint64(32)
    return np.flatnonzero(total % np.uint64(every) == 0) + WINDOW


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a piece may end, sorted, and the strength of each."""
    strength: dict[int, int] = {}
    for level, pattern in _BOUNDARIES:
        for m in pattern.finditer(text):
            if 0 < m.end() < len(text):
                strength.setdefault(m.end(), level)
    where = np.array(sorted(strength), dtype=np.int64)
    return where, np.array([strength[p] for p in where.tolist()], dtype=np.int64)


def _snapped(text: str, where: np.ndarray, level: np.ndarray, limits: Limits) -> list[int]:
    out = []
    for mark in landmarks(text, limits.every).tolist():
        lo, hi = np.searchsorted(where, (mark - limits.reach, mark + limits.reach + 1))
        if lo < hi:
            near = np.abs(where[lo:hi] - mark)
            # nearest sentence or stronger if there is one, else the nearest of any kind
            strong = np.flatnonzero(level[lo:hi] >= 3)
            pick = strong[near[strong].argmin()] if len(strong) else near.argmin()
            out.append(int(where[lo + pick]))
    return sorted(set(out))


def pieces(text: str, limits: Limits = Limits()) -> list[tuple[int, int, int]]:
    """(start, core, end) per piece: text[start:end] is the piece, text[start:core] its overlap."""
    n = len(text)
    starts = np.array([m.start() for m in _TOKEN.finditer(text)], dtype=np.int64)

    def begun(a: int) -> int:
        """Index of the token that ``a`` stands in or before."""
        cut = 0 < a < n and not text[a].isspace() and not text[a - 1].isspace()
        return int(np.searchsorted(starts, a)) - cut

    def tokens(a: int, b: int) -> int:
        return int(np.searchsorted(starts, b)) - begun(a) if b > a else 0

    if n <= limits.max_chars and len(starts) <= limits.max_tokens:
        return [(0, 0, n)] if text.strip() else []
    where, level = boundaries(text)
    marks = np.array(_snapped(text, where, level, limits), dtype=np.int64)
    out: list[tuple[int, int, int]] = []
    core = 0
    while core < n:
        start = core
        if out and limits.overlap:
            start = max(core - limits.overlap, out[-1][1])
            if start > 0 and not text[start - 1].isspace():
                lo, hi = np.searchsorted(where, (start, core))
                start = int(where[lo]) if lo < hi else start
            while start < core and tokens(start, core) > limits.max_tokens // 4:
                at = int(np.searchsorted(where, start, side="right"))
                start = min(core, int(where[at])) if at < len(where) else core
        # the largest end that keeps both limits
        last = min(n, start + limits.max_chars)
        if tokens(start, last) > limits.max_tokens:
            last = min(last, int(starts[begun(start) + limits.max_tokens]))
        if last >= n:
            end = n
        else:
            least = core + max(1, int((last - core) * limits.min_share))
            lo, hi = np.searchsorted(marks, (least, last + 1))
            if lo < hi:
                end = int(marks[lo])
            else:
                lo, hi = np.searchsorted(where, (least, last + 1))
                if lo < hi:
                    best = level[lo:hi].max()
                    end = int(where[lo + np.flatnonzero(level[lo:hi] == best)[-1]])
                else:
                    end = last
        out.append((start, core, end))
        core = end
    if len(out) > 1 and not text[out[-1][1] :].strip():
        # white space at the end is no piece of its own: it stays with its predecessor if that keeps the limits
        s, c, e = out[-2]
        if n - s <= limits.max_chars:
            out[-2:] = [(s, c, n)]
    return out


def is_oversized(content: Column, limits: Limits = Limits()) -> Column:
    """More characters or more tokens than allowed; false for null. Tokens are counted only where there may be enough."""
    length = F.char_length(content)
    long_enough = length > 2 * limits.max_tokens
    return F.coalesce(
        (length > limits.max_chars) | (long_enough & (F.when(long_enough, word_count(content)) > limits.max_tokens)),
        F.lit(False),
    )


def split_oversized(chunks: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The pieces of the oversized rows of (rec_no, content, chunk_order_idx, doc_id).

    Gives (rec_no, id, content, chunk_order_idx, source_order_idx, doc_id,
    num_tokens, start_char, overlap_chars).
    """
    large = chunks.filter(is_oversized(F.col("content"), limits)).select(
        F.col("rec_no").cast("long").alias("rec_no"),
        "content",
        F.col("chunk_order_idx").cast("int").alias("source_order_idx"),
        "doc_id",
    )

    def work(columns):
        out: dict[str, list] = {k: [] for k in ("rec_no", "source_order_idx", "doc_id", "content", "chunk_order_idx", "num_tokens", "start_char", "overlap_chars")}
        for rec, text, order, doc in zip(
            *(columns[k].to_pylist() for k in ("rec_no", "content", "source_order_idx", "doc_id")), strict=True
        ):
            for i, (start, core, end) in enumerate(pieces(text, limits)):
                part = text[start:end]
                for k, v in zip(out, (rec, order, doc, part, i, len(part.split()), start, core - start), strict=True):
                    out[k].append(v)
        return out

    schema = "rec_no long, source_order_idx int, doc_id string, content string, chunk_order_idx int, num_tokens int, start_char int, overlap_chars int"
    return map_batches(large, schema, work).select(
        "rec_no",
        chunk_id(F.col("content")).alias("id"),
        "content",
        "chunk_order_idx",
        "source_order_idx",
        "doc_id",
        "num_tokens",
        "start_char",
        "overlap_chars",
    )


def resplit(chunks: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """All rows, the oversized ones replaced by their pieces; num_tokens is counted anew everywhere."""
    kept = chunks.filter(~is_oversized(F.col("content"), limits)).select(
        F.col("rec_no").cast("long").alias("rec_no"),
        "id",
        "content",
        F.lit(0).alias("chunk_order_idx"),
        F.col("chunk_order_idx").cast("int").alias("source_order_idx"),
        "doc_id",
        word_count(F.col("content")).alias("num_tokens"),
        F.lit(0).alias("start_char"),
        F.lit(0).alias("overlap_chars"),
    )
    return kept.unionByName(split_oversized(chunks, limits))
