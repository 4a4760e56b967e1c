"""Evaluation texts leaking into training text (problem 7).

The word n-grams of all test items form a set of hashes that is broadcast to
the tasks scanning the corpus: every document is read once, whole, its words are
numbered by the items' vocabulary, and its n-gram hashes are looked up. The
n-grams are pairs of words, next to each other or with one word between, as
these survive a change in every second or third word. Hits of an item on nearby
diagonals (place in the document minus place in the item) are counted; where
there are as many as a passage must leave, the stretch is verified by a local
alignment: a leak is an aligned passage that spans at least ``min_share`` of the
item's words in the item's order, single changed, missing or added words being
bridged. Nothing is shuffled.

The set is broadcast only while it has at most ``MAX_GRAMS`` n-grams (about 100
MB with its items); beyond, :func:`leaks` cuts the items into groups under that
bound and scans the corpus once per group, which keeps every task within the
same memory whatever the number of items. The index is built once in each
worker process.

Words are runs of letters and digits after compatibility normalisation, in
lower case; markup tags are dropped. Defined results: null, empty and wordless
documents and items leak nothing; items of one or two words are looked up by
all their words; an item stored twice counts for each of its ids; repeated
documents each come out; documents of any length are scanned whole; extra
columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_GRAMS = 2_000_000
MIN_SHARE = 0.5
#: Weight of pairs a passage must leave, as a share of the least that an unchanged one has: each kind of pair loses
#: half if every second word is changed and two in three if every third is, and rare pairs may be hit first.
HITS = 0.15
#: Places of the items that have a pair, up to which it is looked for wherever it could help.
LIGHT = 8
#: Matching words an alignment must have, as a share of the passage.
MATCHED = 0.6

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>|&[A-Za-z]{2,8};|&#\d{1,6};|[­​-‏⁠﻿]")
_MATCH, _MISS, _GAP = 1.0, -0.75, -0.75


def words_of(text: str) -> list[str]:
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        if any(c in text for c in "­​‌‍‎‏⁠﻿"):
            text = re.sub("[­​-‏⁠﻿]", "", text)
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    return _WORD.findall(text.lower())


def aligned_spans(items: list[np.ndarray], parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(item words spanned, words matched) by the best local alignment of each item with its part.

    Smith-Waterman over word numbers, all pairs at once: a step takes one word
    of every part, gaps inside the items by a running maximum.
    """
    pairs, n, m = len(items), max(map(len, items)), max(map(len, parts))
    own = np.full((pairs, n), -1, dtype=np.int64)
    text = np.full((pairs, m), -2, dtype=np.int64)
    for k, (item, part) in enumerate(zip(items, parts, strict=True)):
        own[k, : len(item)] = item
        text[k, : len(part)] = part
    columns = np.broadcast_to(np.arange(n + 1), (pairs, n + 1))
    rows = np.arange(pairs)
    steps = columns * -_GAP
    score = np.zeros((pairs, n + 1))
    begin = columns.copy()
    hits = np.zeros((pairs, n + 1), dtype=np.int64)
    top, span, matched = np.zeros(pairs), np.zeros(pairs, dtype=np.int64), np.zeros(pairs, dtype=np.int64)
    for at in range(m):
        same = own == text[:, at : at + 1]
        diag = score[:, :-1] + np.where(same, _MATCH, _MISS)
        up = score[:, 1:] + _GAP
        by_diag = diag >= up
        new, b, h = np.zeros_like(score), columns.copy(), np.zeros_like(hits)
        new[:, 1:] = np.maximum(np.maximum(diag, up), 0.0)
        alive = new[:, 1:] > 0
        b[:, 1:] = np.where(alive, np.where(by_diag, begin[:, :-1], begin[:, 1:]), columns[:, 1:])
        h[:, 1:] = np.where(alive, np.where(by_diag, hits[:, :-1] + same, hits[:, 1:]), 0)
        # gaps along the item: score[j] >= score[i] - (j - i)
        lifted = new + steps
        highest = np.maximum.accumulate(lifted, axis=1)
        source = np.maximum.accumulate(np.where(lifted >= highest, columns, 0), axis=1)
        better = highest - steps > new
        score = np.where(better, highest - steps, new)
        begin = np.where(better, np.take_along_axis(b, source, 1), b)
        hits = np.where(better, np.take_along_axis(h, source, 1), h)
        j = score.argmax(axis=1)
        value = score[rows, j]
        won = value > top
        top = np.where(won, value, top)
        span = np.where(won, j - begin[rows, j], span)
        matched = np.where(won, hits[rows, j], matched)
    return span, matched


def _pairs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the pairs of words next to each other and with one between; unknown words (0) make none."""
    hashes, places = [], []
    for step in (1, 2):
        a, b = words[:-step], words[step:]
        at = np.flatnonzero((a > 0) & (b > 0))
        hashes.append(a[at] << 32 | b[at])
        places.append(at)
    return np.concatenate(hashes), np.concatenate(places)


class Index:
    """The items of one broadcast: vocabulary, n-gram hashes and their places."""

    def __init__(self, items: list[tuple[int, list[str]]], min_share: float) -> None:
        self.min_share = min_share
        same: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for item_id, words in items:
            if words:
                same[tuple(words)].append(item_id)
        vocab: dict[str, int] = {}
        self.ids = list(same.values())
        self.words = [np.array([vocab.setdefault(w, len(vocab) + 1) for w in ws], dtype=np.int64) for ws in same]
        self.vocab = vocab
        self.short = [k for k, ws in enumerate(self.words) if len(ws) < 3]
        size = np.array([len(ws) for ws in self.words], dtype=np.int64)
        self.width = size // 4 + 4
        hashes, item, place, length = ([np.empty(0, dtype=np.int64)] for _ in range(4))
        for k, ws in enumerate(self.words):
            if len(ws) >= 3:
                h, at = _pairs(ws)
                hashes.append(h)
                item.append(np.full(len(h), k))
                place.append(at)
                length.append(np.repeat([1, 2], [len(ws) - 1, len(ws) - 2]))
        code, item_of, place_of, step = (np.concatenate(x) for x in (hashes, item, place, length))
        order = np.argsort(code, kind="stable")
        self.item, self.place, step = item_of[order], place_of[order], step[order]
        self.codes, self.first, self.count = np.unique(code[order], return_index=True, return_counts=True)
        # a pair weighs the less the more places of the items have it
        self.weight = np.repeat(1.0 / self.count, self.count)
        self.rows = np.argsort(self.item, kind="stable")
        self.ends = np.searchsorted(self.item[self.rows], np.arange(len(self.words) + 1))
        self.need = np.array([self._least(k, n, min_share, step) for k, n in enumerate(size.tolist())])
        self._lighten(code[order])
        self.bits = np.zeros(1 << 22, dtype=bool)
        self.bits[self._slot(self.codes)] = True

    def _lighten(self, code: np.ndarray) -> None:
        """Leaves out the pairs that more than LIGHT places have, where an item is found without them.

        They are most of the hits and hardly weigh anything: what they could add
        at most is taken off the weight the item needs, so nothing is lost.
        """
        light = np.repeat(self.count > LIGHT, self.count)
        spare = np.bincount(self.item[light], weights=self.weight[light], minlength=len(self.words))
        without = spare <= self.need / 2
        self.need = np.where(without, self.need - spare, self.need)
        kept = ~(light & without[self.item])
        self.item, self.place, self.weight = self.item[kept], self.place[kept], self.weight[kept]
        self.codes, self.first, self.count = np.unique(code[kept], return_index=True, return_counts=True)
        del self.rows, self.ends

    def _least(self, k: int, n: int, min_share: float, step: np.ndarray) -> float:
        """HITS of the least weight the pairs inside a passage of the wanted length have."""
        if n < 3:
            return 0.0
        m = max(2, int(np.ceil(min_share * n)))
        own = self.rows[self.ends[k] : self.ends[k + 1]]
        least = np.zeros(n + 1 - m)
        for s in (1, 2):
            some = own[step[own] == s]
            by_place = np.zeros(n + 1)
            by_place[self.place[some] + 1] = self.weight[some]
            total = np.cumsum(by_place)
            # pairs that begin in the passage and end in it
            least += total[np.arange(m, n + 1) - s] - total[: n + 1 - m] if m > s else 0.0
        return HITS * float(least.min())

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (codes * np.int64(0x5851F42D4C957F2D) >> np.int64(40)) & 0x3FFFFF

    def leaks(self, texts: list[str]) -> list[tuple[int, int, float]]:
        """(number of the text, item id, share of the item's words) for each item a text leaks."""
        get = self.vocab.get
        best: dict[tuple[int, int], float] = {}
        lists = [words_of(text) for text in texts]
        # two unknown words between the texts, so that no pair spans them
        gap = [None, None]
        begins = np.cumsum([0, *(len(x) + 2 for x in lists)])
        numbers = np.fromiter(map(get, chain.from_iterable(chain(x, gap) for x in lists), repeat(0)), np.int64, int(begins[-1]))
        for number, k, part in self._stretches(numbers, begins):
            best[number, k] = max(best.get((number, k), 0.0), part)
        for k in self.short:
            own = self.words[k]
            m = len(numbers) - len(own) + 1
            if m > 0:
                at = np.flatnonzero(np.logical_and.reduce([numbers[j : j + m] == own[j] for j in range(len(own))]))
                for number in np.unique(np.searchsorted(begins, at, side="right") - 1).tolist():
                    best[number, k] = 1.0
        return [(number, i, share) for (number, k), share in sorted(best.items()) for i in self.ids[k]]

    def _stretches(self, numbers: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(number of the text, item, share) of the stretches whose hits suffice and whose alignment holds."""
        code, at = _pairs(numbers)
        some = np.flatnonzero(self.bits[self._slot(code)])
        code, at = code[some], at[some]
        where = np.minimum(np.searchsorted(self.codes, code), max(0, len(self.codes) - 1))
        hit = self.codes[where] == code if len(self.codes) else np.zeros(len(code), dtype=bool)
        where, at = where[hit], at[hit]
        if not len(at):
            return
        # every place of every item that has the pair
        times = self.count[where]
        total = np.cumsum(times)
        entry = np.arange(total[-1]) - np.repeat(total - times - self.first[where], times)
        item, at = self.item[entry], np.repeat(at, times)
        text = np.searchsorted(begins, at, side="right") - 1
        # diagonals in bands of the item's slack; the hits of a passage fall into two neighbouring bands
        band = (at - begins[text] - self.place[entry]) // self.width[item]
        pair = text * len(self.words) + item
        # a pair of the item counts once in a band, however often the text has it there, and the less the more items have it
        once = np.lexsort((entry, band, pair))
        pair, band, entry = pair[once], band[once], entry[once]
        fresh = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (band[1:] != band[:-1]) | (entry[1:] != entry[:-1])))
        keys, begin = np.unique(pair[fresh] << 32 | band[fresh] + (1 << 31), return_index=True)
        hits = np.add.reduceat(self.weight[entry[fresh]], begin)
        pair, band = keys >> 32, (keys & 0xFFFFFFFF) - (1 << 31)
        text_of, item_of = pair // len(self.words), pair % len(self.words)
        follows = np.append(keys[1:] == keys[:-1] + 1, False)
        both = hits + np.where(follows, np.append(hits[1:], 0), 0)
        enough = both >= self.need[item_of] - 1e-9
        # a band that only completes the one before it needs no look of its own
        covered = np.zeros(len(keys), dtype=bool)
        covered[1:] = enough[:-1] & follows[:-1] & (both[1:] == hits[1:])
        found = []
        for g in np.flatnonzero(enough & ~covered).tolist():
            k, number = int(item_of[g]), int(text_of[g])
            width, n = int(self.width[k]), len(self.words[k])
            low = int(band[g]) * width
            lo, hi = int(begins[number]), int(begins[number + 1]) - 2
            part = numbers[max(lo, lo + low - width) : max(lo, min(hi, lo + low + 3 * width + n))]
            if len(part):
                found.append((number, k, part))
        found.sort(key=lambda x: len(x[2]))  # those of one alignment are of about one length
        for first in range(0, len(found), 128):
            some = found[first : first + 128]
            span, matched = aligned_spans([self.words[k] for _, k, _ in some], [part for _, _, part in some])
            for (number, k, _), s, m in zip(some, span.tolist(), matched.tolist(), strict=True):
                n = len(self.words[k])
                if s >= self.min_share * n and m >= MATCHED * self.min_share * n:
                    yield number, k, s / n


_BUILT: dict[str, Index] = {}


def _index_of(name: str, items: list[tuple[int, list[str]]], min_share: float) -> Index:
    """The index, built once per worker process and set of items."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Index(items, min_share)
    return _BUILT[name]


def leaks(documents: DataFrame, items: DataFrame, min_share: float = MIN_SHARE, max_grams: int = MAX_GRAMS) -> DataFrame:
    """(doc_id, item_id, share) for documents (doc_id, text) and items (item_id, text)."""
    spark = documents.sparkSession
    size = items.select(F.sum(F.coalesce(F.char_length("text"), F.lit(0)))).first()[0] or 0
    # a word takes two characters at least and begins two pairs, so that the characters bound the n-grams
    groups = max(1, -(-size // max_grams))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    out = None
    for g in range(groups):
        part = items.filter(F.pmod(F.xxhash64("text"), F.lit(groups)) == g) if groups > 1 else items
        rows = part.filter("text is not null").select("item_id", "text").collect()
        shared = spark.sparkContext.broadcast([(r["item_id"], words_of(r["text"])) for r in rows])
        name = uuid.uuid4().hex

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            index = _index_of(name, shared.value, min_share)
            for whole in batches:
                for lo in range(0, whole.num_rows, 1000):
                    batch = whole.slice(lo, 1000)
                    ids = batch.column(0).to_pylist()
                    rows = index.leaks(batch.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ids[number] for number, _, _ in rows], pa.int64()),
                            pa.array([item for _, item, _ in rows], pa.int64()),
                            pa.array([share for _, _, share in rows], pa.float64()),
                        ],
                        names=["doc_id", "item_id", "share"],
                    )

        found = docs.mapInArrow(scan, "doc_id long, item_id long, share double")
        out = found if out is None else out.unionAll(found)
    return out


def remove_leaks(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents without those that leak an item; all columns are kept."""
    return documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
