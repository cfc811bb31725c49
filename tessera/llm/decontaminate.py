"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of word characters in lower case. Every 3-word sequence of a benchmark item is counted over all documents;
an item's rare seeds are those of its sequences that occur at most ``RARE`` times or are no more frequent than its median one.
Any sequence found in a document opens a window as long as the item and half of it again on either side; windows of an item
that overlap become one. Item and window are aligned word by word (match 2, mismatch and
gap -1); the score is the alignment's divided by that of the item with itself, and 0.4 or more is a leak (unrelated text stays under 0.2).
A window with a rare seed is aligned at once; one opened by frequent sequences alone only if the words that it shares with the
item, all matched and no gap between, would reach the threshold, which no leak fails. So counts save alignments and change no result: whether a copy is
found does not depend on how many others there are. Copies with about a third of their words replaced, dropped or added are found, provided
that one 3-word sequence is left whole.

Two scans of the documents, without a shuffle of texts: the first shuffles one count per sequence and task, the second
aligns where it reads. The benchmark is broadcast in slices of at most ``SLICE_WORDS`` words; what one slice finds is written, and its broadcast removed, before
the next, so a larger benchmark costs more scans, not more memory. Alignments are made in blocks of bounded size.

Cases: null and empty texts leak nothing; an item with fewer than three words matches nothing; repeated documents and
repeated items each count for themselves; a document that holds an item several times gives its best place, the first on ties.
Extra columns are ignored by ``leaks`` and kept by ``clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, drop_cut, text_parts, thrifty

SEED = 3
RARE = 32
MATCH, OTHER = 2, -1
THRESHOLD = 0.4
SLICE_WORDS = 2_000_000
CELLS = 2_000_000
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class Items:
    """Benchmark items as word numbers, with their word sequences in one sorted array."""

    def __init__(self, rows: list[tuple[int, list[str]]]):
        rows = [(i, w) for i, w in rows if len(w) >= SEED]
        self.item = [i for i, _ in rows]
        self.vocabulary: dict[str, int] = {}
        self.words = [np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], np.int64) for _, w in rows]
        self.base = len(self.vocabulary) + 1
        keys = [self.sequences(w)[1] for w in self.words]
        flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
        self.owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        self.offset = np.concatenate([np.arange(len(k)) for k in keys]) if keys else np.empty(0, np.int64)
        self.known, self.number = np.unique(flat, return_inverse=True)
        self.places = np.argsort(self.number, kind="stable")
        self.first = np.searchsorted(self.number[self.places], np.arange(len(self.known) + 1))
        self.bags = [np.unique(w, return_counts=True) for w in self.words]
        self.rare = np.ones(len(self.number), bool)

    def sequences(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and keys of word sequences all of whose words are in the benchmark."""
        n = len(numbers) - SEED + 1
        if n < 1:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        some = numbers[:n] > 0
        key = numbers[:n].copy()
        for i in range(1, SEED):
            x = numbers[i : n + i]
            some &= x > 0
            key = key * self.base + x
        at = np.flatnonzero(some)
        return at, key[at]

    def numbers(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and numbers of known sequences."""
        at, key = self.sequences(numbers)
        if not len(at) or not len(self.known):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.known, key), len(self.known) - 1)
        ok = self.known[k] == key
        return at[ok], k[ok]

    def seeds(self, counts: np.ndarray) -> None:
        """Marks as rare seeds what is rare, or no more frequent than its item's median."""
        own = counts[self.number]
        for k in range(len(self.words)):
            at = slice(*np.searchsorted(self.owner, [k, k + 1]))
            self.rare[at] = own[at] <= max(RARE, np.median(own[at]))

    def possible(self, item: int, window: np.ndarray) -> bool:
        """Whether the words shared with the item could make a leak; never false for a window that holds one."""
        word, times = self.bags[item]
        k = np.minimum(np.searchsorted(word, window), len(word) - 1)
        shared = np.minimum(np.bincount(k[word[k] == window], minlength=len(word)), times).sum()
        return MATCH * shared / (MATCH * len(self.words[item])) >= THRESHOLD

    def windows(self, numbers: np.ndarray) -> list[tuple[int, int, int]]:
        """(index of item, first word, end word) of what is to be aligned, by item and place."""
        at, k = self.hits(numbers)
        spans: dict[int, list[tuple[int, int, bool]]] = {}
        for pos, key in zip(at.tolist(), k.tolist(), strict=True):
            for p in self.places[self.first[key] : self.first[key + 1]].tolist():
                item, size = int(self.owner[p]), len(self.words[self.owner[p]])
                start = pos - int(self.offset[p])
                slack = size // 2 + 5
                spans.setdefault(item, []).append((max(0, start - slack), min(len(numbers), start + size + slack), bool(self.rare[p])))
        out = []
        for item, own in sorted(spans.items()):
            own.sort()
            merged = [own[0]]
            for x, y, rare in own[1:]:
                a, b, sure = merged[-1]
                if x > b:
                    merged.append((x, y, rare))
                else:
                    merged[-1] = a, max(b, y), sure or rare
            out += [(item, a, b) for a, b, sure in merged if sure or self.possible(item, numbers[a:b])]
        return out


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each (item, window), and where it ends in the window (the first such place)."""
    best, end = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    order = sorted(range(len(pairs)), key=lambda i: len(pairs[i][1]))
    while order:
        width = len(pairs[order[0]][1])
        take = 1
        while take < len(order) and (take + 1) * len(pairs[order[take]][1]) <= CELLS // 50 and len(pairs[order[take]][1]) <= 2 * width + 20:
            take += 1
        block, order = order[:take], order[take:]
        wide, tall = max(len(pairs[i][1]) for i in block), max(len(pairs[i][0]) for i in block)
        w = np.full((len(block), wide), -1, np.int64)
        v = np.full((len(block), tall), -2, np.int64)
        for r, i in enumerate(block):
            v[r, : len(pairs[i][0])] = pairs[i][0]
            own = pairs[i][1]
            w[r, : len(own)] = np.where(own > 0, own, -1)
        step = np.arange(wide + 1, dtype=np.int32)
        h = np.zeros((len(block), wide + 1), np.int32)
        top, where = np.zeros(len(block), np.int32), np.zeros(len(block), np.int64)
        for i in range(tall):
            new = np.zeros_like(h)
            same = w == v[:, i, None]
            new[:, 1:] = np.maximum(0, np.maximum(h[:, :-1] + np.where(same, MATCH, OTHER).astype(np.int32), h[:, 1:] + OTHER))
            # a gap of any length in one step: the running maximum of what each cell gives to those on its right
            h = np.maximum.accumulate(new + step, axis=1) - step
            at = h.argmax(1)
            score = h[np.arange(len(block)), at]
            better = (score > top) | ((score == top) & (at < where) & (score > 0))
            top, where = np.where(better, score, top), np.where(better, at, where)
        best[block], end[block] = top, where
    return best, end


def find(items: Items, texts: list[str | None]) -> list[list[dict]]:
    """For each text its leaks, one an item: item, score, and the place in characters."""
    numbers = [items.numbers(t) for t in texts]
    asked = [(d, *w) for d, x in enumerate(numbers) for w in items.windows(x)]
    out: list[list[dict]] = [[] for _ in texts]
    if not asked:
        return out
    score, end = align([(items.words[k], numbers[d][a:b]) for d, k, a, b in asked])
    kept: dict[tuple[int, int], tuple[float, int]] = {}
    for i, (d, k, _, _) in enumerate(asked):
        s = score[i] / (MATCH * len(items.words[k]))
        if s >= THRESHOLD and s > kept.get((d, k), (0.0, 0))[0]:
            kept[d, k] = s, i
    if not kept:
        return out
    chosen = [i for _, i in kept.values()]
    back = []  # the same alignment from its end, to tell where it begins
    for i in chosen:
        d, k, a, _ = asked[i]
        back.append((items.words[k][::-1], numbers[d][a : a + end[i]][::-1]))
    _, length = align(back)
    for (d, k), i, n in zip(kept, chosen, length.tolist(), strict=True):
        stop = asked[i][2] + int(end[i])
        places = _spans(texts[d], stop - n, stop)
        out[d].append({"item_id": items.item[k], "score": float(kept[d, k][0]), "start": places[0], "end": places[1]})
    return out


def _spans(text: str, first: int, end: int) -> tuple[int, int]:
    """Characters of words first to end - 1. Lower case may change lengths, so words are found in the text as it is."""
    start = stop = 0
    for i, m in enumerate(_WORD.finditer(text)):
        if i == first:
            start = m.start()
        stop = m.end()
        if i == end - 1:
            break
    return start, stop


def slices(benchmark: DataFrame, most: int | None = None) -> Iterator[list[tuple[int, list[str]]]]:
    """Items in slices of bounded size, as they come."""
    rows, size, most = [], 0, most or SLICE_WORDS
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").toLocalIterator():
        words = words_of(r.text)
        if rows and size + len(words) > most:
            yield rows
            rows, size = [], 0
        rows.append((r.item_id, words))
        size += len(words)
    yield rows


def _counted(docs: DataFrame, items: Items) -> Items:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        total = np.zeros(len(own.known), np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                _, k = own.hits(own.numbers(t))
                if len(k):
                    total += np.bincount(k, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["k", "n"])

    counts = np.zeros(len(items.known), np.int64)
    for r in docs.select("text").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.k] = r.n
    items.seeds(counts)
    return items


def with_leaks(docs: DataFrame, benchmark: DataFrame, column: str = "leaks") -> DataFrame:
    """The documents with an array of (item_id, score, start, end) in the order of the benchmark's slices."""
    kind = "array<struct<item_id:long,score:double,start:int,end:int>>"
    before, shared = None, None
    for rows in slices(benchmark):
        if shared is not None:
            written = cut(docs, "leaks")
            shared.unpersist()
            if before is not None:
                drop_cut(before)
            docs = before = written
        shared = docs.sparkSession.sparkContext.broadcast(_counted(docs, Items(rows)))

        def run(batches: Iterator[pa.Array], shared=shared) -> Iterator[pa.Array]:
            for texts in batches:
                yield pa.array(find(shared.value, texts.to_pylist()), pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])))

        made = F.arrow_udf(thrifty(_iterating(run)), kind).asNondeterministic()(F.col("text"))
        docs = docs.withColumn(column, F.concat(column, made) if before is not None else made)
    return docs


def _iterating(run):
    """An iterator function with the annotations that tell Spark its kind."""

    def typed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run(batches)

    return typed


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, start, end: one row for each document and item that leaks into it."""
    found = with_leaks(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, into which no item leaks."""
    mark = "__leaks"
    return with_leaks(docs, benchmark, mark).where(F.size(mark) == 0).drop(mark)
