"""Jaccard join of documents on 5-word shingles, by parity sketches.

Words are runs of other than ASCII white space, with A-Z in lower case. Two documents link when their shingle sets have
a Jaccard similarity of 0.75 or more, that is, a symmetric difference of at most (a + b) / 7 for sizes a and b.

The sketch. Sizes from 2^k up to 2^(k+1) are a band. For a band the hash space is cut into 2^(k+SPARE) parts, and each
shingle XORs its 64-bit hash into the word of its part. A shingle of the symmetric difference changes one word, so the
number of differing words (the Hamming distance of the sketches, by words) is at most the symmetric difference. By the
pigeonhole principle, two linked sets agree in one of any D + 1 non-empty words, D being the largest (a + b) // 7;
each document gives its D + 1 first words in one global order, and equal words make candidate pairs. A document
whose partner may be in the next lower band gives words of that band too.
The order puts words that are common in a sample last, which only saves work: any order that is the same for all finds all.

Steps. (0) Texts are read once: each set is written as sorted 64-bit hashes, and only from these is all else made. (1) Equal sets fall into classes,
which their smallest doc_id stands for. (2) A first pass compares each representative
with one that shares most of its six least shingle hashes, which ties large groups of copies together.
(3) The pigeonhole join proper, over all representatives, leaves out pairs that are known to be in one component, as such
links cannot change a component. A document that step 2 linked is met as its partner there, its pivot, at a known symmetric difference (0 for others): the
symmetric difference is a metric, so two documents can only link if their pivots are no further apart than both radii and (a + b) / 7. Each pair of pivots is measured
once, however many documents stand behind them; (4) only where that leaves a link possible, and the pivots' own links have not tied the components, are the documents
behind them joined, by what they differ in from a pivot (``open_pairs``), and verified. (5) Components of all links.

Pairs are verified twice: a parity sketch of at least 1,024 bits, and twice as many as shingles, rejects those whose Hamming distance, which is at most the symmetric
difference, is over (a + b) / 7; the rest by the exact intersection of 64-bit shingle hashes.

A pair is made only at a word that may be its first common one. The words before it all differ, and those of an odd number of shingles count on both
sides: where an odd word differs from an odd one the parts differ in two shingles at least, from an even one or none in one at least. So the odd words before it, of both documents
together, are at most the symmetric difference, which bounds the sizes of a pair. Words travel in blocks: (32 bits of the word, doc_id, size, odd words before it), 20 bytes each, about 0.45 for each shingle, dealt
to buckets of about a million; those of sets of at most ``SMALL`` shingles have 16 bytes more, a parity sketch of ``MEET_BITS`` bits that is compared where they meet, so that sets which share a passage and cannot link make no pair; a bucket is sorted in one go. A word that the sample shows in more than ``HEAVY`` documents is split: its documents fall into
blocks by a hash, and each pair of blocks is a word of its own, in a bucket of its own. Of equal sets, too, classes of over ``HEAVY`` rows (and over a
millionth of all, so that they are fewer than a million) are met by broadcast, and only smaller ones by a shuffle.
To the driver come a bit table of fixed size and the split words. Work tables are written to the
shared folder, so lost executors cost no rework beyond a stage, and removed when nothing reads them. What remains quadratic: documents of different
components that share a word of a sketch at a place and size where they may link, and do not, are all compared with one another, pivot by pivot.

Cases: a null or white text has no shingle, links with nothing and is its own component; fewer than five words are one
shingle; rows with one doc_id are one document, with the larger of its sets if their texts differ; a null doc_id links with nothing and has a null component; no rows give none. Extra
columns are ignored by ``link`` and kept by ``representatives``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, cut, drop_cut, hash_sample, small, thrifty
from tessera.llm.components import components

SHINGLE = 5
LEAST = 6
#: A sketch of band k has 2 ** (k + SPARE) parts, 2 to 4 times 2 ** (SPARE - 2) for each shingle.
SPARE = 3
HOT_BITS = 24
HOT_SHARE = 1 / 8
#: Documents of one word, or rows of one class, that one task holds at most, as far as the sample can tell.
HEAVY = 1_000
ENTRIES = 1_000_000
SKETCH_BITS = 1024
#: Bytes of hashes whose words are dealt in one go; a larger set is dealt alone.
DEALT_BYTES = 8 << 20
#: Sets of at most so many shingles travel with their parities by MEET_BITS bits (16 bytes a word), which tell most sets apart where they meet; of larger sets these few would not.
SMALL, MEET_BITS = 256, 128
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64) + np.uint64(1)
_BASE = 0x9E6C63D0876A9A47
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, as far as the longest text so far."""
    if len(_POWERS[0]) < n:
        for k, x in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _POWERS[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 16), x, np.uint64)]), dtype=np.uint64)
    return _POWERS


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit polynomial hash of each word, from differences of one running sum over the bytes."""
    b = np.frombuffer(data, np.uint8)
    inside = ~_SPACE[b]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    if not len(edges):
        return np.empty(0, np.uint64)
    start, end = edges[::2], edges[1::2]
    up, down = _powers(len(b))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LOWER[b] * up[: len(b)], dtype=np.uint64)])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _FACTORS[4])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: pa.StringScalar) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    h = word_hashes(text.as_buffer()) if text.is_valid and len(text.as_buffer()) else np.empty(0, np.uint64)
    if not len(h):
        return h
    n = min(len(h), SHINGLE)
    total = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        total += h[i : len(h) - n + 1 + i] * _FACTORS[i]
    return np.unique(mix(total))


def _bands(n: int) -> Iterator[tuple[int, int]]:
    """(band, most words that differ from a linked set's) under which a set of n shingles is looked for: its own band, and the one below
    if a linked set may be there, as both sets of a pair use the band of the smaller."""
    k = n.bit_length() - 1
    yield k, (n + 4 * n // 3) // 7
    if -(-3 * n // 4) < 1 << k:
        yield k - 1, (n + (1 << k) - 1) // 7


def sketch_words(h: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """The non-empty words of the parity sketch for a band, each made to tell its part and band, and whether each is of an odd number of shingles."""
    part = h >> np.uint64(64 - band - SPARE)
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    odd = np.diff(np.append(starts, len(h))) & 1
    return mix(np.bitwise_xor.reduceat(mix(h), starts) + part[starts] * _FACTORS[0] + np.uint64(band)), odd


def prefix(h: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that a document gives to the join, and the number of odd ones before each in the order."""
    words, places = [np.empty(0, np.uint64)], [np.empty(0, np.uint32)]
    for band, most in _bands(len(h)) if len(h) else ():
        w, odd = sketch_words(h, band)
        low = (w & np.uint64((1 << HOT_BITS) - 1)).astype(np.int64)
        common = (hot[low >> 3] >> (7 - (low & 7)).astype(np.uint8)) & np.uint8(1)
        first = np.lexsort((w, common))[: most + 1]
        words.append(w[first])
        places.append((np.cumsum(odd[first]) - odd[first]).astype(np.uint32))
    return np.concatenate(words), np.concatenate(places)


def partners(n: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest size of a linked set whose first common word with a set of n has ``place`` odd words before it:
    they all differ, and each takes a shingle of the symmetric difference, of which there are (n + m) / 7 at most."""
    n, place = n.astype(np.int64), place.astype(np.int64)
    return np.maximum(-(-3 * n // 4), 7 * place - n), 4 * n // 3


def bit_sketch(h: np.ndarray) -> np.ndarray:
    """Parities of the shingles by the low bits of a part of their hash, at least twice as many bits as shingles, as 64-bit words."""
    bits = max(SKETCH_BITS, 1 << (2 * len(h) - 1).bit_length())
    counts = np.bincount((h >> np.uint64(24)).astype(np.int64) & (bits - 1), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def parities(h: np.ndarray) -> np.ndarray:
    """A bit sketch of MEET_BITS bits; their Hamming distance is at most the symmetric difference, as every shingle changes one."""
    counts = np.bincount((h >> np.uint64(24)).astype(np.int64) & (MEET_BITS - 1), minlength=MEET_BITS)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.uint64)


def distance(a: Column, b: Column) -> Column:
    """Hamming distance of two bit sketches; one that is twice as long is folded, which keeps parities parities."""
    k = F.least(F.size(a), F.size(b))
    xor = lambda x, y: F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q))
    fold = lambda x: F.when(F.size(x) > k, xor(F.slice(x, F.lit(1), k), F.slice(x, k + 1, k))).otherwise(x)
    return F.aggregate(xor(fold(a), fold(b)), F.lit(0), lambda s, x: s + F.bit_count(x))


def pack(h: np.ndarray) -> bytes:
    """Sorted hashes byte by byte, the high bytes of all first, as those compress."""
    return np.ascontiguousarray(h.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(data: bytes | pa.Buffer) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(np.uint64)


def _sets(column: pa.Array) -> list[np.ndarray]:
    return [unpack(x.as_buffer()) if x.is_valid else np.empty(0, np.uint64) for x in column]


def in_parts(f, *columns: pa.Array) -> pa.Array:
    """What ``f`` gives for the columns, made in parts of about ``DEALT_BYTES``, so that what it holds is bounded however many rows a batch has."""
    sizes = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    edges = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // DEALT_BYTES)) + 1).tolist(), len(sizes)]
    parts = [f(*[c.slice(a, b - a) for c in columns]) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]
    return pa.concat_arrays(parts) if parts else f(*columns)


def _udf(f, kind: str, *inputs: str):
    """A function of Arrow arrays as a UDF; as not deterministic, so that it is evaluated once a row."""

    def one(batches):
        for x in batches:
            yield in_parts(f, x)

    def two(batches):
        for x, y in batches:
            yield in_parts(f, x, y)
    one.__annotations__, two.__annotations__ = ({"batches": Iterator[t], "return": Iterator[pa.Array]} for t in (pa.Array, tuple[pa.Array, pa.Array]))
    return F.arrow_udf(thrifty(two if len(inputs) == 2 else one), kind).asNondeterministic()


def written_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n, digest, low, hashes of every row; digest and hashes are null without shingles."""

    def describe(texts):
        sets = [shingles(t) for t in texts]
        return pa.StructArray.from_arrays(
            [
                pa.array([len(h) for h in sets], pa.int64()),
                pa.array([hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None for h in sets], pa.binary()),
                pa.array([h[:LEAST].view(np.int64) for h in sets], pa.list_(pa.int64())),
                pa.array([pack(h) if len(h) else None for h in sets], pa.binary()),
            ],
            ["n", "digest", "low", "hashes"],
        )

    made = _udf(describe, "struct<n:long,digest:binary,low:array<long>,hashes:binary>", "texts")
    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), made(F.col("text")).alias("s")).select("doc_id", "s.*"), "sets")


def classes(base: DataFrame) -> DataFrame:
    """Every row's (doc_id, n, rep): rep is the smallest doc_id with the same shingles, null without shingles or doc_id."""
    some = base.where("doc_id is not null and digest is not null").select("doc_id", "n", "digest")
    none = base.where("doc_id is null or digest is null").select("doc_id", "n", F.lit(None).cast("long").alias("rep"))
    groups = cut(some.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("k")).where("k > 1"), "groups")
    most = max(HEAVY, (groups.agg(F.sum("k")).first()[0] or 0) // 1_000_000)
    hot = F.broadcast(groups.where(F.col("k") > most).drop("k"))  # fewer than a million
    rest = small(groups.where(F.col("k") <= most).drop("k"))
    in_hot = some.join(hot, "digest").select("doc_id", "n", "rep")
    others = some.join(hot, "digest", "left_anti").join(rest, "digest", "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    out = cut(in_hot.unionByName(others).unionByName(none), "classes")
    drop_cut(groups)
    return out


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of distinct (a, b) those that link, with n_a, n_b and their symmetric difference ``gap``; with a column ``reach``, those of at most a seventh of it.
    ``sets``: doc_id, n, hashes, one row a document."""
    ids = lambda p: p.select(F.col("a").alias("doc_id")).union(p.select("b")).distinct()
    side = lambda t, x, *c: t.select(F.col("doc_id").alias(x), *[F.col(i).alias(f"{i}_{x}") for i in c])
    reach = F.col("reach") if "reach" in pairs.columns else F.col("n_a") + F.col("n_b")

    def bits(column):
        return pa.array([bit_sketch(h) for h in _sets(column)], pa.list_(pa.int64()))

    mine = sets.join(small(ids(pairs)), "doc_id", "left_semi")
    sketches = cut(mine.select("doc_id", "n", _udf(bits, "array<long>", "column")(F.col("hashes")).alias("bits")), "sketches")
    near = pairs.join(side(sketches, "a", "n", "bits"), "a").join(side(sketches, "b", "n", "bits"), "b").where(F.abs(F.col("n_a") - F.col("n_b")) * 7 <= reach)
    near = cut(near.where(distance(F.col("bits_a"), F.col("bits_b")) * 7 <= reach).select(*pairs.columns).distinct(), "near")
    drop_cut(sketches)

    def common(x, y):
        return pa.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(_sets(x), _sets(y), strict=True)], pa.int64())

    mine = sets.join(small(ids(near)), "doc_id", "left_semi")
    both = near.join(side(mine, "b", "n", "hashes"), "b").join(side(mine, "a", "n", "hashes"), "a")
    both = both.withColumn("gap", F.col("n_a") + F.col("n_b") - 2 * _udf(common, "long", "x", "y")(F.col("hashes_a"), F.col("hashes_b")))
    out = cut(both.where(F.col("gap") * 7 <= reach).select("a", "b", "n_a", "n_b", "gap").distinct(), "links")
    drop_cut(near)
    return out


#: Of words: low bits, documents, sizes, odd words before, and parities where sets are small; of documents that are tied to others: ids, components, pivots, radii.
_COLUMNS = ("w", "d", "n", "p", "s", "o", "c", "v", "r")
_KINDS = (np.uint32, np.int64, np.uint32, np.uint32, np.uint64, np.int64, np.int64, np.int64, np.int64)
#: What is known of a document.
_KNOWN = ("component", "pivot", "radius")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' rows in parts of at most ``DEALT_BYTES`` of hashes, or of one row, however long the texts and however small the batches
    are: what is made of a part is bounded, and a part makes one row a bucket, so that small batches make no more rows."""
    held, size = [], 0
    for b in batches:
        sizes = pc.binary_length(b.column("hashes")).to_numpy(zero_copy_only=False).astype(np.int64)
        first = 0
        for k, n in enumerate(sizes.tolist()):
            if size and size + n > DEALT_BYTES:
                yield _joined([*held, b.slice(first, k - first)])
                held, size, first = [], 0, k
            size += n
        held.append(b.slice(first))
    if size:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0] if len(batches) > 1 else batches[0]


def _deal(words: list[np.ndarray], places: list[np.ndarray], sets: list[np.ndarray], batch: pa.RecordBatch, buckets: int, heavy: np.ndarray, meets: bool = True) -> pa.RecordBatch:
    """A batch's words as one row a bucket: words, documents, sizes, places, parities of small sets (if it ``meets``), and what is known of documents not alone in their components.

    ``heavy``: (low bits of a word, number of blocks) of the words that are split, in order of the former. A document of such a word is in one
    block, and goes to every pair of blocks that has it.
    """
    ids, *known = (batch.column(c).to_numpy() for c in ("doc_id", *_KNOWN))
    row = np.repeat(np.arange(len(ids)), [len(p) for p in words])
    words, place = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((words, np.uint64), (places, np.uint32)))
    low = words.astype(np.uint32)
    at = np.minimum(np.searchsorted(heavy[0], low), max(0, len(heavy[0]) - 1))
    split = np.flatnonzero(heavy[0][at] == low) if len(heavy[0]) else np.empty(0, np.int64)
    if len(split):
        blocks = heavy[1][at[split]].astype(np.int64)
        own = (mix(ids[row[split]].astype(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
        copy = np.repeat(np.arange(len(split)), blocks)
        other = np.arange(len(copy)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        first, second = (f(own[copy], other).astype(np.uint64) for f in (np.minimum, np.maximum))
        made = mix(words[split][copy] + first * _FACTORS[0] + second * _FACTORS[1] + np.uint64(1))
        kept = np.ones(len(words), bool)
        kept[split] = False
        words, place, row = (np.concatenate([x[kept], y]) for x, y in ((words, made), (place, place[split][copy]), (row, row[split][copy])))
    size = np.array([len(h) for h in sets], np.uint32)
    few = size <= SMALL
    parity = np.zeros((len(size), MEET_BITS // 64), np.uint64)
    for k in np.flatnonzero(few) if meets else ():
        parity[k] = parities(sets[k])
    to = ((words >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    edges = np.searchsorted(to[order], np.arange(buckets + 1))
    made = []
    for k in np.flatnonzero(np.diff(edges)):
        at = order[edges[k] : edges[k + 1]]
        own = np.unique(row[at])
        own = own[(known[0][own] != ids[own]) | (known[1][own] != ids[own])]
        made.append((int(k), *[x.tobytes() for x in (words[at].astype(np.uint32), ids[row[at]], size[row[at]], place[at], parity[row[at][few[row[at]]]] if meets else parity[:0], ids[own], *[x[own] for x in known])]))
    columns = list(zip(*made, strict=True)) or [[]] * (len(_COLUMNS) + 1)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] + [pa.binary()] * len(_COLUMNS), strict=True)], names=["bucket", *_COLUMNS])


_DEALT = "bucket int, " + ", ".join(f"{c} binary" for c in _COLUMNS)
_WHOLE = np.empty((2, 0), np.uint32)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Bucket by bucket the words that several documents have, sorted, with documents, sizes, places, parities, components, pivots and radii."""
    held: dict[int, list[list[bytes]]] = {}
    for b in batches:
        for k, *blobs in zip(*[b.column(c).to_pylist() for c in ("bucket", *_COLUMNS)], strict=True):
            for have, new in zip(held.setdefault(k, [[] for _ in _COLUMNS]), blobs, strict=True):
                have.append(new)
    while held:
        _, parts = held.popitem()
        w, d, n, p, s, o, *known = (np.frombuffer(b"".join(x), t) for x, t in zip(parts, _KINDS, strict=True))
        parity = np.zeros((len(w), MEET_BITS // 64), np.uint64)
        if len(s):
            parity[n <= SMALL] = s.reshape(-1, MEET_BITS // 64)
        order = np.argsort(w, kind="stable")
        same = w[order][1:] == w[order][:-1]
        twin = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(w) else order
        w, d, n, p, parity = w[twin], d[twin], n[twin], p[twin], parity[twin]
        o, first = np.unique(o, return_index=True)
        known = [x[first] for x in known]
        of = [d, d, np.zeros(len(d), np.int64)]
        if len(o) and len(d):
            at = np.minimum(np.searchsorted(o, d), len(o) - 1)
            of = [np.where(o[at] == d, x[at], y) for x, y in zip(known, of, strict=True)]
        if len(w):
            yield w, d, n, p, parity, *of


def _hot(sets: DataFrame, known: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """From a sample of the documents: a bit for each value of the low bits of a sketch word, whether words with it are in
    several components, a table of fixed size; and the words to be split, with the number of their blocks, at most one for HEAVY * HOT_SHARE words of the sample."""
    buckets = max(1, int(buckets * HOT_SHARE * 2))
    least = max(2, int(HEAVY * HOT_SHARE))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            sets = _sets(b.column("hashes"))
            own = [np.concatenate([sketch_words(h, band)[0] for band, _ in _bands(len(h))]) if len(h) else h for h in sets]
            yield _deal(own, [np.zeros(len(w), np.uint32) for w in own], sets, b, buckets, _WHOLE, meets=False)

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, _, _, _, _, comp, *_ in _buckets(batches):
            at = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            mixed = np.minimum.reduceat(comp, at) != np.maximum.reduceat(comp, at)
            count = np.diff(np.append(at, len(w)))
            many = mixed & (count > least)
            found = np.unique(w[at][mixed] & np.uint32((1 << HOT_BITS) - 1)).astype(np.int64)
            # a count of 0 tells of low bits, others of words to be split
            yield pa.RecordBatch.from_arrays([pa.array(np.append(found, w[at][many].astype(np.int64))), pa.array(np.append(np.zeros(len(found), np.int64), count[many]))], names=["w", "k"])

    sample = hash_sample(sets.select("doc_id", "hashes"), "doc_id", HOT_SHARE, 5).join(known, "doc_id")
    dealt = sample.select("doc_id", *_KNOWN, "hashes").mapInArrow(thrifty(words), _DEALT)
    found = dealt.repartitionById(buckets, "bucket").mapInArrow(thrifty(common), "w long, k long").groupBy("w").agg(F.max("k").alias("k"), F.min("k").alias("least")).toArrow()
    w, k, least_k = (found.column(c).to_numpy() for c in ("w", "k", "least"))
    hot = np.zeros(1 << HOT_BITS, np.bool_)
    hot[w[least_k == 0]] = True
    order = np.flatnonzero(k > 0)
    order = order[np.argsort(w[order])]
    split = np.stack([w[order], -(-k[order] // least)]).astype(np.uint32)
    return np.packbits(hot), split


def candidates(sets: DataFrame, known: DataFrame, total: int) -> DataFrame:
    """(a, b, reach), a < b: distinct pairs of pivots of documents that share a sketch word and are in different components, and the most of
    seven times the radii and the sizes of two such documents: they can only link if seven times the pivots' symmetric difference is at most that.

    ``known``: (doc_id, component, pivot, radius), one row a document; ``total``: the number of all their shingles.
    """
    spark = sets.sparkSession
    known = small(known)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(0.45 * total / ENTRIES))
    shared = spark.sparkContext.broadcast(_hot(sets, known, buckets))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, heavy = shared.value
        for b in _parts(batches):
            sets = _sets(b.column("hashes"))
            words, places = zip(*[prefix(h, hot) for h in sets], strict=True) if sets else ((), ())
            yield _deal(list(words), list(places), sets, b, buckets, heavy)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met in _buckets(batches):
            yield from _cross(*met)

    mine = sets.select("doc_id", "hashes").join(known, "doc_id")
    met = mine.select("doc_id", *_KNOWN, "hashes").mapInArrow(thrifty(deal), _DEALT).repartitionById(buckets, "bucket").mapInArrow(thrifty(meet), "a long, b long, reach long")
    out = cut(met.groupBy("a", "b").agg(F.max("reach").alias("reach")), "pairs")
    shared.unpersist()
    return out


def _cross(w, d, n, place, parity, comp, pivot, radius, block: int = 400_000) -> Iterator[pa.RecordBatch]:
    """The pivots of pairs of different components in each run of equal words, if this may be their first common word and their parities, where
    both are small, leave a link possible, and their reach."""
    start = np.concatenate([[True], w[1:] != w[:-1]])
    at, run = np.flatnonzero(start), np.cumsum(start) - 1
    mixed = (np.minimum.reduceat(comp, at) != np.maximum.reduceat(comp, at))[run]  # runs of one component have no pairs
    low, high = partners(n, place)
    # of the rest, those whose run has a partner of a fitting size
    key = run.astype(np.int64) << 32
    sizes = np.sort(key + n)
    fitting = np.searchsorted(sizes, key + high, "right") - np.searchsorted(sizes, key + low) - ((low <= n) & (n <= high))
    kept = np.flatnonzero(mixed & (fitting > 0))
    w, n, parity, comp, low, high, pivot = w[kept], n[kept].astype(np.int64), parity[kept], comp[kept], low[kept], high[kept], pivot[kept]
    spare = n - 7 * place[kept].astype(np.int64)  # of both sides together: seven times the shingles by which they may still differ
    reach = n + 7 * radius[kept]
    total, gap, left = len(w), 1, np.arange(len(w))
    held, size = [], 0
    while len(left) or held:
        left = left[left + gap < total]
        left = left[w[left + gap] == w[left]]
        right = left + gap
        hit = left[(comp[left] != comp[right]) & (spare[left] + spare[right] >= 0) & (low[left] <= n[right]) & (n[right] <= high[left]) & (low[right] <= n[left]) & (n[left] <= high[right])]
        apart = np.bitwise_count(parity[hit] ^ parity[hit + gap]).sum(1) * 7
        hit = hit[(np.maximum(n[hit], n[hit + gap]) > SMALL) | (apart <= n[hit] + n[hit + gap])]
        a, b = pivot[hit], pivot[hit + gap]
        held.append(np.stack([np.minimum(a, b), np.maximum(a, b), reach[hit] + reach[hit + gap]], 1))
        size += len(hit)
        gap += 1
        if size > block or not len(left):
            pairs = np.concatenate(held)
            pairs = pairs[np.lexsort((-pairs[:, 2], pairs[:, 1], pairs[:, 0]))]
            pairs = pairs[np.concatenate([[True], (pairs[1:, :2] != pairs[:-1, :2]).any(1)])] if len(pairs) else pairs
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in pairs.T], names=["a", "b", "reach"])
            held, size = [], 0


def open_pairs(apart: DataFrame, known: DataFrame, tied: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b) of links that are certain, and distinct (a, b) that may link, of documents of different components behind pivots that are ``apart``: as many links
    as the components need.

    A document is in its pivot's component, so pairs of pivots that are tied by now go first. Of the others the pivot with fewer documents behind it gives them up: each such
    stranger y is measured against the other pivot a. With X and Y for what x and y differ in from a, x and y differ in |X| + |Y| - 2 |X & Y| shingles. So they link for certain
    where 7 (|X| + |Y|) <= n_x + n_y, which the x of least 7 |X| - n_x decides; else they need an X & Y of t = (7 |X| - n_x + 7 |Y| - n_y) / 14 or more, and so share one of the
    first |X| - t + 1 of X and of the first |Y| - t + 1 of Y, in an order that puts first what is rare among those that differ from a. As y is no link of a, that is about
    half of X: the half that an edit made, not the half of a that it took away, which other edits take away too.
    """
    now = known.drop("component").join(tied.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    now = cut(now.withColumn("score", F.col("radius") * 7 - F.col("n")), "now")
    of = lambda x: now.select(F.col("doc_id").alias(x), F.col("component").alias(f"of_{x}"))
    untied = cut(apart.select("a", "b", "gap").join(of("a"), "a").join(of("b"), "b").where("of_a <> of_b").select("a", "b", "gap"), "untied")
    pivots = untied.select(F.col("a").alias("pivot")).union(untied.select("b")).distinct()
    behind = now.join(small(pivots), "pivot", "left_semi")
    group = (F.count("*").alias("k"), F.max(F.col("radius") * 7 + F.col("n")).alias("most"), F.min(F.struct("score", "doc_id")).alias("least"))
    groups = small(cut(behind.groupBy("pivot").agg(*group), "groups"))
    sides = untied.join(groups.select(F.col("pivot").alias("a"), F.col("k").alias("k_a")), "a").join(groups.select(F.col("pivot").alias("b"), F.col("k").alias("k_b")), "b")
    more = F.col("k_a") >= F.col("k_b")
    sides = sides.select(F.when(more, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(more, F.col("b")).otherwise(F.col("a")).alias("b"), "gap")
    strangers = sides.join(groups.withColumnRenamed("pivot", "a"), "a").join(behind.select(F.col("pivot").alias("b"), F.col("doc_id").alias("y"), "radius", "n"), "b")
    strangers = cut(strangers.where(F.col("gap") * 7 <= F.col("most") + F.col("radius") * 7 + F.col("n")).select("a", "b", "y", "n", "gap", "most", "least"), "strangers")
    near = measured(strangers.where("y <> b").select("a", F.col("y").alias("b"), (F.col("most") + F.col("n")).alias("reach")), sets)
    met = strangers.where("y = b and gap * 7 <= most + n").select("a", "y", "n", "gap").union(near.select("a", "b", "n_b", "gap"))
    met = cut(met.withColumn("score", F.col("gap") * 7 - F.col("n")).join(groups.select(F.col("pivot").alias("a"), "least"), "a"), "met")
    sure = cut(met.where("score + least.score <= 0").select(F.col("least.doc_id").alias("a"), F.col("y").alias("b")), "sure")
    rest = met.where("score + least.score > 0")
    # every document that differs from a pivot that has strangers, with the least t of its pairs
    own = behind.join(small(rest.groupBy(F.col("a").alias("pivot")).agg(F.min("score").alias("other"))), "pivot")
    own = own.select(F.col("pivot").alias("a"), F.col("doc_id").alias("d"), F.lit(True).alias("own"), F.col("radius").alias("size"), "n", "score", "other")
    both = own.union(rest.select("a", "y", F.lit(False), "gap", "n", "score", "least.score"))
    both = both.withColumn("t", F.expr("(score + other + 13) div 14")).where("t <= size").drop("other")

    def differ(x, y):
        return pa.array([np.setxor1d(p, q, assume_unique=True).view(np.int64) for p, q in zip(_sets(x), _sets(y), strict=True)], pa.list_(pa.int64()))

    centres = small(sets.join(small(both.select(F.col("a").alias("doc_id")).distinct()), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("hashes").alias("hashes_a")))
    mine = sets.join(small(both.select(F.col("d").alias("doc_id")).distinct()), "doc_id", "left_semi").select(F.col("doc_id").alias("d"), "hashes")
    both = both.join(mine, "d").join(centres, "a")
    both = cut(both.withColumn("e", _udf(differ, "array<long>", "x", "y")(F.col("hashes"), F.col("hashes_a"))).drop("hashes", "hashes_a"), "differences")
    each = both.withColumn("e", F.explode("e"))
    shared = cut(each.groupBy("a", "e").agg(F.count("*").alias("k"), (F.min("own") != F.max("own")).alias("meets")).where("k > 1"), "shared")
    placed = each.join(small(shared), ["a", "e"], "left")
    order = Window.partitionBy("a", "d", "own").orderBy(F.coalesce("k", F.lit(1)), "e")
    first = cut(placed.withColumn("place", F.row_number().over(order)).where("place <= size - t + 1 and meets").drop("k", "meets", "place", "t"), "first")
    side = lambda x: first.where("own" if x == "x" else "not own").select("a", "e", *[F.col(c).alias(f"{c}_{x}") for c in ("d", "size", "n", "score")])
    may = (F.col("score_x") + F.col("score_y") <= F.least("size_x", "size_y") * 14) & (F.abs(F.col("n_x") - F.col("n_y")) * 7 <= F.col("n_x") + F.col("n_y"))
    pairs = side("x").join(side("y"), ["a", "e"]).where(may)
    out = cut(pairs.select(F.least("d_x", "d_y").alias("a"), F.greatest("d_x", "d_y").alias("b")).distinct(), "behind")
    for done in (now, untied, groups, strangers, near, met, both, shared, first):
        drop_cut(done)
    return sure, out


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    with bounded_batches(docs.sparkSession):  # all that runs Python is written here
        return _link(docs)


def _link(docs: DataFrame) -> DataFrame:
    base = written_sets(docs)
    rows = classes(base)
    # one row for each class; of rows with one doc_id and several texts the larger set stands for it
    reps = rows.where("doc_id = rep").groupBy("doc_id").agg(F.max("n").alias("n"), F.count("*").alias("k"))
    sets = base.where("digest is not null").join(small(reps.select("doc_id", "n")), ["doc_id", "n"], "left_semi")
    if reps.where("k > 1").limit(1).count():
        sets = sets.dropDuplicates(["doc_id"])
    sets = sets.select("doc_id", "n", "low", "hashes")
    low = sets.select("doc_id", F.explode("low").alias("h"))
    leads = low.groupBy("h").agg(F.min("doc_id").alias("a"), F.count("*").alias("k")).where("k > 1").select("h", "a")
    met = low.join(leads, "h").where("a <> doc_id").groupBy("a", F.col("doc_id").alias("b")).agg(F.count("*").alias("k"))
    first = cut(met.groupBy("b").agg(F.min(F.struct(-F.col("k"), "a")).alias("x")).select("x.a", "b"), "first")  # one lead a document: the rest is left to step 3
    links = measured(first, sets)
    tied = components(links)
    own = reps.join(tied.withColumnRenamed("node", "doc_id"), "doc_id", "left").join(links.select(F.col("b").alias("doc_id"), F.col("a").alias("pivot"), F.col("gap").alias("radius")), "doc_id", "left")
    known = cut(own.select("doc_id", F.coalesce("component", "doc_id").alias("component"), F.coalesce("pivot", "doc_id").alias("pivot"), F.coalesce("radius", F.lit(0)).cast("long").alias("radius"), "n"), "known")
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    pairs = candidates(sets, known.drop("n"), total)
    apart = measured(pairs, sets)
    stars = lambda t: t.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    tied = components(stars(tied).union(apart.where(F.col("gap") * 7 <= F.col("n_a") + F.col("n_b")).select("a", "b")))
    sure, behind = open_pairs(apart, known, tied, sets)
    more = measured(behind, sets)
    final = components(stars(tied).union(sure).union(more.select("a", "b")))
    for done in (base, first, links, known, pairs, apart, sure, behind, more):
        drop_cut(done)
    out = rows.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, less those that are linked to one with a smaller doc_id; of rows with one doc_id, one stays."""
    linked = cut(link(docs), "linked")
    gone = linked.where("doc_id <> component_id").select("doc_id").distinct()
    again = linked.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    kept = docs.join(small(gone), docs["doc_id"] == gone["doc_id"], "left_anti")
    if again.limit(1).count():
        again = small(again)
        twice = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        kept = kept.join(again, "doc_id", "left_anti").select(*kept.columns).unionByName(twice.select(*kept.columns))
    return kept
