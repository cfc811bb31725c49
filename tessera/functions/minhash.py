"""The 32-bit keyword hash and the MinHash signature.

The base-31 string hash has two equal forms: ``string_hash`` is a Spark expression, a fold over characters, and
``string_hashes`` takes whole Arrow batches of keyword lists (9.8 and 5.4 s for two seeds at sf0.1, one run each). As the hash of
word + seed is hash(word) * 31^len(seed) + hash(seed), words are hashed once whatever the number of seeds, and all that
depends on a seed stays in the JVM.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the signature format: two signed 32-bit multipliers and two shifts; the string hash has base 31.
FIRST_FACTOR = -862048943
SECOND_FACTOR = 461845907
FIRST_SHIFT = 15
SECOND_SHIFT = 13
BASE = 31
#: Signatures lie in 0..LARGEST, which bounds any histogram of them.
LARGEST = 262_144
#: Bytes of words that a Python worker hashes in one go.
PART_BYTES = 2 << 20


def _wrap(x: Column) -> Column:
    """To a signed 32-bit value, kept in a bigint (ANSI mode raises on overflow of an int)."""
    high = F.lit(1 << 31).cast("long")
    return x.bitwiseAND(F.lit((1 << 32) - 1)).bitwiseXOR(high) - high


def string_hash(text: Column) -> Column:
    """Base-31 hash over UTF-16 units; a code point over 65535 counts as its two units."""

    def step(acc: Column, unit: Column) -> Column:
        return _wrap(acc * BASE + unit)

    def fold(acc: Column, code: Column) -> Column:
        over = code - 65536
        pair = step(step(acc, F.shiftright(over, 10) + 55296), over.bitwiseAND(F.lit(1023)) + 56320)
        return F.when(code < 65536, step(acc, code)).otherwise(pair)

    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), fold)


def _list_hashes(lists: pa.Array) -> pa.Array:
    """In parts of about PART_BYTES of words, as what is made of a part takes over twenty times that."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(lists.flatten()), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
    edges = [0, *(np.flatnonzero(np.diff(sizes[ends] // PART_BYTES)) + 1).tolist(), len(lists)]
    parts = [_part_hashes(lists.slice(a, b - a)) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]
    return pa.concat_arrays(parts) if parts else _part_hashes(lists)


def _part_hashes(lists: pa.Array) -> pa.Array:
    words = lists.flatten()
    text = "".join(words.drop_null().to_pylist())
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2").astype(np.uint32)
    sizes = pc.fill_null(pc.utf8_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if len(units) != len(text):  # some characters are two units
        sizes = np.array([len((w or "").encode("utf-16-le", "surrogatepass")) // 2 for w in words.to_pylist()], dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    powers = np.cumprod(np.concatenate([[1], np.full(int(sizes.max(initial=0)), BASE)]).astype(np.uint32), dtype=np.uint32)
    place = np.repeat(ends[1:], sizes) - 1 - np.arange(len(units))
    sums = np.concatenate([np.zeros(1, np.uint32), np.cumsum(units * powers[place], dtype=np.uint32)])
    hashes = pa.array((sums[ends[1:]] - sums[ends[:-1]]).view(np.int32), mask=np.asarray(words.is_null()))
    filled = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(filled)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), hashes)


def string_hashes(keywords: Column) -> Column:
    """array<string> to array<int>, element by element; a null list gives an empty one."""
    # as not deterministic, so that no filter that is inferred from what is made of it evaluates it again
    return F.arrow_udf(_list_hashes, "array<int>").asNondeterministic()(keywords)


def _seeded(h: Column, seed: int) -> Column:
    tail, own = str(seed), 0
    for c in tail:
        own = (own * BASE + ord(c)) & ((1 << 32) - 1)
    factor = pow(BASE, len(tail), 1 << 32)
    h = _wrap(h.cast("long") * F.lit(factor).cast("long") + F.lit(own).cast("long"))
    h = F.shiftright(_wrap(h * FIRST_FACTOR), FIRST_SHIFT)
    h = F.shiftright(_wrap(h * SECOND_FACTOR), SECOND_SHIFT)
    return F.abs(h).cast("int")


def keyword_hash(keyword: Column, seed: int) -> Column:
    return _seeded(string_hash(keyword), seed)


def signature(keywords: Column, seed: int) -> Column:
    """The least hash of a keyword set; null for an empty or null set."""
    return hashed_signature(string_hashes(keywords), seed)


def hashed_signature(hashes: Column, seed: int) -> Column:
    """The signature from what ``string_hashes`` gave."""
    return F.array_min(F.transform(hashes, lambda h: _seeded(h, seed)))


def jaccard(a: Column, b: Column) -> Column:
    """Null if both sets are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.try_divide(both.cast("double"), F.size(F.array_union(a, b)).cast("double"))
