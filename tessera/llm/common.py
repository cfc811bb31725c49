"""What the operators share: reading tables, the shared work folder, hash tests and bounded samples."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.store import bound_batches, bounded_batches, cut, drop_cut, remove, small, work_path

__all__ = ["PIECE_MODEL", "bound_batches", "bounded_batches", "crc", "cut", "drop_cut", "hash_sample", "remove", "small", "table", "text_parts", "thrifty", "work_path"]

#: Public tokenizer files; a parameter of every operator that uses one.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of texts that a Python worker takes apart in one go; a longer one is taken alone. Words as Python strings take ten times that.
TEXT_BYTES = 2 << 20


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def crc(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def hash_sample(df: DataFrame, key: str, fraction: Column | float, seed: int) -> DataFrame:
    """A reproducible sample by a hash of ``key``; which rows are in it does not depend on partitions."""
    u = F.xxhash64(F.col(key), F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") / float(1 << 52)
    return df.where(u < fraction)


def text_parts(texts: pa.Array, most: int | None = None) -> Iterator[pa.Array]:
    """The texts in parts of about ``most`` bytes, so that what is made of one is bounded however many rows a batch has."""
    part = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // (most or TEXT_BYTES)
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            yield texts.slice(a, b - a)


def release() -> None:
    """Gives what this process has freed back to the system. Python workers outlive their tasks and would keep it beside the heap that later stages need."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def thrifty(f: Callable) -> Callable:
    """A function of an iterator of batches that releases a worker's memory when a task ends."""

    @wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            release()

    return run
