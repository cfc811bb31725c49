"""An extension: neighbour lookup for a stream of points against a static index (a stream-static join, no state)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.neighbors import hashed, signatures


def stream_lookup(stream: DataFrame, data: DataFrame, seed: int) -> DataFrame:
    """(query_id, neighbor_id) for each streamed (id, keywords); append mode."""
    index = signatures(hashed(data), seed).select(F.col("id").alias("neighbor_id"), "sig")
    return signatures(stream, seed).select(F.col("id").alias("query_id"), "sig").join(index, "sig").select("query_id", "neighbor_id")
