"""Quality classifier: logistic regression on hashed word 1- and 2-grams, trained by follow-the-regularised-leader.

Tokens are runs of word characters and single other characters. Next to the n-grams of the tokens themselves stand
2-grams of their shapes (lower, title, upper case, digits, the character itself, or 'as before' for a repeated token),
which tell of words never seen in training. A text is the vector of square roots of its hashed n-gram counts, of length
1; its score is the sigmoid of the sparse dot product with the weights plus the bias.

Training sees at most about ``FIT_DOCS`` labelled documents, picked by a hash of doc_id, in the order of another hash,
in one task, for ``EPOCHS`` passes; everything else is one scan without a shuffle. Cases: a null text scores as an
empty one, by the bias alone; a null label, a label without a document and a document without a label train nothing; a
document with several labels trains once for each; without any label all scores are 0.5. Extra columns are kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import crc, hash_sample, small, thrifty

BITS = 18
FIT_DOCS = 8_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
THRESHOLD = 0.3
_TOKEN = re.compile(r"\w+|[^\w\s]")
_CACHE = 300_000


_AGAIN = 255


def shape(token: str) -> int:
    """0 to 254."""
    if token[0].isalnum() or token[0] == "_":
        return 0 if token.islower() else 1 if token.istitle() else 2 if token.isupper() else 3 if token.isdigit() else 4
    return 5 + ord(token[0]) % 250


class TokenHashes(dict):
    """Token to its 32-bit hash times 256, plus its shape; emptied by its owner when it is large."""

    def __missing__(self, token: str) -> int:
        self[token] = value = zlib.crc32(token.encode("utf-8", "surrogatepass")) << 8 | shape(token)
        return value


def features(text: str | None, known: TokenHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams and their values."""
    tokens = _TOKEN.findall(text or "")
    if not tokens:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    own = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    one, form = (own >> np.uint64(8)).astype(np.uint32), (own & np.uint64(255)).astype(np.uint32)
    two = (one[:-1] * np.uint32(0x9E3779B1) + one[1:]) * np.uint32(0x85EBCA6B)
    forms = (form[:-1] << np.uint32(8)) + np.where(one[1:] == one[:-1], np.uint32(_AGAIN), form[1:])
    forms = (forms + np.uint32(1)) * np.uint32(0x27D4EB2F)
    index, counts = np.unique(np.concatenate([one * np.uint32(0xC2B2AE35), two, forms]) >> np.uint32(32 - BITS), return_counts=True)
    return index.astype(np.int64), (np.sqrt(counts) / np.sqrt(counts.sum())).astype(np.float32)


class Ftrl:
    """The per-coordinate leader with L1 and L2 terms (McMahan and others, 2013). The last coordinate is the bias."""

    def __init__(self, size: int = 1 << BITS):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, i: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, index: np.ndarray, values: np.ndarray, label: int) -> None:
        i, x = np.append(index, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(i)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[i] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, target: str = "quality") -> np.ndarray:
    """The dense weight vector, bias last. ``labels``: (doc_id, target) of the rows that may be learned from."""
    own = labels.select("doc_id", F.col(target).cast("int").alias("y")).where("doc_id is not null and y is not null")
    n = own.count()
    own = hash_sample(own, "doc_id", min(1.0, fit_docs / max(n, 1)), 7)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = TokenHashes()
        for b in batches:
            made = [features(t, known) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("k"), b.column("y"), pa.array([i.astype(np.int32).tobytes() for i, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary())],
                names=["k", "y", "i", "v"],
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [
            (np.frombuffer(i, np.int32).astype(np.int64), np.frombuffer(v, np.float32), y)
            for b in batches
            for y, i, v in zip(b.column("y").to_pylist(), b.column("i").to_pylist(), b.column("v").to_pylist(), strict=True)
        ]
        model = Ftrl()
        for _ in range(EPOCHS):
            for row in rows:
                model.learn(*row)
        w = model.weights().astype(np.float32)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int32).tobytes()]), pa.array([w[at].tobytes()])], names=["i", "w"])

    # the sample is bounded by its parameter (in expectation, so it is measured too): broadcast to the scan of the texts, and met again in one task
    picked = docs.select("doc_id", "text").join(small(own), "doc_id")
    made = picked.select(F.xxhash64("doc_id", F.lit(11)).alias("k"), "y", "text").mapInArrow(extract, "k long, y int, i binary, v binary")
    got = made.repartition(1).sortWithinPartitions("k", "y", "i").mapInArrow(learn, "i binary, w binary").collect()
    w = np.zeros((1 << BITS) + 1, np.float32)
    for r in got:
        w[np.frombuffer(r.i, np.int32)] = np.frombuffer(r.w, np.float32)
    return w


def with_score(docs: DataFrame, weights: np.ndarray, column: str = "score") -> DataFrame:
    """The documents with a score from 0 to 1 for every text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w, known = shared.value, TokenHashes()
        for texts in batches:
            out = np.empty(len(texts))
            for k, text in enumerate(texts):
                index, values = features(text.as_py(), known)
                out[k] = w[index] @ values + w[-1]
            if len(known) > _CACHE:
                known.clear()
            yield pa.array(1 / (1 + np.exp(-out)))

    def typed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return score(batches)

    return docs.withColumn(column, F.arrow_udf(thrifty(typed), "double").asNondeterministic()(F.col("text")))


def learnable(labels: DataFrame) -> DataFrame:
    """Rows that training may see: crc32(doc_id) mod 5 is not 0."""
    return labels.where(crc("doc_id", 5) != 0)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = with_score(docs.select("doc_id", "text"), fit(docs, learnable(labels)))
    return scored.select(
        "doc_id", F.coalesce(crc("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that the classifier accepts."""
    mark = "__quality"
    return with_score(docs, fit(docs, learnable(labels)), mark).where(F.col(mark) >= THRESHOLD).drop(mark)
