"""Language identification by unigrams over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum
over all its segmentations into pieces, by the forward algorithm; that of a text is the product over its words, which
are its runs of letters in lower case. Probabilities are learned by expectation maximisation (forward-backward counts)
from the words of at most about ``FIT_DOCS`` documents a language, picked by a hash of doc_id.

Scoring is one scan without a shuffle; the model (pieces x languages) is broadcast, and is bounded by the vocabulary.
Cases: a null text and one without a letter are 'und' with score 0; null languages are not learned; with no language
at all everything is 'und'; equally likely languages go to the first in order of name. Repeated rows count as often
as they occur. Extra columns are kept. Long texts and long words are learned from and scored whole (scaled to avoid
underflow; scoring holds a window of a word's sums, learning those of one word).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import PIECE_MODEL, crc, cut, drop_cut, hash_sample, text_parts, thrifty

FIT_DOCS = 3_000
ROUNDS = 3
#: Added to the expected count of every piece, so that none is impossible.
FLOOR = 0.05
#: The probability of one letter that no piece has, in every language.
UNKNOWN = 1e-9
#: Letters and other numerals than digits; only a word that is not all letters is cut again, letter by letter.
_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 200_000
#: Steps of the automaton that are remembered, and cells of one block of a word's sums.
_STEPS, _CELLS = 300_000, 1 << 16
MARK = "▁"


def load_pieces(path: str = PIECE_MODEL) -> list[str]:
    """The vocabulary's pieces of lower-case letters, with or without the word mark."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [p.id_to_piece(i) for i in range(p.vocab_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]
    return [x for x in pieces if x == MARK or x.removeprefix(MARK).isalpha() and x == x.lower()]


def words_of(text: str | None) -> list[str]:
    words = _WORD.findall(text.lower()) if text else []
    if not all(map(str.isalpha, words)):
        words = ["".join(g) for w in words for letters, g in groupby(w, str.isalpha) if letters]
    return words


class Lattice:
    """Segmentations of marked words into pieces, many words of one length at a time."""

    def __init__(self, pieces: list[str]):
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.widest = max(map(len, pieces))
        self.none, self.unknown = len(pieces), len(pieces) + 1
        self.starts = {p[:k] for p in pieces for k in range(1, len(p) + 1)}
        self.forget()

    def forget(self) -> None:
        self.steps: dict[str, tuple[str, int]] = {}  # a state and the next character: the next state, and the row of the pieces that end there
        self.rows = np.empty((1024, self.widest), np.int32)
        self.n_rows = 0

    def step(self, end: str) -> tuple[str, int]:
        """The longest end that begins a piece, as in an Aho-Corasick automaton whose steps are found when first needed, and the row of the pieces that end here."""
        if self.n_rows == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        row = self.rows[self.n_rows]
        row[:] = [self.ids.get(end[-k:], self.none) if k <= len(end) else self.none for k in range(1, self.widest + 1)]
        if row[0] == self.none:
            row[0] = self.unknown
        state = next((end[k:] for k in range(len(end)) if end[k:] in self.starts), "")
        found = self.steps[end] = state, self.n_rows
        self.n_rows += 1
        return found

    def arcs(self, words: list[str], n: int, states: list[str] | None = None) -> np.ndarray:
        """[word, end - 1, width - 1] piece ids of words that all have n characters with the mark. ``states``: those of the words so far, which are moved on."""
        if self.n_rows > _STEPS:
            self.forget()
        out, steps = np.empty((len(words), n), np.int32), self.steps
        for k, word in enumerate(words):
            state = states[k] if states else ""
            row = []
            for c in word:
                end = state + c
                state, r = steps.get(end) or self.step(end)
                row.append(r)
            out[k] = row
            if states:
                states[k] = state
        return self.rows[out]

    def log_probability(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """[word, language] sums over all segmentations, in blocks of ends: of a word of any length only a window of sums is held."""
        out = np.empty((len(words), p.shape[1]))
        for at, group, n in self.by_length(words):
            wide, block = self.widest, max(self.widest, _CELLS // len(group))
            scale = np.zeros(len(group))
            a = np.zeros((len(group), wide + min(block, n), p.shape[1]))  # a[:, wide + j] are the sums of the prefixes that end at j of this block
            a[:, wide - 1] = 1
            states = [""] * len(group) if n > block else None
            for first in range(0, n, block):
                size = min(block, n - first)
                arcs = self.arcs([w[first : first + size] for w in group] if states else group, size, states)
                for j in range(size):
                    m = min(wide, first + j + 1)
                    window = a[:, wide + j - m : wide + j]
                    x = np.einsum("wkl,wkl->wl", window[:, ::-1], p[arcs[:, j, :m]])
                    top = x.max(1)
                    tiny = top < 1e-60
                    if tiny.any():  # the window moves to a new scale, so that long words do not underflow
                        f = np.where(tiny, 1 / np.maximum(top, 1e-300), 1.0)
                        x *= f[:, None]
                        window *= f[:, None, None]
                        scale -= np.log(f)
                    a[:, wide + j] = x
                a[:, :wide] = a[:, size : size + wide]
            out[at] = np.log(np.maximum(a[:, wide - 1], 1e-300)) + scale[:, None]
        return out

    @staticmethod
    def by_length(words: list[str], cells: int = _CELLS) -> Iterator[tuple[np.ndarray, list[str], int]]:
        """Positions and marked words of one length, in blocks of bounded size."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            step = max(1, cells // (int(n) + 2))
            for k in range(0, len(at), step):
                yield at[k : k + step], [MARK + words[i] for i in at[k : k + step]], int(n) + 1

    def expected(self, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected piece counts under one language's probabilities, by forward and backward sums; of long words in logarithms, as a long chain would underflow."""
        total = np.zeros(len(p))
        for at, group, n in self.by_length(words):
            arcs = self.arcs(group, n)
            width = min(arcs.shape[2], n)
            if n > 64:
                total += self._expected_long(arcs, counts[at], p)
                continue
            q = p[arcs]
            a, b = np.zeros((len(group), n + 1)), np.zeros((len(group), n + 1))
            a[:, 0] = b[:, n] = 1
            for j in range(1, n + 1):
                m = min(width, j)
                a[:, j] = np.einsum("wk,wk->w", a[:, j - m : j][:, ::-1], q[:, j - 1, :m])
            z = np.maximum(a[:, n], 1e-300)
            for j in range(n, 0, -1):
                for k in range(1, min(width, j) + 1):
                    b[:, j - k] += q[:, j - 1, k - 1] * b[:, j]
            share = counts[at] / z
            for k in range(1, width + 1):  # pieces of k characters, at all ends at once
                total += np.bincount(arcs[:, k - 1 :, k - 1].ravel(), (a[:, : n + 1 - k] * q[:, k - 1 :, k - 1] * b[:, k:] * share[:, None]).ravel(), len(p))
        return total

    @staticmethod
    def _expected_long(arcs: np.ndarray, counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        w, n, width = arcs.shape
        log_p = np.log(p, where=p > 0, out=np.full(len(p), -np.inf))
        a, b = np.full((w, n + 1), -np.inf), np.full((w, n + 1), -np.inf)
        a[:, 0] = b[:, n] = 0
        for j in range(1, n + 1):
            m = min(width, j)
            a[:, j] = np.logaddexp.reduce(a[:, j - m : j][:, ::-1] + log_p[arcs[:, j - 1, :m]], axis=1)
        for k in range(n - 1, -1, -1):
            m = np.arange(min(width, n - k))
            b[:, k] = np.logaddexp.reduce(b[:, k + 1 : k + 1 + len(m)] + log_p[arcs[:, k + m, m]], axis=1)
        total = np.zeros(len(p))
        for k in range(1, min(width, n) + 1):
            own = arcs[:, k - 1 :, k - 1]
            total += np.bincount(own.ravel(), (counts[:, None] * np.exp(a[:, : n + 1 - k] + log_p[own] + b[:, k:] - a[:, n:])).ravel(), len(p))
        return total


def _with_rest(p: np.ndarray) -> np.ndarray:
    """Rows for no piece (0) and for an unknown letter."""
    return np.vstack([p, np.zeros((1, p.shape[1])), np.full((1, p.shape[1]), UNKNOWN)])


def fit(docs: DataFrame, pieces: list[str], fit_docs: int = FIT_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages in order of name, and probabilities [piece, language]."""
    spark = docs.sparkSession
    own = docs.select("doc_id", "lang", "text").where("lang is not null")
    counts = {r.lang: r.n for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((len(pieces), 0))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, fit_docs / counts[lang]))])
    picked = hash_sample(own, "doc_id", share[F.col("lang")], 3)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter = Counter()
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                found.update((lang, w) for w in words_of(text))
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([found[k] for k in keys], pa.int64())], names=["lang", "word", "n"])

    words = cut(picked.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    place = {x: i for i, x in enumerate(langs)}
    p = np.full((len(pieces), len(langs)), 1 / len(pieces))
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((pieces, _with_rest(p)))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary, q = shared.value  # noqa: B023
            lattice = Lattice(vocabulary)
            for b in batches:
                lang = np.array(b.column("lang").to_pylist(), dtype=object)
                word, n = b.column("word").to_pylist(), b.column("n").to_numpy()
                for x in sorted({*lang}):
                    at = np.flatnonzero(lang == x)
                    c = lattice.expected([word[i] for i in at], n[at], q[:, place[x]])[: len(vocabulary)]
                    some = np.flatnonzero(c)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), place[x], np.int32)), pa.array(some.astype(np.int32)), pa.array(c[some])], names=["l", "i", "c"])

        got = words.mapInArrow(expect, "l int, i int, c double").groupBy("l", "i").agg(F.sum("c").alias("c")).toPandas()
        p = np.full((len(pieces), len(langs)), FLOOR)
        p[got["i"].to_numpy(), got["l"].to_numpy()] += got["c"].to_numpy()
        p /= p.sum(0)
        shared.unpersist()
    drop_cut(words)
    return langs, p


def predictions(batches: Iterator[pa.Array], vocabulary: list[str], names: list[str], q: np.ndarray) -> Iterator[pa.Array]:
    """(lang, score) of every text. A batch is taken apart in parts of bounded bytes."""
    lattice, known, table = Lattice(vocabulary), {}, np.empty((0, q.shape[1]))
    for batch in batches:
        langs, scores = [], []
        for texts in text_parts(batch):
            split = [words_of(t.as_py()) for t in texts]
            if len(known) > _CACHE:
                known, table = {}, table[:0].copy()
            new = list({w for words in split for w in words} - known.keys()) if names else []
            if new:
                known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                table = np.vstack([table, lattice.log_probability(new, q)])
            lang, score = ["und"] * len(split), np.zeros(len(split))
            for k, words in enumerate(split):
                if words and names:
                    x = table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(0)
                    best = int(x.argmax())
                    lang[k], score[k] = names[best], 1 / np.exp(x - x[best]).sum()
            langs.append(pa.array(lang, pa.string()))
            scores.append(pa.array(score))
        yield pa.StructArray.from_arrays([pa.concat_arrays(langs) if langs else pa.array([], pa.string()), pa.concat_arrays(scores) if scores else pa.array([], pa.float64())], ["lang", "score"])


def with_language(docs: DataFrame, pieces: list[str], langs: list[str], p: np.ndarray, column: str = "language") -> DataFrame:
    """The documents with a struct (lang, score): the likeliest language and its posterior under equal priors."""
    shared = docs.sparkSession.sparkContext.broadcast((pieces, langs, _with_rest(p)))

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return predictions(batches, *shared.value)

    def typed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return predict(batches)

    return docs.withColumn(column, F.arrow_udf(thrifty(typed), "struct<lang:string,score:double>").asNondeterministic()(F.col("text")))


def learnable(docs: DataFrame) -> DataFrame:
    """Rows that training may see: crc32(doc_id) mod 4 is not 2."""
    return docs.where(crc("doc_id", 4) != 2)


def identify(docs: DataFrame, model_path: str = PIECE_MODEL) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    pieces = load_pieces(model_path)
    out = with_language(docs.select("doc_id", "text"), pieces, *fit(learnable(docs), pieces))
    return out.select(
        "doc_id", F.coalesce(crc("doc_id", 4) == 2, F.lit(False)).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score")
    )


def accepted(docs: DataFrame, model_path: str = PIECE_MODEL) -> DataFrame:
    """The documents, with all their columns, whose language is told: texts without a letter and undecided ones (posterior under 0.5) go."""
    pieces, mark = load_pieces(model_path), "__language"
    out = with_language(docs, pieces, *fit(learnable(docs), pieces), mark)
    return out.where((F.col(f"{mark}.lang") != "und") & (F.col(f"{mark}.score") >= 0.5)).drop(mark)
