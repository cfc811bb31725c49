"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

The distinct marked words of a batch are sorted, which lays them out as a depth-first walk of their trie: each word
keeps the forward states of the prefix that it shares with the word before and extends them by its own characters only.
The state of a prefix is its best last piece, the score of the best path there and its longest end that begins a piece, from which
the pieces that it can end with are known (as in an Aho-Corasick automaton, whose steps are found when first needed).

Two kinds of model are read from the file. For a unigram model the best path has the largest sum of piece scores. For
a merge (BPE) model, scores are merge ranks and the library's result is that of merging, not the largest sum; there the
lattice has a constraint on neighbours instead: piece b may follow piece a only if merging the text of both gives a, b
again. A sequence of pieces is the result of merging exactly if all its neighbours pass, so each prefix has one path, the
search is exact, and ids equal the library's. Whether a pair passes depends on the pair alone and is remembered.

Text is handled as the library does for a model without normalisation: a space becomes the mark, one mark goes before
the text, characters without a piece become byte pieces. Pieces hold marks at their start only, so a text is cut into
marked words before each mark that follows another character, and words are encoded alone.

One scan, no shuffle; memory is that of one batch plus bounded caches. Cases: a null text gives null ids and null text,
an empty one no ids and the empty text; a literal mark in a text reads back as a space, as in the library; a text with
lone surrogates cannot occur in Parquet. Words of any length are encoded whole. Extra columns are kept.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import PIECE_MODEL, thrifty

MARK = "▁"
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_CUT = "\0"
#: Words, and pairs or steps, that an encoder remembers, and bytes of text (or ids) worked on at a time.
_CACHE = 250_000
_PAIRS = 400_000
_SLICE = 2_000_000
NORMAL, UNIGRAM, BPE = 1, 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol-buffer message: number and value (int or bytes)."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[i : i + size]
            i += size


@dataclass
class Model:
    """Pieces by id, with the normal ones' ids and scores by text."""

    pieces: list[str]
    ids: dict[str, int]
    scores: list[float]
    byte_ids: list[int]
    unknown: int
    merging: bool
    reachable: dict[str, int] = field(default_factory=dict)
    starts: set[str] = field(default_factory=set)
    bytes_of: pa.BinaryArray | None = None

    @classmethod
    def load(cls, path: str = PIECE_MODEL, unigram: bool | None = None) -> "Model":
        """``unigram`` overrides the kind that the file states."""
        pieces, scores, kinds, merging = [], [], [], False
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    own = dict(_fields(value))
                    pieces.append(own[1].decode())
                    scores.append(float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0]))
                    kinds.append(own.get(3, NORMAL))
                elif number == 2:
                    merging = dict(_fields(value)).get(3, UNIGRAM) == BPE
        ids = {p: i for i, p in enumerate(pieces) if kinds[i] in (1, 4)}  # normal and user-defined
        byte_ids = [i for i, k in enumerate(kinds) if k == 6]
        m = cls(pieces, ids, scores, byte_ids, kinds.index(2), merging if unigram is None else not unigram)
        # a piece that merging its own text does not give back occurs in no result
        m.reachable = {p: i for p, i in ids.items() if len(p) == 1 or m.merged(p) == [p]} if m.merging else ids
        m.starts = {p[:k] for p in m.reachable for k in range(len(p) + 1)} | {""}
        own = {i: bytes([b]) for b, i in enumerate(byte_ids)}
        m.bytes_of = pa.array([own.get(i) or (p.encode() if p in ids else b"") for i, p in enumerate(pieces)], pa.binary())
        return m

    def merged(self, text: str) -> list[str]:
        """Merging by its definition: the neighbours whose joined piece scores best, leftmost first. For short texts."""
        parts = list(text)
        while True:
            best = None
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best[0]):
                    best = self.scores[k], i
            if best is None:
                return parts
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]


class Encoder:
    """Encodes arrays of texts; remembers words and pairs up to a bound."""

    def __init__(self, model: Model):
        self.m, self.pairs, self.steps = model, {}, {}
        self.unknown_score = min(model.scores) - 10
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, int] = {}  # the number of each known word; its ids are flat[ends[number] : ends[number + 1]]
        self.flat, self.ends = array("i"), array("i", [0])

    def encode_words(self, words: Iterable[str]) -> None:
        """Adds the ids of new words, sharing the states of common prefixes."""
        m, pairs, steps, ids = self.m, self.pairs, self.steps, self.m.ids
        last: list[str] = [""]  # the best last piece of each prefix of the word at hand
        score: list[float] = [0.0]
        state: list[str] = [""]  # the longest end of each prefix that begins a piece
        before = ""
        for word in sorted(words):
            n, keep = len(word), 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                keep += 1
            del last[keep + 1 :], score[keep + 1 :], state[keep + 1 :]
            for j in range(keep + 1, n + 1):
                end = state[-1] + word[j - 1]
                step = steps.get(end) or self.step(end)
                state.append(step[0])
                piece, best = None, -np.inf
                for t in step[1]:
                    k = j - len(t)
                    if m.merging:
                        ok = k == 0 or pairs.get((last[k], t))
                        if ok or ok is None and self.follows(last[k], t):
                            piece, best = t, 0.0
                            break
                    else:
                        i = ids.get(t)
                        s = score[k] + (self.unknown_score if i is None else m.scores[i])
                        if s > best:
                            piece, best = t, s
                last.append(piece)
                score.append(best)
            parts, j = [], n
            while j:
                parts.append(last[j])
                j -= len(last[j])
            for p in reversed(parts):
                i = ids.get(p)
                if i is not None:
                    self.flat.append(i)
                else:
                    self.flat.extend([m.byte_ids[b] for b in p.encode()] if m.byte_ids else [m.unknown])
            self.codes[word] = len(self.codes)
            self.ends.append(len(self.flat))
            before = word

    def step(self, end: str) -> tuple[str, tuple[str, ...]]:
        """The state of a prefix that ends so, and the pieces that it can end with: longest first, its last character always."""
        if len(self.steps) > _PAIRS:
            self.steps.clear()
        state = next(end[k:] for k in range(len(end) + 1) if end[k:] in self.m.starts)
        fit = [state[k:] for k in range(len(state) - 1) if state[k:] in self.m.reachable]
        found = self.steps[end] = state, (*fit, end[-1])
        return found

    def follows(self, a: str, b: str) -> bool:
        if len(self.pairs) > _PAIRS:
            self.pairs.clear()
        ok = self.pairs[a, b] = self.m.merged(a + b) == [a, b]
        return ok

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text, in slices of a bounded number of bytes."""
        size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
        return _joined([self._encode(texts.slice(a, b - a)) for a, b in _slices(size)], pa.list_(pa.int32()))

    def _encode(self, texts: pa.Array) -> pa.ListArray:
        words = marked_words(texts)
        if len(self.codes) > _CACHE:
            self.forget()
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self.encode_words([w for w in distinct if w not in self.codes])
        known = np.fromiter((self.codes[w] for w in distinct), np.int64, len(distinct))
        ends = np.array(self.ends, np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.array(self.flat, np.int32)))
        ids = ids.take(pa.array(known[coded.indices.to_numpy()]))
        at = words.offsets.to_numpy()
        into = ids.offsets.to_numpy()[at - at[0]]
        return pa.ListArray.from_arrays(pa.array(into - into[0]), ids.flatten(), mask=texts.is_null())


def marked_words(texts: pa.Array) -> pa.ListArray:
    """Each text marked and cut before each mark that follows another character; no words for an empty or null text."""
    texts = pc.fill_null(texts, "")
    if pc.any(pc.match_substring(texts, _CUT)).as_py():  # the character that cuts occurs in a text itself
        return pa.array([_WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))
    marked = pc.replace_substring(pc.binary_join_element_wise(MARK, texts, ""), " ", MARK)
    words = pc.split_pattern(pc.replace_substring_regex(marked, f"([^{MARK}]){MARK}", f"\\1{_CUT}{MARK}"), _CUT)
    filled = pc.not_equal(texts, "")
    if pc.all(filled).as_py():
        return words
    at = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy() * filled.to_numpy(zero_copy_only=False))])
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), words.filter(filled).flatten())


def _slices(size: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` units, or one row, from running totals that begin with 0."""
    a, rows, most = 0, len(size) - 1, most or _SLICE
    while a < rows:
        b = max(a + 1, int(np.searchsorted(size, size[a] + most, "right")) - 1)
        yield a, b
        a = b


def _joined(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def decode_lists(model: Model, lists: pa.ListArray) -> pa.StringArray:
    """Pieces joined, byte pieces as UTF-8 (bad bytes as U+FFFD), marks as spaces, without the first space."""
    at = lists.offsets.to_numpy().astype(np.int64)
    return _joined([_decode(model, lists.slice(a, b - a)) for a, b in _slices(at - at[0])], pa.string())


def _decode(model: Model, lists: pa.ListArray) -> pa.StringArray:
    at = lists.offsets.to_numpy()
    ids = lists.values.slice(at[0], at[-1] - at[0])
    pieces = model.bytes_of.take(ids)
    ends = np.frombuffer(pieces.buffers()[1], np.int32)[: len(ids) + 1][at - at[0]]
    raw = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(np.ascontiguousarray(ends)), pieces.buffers()[2]])
    try:
        text = raw.cast(pa.string())
    except pa.ArrowInvalid:  # only for ids that do not come from a text
        text = pa.array([b.decode("utf-8", "replace") for b in raw.to_pylist()], pa.string())
    text = pc.replace_substring_regex(pc.replace_substring(text, MARK, " "), "^ ", "", max_replacements=1)
    return pc.if_else(lists.is_valid(), text, pa.scalar(None, pa.string()))


def decode(model: Model, ids: np.ndarray) -> str:
    return decode_lists(model, pa.array([ids], pa.list_(pa.int32())))[0].as_py()


def with_ids(docs: DataFrame, model_path: str = PIECE_MODEL, column: str = "piece_ids") -> DataFrame:
    """The documents with their piece ids."""
    shared = docs.sparkSession.sparkContext.broadcast(Model.load(model_path))

    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(shared.value)
        for texts in batches:
            yield encoder.encode(texts)

    return docs.withColumn(column, F.arrow_udf(thrifty(encoded), "array<int>").asNondeterministic()(F.col("text")))


def with_text(encoded: DataFrame, model_path: str = PIECE_MODEL, ids: str = "piece_ids", column: str = "decoded") -> DataFrame:
    """Rows of ids with the text that they stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast(Model.load(model_path))

    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield decode_lists(shared.value, lists)

    return encoded.withColumn(column, F.arrow_udf(decoded, "string").asNondeterministic()(F.col(ids)))


def tokenise(docs: DataFrame, model_path: str = PIECE_MODEL) -> DataFrame:
    """doc_id, piece_ids, n_pieces, and whether decoding the ids gives the text back (null for a null text).

    Encoding and decoding share one pass, so that a task has one Python worker and the decoded text stays there.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Model.load(model_path))

    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(shared.value)
        for texts in batches:
            ids = encoder.encode(texts)
            same = pc.equal(decode_lists(shared.value, ids), pc.replace_substring(texts, MARK, " "))
            yield pa.StructArray.from_arrays([ids, same], ["piece_ids", "round_trip"])

    run = F.arrow_udf(both, "piece_ids array<int>, round_trip boolean").asNondeterministic()
    out = docs.select("doc_id", run(F.col("text")).alias("own"))
    return out.select("doc_id", "own.piece_ids", F.size("own.piece_ids").alias("n_pieces"), "own.round_trip")
