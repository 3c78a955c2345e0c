"""SentencePiece encoding and decoding: distinct marked words in a trie, forward states shared by common prefixes.

A text becomes words that start with their space marks; no piece crosses the
start of a word, so words are encoded one by one and each distinct one once.
Sorted, they are the depth-first order of a trie: the forward states of a word
up to its common prefix with the word before it are those of that word.

The vocabulary at hand is of the BPE kind, whose right segmentation is that of
its merges and not the one of the greatest total score. It is a Viterbi of
one state per position all the same: the last piece of a prefix is the only
piece that ends there, goes on from the last piece before it, and forms with
it a pair that merging leaves as it is. Which pairs merging leaves is found
once per pair. Characters outside the vocabulary become byte pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tanyalah.llm.words import text_buffer

MARK = "▁"
CACHE_WORDS = 250_000
BLOCK_CHARS = 1 << 22
UNKNOWN = " ⁇ "


class Vocabulary(NamedTuple):
    """Pieces by id, their scores, and their kinds: n normal, b byte, u unknown, c control or unused."""

    pieces: list[str]
    scores: list[float]
    kinds: str


def read_vocabulary(path: str) -> Vocabulary:
    """Read on the driver; a vocabulary is small, and goes to the tasks in a broadcast."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    kinds = "".join("u" if model.is_unknown(k) else "b" if model.is_byte(k) else "c" if model.is_control(k) or model.is_unused(k) else "n" for k in ids)
    out = Vocabulary([model.id_to_piece(k) for k in ids], [model.get_score(k) for k in ids], kinds)
    for piece, kind in zip(out.pieces, out.kinds):
        if kind == "n" and (MARK in piece.lstrip(MARK) or "\n" in piece):
            raise ValueError(f"the piece {piece!r} crosses words")
    return out


class Encoder:
    """Encodes words of one vocabulary; keeps what it has found."""

    def __init__(self, vocabulary: Vocabulary):
        pieces, self.scores, kinds = vocabulary
        self.ids = {p: k for k, (p, kind) in enumerate(zip(pieces, kinds)) if kind == "n"}
        self.ends = {p[i:] for p in self.ids for i in range(len(p))}
        self.bytes = {int(pieces[k][1:-1], 16): k for k in range(len(pieces)) if kinds[k] == "b"}
        self.unknown = kinds.index("u")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.raw: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """Segmentation of a short text by its merges: the best pair first, of equals the leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                found = self.ids.get(parts[k] + parts[k + 1])
                if found is not None and (best is None or self.scores[found] > best):
                    best, at = self.scores[found], k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def lasting(self, before: str, piece: str) -> bool:
        """Whether merging leaves the two pieces side by side; `before` is empty at the start of a word."""
        known = self.pairs.get((before, piece))
        if known is None:
            known = self.merge(before + piece) == ([before, piece] if before else [piece])
            self.pairs[before, piece] = known
        return known

    def learn(self, words: Sequence[str]) -> None:
        """Encode distinct sorted words; the forward states are kept on a stack along the trie."""
        last, ends, ids = [""], self.ends, self.ids
        previous = ""
        for word in words:
            shared = 0
            for a, b in zip(previous, word):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                found, start = [], end - 1
                while start >= 0 and (tail := word[start:end]) in ends:
                    if tail in ids:
                        found.append(start)
                    start -= 1
                for start in reversed(found or [end - 1]):
                    if self.lasting(last[start], word[start:end]):
                        last.append(word[start:end])
                        break
                else:
                    last.append(word[end - 1 : end])
            previous = word
            out, end = [], len(word)
            while end:
                out.append(last[end])
                end -= len(last[end])
            out.reverse()
            self.words[word] = b"".join([self.raw.get(piece) or self.piece(piece) for piece in out])

    def piece(self, piece: str) -> bytes:
        """The ids of a piece, or of a character outside the vocabulary, as the bytes of 32-bit numbers."""
        known = self.ids.get(piece)
        ids = [known] if known is not None else [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]
        self.raw[piece] = np.array(ids, np.int32).tobytes()
        return self.raw[piece]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column in a row, and where those of each text begin and end."""
        words, first = cut(texts)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.words) + len(distinct) > CACHE_WORDS:
            self.words = {w: self.words[w] for w in distinct if w in self.words}
        self.learn(sorted(w for w in distinct if w not in self.words))
        raw = [self.words[w] for w in distinct]
        ends = np.cumsum([0, *(len(r) // 4 for r in raw)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), np.int32)))
        taken = lists.take(coded.indices)
        return taken.flatten().to_numpy(zero_copy_only=False), np.asarray(taken.offsets)[first]


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts of a column in a row, and the number of the first word of each text, then of all.

    A word is a line break, or marks with what follows up to the next mark or
    line break. Spaces are marks, and a text that is not empty starts with one.
    """
    texts = pc.fill_null(texts, "")
    marked = pc.binary_join_element_wise(MARK, pc.replace_substring(texts, " ", MARK), "")
    buf, at = text_buffer(pc.if_else(pc.equal(pc.binary_length(texts), 0), "", marked))
    begins = np.zeros(len(buf) + 1, bool)
    if len(buf):
        one, two, three = np.frombuffer(MARK.encode(), np.uint8)
        mark = np.zeros(len(buf), bool)
        mark[:-2] = (buf[:-2] == one) & (buf[1:-1] == two) & (buf[2:] == three)
        begins[: len(buf)] = mark
        begins[3 : len(buf)] &= ~mark[:-3]
        line = buf == 10
        begins[:-1] |= line
        begins[1:] |= line
        begins[at] = True
        begins[len(buf)] = False
    starts = np.flatnonzero(begins)
    offsets = pa.py_buffer(np.append(starts, len(buf)).astype(np.int32))
    words = pa.StringArray.from_buffers(len(starts), offsets, pa.py_buffer(np.ascontiguousarray(buf)))
    return words, np.searchsorted(starts, at)


def surfaces(vocabulary: Vocabulary) -> list[bytes]:
    """What each id stands for in a decoded text, as bytes."""
    table = {"n": lambda p: p.replace(MARK, " ").encode(), "b": lambda p: bytes([int(p[1:-1], 16)]), "u": lambda p: UNKNOWN.encode(), "c": lambda p: b""}
    return [table[kind](piece) for piece, kind in zip(vocabulary.pieces, vocabulary.kinds)]


def _parts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes are about `most` together, one row at least."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def _encoder(box) -> Callable[[pa.RecordBatch], Iterator[tuple[pa.RecordBatch, pa.ListArray]]]:
    """Cuts a batch into parts, each with the ids of its texts."""
    encoder = Encoder(Vocabulary(*box.value))

    def run(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.ListArray]]:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        for lo, hi in _parts(sizes, BLOCK_CHARS):
            part = batch.slice(lo, hi - lo)
            ids, at = encoder.encode(part.column("text"))
            yield part, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))
            pa.default_memory_pool().release_unused()

    return run


def _decoded(ids: np.ndarray, at: np.ndarray, surface: list[bytes]) -> pa.Array:
    """The texts of the ids between each two numbers of `at`.

    Surfaces are taken all at once; those that start a text lose a leading
    space, so their ids stand for a second table.
    """
    bare = [s[1:] if s[:1] == b" " else s for s in surface]
    ids, first = ids.astype(np.int64), at[:-1][at[:-1] < at[1:]]
    ids[first] += len(surface)
    taken = pa.array([*surface, *bare], pa.binary()).take(pa.array(ids))
    _, offsets, data = taken.buffers()
    ends = np.frombuffer(offsets, np.int32, len(ids) + 1)[at]
    raw = pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(ends.astype(np.int32)), data])
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([r.decode("utf-8", "replace") for r in raw.to_pylist()], pa.string())


def _encode(box):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_parts = _encoder(box)
        for batch in batches:
            for part, ids in encode_parts(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*batch.schema.names, "ids"])

    return run


def _encode_and_decode(box):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_parts, surface = _encoder(box), surfaces(Vocabulary(*box.value))
        for batch in batches:
            for part, ids in encode_parts(batch):
                texts = _decoded(ids.values.to_numpy(), np.asarray(ids.offsets), surface)
                yield pa.RecordBatch.from_arrays([*part.columns, ids, texts], names=[*batch.schema.names, "ids", "decoded"])

    return run


def _carried(docs: DataFrame, carry: Sequence[str]) -> tuple[DataFrame, str]:
    narrow = docs.select("text", F.struct(*[docs[c] for c in carry]).alias("row"))
    return narrow, f"text string, row {narrow.schema['row'].dataType.simpleString()}, ids array<int>"


def encode(docs: DataFrame, vocabulary: Vocabulary, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """`text`, a struct `row` of the columns `carry`, and `ids` of every row of `docs`.

    A null or empty text has no ids. Repeated rows stay. An empty table gives
    an empty result. Columns of any name can be carried.
    """
    box = docs.sparkSession.sparkContext.broadcast(tuple(vocabulary))
    narrow, schema = _carried(docs, carry)
    return narrow.mapInArrow(_encode(box), schema)


def encode_and_decode(docs: DataFrame, vocabulary: Vocabulary, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """As `decode(encode(docs))`, in one pass over the texts."""
    box = docs.sparkSession.sparkContext.broadcast(tuple(vocabulary))
    narrow, schema = _carried(docs, carry)
    return narrow.mapInArrow(_encode_and_decode(box), f"{schema}, decoded string")


def _decode(box):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            for lo, hi in _parts(pc.list_value_length(ids).to_numpy(), BLOCK_CHARS // 4):
                part = ids.slice(lo, hi - lo)
                at = np.asarray(part.offsets)
                texts = _decoded(part.flatten().to_numpy(zero_copy_only=False), at - at[0], box.value)
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in batch.columns], texts], names=[*batch.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """`encoded` with `decoded`, the text of the column `ids`; no or null ids give an empty text.

    The space that encoding puts before a text is taken away again. Bytes that
    form no character become replacement characters.
    """
    box = encoded.sparkSession.sparkContext.broadcast(surfaces(vocabulary))
    filled = encoded.withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in filled.schema.fields)
    return filled.mapInArrow(_decode(box), f"{columns}, decoded string")
