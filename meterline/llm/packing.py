"""Packing documents into sequences of equal attention cost."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.taskcontext import TaskContext

from meterline.llm.shared import in_batches

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()), T.StructField("capacity", T.LongType()),
])
#: Sequences of a task are numbered from its partition's number shifted by so many bits.
_SHIFT = 33
#: Words that a worker keeps: the first it meets, so that frequent ones are among them.
_KEPT_WORDS = 100_000
#: Parts of words that a worker remembers at most; this memory starts anew beyond.
_KEPT_PARTS = 1_500_000
#: Words of a text taken at once.
_STRETCH = 100_000

# How the tokenizer of word_bpe_49k.json cuts lower-case words whose letters lie below U+0250, and how it
# names the bytes of a part.
_LETTERS = "".join(sorted({chr(c).lower() for c in range(0x250) if chr(c).isalpha() and c != 0x130}))
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
_PLAIN = re.compile(rf"[{_LETTERS}0-9!-/:;=?-@\[-`{{}}~]+")
_NAMED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_NAMES = {b: chr(b) for b in _NAMED} | {
    b: chr(0x100 + i) for i, b in enumerate(sorted(set(range(256)).difference(_NAMED)))}


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds:
    """Token ids of texts, as little-endian 32-bit bytes, remembered word by word.

    Only for tokenizers that drop white space and never join across it. Texts are cut at blanks
    and line feeds; other white space is left to the tokenizer. With ``parts`` a word of plain characters
    is cut as the tokenizer itself would, and its parts go to the tokenizer's model alone, remembered too;
    that spares the tokenizer's slow steps for words that occur once. All other words take all its steps.
    """

    def __init__(self, path: str, parts: bool = True) -> None:
        self.tokenizer, self.parts = _tokenizer(path), parts
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        if len(self.pieces) >= _KEPT_PARTS:
            self.pieces.clear()
        named = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTE_NAMES)
        known = self.pieces[piece] = array("I", [t.id for t in self.tokenizer.model.tokenize(named)]).tobytes()
        return known

    def _coded(self, words: set[str]) -> dict[str, bytes]:
        coded, odd, known = {}, [], self.pieces.get
        for word in words:
            low = word.lower()
            if self.parts and _PLAIN.fullmatch(low):
                coded[word] = b"".join([known(p) or self._piece(p) for p in _PARTS.findall(low)])
            else:
                odd.append(word)
        ids = self.tokenizer.encode_batch(odd, add_special_tokens=False)
        return coded | {word: array("I", c.ids).tobytes() for word, c in zip(odd, ids, strict=True)}

    def __call__(self, text: str) -> bytes:
        words, ids = text.replace("\n", " ").split(" "), []
        for at in range(0, len(words), _STRETCH):
            stretch = words[at:at + _STRETCH]
            coded = self._coded(set(stretch).difference(self.words))
            passing = len(self.words) + len(coded) > _KEPT_WORDS
            self.words.update(coded)
            ids.append(b"".join(map(self.words.__getitem__, stretch)))
            if passing:
                for word in coded:
                    del self.words[word]
        return b"".join(ids)


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One memory per worker and tokenizer, which the worker's tasks share."""
    return WordIds(path)


def capacities(tokens: int, length: int) -> list[int]:
    """Sequence sizes that hold ``tokens`` exactly: full ones, then falling powers of two.

    A sequence that ends at a power of two needs no padding, so nothing is padded.
    """
    rest = tokens % length
    return [length] * (tokens // length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def balance(
    lengths: list[int], room: list[int], linear: float, quadratic: float,
) -> list[tuple[int, int, int, int, int]]:
    """``(document, start, length, sequence, offset)``: documents in descending length, each to the
    sequence of lowest cost that still has room for it; one that fits nowhere is cut, and its
    parts fill the largest rooms left. The cost of a part of n tokens is linear * n + quadratic * n * n.
    """
    left = np.array(room, np.int64)
    cost, fill = np.zeros(len(room)), np.zeros(len(room), np.int64)
    placed = []

    def put(document: int, start: int, n: int, at: int) -> None:
        placed.append((document, start, n, at, int(fill[at])))
        fill[at] += n
        left[at] -= n
        cost[at] += linear * n + quadratic * n * n

    for document in sorted(range(len(lengths)), key=lambda d: (-lengths[d], d)):
        start, rest = 0, lengths[document]
        while rest:
            fits = np.flatnonzero(left >= rest)
            at = int(fits[np.argmin(cost[fits])]) if len(fits) else int(np.argmax(left))
            n = min(rest, int(left[at]))
            put(document, start, n, at)
            start, rest = start + n, rest - n
    return placed


def pack(
    docs: DataFrame, tokenizer_path: str | Callable[[], str], key: str = "doc_id", text: str = "text",
    length: int = 4096, end_id: int = 2, window: int = 1 << 20, linear: float = 1.0,
    quadratic: float = 1.0 / 4096, with_ids: bool = False,
) -> DataFrame:
    """Pieces of documents: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, capacity``.

    A document is its token ids and ``end_id``; missing and empty texts are ``end_id`` alone. Nothing is
    shuffled: each task tokenises its rows in order and packs them in windows of about
    ``window`` tokens, so its memory doesn't grow with the rows. Within a window the sequence sizes
    add up to the tokens exactly (``capacities``), and ``balance`` spreads the documents so that the sequences
    cost alike. What a window leaves beyond full sequences goes into the next one, except for
    the last of a task. ``capacity`` is the padded size of the sequence, which its pieces fill.

    A document longer than a window is cut where the window ends. Repeated rows and keys are documents
    of their own, a missing key stays missing. ``with_ids`` adds ``ids``, the piece's ids. Other columns
    are not read. A table without rows gives none.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([*PIECES, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])
    arrow = [pa.field(f.name, pa.int64() if f.name != "ids" else pa.list_(pa.int32())) for f in schema]
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer_path if isinstance(tokenizer_path, str) else tokenizer_path())
        sequence = TaskContext.get().partitionId() << _SHIFT
        # Parts waiting to be packed: key, tokens before, ids, tokens of the whole document.
        waiting: list[tuple[int | None, int, bytes, int]] = []
        tokens = 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal sequence, waiting, tokens
            held, kept = waiting, []
            surplus = 0 if last else tokens % length
            while surplus:  # the newest parts wait for the next window
                doc, start, ids, n = held.pop()
                have = len(ids) // 4
                moved = min(have, surplus)
                kept.append((doc, start + have - moved, ids[4 * (have - moved):], n))
                if moved < have:
                    held.append((doc, start, ids[:4 * (have - moved)], n))
                surplus -= moved
            room = capacities(sum(len(p[2]) for p in held) // 4, length)
            out = []
            for i, start, n, at, offset in balance([len(p[2]) // 4 for p in held], room, linear, quadratic):
                doc, before, ids, whole = held[i]
                own = ids[4 * start:4 * (start + n)]
                out.append((doc, before + start, n, zlib.crc32(own), whole, sequence + at, offset, room[at],
                            *([np.frombuffer(own, "<i4")] if with_ids else [])))
            sequence += len(room)
            waiting, tokens = kept[::-1], sum(len(p[2]) for p in kept) // 4
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)],
                schema=pa.schema(arrow))

        for batch in batches:
            for doc, words in zip(batch.column(0), batch.column(1), strict=True):
                ids = ids_of(words.as_py() or "") + tail
                whole, at = len(ids) // 4, 0
                while at < whole:
                    n = min(whole - at, window - tokens)
                    waiting.append((doc.as_py(), at, ids[4 * at:4 * (at + n)], whole))
                    at, tokens = at + n, tokens + n
                    if tokens >= window:
                        yield flush(last=False)
        if waiting:
            yield flush(last=True)

    return in_batches(rows, run, schema)
