"""Packing token sequences by best-fit decreasing.

A document is its token ids followed by an end id.  Documents longer than a window are first cut into
full windows; what is left of them and the shorter documents are placed, longest first, into the open
window with the least sufficient room.  A segment tree indexed by remaining capacity finds that window.

Packing has two rounds.  First each task packs what it reads, one bounded batch after another; windows that end up
almost full are closed.  The pieces of all other windows are packed again, across tasks: their lengths alone are
shuffled into groups of bounded size, each packed by itself, so the room that is left does not depend on how many
partitions the documents have.  Ids of closed windows are never shuffled.  Pieces are written to the shared folder once,
so a task that runs again changes no placement.  Sequence numbers of the second round are negative.

Edge cases: a null text counts as empty and gives the end id alone; repeated ids and rows are packed
row by row; an empty table gives no pieces; extra columns are ignored, also those named like the added ones; a null id
is kept.
"""

from __future__ import annotations

import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

WINDOW = 4096
END_ID = 2
#: Most words whose ids a worker keeps, about 200 bytes each; then it starts afresh.
MEMO_WORDS = 300_000
#: A window with at most this part of it free is closed.
CLOSED_ROOM = 1 / 64
#: A group of the second round has about so many pieces (under 200 bytes each in the worker).
GROUP_PIECES = 200_000
_SEQUENCES_PER_TASK = 1 << 32

# A run of Latin letters before a space, one of .,;:!? or the end is a word of its own to the tokenizer's
# splitting rule; every other piece reaches to the next space.  No word crosses white space.
_PIECES = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[\t-\r .,;:!?]|\\Z)|[^\t-\r ]+")


_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Two-byte letters as the byte-level alphabet writes their UTF-8 bytes: those of 0xC3 and 0xA1..0xAC, 0xAE..0xBF
#: stand for themselves; 0x80..0xA0 and 0xAD are moved behind 0x100, after the 33 other moved bytes.
_BYTE_LEVEL = {
    c: "Ã" + (chr(low) if low > 0xA0 and low != 0xAD else chr(0x143) if low == 0xAD else chr(0x122 + low - 0x80))
    for c in (*range(0xE0, 0xF7), *range(0xF8, 0x100), 0xDF)
    for low in [chr(c).encode()[1]]
}


class WordTokenizer(dict):
    """Ids of whole texts from a word-level tokenizer file; it holds the ids of pieces seen before.

    Equal to encoding the whole text, because this vocabulary splits at white space and between letters
    and punctuation before it merges.  A piece of Latin letters goes to the library's merging step at once,
    all others through the whole of it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model

    def __missing__(self, piece: str) -> bytes:
        if len(self) > MEMO_WORDS:
            self.clear()
        if _LATIN.fullmatch(piece):
            lower = piece.lower()
            coded = lower if lower.isascii() else lower.translate(_BYTE_LEVEL)
            ids = [t.id for t in self._model.tokenize(coded)]
        else:
            ids = self._tokenizer.encode(piece, add_special_tokens=False).ids
        out = self[piece] = array("I", ids).tobytes()
        return out

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return b"".join(map(self.__getitem__, _PIECES.findall(text)))


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer_at(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


class OpenWindows:
    """Windows by remaining capacity, in a segment tree of counts over the capacities 0..window."""

    def __init__(self, window: int):
        self.window = window
        self._leaves = 1 << window.bit_length()
        self._count = [0] * (2 * self._leaves)
        self._at: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, sequence: int, room: int) -> None:
        self._at[room].append(sequence)
        self._change(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least room of at least ``need``, and its room; None if there is none."""
        node, count = need + self._leaves, self._count
        while not count[node]:
            while node & 1:
                node >>= 1
                if not node:
                    return None
            node += 1
        while node < self._leaves:
            node *= 2
            if not count[node]:
                node += 1
        room = node - self._leaves
        self._change(room, -1)
        return self._at[room].pop(), room

    def _change(self, room: int, by: int) -> None:
        node = room + self._leaves
        while node:
            self._count[node] += by
            node >>= 1


class Packer:
    """Best-fit decreasing; windows stay open from one call to the next."""

    def __init__(self, window: int, first_sequence: int = 0):
        self.window = window
        self._next = first_sequence
        self._open = OpenWindows(window)

    def place(self, lengths: list[int]) -> list[tuple[int, int]]:
        """(sequence, offset) for each piece, none longer than a window."""
        placed: list[tuple[int, int]] = [(0, 0)] * len(lengths)
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            found = self._open.take(lengths[i]) if lengths[i] < self.window else None
            if found is None:
                found = self._next, self.window
                self._next += 1
            sequence, room = found
            placed[i] = sequence, self.window - room
            if room > lengths[i]:
                self._open.add(sequence, room - lengths[i])
        return placed


_PIECE_FIELDS = [
    ("start", pa.int64(), T.LongType()),
    ("length", pa.int64(), T.LongType()),
    ("doc_tokens", pa.int64(), T.LongType()),
    ("sequence_id", pa.int64(), T.LongType()),
    ("offset", pa.int64(), T.LongType()),
    ("input_ids", pa.binary(), T.BinaryType()),
    ("piece", pa.int64(), T.LongType()),
]


def _first_round(
    docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, window: int, end_id: int, batch_tokens: int
) -> DataFrame:
    """Pieces with their ids; those of windows that are not almost full have no sequence, but a number, ``piece``."""
    end = end_id.to_bytes(4, "little")
    room = int(window * CLOSED_ROOM)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_at(tokenizer_path)
        first = TaskContext.get().partitionId() * _SEQUENCES_PER_TASK
        sequence = piece = first
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence, piece
            packer = Packer(window, sequence)
            spots = packer.place([r[2] for r in rows])
            used: Counter[int] = Counter()
            for (at, _), r in zip(spots, rows, strict=True):
                used[at] += r[2]
            closed = {k: sequence + i for i, k in enumerate(sorted(k for k, n in used.items() if n >= window - room))}
            sequence += len(closed)
            placed, offset, number = [], [], []
            for at, before in spots:
                placed.append(closed.get(at))
                offset.append(before if at in closed else None)
                number.append(None if at in closed else piece)
                piece += at not in closed
            ids, start, length, total, coded = zip(*rows, strict=True)
            columns = (start, length, total, placed, offset, coded, number)
            arrays = [pa.array(x, t) for x, (_, t, _) in zip(columns, _PIECE_FIELDS, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *arrays], ["id", *(f[0] for f in _PIECE_FIELDS)])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                coded = tokenizer.encode(text.as_py() or "") + end
                total = len(coded) // 4
                for start in range(0, total, window):
                    part = coded[4 * start : 4 * (start + window)]
                    rows.append((key, start, len(part) // 4, total, part))
                held += total
                if held >= batch_tokens:
                    yield flush()
                    rows, held = [], 0
        if rows:
            yield flush()

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(n, t) for n, _, t in _PIECE_FIELDS)])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(pack, schema)


def _second_round(left: DataFrame, window: int) -> DataFrame:
    """(piece, sequence_id, offset) of the pieces that the first round left; ``left`` has piece and length."""
    groups = max(1, -(-left.count() // GROUP_PIECES))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                pieces = sorted((x["piece"], x["length"]) for x in held.as_py())
                spots = Packer(window).place([n for _, n in pieces])
                columns = (
                    [k for k, _ in pieces],
                    [-1 - group * _SEQUENCES_PER_TASK - at for at, _ in spots],
                    [offset for _, offset in spots],
                )
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["_piece", "_sequence", "_offset"])

    group = F.pmod(F.xxhash64("piece"), F.lit(groups)).alias("group")
    dealt = left.groupBy(group).agg(F.collect_list(F.struct("piece", "length")).alias("held"))
    return dealt.mapInArrow(pack, "_piece long, _sequence long, _offset long")


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
    batch_tokens: int = 4_000_000,
) -> DataFrame:
    """Pieces of all documents: id, start, length, doc_tokens, sequence_id, offset, input_ids (binary,
    little-endian unsigned 32-bit).  ``batch_tokens`` bounds what a task holds besides one document."""
    scratch = Scratch(docs.sparkSession, "pack")
    pieces = scratch.put(_first_round(docs, tokenizer_path, id_col, text_col, window, end_id, batch_tokens), "pieces")
    spots = scratch.put(_second_round(pieces.filter("piece is not null"), window), "spots")
    named = [F.col("id").alias(id_col), "start", "length", "doc_tokens"]
    done = pieces.filter("piece is null").select(*named, "sequence_id", "offset", "input_ids")
    moved = pieces.filter("piece is not null").join(spots, F.col("piece") == F.col("_piece"))
    return done.union(moved.select(*named, F.col("_sequence"), F.col("_offset"), "input_ids"))
