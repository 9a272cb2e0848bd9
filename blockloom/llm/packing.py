"""Vector bin packing of token ids into sequences, by the dot-product heuristic.

A piece of a document has a size in three dimensions: tokens, segments (always one) and
loss-bearing tokens. Every sequence has a limit in each. An open sequence takes, of the pieces
that fit it in all three, the one whose size has the largest dot product with what is left of the
limits (both as shares of the limits); where only a part of that piece would fit, the piece is cut.

Rows are packed where they are read: a task packs its pieces WINDOW at a time, so nothing is
shuffled, memory is bounded, no key can be hot, and a lost task packs the same rows again. What a
window leaves in unfilled sequences goes on to the next one.

A null or empty text has the end id only. Equal rows are packed as often as they occur; a null
doc_id stays null. No rows give no sequences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm import tokens
from blockloom.llm.common import rows_of, table

WINDOW = 4096  # pieces that are packed together
PORTION = 1 << 21  # characters that are tokenized at a time
END_ID = 0


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most."""

    tokens: int = 1024
    segments: int = 128
    loss: int = 1024
    shortest: int = 8  # no piece is cut to fewer tokens than these, but for the rest of a document


@dataclass
class Piece:
    """A run of a document's ids; mask tells which of them bear loss."""

    doc_id: int | None
    start: int
    ids: np.ndarray
    mask: np.ndarray
    doc_tokens: int

    def split(self, k: int) -> tuple[Piece, Piece]:
        rest = Piece(self.doc_id, self.start + k, self.ids[k:], self.mask[k:], self.doc_tokens)
        return Piece(self.doc_id, self.start, self.ids[:k], self.mask[:k], self.doc_tokens), rest


class Packer:
    def __init__(self, limits: Limits):
        self.limits = limits
        self.waiting: list[Piece] = []

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Full sequences of one long document are given at once; what is left of it waits."""
        whole = self.limits
        while len(piece.ids) >= whole.tokens and int(piece.mask[: whole.tokens].sum()) <= whole.loss:
            first, piece = piece.split(whole.tokens)
            yield [first]
        while len(piece.ids) > whole.tokens or int(piece.mask.sum()) > whole.loss:
            first, piece = piece.split(self._fitting(piece, whole.tokens, whole.loss))
            self.waiting.append(first)
        if len(piece.ids):
            self.waiting.append(piece)
        if len(self.waiting) >= WINDOW:
            yield from self.pack(last=False)

    @staticmethod
    def _fitting(piece: Piece, room: int, loss: int) -> int:
        """How many of the piece's first ids fit."""
        return int(np.searchsorted(np.cumsum(piece.mask[:room]), loss, "right"))

    def pack(self, last: bool) -> Iterator[list[Piece]]:
        """Pack what waits. Unless this is the last window, an unfilled sequence waits on."""
        whole, pieces = self.limits, self.waiting
        share = np.array([1 / whole.tokens, 1 / whole.segments, 1 / whole.loss])
        sizes = np.array([(len(p.ids), 1, p.mask.sum()) for p in pieces], np.int64).reshape(-1, 3)
        scaled = sizes * share
        free = np.ones(len(pieces), bool)
        self.waiting = []
        while free.any():
            sequence, room = [], np.array([whole.tokens, whole.segments, whole.loss])
            while room[0] and room[1]:
                fit = free & (sizes <= room).all(axis=1)
                if fit.any():
                    k = int(np.argmax(np.where(fit, scaled @ (room * share), -1.0)))
                    sequence.append(pieces[k])
                    free[k] = False
                    room = room - sizes[k]
                    continue
                # Nothing fits whole: cut the longest piece that is left, if that is worth while.
                k = int(np.argmax(np.where(free, sizes[:, 0], 0)))
                cut = self._fitting(pieces[k], int(room[0]), int(room[2])) if free[k] else 0
                if cut < whole.shortest:
                    break
                first, rest = pieces[k].split(cut)
                pieces[k] = rest
                sizes[k] -= (cut, 0, int(first.mask.sum()))
                scaled[k] = sizes[k] * share
                sequence.append(first)
                room = room - (cut, 1, int(first.mask.sum()))
            if last or free.any():
                yield sequence
            else:
                self.waiting = sequence


SCHEMA = (
    "sequence_id bigint, ids binary, pieces array<struct<doc_id:bigint,start:bigint,length:bigint,"
    "doc_tokens:bigint,offset:bigint>>"
)
_PIECE = pa.struct([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "offset")])


def pack(
    docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = END_ID, loss_from: Column | None = None
) -> DataFrame:
    """Sequences (sequence_id, ids, pieces) of docs (doc_id, text); other columns are not read.

    ids: little-endian 32-bit integers, not padded. pieces: in order, with the place in the document and in
    the sequence. Without loss_from every id bears loss; with it, the row's ids before that place do not
    (none or a negative one: all bear loss).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer)
        end = np.array([end_id], encoder.dtype).tobytes()
        packer, number = Packer(limits), TaskContext.get().partitionId() << 33

        def batch_of(sequences: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal number
            numbers, ids, places = [], [], []
            for sequence in sequences:
                offset, row = 0, []
                for p in sequence:
                    row.append((p.doc_id, p.start, len(p.ids), p.doc_tokens, offset))
                    offset += len(p.ids)
                numbers.append(number)
                ids.append(np.concatenate([p.ids for p in sequence]).astype("<u4").tobytes())
                places.append([dict(zip(_PIECE.names, r)) for r in row])
                number += 1
            columns = [pa.array(numbers, pa.int64()), pa.array(ids, pa.binary()), pa.array(places, pa.list_(_PIECE))]
            return pa.RecordBatch.from_arrays(columns, ["sequence_id", "ids", "pieces"])

        done: list[list[Piece]] = []
        for doc_ids, texts, froms in rows_of(batches, ["doc_id", "text", "loss_from"], PORTION, "text"):
            for doc_id, x, loss_from in zip(doc_ids, encoder.encode(texts), froms):
                ids = np.frombuffer(x + end, encoder.dtype)
                mask = np.ones(len(ids), np.uint8)
                mask[: max(loss_from or 0, 0)] = 0
                done += packer.add(Piece(doc_id, 0, ids, mask, len(ids)))
            if done:
                yield batch_of(done)
                done = []
        done += packer.pack(last=True)
        if done:
            yield batch_of(done)

    first = F.lit(None) if loss_from is None else loss_from
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), first.cast("bigint").alias("loss_from"))
    return rows.mapInArrow(run, SCHEMA)


def pieces(sequences: DataFrame) -> DataFrame:
    """A row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    at = F.col("p.offset") * 4 + 1
    own = F.substring(F.col("ids"), at.cast("int"), (F.col("p.length") * 4).cast("int"))
    return sequences.select("sequence_id", "ids", F.explode("pieces").alias("p")).select(
        "p.doc_id",
        "p.start",
        "p.length",
        F.crc32(own).alias("ids_crc32"),
        "p.doc_tokens",
        "sequence_id",
        "p.offset",
    )


def op2_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 ids, a row per piece."""
    return pieces(pack(table(spark, sf_dir, "documents"), tokens.default_path()))
