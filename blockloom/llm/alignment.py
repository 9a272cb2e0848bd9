"""Alignment of the tokens of two tokenizers, with an identity map as the fast path.

Both tokenizers encode the same bytes, a space and the text. Byte offsets where a token of A and one of
B end cut both rows of tokens into groups; the last tokens of a group end together and are a link. The
ids of A that have a B id of the same bytes are known before any text is read: a group of one token on
either side is found in that array, and is counted in a vector as long as A's vocabulary. Only the links
of all other groups are shuffled, as pairs of ids with counts.

Texts are cut where neither tokenizer ever merges, and what a piece comes to (ids, groups, links) is kept
in a bounded table per worker, so a piece that recurs is encoded and aligned once.

A text that is null or empty, or whose tokens do not spell it (the space mark of B in the text does
that), has no tokens: zeros, and '' for the digest. Rows with equal doc_id, or none, are counted and
returned one by one. Other columns are not read. No rows give no rows.
"""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm import tokens
from blockloom.llm.common import rows_of, table
from blockloom.session import stored

PORTION = 1 << 20  # characters that are worked off at a time
PIECES, PIECE_CHARS = 200_000, 1 << 22  # pieces a worker keeps, and their characters; the table starts anew beyond that
RUN, LONG_PIECE = 256, 1 << 12  # pieces that are encoded as one text; characters of one that stands alone
HEAVY = 1 << 16  # a pair with one in so many of all irregular links is looked up where its document is
SPACE_MARK = "▁"  # fixed value: a space in the pieces of B
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


class ByteLevel:
    """A: byte-level BPE of the tokenizers library. Special tokens' strings are plain text."""

    def __init__(self, path: str):
        encoder = tokens.Encoder(path)
        self.tokenizer, self.cuts = encoder.tokenizer, encoder.cut
        self.tokenizer.encode_special_tokens = True
        # Bytes that print stand for themselves, the others for the characters from 256 on.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(own)))}
        self.bytes: list[bytes] = [b""] * self.tokenizer.get_vocab_size()
        for entry, i in self.tokenizer.get_vocab().items():
            if all(c in byte for c in entry):
                self.bytes[i] = bytes(byte[c] for c in entry)

    def encode(self, spaced: list[str]) -> list[list[int]]:
        """Ids of texts that begin with the space, or with a line's end inside a text."""
        return [x.ids for x in self.tokenizer.encode_batch_fast(spaced, add_special_tokens=False)]


class Pieced:
    """B: BPE with byte fallback of the sentencepiece library, which puts the space before a text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = model = SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.bytes: list[bytes] = [b""] * len(ids)
        for i in plain:
            self.bytes[i] = model.id_to_piece(i).replace(SPACE_MARK, " ").encode()
        for i in ids:
            if model.is_byte(i):
                self.bytes[i] = bytes([int(model.id_to_piece(i)[3:-1], 16)])
        self.twice = {i for i in ids if model.is_byte(i)}
        # No piece goes on after a space mark that other characters come before, and none holds a line's end.
        inside = re.compile(f"[^{SPACE_MARK}]{SPACE_MARK}|\n")
        self.cuts = not any(inside.search(model.id_to_piece(i)) for i in plain)

    def encode(self, spaced: list[str]) -> list[list[int]]:
        found = self.model.encode([x[1:] if x[0] == " " else x for x in spaced], num_threads=1)
        # Before a line's end, the added space is a token of its own.
        return [ids if x[0] == " " else ids[1:] for x, ids in zip(spaced, found)]


def same_bytes(a: Sequence[bytes], b: Sequence[bytes], last: set[int]) -> np.ndarray:
    """The B id of the same bytes for every A id, -1 where there is none; ids in `last` only where no other fits."""
    ids = sorted((i for i in range(len(b)) if b[i]), key=lambda i: (i not in last, -i))
    at = {b[i]: i for i in ids}
    return np.array([at.get(x, -1) if x else -1 for x in a], np.int64)


class Aligner:
    """What texts come to; pieces that recur are looked up."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieced(b_path)
        self.same = same_bytes(self.a.bytes, self.b.bytes, self.b.twice)
        self.cuts = self.a.cuts and self.b.cuts
        self.a_size, self.b_size = (np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b))
        # Every id as text, inside a group and at its end.
        self.marked = [f"{i}{mark}" for i in range(len(self.a_size)) for mark in ",|"]
        self.marked += [f"{i}{mark}" for i in range(len(self.b_size)) for mark in ",;"]
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.chars = 0
        self.written: list[str] = []  # the groups of a piece, as text
        self.sizes = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups, 1 if the tokens spell the piece
        self.one_end, self.pair_end = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.ones, self.pairs = np.zeros(0, np.int64), np.zeros(0, np.int64)  # links, by piece
        self.fresh: list[tuple[np.ndarray, ...]] = []

    def pieces(self, text: str) -> list[str]:
        """The pieces of a space and the text; the space before a piece is left out where no blank follows."""
        if not self.cuts or SPACE_MARK in text:
            return [" " + text]
        spaced = text.replace("\n", " ")
        if "  " not in spaced and spaced[0] != " " and spaced[-1] != " " and spaced.isprintable():
            return text.replace("\n", " \n").split(" ")
        return [p[1:] if p[0] == " " and p[1:2].strip() else p for p in _CUT.split(" " + text)]

    def learn(self, keys: list[str]) -> None:
        """Encode and align pieces that are not in the table, many that follow one another as one text."""
        spaced = [k if k[0] in " \n" else " " + k for k in keys]
        # Where a piece does not begin with one blank and end without, what stands beside it matters.
        alone = [
            not self.cuts or SPACE_MARK in p or p[1:2].isspace() or p[-1].isspace() or len(p) > LONG_PIECE for p in spaced
        ]
        close = [i for i, x in enumerate(alone) if not x]
        runs = [close[i : i + RUN] for i in range(0, len(close), RUN)] + [[i] for i, x in enumerate(alone) if x]
        while runs:
            texts = ["".join([spaced[i] for i in run]) for run in runs]
            again = []
            for run, a, b in zip(runs, self.a.encode(texts), self.b.encode(texts)):
                if not self._add([keys[i] for i in run], [spaced[i].encode() for i in run], a, b):
                    again += [[i] for i in run]
            runs = again

    def _add(self, keys: list[str], raw: list[bytes], a: list[int], b: list[int]) -> bool:
        """Note what the pieces of a run come to. False if its tokens do not spell them; a single piece is noted as such."""
        whole, n = b"".join(raw), len(keys)
        spelled = all(b"".join([own[i] for i in ids]) == whole for ids, own in ((a, self.a.bytes), (b, self.b.bytes)))
        if not spelled and n > 1:
            return False
        a, b = (np.array(x if spelled else [], np.int64) for x in (a, b))
        end_a, end_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        both = np.intersect1d(end_a, end_b)
        piece_end = np.cumsum([len(x) for x in raw])
        if spelled and not np.isin(piece_end, both, assume_unique=True).all():
            return False
        in_a, in_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)  # the group of every token
        of = np.searchsorted(piece_end, both)  # the piece of every group
        last_a, last_b = a[np.searchsorted(end_a, both)], b[np.searchsorted(end_b, both)]
        single = (np.bincount(in_a, minlength=len(both)) == 1) & (np.bincount(in_b, minlength=len(both)) == 1)
        one = single & (self.same[last_a] == last_b)
        codes = np.concatenate([2 * a + (both[in_a] == end_a), 2 * (len(self.a_size) + b) + (both[in_b] == end_b)])
        order = np.argsort(np.concatenate([2 * in_a, 2 * in_b + 1]), kind="stable")
        written = [self.marked[c] for c in codes[order].tolist()]
        sizes = np.stack([*(np.bincount(of[x], minlength=n) for x in (in_a, in_b)), np.bincount(of, minlength=n)], 1)
        stops = np.cumsum(sizes[:, 0] + sizes[:, 1]).tolist()
        for key, start, stop in zip(keys, [0, *stops], stops):
            self.at[key] = len(self.written)
            self.written.append("".join(written[start:stop])[:-1])
        self.chars += sum(map(len, keys))
        self.fresh.append(
            (
                np.column_stack([sizes, np.full(n, int(spelled))]),
                np.bincount(of[one], minlength=n), last_a[one],
                np.bincount(of[~one], minlength=n), (last_a * len(self.b_size) + last_b)[~one],
            )
        )
        return True

    def _settle(self) -> None:
        """Add what is new to the table."""
        if self.fresh:
            sizes, n_one, ones, n_pair, pairs = (np.concatenate(x) for x in zip(*self.fresh))
            self.one_end = np.concatenate([self.one_end, len(self.ones) + np.cumsum(n_one)])
            self.pair_end = np.concatenate([self.pair_end, len(self.pairs) + np.cumsum(n_pair)])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.ones, self.pairs = np.concatenate([self.ones, ones]), np.concatenate([self.pairs, pairs])
            self.fresh = []

    @staticmethod
    def _counted(at: np.ndarray, doc: np.ndarray, flat: np.ndarray, ends: np.ndarray, docs: int) -> tuple:
        """Distinct links of every text with their numbers: (ends of the texts, links, numbers)."""
        size = ends[at + 1] - ends[at]
        stop = np.cumsum(size)
        links = flat[np.repeat(ends[at] - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)]
        width = int(flat.max(initial=0)) + 1
        found, n = np.unique(np.repeat(doc, size) * width + links, return_counts=True)
        return np.searchsorted(found // width, np.arange(docs + 1)), found % width, n

    def align(self, texts: list[str | None]) -> dict:
        """sizes (tokens of A, of B, groups; a row per text), digests, and distinct links of both kinds with numbers."""
        cut = [self.pieces(t) if t else [] for t in texts]
        seen = set().union(*cut)
        if len(self.at) + len(seen - self.at.keys()) > PIECES or self.chars > PIECE_CHARS:
            self.clear()
        new = [k for k in seen if k not in self.at]
        if new:
            self.learn(new)
            self._settle()
        at = np.fromiter((self.at[k] for c in cut for k in c), np.int64, sum(map(len, cut)))
        ends = np.cumsum([0, *map(len, cut)])
        doc = np.repeat(np.arange(len(cut)), np.diff(ends))
        spelled = np.bincount(doc, 1 - self.sizes[at, 3], len(cut)) == 0
        keep = spelled[doc]
        sums = [np.bincount(doc, self.sizes[at, i] * keep, len(cut)).astype(np.int64) for i in range(3)]
        digests = []
        for i, pieces in enumerate(cut):
            whole = ";".join([self.written[k] for k in at[ends[i] : ends[i + 1]].tolist()])
            digests.append(sha256(whole.encode()).hexdigest() if pieces and spelled[i] else "")
        return {
            "sums": sums,
            "digests": digests,
            "ones": self._counted(at[keep], doc[keep], self.ones, self.one_end, len(cut)),
            "pairs": self._counted(at[keep], doc[keep], self.pairs, self.pair_end, len(cut)),
        }


def aligner(a_path: str, b_path: str) -> Aligner:
    """This worker's aligner, which stays for its later tasks."""
    kept = sys.modules.setdefault("_worker_aligners", types.ModuleType("_worker_aligners")).__dict__
    name = f"{a_path}\n{b_path}"
    if name not in kept:
        kept[name] = Aligner(a_path, b_path)
    return kept[name]


_HELD = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string"
HELD = f"{_HELD}, one array<int>, one_n array<int>, pair array<bigint>, pair_n array<int>"


def _lists(ends: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values).cast(kind))


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row per document: sizes, digest, and its distinct links of both kinds with how often it has them.

    one: ids of A in groups of one token on either side, of the same bytes by the identity map.
    pair: A id times B's vocabulary plus B id, of the last tokens of every other group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, row = aligner(a_path, b_path), TaskContext.get().partitionId() << 33
        names = [f.split()[0] for f in HELD.split(", ")]
        for doc_ids, texts in rows_of(batches, ["doc_id", "text"], PORTION, "text"):
            got = found.align(texts)
            n = len(texts)
            columns = [
                pa.array(np.arange(row, row + n)),
                pa.array(doc_ids, pa.int64()),
                *[pa.array(x) for x in got["sums"]],
                pa.array(got["digests"], pa.string()),
            ]
            for kind, width in (("ones", pa.int32()), ("pairs", pa.int64())):
                ends, links, numbers = got[kind]
                columns += [_lists(ends, links, width), _lists(ends, numbers, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names)
            row += n

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, HELD)


def count_ones(held: DataFrame, size: int) -> DataFrame:
    """(a, n): links of the identity map in the whole table; a task adds up one vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            ids, n = (batch.column(i).flatten().to_numpy() for i in (0, 1))
            total += np.bincount(ids, n, size).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["a", "n"])

    made = held.select("one", "one_n").mapInArrow(run, "a bigint, n bigint")
    return made.groupBy("a").agg(F.sum("n").alias("n"))


def count_pairs(held: DataFrame) -> DataFrame:
    """(pair, n): irregular links in the whole table, added up by batch, by task and then by pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, n = (batch.column(i).flatten().to_numpy() for i in (0, 1))
            found, at = np.unique(pairs, return_inverse=True)
            total = np.bincount(at, n, len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total, pa.int64())], ["pair", "n"])

    made = held.select("pair", "pair_n").mapInArrow(run, "pair bigint, n bigint")
    return made.groupBy("pair").agg(F.sum("n").alias("n"))


def scored(held: DataFrame, same: np.ndarray, width: int) -> DataFrame:
    """held's rows with n_links, n_best and count_sum.

    The driver gets a count per id of A, the greatest count per id of B, and at most HEAVY pairs, each
    of which has more than one in HEAVY of all irregular links. So no pair that is shuffled is hot.
    """
    ones = np.zeros(len(same), np.int64)
    for r in count_ones(held, len(same)).collect():
        ones[r["a"]] = r["n"]
    counts = stored(count_pairs(held))
    best = np.zeros(width, np.int64)
    mapped = np.flatnonzero(same >= 0)
    np.maximum.at(best, same[mapped], ones[mapped])
    for r in counts.groupBy((F.col("pair") % width).alias("b")).agg(F.max("n").alias("n")).collect():
        best[r["b"]] = max(best[r["b"]], r["n"])
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = counts.where(F.col("n") * HEAVY > total).orderBy("pair").collect()
    known, known_n = (np.array([r[c] for r in heavy], np.int64) for c in ("pair", "n"))
    one_best = (ones == best[same]) & (same >= 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            doc = lambda column: np.repeat(np.arange(n), np.diff(column.offsets.to_numpy()))
            flat = lambda i: batch.column(i).flatten().to_numpy()
            at, of, one, one_n = doc(batch.column(6)), doc(batch.column(8)), flat(6), flat(7).astype(np.int64)
            pair, pair_n = flat(8), flat(9).astype(np.int64)
            place = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            here = known[place] == pair if len(known) else np.zeros(len(pair), bool)
            number = known_n[place[here]]
            sums = []
            for x, y in (
                (one_n, pair_n),
                (one_n * one_best[one], pair_n[here] * (number == best[pair[here] % width])),
                (one_n * ones[one], pair_n[here] * number),
            ):
                total = np.zeros(n, np.int64)
                np.add.at(total, at, x)
                np.add.at(total, of if len(y) == len(of) else of[here], y)
                sums.append(pa.array(total))
            rest = np.append(0, np.cumsum(np.bincount(of[~here], minlength=n)))
            lists = [_lists(rest, pair[~here], pa.int64()), _lists(rest, pair_n[~here], pa.int32())]
            names = [f.split()[0] for f in made_ddl.split(", ")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], *sums, *lists], names)

    made_ddl = f"{_HELD}, n_links bigint, n_best bigint, count_sum bigint, pair array<bigint>, pair_n array<int>"
    made = stored(held.mapInArrow(run, made_ddl))
    rare = made.select("row", F.explode(F.arrays_zip("pair", "pair_n")).alias("p")).select("row", "p.pair", "p.pair_n")
    tops = F.col("n") == F.element_at(F.lit(best.tolist()), (F.col("pair") % width + 1).cast("int"))
    found = rare.join(counts.where(F.col("n") * HEAVY <= total), "pair").groupBy("row").agg(
        F.sum(F.when(tops, F.col("pair_n")).otherwise(0)).alias("__best"),
        F.sum(F.col("pair_n") * F.col("n")).alias("__sum"),
    )
    added = lambda c, x: (F.col(c) + F.coalesce(F.col(x), F.lit(0))).alias(c)
    return made.drop("pair", "pair_n").join(found, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", added("n_best", "__best"), added("count_sum", "__sum"), "groups_sha256"
    )


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of all documents."""
    held = stored(align(docs, a_path, b_path))
    local = Aligner(a_path, b_path)
    return scored(held, local.same, len(local.b.bytes))


def op12_identity_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, byte_bpe_50k.json against piece_bpe_32k.model."""
    return aligned(table(spark, sf_dir, "documents"), *paths())
