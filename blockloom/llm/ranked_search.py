"""Ranked lexical search: Block-Max MaxScore over the shards of an inverted index.

The index of a table is a folder of Parquet, with two kinds of rows:

* one per shard, without a term: ids and numbers of terms of its documents, which are numbered from 0 in it;
* one per shard and term: the term's documents, in ascending order, in blocks of 128. A block is a run of
  bytes (gaps of document numbers and occurrences, each in as few bytes as it needs) beside which its last
  document and the greatest impact of its documents stand.

A shard holds bounded numbers of documents and characters, and is made by one task from rows it reads, so
building shuffles nothing. A search sends the lists of its terms to one group per shard. There, the
terms' bounds over the whole index (their weight times their greatest impact anywhere) part an item's lists
into essential ones, whose documents are candidates, and others that together can not reach the least of
the best scores so far. Candidates look into the others from the strongest to the weakest; where a block's
greatest impact shows that the rest can not suffice, the candidate is dropped before the block is unpacked.
What is looked for begins at the least score of the best in a few shards, which are searched first, and
rises with the best of the shard at hand. Every shard gives its best documents per item, and the best of
these are the result; Spark limits the rows of an item in every task before it shuffles them.

Items are searched in blocks of a bounded number of terms, as these go to all tasks. Each row of items is
an item of its own, also where item_id repeats or is null; items without terms, or terms that no document
holds, have no rows. A null, empty or termless text is found by nothing and counted nowhere. Rows with
equal doc_id are documents of their own; a null doc_id comes after all others of the same score (2^63 - 1 is
taken for null). Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockloom.llm.common import rows_of, table
from blockloom.session import scratch_path, stored

PORTION = 1 << 20  # bytes of text whose words are held at a time
SHARD_DOCS, SHARD_WORDS = 1 << 16, 1 << 20  # a shard is closed when it has so many documents, or words
BLOCK = 128  # documents
STEP = 4096  # documents of a shard that are scored at a time
FIRST_SHARDS = 8  # that are searched first
TASK_SHARDS = 4  # that a task searches
ITEM_TERMS = 1 << 18  # (item, term) pairs that are searched at a time
NULL_ID = np.iinfo(np.int64).max  # orders a document without id last
# Everything but 0-9, a-z, A-Z and bytes beyond ASCII ends a term.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str | None, most: int = PORTION) -> Iterator[list[bytes]]:
    """The terms of a text in order, with repeats, some of them at a time."""
    raw = (text or "").encode("utf-8", "replace").translate(_TERMS)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + most) if len(raw) - at > most else len(raw)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


@dataclass(frozen=True)
class Corpus:
    """Numbers that impacts depend on: documents with a term, and terms with repeats."""

    documents: int
    words: int

    def impact(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 100 - 90 + (90 * n * self.documents) // max(self.words, 1)
        return (1_000_000_000 * tf) // (1000 * tf + 8 * m)

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))


def corpus_of(docs: DataFrame) -> Corpus:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = words = 0
        for (texts,) in rows_of(batches, ["text"], PORTION, "text"):
            for text in texts:
                n = sum(map(len, terms_of(text)))
                documents += n > 0
                words += n
        yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([words])], ["documents", "words"])

    made = docs.select(F.col("text").cast("string")).mapInArrow(run, "documents bigint, words bigint")
    found = made.agg(F.sum("documents").alias("documents"), F.sum("words").alias("words")).first()
    return Corpus(found["documents"] or 0, found["words"] or 0)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integers in seven bits a byte, the last byte of each marked: (bytes, where every integer ends)."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for bits in range(7, 64, 7):
        more = values >> np.uint64(bits) > 0
        if not more.any():
            break
        size += more
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):  # the k-th byte from the end holds the k-th seven bits
        own = size > k
        out[ends[own] - 1 - k] = (values[own] >> np.uint64(7 * k)).astype(np.uint8) & 127
    out[ends - 1] |= 128
    return out, ends


def unpack(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data & 128)
    values = (data[ends] & 127).astype(np.int64)
    size = np.diff(ends, prepend=-1)
    for k in range(1, int(size.max(initial=1))):
        own = size > k
        values[own] |= (data[ends[own] - k] & 127).astype(np.int64) << (7 * k)
    return values


LISTS = "shard bigint, term binary, df bigint, top bigint, last array<int>, tops array<int>, ends array<int>, data binary"
INDEX = f"{LISTS}, doc_ids binary, sizes binary"


class ShardWriter:
    """Collects documents and gives a shard's lists as Arrow rows."""

    def __init__(self, corpus: Corpus):
        self.corpus = corpus
        self.clear()

    def clear(self) -> None:
        self.ids: list[int | None] = []
        self.vocabulary: dict[bytes, int] = {}
        self.keys: list[np.ndarray] = []  # term number and document, by portion
        self.counts: list[np.ndarray] = []
        self.words = 0
        self.waiting: list[bytes] = []  # words of the portion, and whose they are
        self.owners: list[tuple[int, int]] = []

    def add(self, doc_id: int | None, text: str | None) -> None:
        """A document; one without terms is left out."""
        own, found = len(self.ids), False
        for part in terms_of(text):
            if part:
                found = True
                self.waiting += part
                self.owners.append((own, len(part)))
            if len(self.waiting) * 8 > PORTION:
                self._count()
        if found:
            self.ids.append(doc_id)

    def _count(self) -> None:
        if not self.waiting:
            return
        vocabulary = self.vocabulary
        for term in set(self.waiting).difference(vocabulary):
            vocabulary[term] = len(vocabulary)
        terms = np.fromiter(map(vocabulary.__getitem__, self.waiting), np.int64, len(self.waiting))
        owner, n = np.array(self.owners, np.int64).T
        keys, counts = np.unique(terms << 32 | np.repeat(owner, n), return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.words += len(terms)
        self.waiting, self.owners = [], []

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.words + len(self.waiting) >= SHARD_WORDS

    def close(self, shard: int) -> tuple[pa.RecordBatch, pa.RecordBatch]:
        """The shard's row of docs and its rows of lists, by term."""
        self._count()
        by_name = sorted(self.vocabulary, key=None)
        order = np.zeros(len(by_name), np.int64)
        order[[self.vocabulary[t] for t in by_name]] = np.arange(len(by_name))
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        keys = order[keys >> 32] << 32 | keys & 0xFFFFFFFF
        keys, at = np.unique(keys, return_inverse=True)  # a long document's words come in parts
        tf = np.bincount(at, counts, len(keys)).astype(np.int64)
        term, doc = keys >> 32, keys & 0xFFFFFFFF
        sizes = np.bincount(doc, tf, len(self.ids)).astype(np.int64)
        impact = self.corpus.impact(tf, sizes[doc])

        first = np.flatnonzero(np.diff(term, prepend=-1))  # of every list
        df = np.diff(np.append(first, len(term)))
        place = np.arange(len(term)) - np.repeat(first, df)
        block = np.flatnonzero(place % BLOCK == 0)
        gap = np.diff(doc, prepend=0)
        gap[block] = doc[block]  # every block stands for itself
        data, ends = pack(np.stack([gap, tf], 1).reshape(-1))
        ends = ends[1::2]
        block_last = np.append(block[1:], len(term)) - 1
        tops = np.maximum.reduceat(impact, block)
        blocks = (df + BLOCK - 1) // BLOCK
        block_ends = np.cumsum(blocks)
        list_end = ends[first + df - 1]
        list_start = np.append(0, list_end[:-1])
        offsets = pa.array(np.append(0, block_ends).astype(np.int32))
        inner = (ends[block_last] - np.repeat(list_start, blocks)).astype(np.int32)
        bounds = np.append(0, list_end).astype(np.int32)
        lists = [
            pa.array(np.full(len(df), shard)),
            pa.array(by_name, pa.binary()),
            pa.array(df),
            pa.array(np.maximum.reduceat(impact, first)),
            pa.ListArray.from_arrays(offsets, pa.array(doc[block_last].astype(np.int32))),
            pa.ListArray.from_arrays(offsets, pa.array(tops.astype(np.int32))),
            pa.ListArray.from_arrays(offsets, pa.array(inner)),
            pa.BinaryArray.from_buffers(pa.binary(), len(df), [None, pa.py_buffer(bounds), pa.py_buffer(data)]),
        ]
        ids = np.array([NULL_ID if i is None else i for i in self.ids], np.int64)
        docs = [pa.array([shard]), pa.array([ids.tobytes()]), pa.array([sizes.tobytes()])]
        self.clear()
        names = [f.split()[0] for f in LISTS.split(", ")]
        return pa.RecordBatch.from_arrays(docs, ["shard", "doc_ids", "sizes"]), pa.RecordBatch.from_arrays(lists, names)


def build(docs: DataFrame, path: str, corpus: Corpus) -> None:
    """Write the index of docs (doc_id, text) below the path, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, shard = ShardWriter(corpus), TaskContext.get().partitionId() << 33

        def rows() -> Iterator[pa.RecordBatch]:
            own, lists = writer.close(shard)
            nothing = [pa.nulls(1, f.type) for f in lists.schema][1:]
            yield pa.RecordBatch.from_arrays([own.column(0), *nothing, *own.columns[1:]], names)
            size = max(1, SHARD_WORDS // 64)
            for i in range(0, lists.num_rows, size):
                part = lists.slice(i, size)
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.nulls(part.num_rows, pa.binary())] * 2], names)

        for doc_ids, texts in rows_of(batches, ["doc_id", "text"], PORTION, "text"):
            for doc_id, text in zip(doc_ids, texts):
                writer.add(doc_id, text)
                if writer.full():
                    yield from rows()
                    shard += 1
        if writer.ids:
            yield from rows()

    names = [f.split()[0] for f in INDEX.split(", ")]
    made = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    made.mapInArrow(run, INDEX).write.parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path)


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term): the distinct terms of every row of items, which are numbered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = TaskContext.get().partitionId() << 33
        for item_ids, texts in rows_of(batches, ["item_id", "text"], PORTION, "text"):
            for item_id, text in zip(item_ids, texts):
                found = sorted({t for part in terms_of(text) for t in part})
                columns = [pa.array([x] * len(found), k) for x, k in ((item, pa.int64()), (item_id, pa.int64()))]
                if found:
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.binary())], ["item", "item_id", "term"])
                item += 1

    rows = items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "item bigint, item_id bigint, term binary")


class List:
    """A term's documents in a shard; blocks are unpacked when they are first looked into."""

    def __init__(self, last: np.ndarray, tops: np.ndarray, ends: np.ndarray, data: bytes, sizes: np.ndarray, corpus: Corpus):
        self.last, self.tops, self.ends, self.data = last, tops, ends, np.frombuffer(data, np.uint8)
        self.sizes, self.corpus = sizes, corpus
        self.kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts)."""
        if k not in self.kept:
            values = unpack(self.data[self.ends[k - 1] if k else 0 : self.ends[k]])
            docs = np.cumsum(values[::2])
            self.kept[k] = docs, self.corpus.impact(values[1::2], self.sizes[docs])
        return self.kept[k]

    def between(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents from low to high - 1 and their impacts."""
        a, b = np.searchsorted(self.last, (low, high - 1)).tolist()
        found = [self.block(k) for k in range(a, min(b + 1, len(self.last)))]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        docs, impacts = (np.concatenate(x) for x in zip(*found))
        a, b = np.searchsorted(docs, (low, high))
        return docs[a:b], impacts[a:b]

    def bounds(self, docs: np.ndarray) -> np.ndarray:
        """What a document's impact is at most, by the block where it would stand; in 64 bits, as weights multiply it."""
        at = np.searchsorted(self.last, docs)
        return np.where(at < len(self.tops), self.tops[np.minimum(at, len(self.tops) - 1)], 0).astype(np.int64)

    def impacts(self, docs: np.ndarray) -> np.ndarray:
        """Impacts of ascending documents, 0 where the term does not stand; only their blocks are unpacked."""
        out = np.zeros(len(docs), np.int64)
        at = np.searchsorted(self.last, docs)
        cuts = np.flatnonzero(np.diff(at, prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(docs)]):
            if at[a] < len(self.last):
                own, impacts = self.block(int(at[a]))
                place = np.minimum(np.searchsorted(own, docs[a:b]), len(own) - 1)
                out[a:b] = np.where(own[place] == docs[a:b], impacts[place], 0)
        return out


def best_of_shard(
    lists: list[tuple[int, int, List]], doc_ids: np.ndarray, k: int, least: int = 1
) -> tuple[np.ndarray, np.ndarray]:
    """(scores, documents) of the k best, by Block-Max MaxScore. lists: (bound, weight, list) of an item's terms."""
    lists = sorted(lists, key=lambda x: x[0])
    reach = np.cumsum([x[0] for x in lists])  # what the lists up to here add at most
    least = max(least, _seen(lists, k))
    scores, docs = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for low in range(0, len(doc_ids), STEP):
        high = min(low + STEP, len(doc_ids))
        first = int(np.searchsorted(reach, least))  # the lists before it can not suffice alone
        if first == len(lists):
            break
        total, held = np.zeros(high - low, np.int64), np.zeros(high - low, bool)
        for _, weight, own in lists[first:]:
            found, impacts = own.between(low, high)
            total[found - low] += weight * impacts
            held[found - low] = True
        at = np.flatnonzero(held)
        sums = total[at]
        at = at + low
        for j in range(first - 1, -1, -1):
            _, weight, own = lists[j]
            rest = int(reach[j - 1]) if j else 0
            stays = sums + reach[j] >= least
            at, sums = at[stays], sums[stays]
            stays = sums + weight * own.bounds(at) + rest >= least
            at, sums = at[stays], sums[stays]
            if not len(at):
                break
            sums = sums + weight * own.impacts(at)
        stays = sums >= least
        scores, docs = np.concatenate([scores, sums[stays]]), np.concatenate([docs, at[stays]])
        order = np.lexsort((doc_ids[docs], -scores))[:k]
        scores, docs = scores[order], docs[order]
        if len(scores) == k:
            least = max(least, int(scores[-1]))  # an equal score may still win by its id
    return scores, docs


def _seen(lists: list[tuple[int, int, List]], k: int) -> int:
    """A score that k documents reach: the k-th best of some that the strongest lists hold."""
    docs = np.zeros(0, np.int64)
    for _, _, own in reversed(lists):
        docs = np.union1d(docs, own.block(0)[0])
        if len(docs) >= k:
            break
    if len(docs) < k:
        return 1
    scores = sum(weight * own.impacts(docs) for _, weight, own in lists)
    return max(1, int(np.partition(scores, -k)[-k]))


FOUND = "item bigint, item_id bigint, doc_id bigint, score bigint"


def search(spark: SparkSession, path: str, corpus: Corpus, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item, with scores above 0."""
    terms = stored(item_terms(items))
    pairs = terms.count()
    blocks = max(1, -(-pairs // ITEM_TERMS))
    own = F.pmod(F.xxhash64("item"), F.lit(blocks))
    found = None
    for block in range(blocks):
        best = _search_block(spark, path, corpus, terms.where(own == block), k)
        found = best if found is None else found.unionByName(best)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search_block(spark: SparkSession, path: str, corpus: Corpus, terms: DataFrame, k: int) -> DataFrame:
    """The k best of every shard, for items of some ITEM_TERMS terms, which the driver and every task get."""
    index = read_index(spark, path)
    wanted = F.broadcast(terms.select("term").distinct())
    sums = index.select("term", "df", "top").join(wanted, "term").groupBy("term").agg(
        F.sum("df").alias("df"), F.max("top").alias("top")
    )
    weights = {bytes(r["term"]): (corpus.weight(r["df"]), r["top"]) for r in sums.collect()}
    asked: dict[tuple[int, int | None], list[bytes]] = {}
    for r in terms.collect():
        if bytes(r["term"]) in weights:
            asked.setdefault((r["item"], r["item_id"]), []).append(bytes(r["term"]))
    shared = spark.sparkContext.broadcast((weights, asked))
    named = index.join(wanted, "term", "left_semi").unionByName(index.where(F.col("term").isNull()))

    def best(rows: DataFrame, least: dict[int, int]) -> DataFrame:
        def run(key: tuple, rows: pa.Table) -> pa.Table:
            weights, asked = shared.value
            whole = rows.filter(pc.is_null(rows["term"]))
            doc_ids, sizes = (np.frombuffer(whole[c][0].as_py(), np.int64) for c in ("doc_ids", "sizes"))
            own = _lists_of(rows.filter(pc.is_valid(rows["term"])).combine_chunks(), sizes, corpus)
            out: list[tuple] = []
            for (item, item_id), names in asked.items():
                held = [(weights[t][0] * weights[t][1], weights[t][0], own[t]) for t in names if t in own and weights[t][0]]
                for score, d in zip(*best_of_shard(held, doc_ids, k, least.get(item, 1))):
                    out.append((item, item_id, None if doc_ids[d] == NULL_ID else int(doc_ids[d]), int(score)))
            columns = list(zip(*out)) if out else [[]] * 4
            return pa.table([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in FOUND.split(", ")])

        # So many shards to a task however small their lists are, as the work is in the items.
        tasks = max(1, shards.count() // TASK_SHARDS)
        return rows.repartition(tasks, "shard").groupBy("shard").applyInArrow(run, FOUND)

    shards = index.where(F.col("term").isNull()).select("shard")
    few = shards.orderBy(F.xxhash64("shard")).limit(FIRST_SHARDS).collect()
    scores: dict[int, list[int]] = {}
    for r in best(named.where(F.col("shard").isin([r["shard"] for r in few])), {}).collect():
        scores.setdefault(r["item"], []).append(r["score"])
    least = {item: sorted(own, reverse=True)[k - 1] for item, own in scores.items() if len(own) >= k}
    return best(named, least)


def _lists_of(rows: pa.Table, sizes: np.ndarray, corpus: Corpus) -> dict[bytes, List]:
    """A shard's lists by term."""
    if not rows.num_rows:
        return {}
    columns = [rows[c].chunk(0) for c in ("last", "tops", "ends")]
    values = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in columns]
    found = {}
    for i, (term, data) in enumerate(zip(rows["term"].to_pylist(), rows["data"].to_pylist())):
        found[term] = List(*[v[o[i] : o[i + 1]] for v, o in values], data, sizes, corpus)
    return found


def op13_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of all for every benchmark item."""
    docs, path = table(spark, sf_dir, "documents"), scratch_path(spark, "index")
    corpus = corpus_of(docs)
    build(docs, path, corpus)
    return search(spark, path, corpus, table(spark, sf_dir, "benchmark"))
