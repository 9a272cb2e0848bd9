"""Jaccard join of documents' sets of word n-grams, by prefix trees of globally ordered sets.

Rows with the same set are one node from the start. The steps, each a Spark job over all nodes:

1. Sets: size and key of every document's set; with them, n-grams that are frequent in the rows of one
   task. These are few by construction (a task's rows hold only so many of that share) and need no
   counting to be known as frequent, so they never meet in one place.
2. Order: (n-gram, node) postings, without the frequent ones, are packed and shuffled by n-gram;
   document frequencies come back for n-grams of two or more nodes. All n-grams are ordered by
   (frequency, n-gram), rare ones first.
3. Postings: an element is posted for a node if it is among its first ones, so many that similar sets
   always have a posted element in common: the first of all that they share.
4. Hub trees: every posting has a hub, the set with the largest share of its elements in common with
   others. A set is walked once, as a prefix tree with the hub that most of its postings have and the
   hub's other sets, in slices.
5. Open postings: where a posting's sets are not all connected yet and of sizes that can be similar,
   they are walked as a tree, from the posted element on, so that a pair is counted in full at
   its first common element and nowhere else. Postings of the same sets are one tree; long ones are cut
   into blocks by size and hash, and pairs of blocks that may hold open links are walked.
6. Links of all trees, which suffice to connect whatever is similar, give components.

A set thus travels once for its hub, and once for each posted element that is open, however many unlike
sets are about (but for postings longer than a tree).

A document without words has an empty set and is linked with nothing; nor is a row without doc_id, which
has a null component. A text of fewer words than an n-gram has is one n-gram. Rows with one doc_id are
one document for components: what any of them is linked with, all are. Other columns are ignored. No rows
give no rows. Words are hashed with a seed of the run's own. Sets are told apart by 63 bits of hashes. Within a set n-grams are told apart by 64 bits, but
between sets by 48 and their frequency up to 16,383, so a pair at the threshold may be linked wrongly by chance.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.common import rows_of, table
from blockloom.llm.components import components
from blockloom.llm.shingles import Shingler, set_key
from blockloom.llm.trie_join import links
from blockloom.session import stored

PORTION = 1 << 22  # characters that are hashed at a time
FREQUENT_SHARE, FREQUENT_LEAST = 1 / 500, 32  # of a task's rows; rows
RARE_MOST = (1 << 14) - 1  # frequencies from here on are one
TREE_SETS, TREE_ELEMENTS = 1000, 1_000_000  # of one tree


@dataclass(frozen=True)
class Similar:
    words: int = 5
    percent: int = 80


def _portions(batches: Iterator[pa.RecordBatch], shingler: Shingler):
    """(doc_ids, hashes, begins, ends) of some rows at a time."""
    for doc_ids, texts in rows_of(batches, ["doc_id", "text"], PORTION, "text"):
        hashes, ends = shingler.sets(texts)
        yield doc_ids, hashes, np.append(0, ends[:-1]), ends


def document_sets(docs: DataFrame, words: int, seed: int = 0) -> DataFrame:
    """(doc_id, n, node) of all rows; rows with negative n carry an n-gram as node, and how often a task saw it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, rows = Shingler(words, seed), 0
        often, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for doc_ids, hashes, begins, ends in _portions(batches, shingler):
            keys = [set_key(hashes[a:b]) for a, b in zip(begins, ends)]
            columns = [pa.array(doc_ids, pa.int64()), pa.array(ends - begins), pa.array(keys, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "node"])
            # What is frequent so far: an n-gram must be so in some portion, which is a bounded table.
            own, n = np.unique(hashes, return_counts=True)
            keep = n >= max(2, FREQUENT_SHARE * len(doc_ids))
            often, at = np.unique(np.concatenate([often, own[keep]]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n[keep]]), len(often)).astype(np.int64)
            rows += len(doc_ids)
            stays = counts >= FREQUENT_SHARE * rows / 2
            often, counts = often[stays], counts[stays]
        chosen = counts >= max(FREQUENT_LEAST, FREQUENT_SHARE * rows)
        none = pa.nulls(int(chosen.sum()), pa.int64())
        columns = [none, pa.array(-counts[chosen]), pa.array(often[chosen].view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "node"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id bigint, n bigint, node bigint")


def _ordered(frequency, grams: np.ndarray) -> np.ndarray:
    """Integers whose order is (frequency, n-gram)."""
    low = grams.view(np.uint64) & np.uint64((1 << 48) - 1)
    return (np.minimum(frequency, RARE_MOST).astype(np.uint64) << np.uint64(48) | low).astype(np.int64)


def shared_elements(docs: DataFrame, frequent: np.ndarray, words: int, parts: int, seed: int = 0) -> DataFrame:
    """(node, element): the elements of every node that two or more nodes have, and frequent ones, which may come repeatedly."""
    frequent = np.sort(frequent.view(np.uint64))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words, seed)
        for doc_ids, hashes, begins, ends in _portions(batches, shingler):
            keys = [set_key(hashes[a:b]) for a, b in zip(begins, ends)]
            taken: set[int] = set()
            chosen = np.zeros(len(keys), bool)
            for i, key in enumerate(keys):  # a set once, if it has a document
                if doc_ids[i] is not None and ends[i] > begins[i] and key not in taken:
                    taken.add(key)
                    chosen[i] = True
            nodes = np.array(keys, np.int64)
            row = np.repeat(np.arange(len(keys)), ends - begins)
            hashes, row = hashes[chosen[row]], row[chosen[row]]
            at = np.minimum(np.searchsorted(frequent, hashes), max(len(frequent) - 1, 0))
            known = frequent[at] == hashes if len(frequent) else np.zeros(len(hashes), bool)
            direct = _ordered(np.full(int(known.sum()), RARE_MOST), hashes[known])
            blobs = [(-1, direct.tobytes(), b"", row[known].astype("<u4").tobytes(), nodes.tobytes())]
            hashes, row = hashes[~known], row[~known]
            part = (hashes >> np.uint64(40)) % np.uint64(parts)
            order = np.lexsort((row, part))
            hashes, row, part = hashes[order], row[order], part[order]
            low, high = hashes.astype("<u4"), (hashes >> np.uint64(32)).astype("<u2")  # 48 bits
            cuts = np.flatnonzero(np.diff(part.astype(np.int64), prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(part)]):
                own, index = np.unique(row[a:b], return_inverse=True)
                index = index.astype(_width(len(own)))
                blobs.append((int(part[a]), low[a:b].tobytes(), high[a:b].tobytes(), index.tobytes(), nodes[own].tobytes()))
            columns = [pa.array(c, t) for c, t in zip(zip(*blobs), [pa.int64(), *[pa.binary()] * 4])]
            yield pa.RecordBatch.from_arrays(columns, ["part", "low", "high", "rows", "nodes"])

    def shared(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        grams, nodes = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((nodes, grams))
        grams, nodes = grams[order], nodes[order]
        new = np.append(True, (grams[1:] != grams[:-1]) | (nodes[1:] != nodes[:-1]))
        grams, nodes = grams[new], nodes[new]
        cuts = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
        n = np.diff(np.append(cuts, len(grams)))
        n = np.repeat(n, n)
        return _pairs(nodes[n > 1], _ordered(n[n > 1], grams[n > 1]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None
        for batch in batches:
            for i in range(batch.num_rows):
                part, low, high, rows, keys = (c[i].as_py() for c in batch.columns)
                own = np.frombuffer(keys, np.int64)
                if part < 0:  # frequent n-grams have their order already
                    yield _pairs(own[np.frombuffer(rows, "<u4")], np.frombuffer(low, np.int64))
                    continue
                if part != current and held:
                    yield shared(held)
                    held = []
                current = part
                grams = np.frombuffer(low, "<u4").astype(np.uint64)
                grams |= np.frombuffer(high, "<u2").astype(np.uint64) << np.uint64(32)
                held.append((grams, own[np.frombuffer(rows, _width(len(own)))]))
        if held:
            yield shared(held)

    packed = _texts(docs).mapInArrow(post, "part bigint, low binary, high binary, rows binary, nodes binary")
    spread = -1 - F.pmod(F.xxhash64("nodes"), F.lit(parts))
    packed = packed.withColumn("deal", F.when(F.col("part") >= 0, F.col("part")).otherwise(spread))
    dealt = packed.repartition("deal").sortWithinPartitions("part").drop("deal")
    return dealt.mapInArrow(count, "node bigint, element bigint")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))


def _width(n: int) -> str:
    return "<u2" if n <= 1 << 16 else "<u4"


def _pairs(nodes: np.ndarray, elements: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(elements)], ["node", "element"])


def sequences(shared: DataFrame) -> DataFrame:
    """(node, elements): ascending, each once, from rows sorted by node; a node's rows may span Arrow batches.

    A set of which several portions or tasks have copies brings its frequent n-grams once from each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = None, []
        for batch in batches:
            nodes, elements = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.append(True, nodes[1:] != nodes[:-1])) if len(nodes) else []
            done = []
            for a, b in zip(cuts, [*cuts[1:], len(nodes)]):
                if nodes[a] != node and held:
                    done.append((node, np.concatenate(held)))
                    held = []
                node = int(nodes[a])
                held.append(elements[a:b])
            if done:
                yield _sets(done)
        if held:
            yield _sets([(node, np.concatenate(held))])

    def _sets(done: list) -> pa.RecordBatch:
        once = [e[np.append(True, e[1:] != e[:-1])] for _, e in done]
        columns = [pa.array([n for n, _ in done], pa.int64()), pa.array(once, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["node", "elements"])

    dealt = shared.repartition("node").sortWithinPartitions("node", "element")
    return dealt.mapInArrow(run, "node bigint, elements array<bigint>")


def _need(n: Column, percent: int) -> Column:
    """The least overlap of a set of n elements with any similar one."""
    return F.floor((F.lit(percent) * n + 99) / 100)


def _similar(overlap: Column, a: Column, b: Column, percent: int) -> Column:
    return overlap * (100 + percent) >= (a + b) * percent


def postings(near: DataFrame, percent: int) -> DataFrame:
    """(element, node, n, m, at, hub, hub_n): elements of prefixes that several sets have in theirs.

    m counts a set's shared elements, at is the place of this one among them.
    """
    m = F.size("elements")
    prefix = F.slice("elements", F.lit(1), (m - _need(F.col("n"), percent) + 1).cast("int"))
    rows = stored(near.select("node", "n", m.alias("m"), F.posexplode(prefix).alias("at", "element")))
    rank = F.struct((F.col("m") / F.col("n")).alias("share"), "node", "n")
    lists = rows.groupBy("element").agg(F.max(rank).alias("hub"), F.count("*").alias("sets")).where("sets > 1")
    lists = lists.select("element", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"))
    return stored(rows.join(lists, "element"))


def _cut(sets: str, total: str, times: int = 1) -> Column:
    """In how many parts so many sets and elements go, of at most a tree's (by `times`)."""
    return F.ceil(F.greatest(F.col(sets) * times / TREE_SETS, F.col(total) * times / TREE_ELEMENTS)).cast("bigint")


def hub_trees(met: DataFrame, percent: int) -> DataFrame:
    """(tree, node, at, known): every set with the hub, of a similar size, that most of its postings have."""
    alike = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent
    pairs = met.where(alike & (F.col("node") != F.col("hub"))).groupBy("node", "hub").agg(F.count("*").alias("k"), F.max("m").alias("m"))
    pairs = stored(pairs.groupBy("node").agg(F.max(F.struct("k", "hub", "m")).alias("p")).select("node", "p.hub", "p.m"))
    sizes = pairs.groupBy("hub").agg(F.count("*").alias("sets"), F.sum("m").alias("total"))
    cuts = sizes.select("hub", _cut("sets", "total").alias("cut"))
    part = F.pmod(F.xxhash64("node"), F.col("cut"))
    members = pairs.join(cuts, "hub").select(F.concat_ws(":", "hub", part).alias("tree"), "node")
    parts = cuts.select("hub", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)).alias("part"))
    hubs = parts.select(F.concat_ws(":", "hub", "part").alias("tree"), F.col("hub").alias("node"))
    return members.unionAll(hubs).select("tree", "node", F.lit(0).alias("at"), F.lit(0).cast("bigint").alias("known"))


def open_trees(met: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(tree, node, at, known): sets of a posting that roots (v, root) do not connect yet."""
    band = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(percent / 100))).cast("bigint")
    rows = met.join(roots.withColumnRenamed("v", "node"), "node", "left")
    rows = stored(rows.select("element", "node", "n", "m", "at", band.alias("band"), F.coalesce("root", "node").alias("root")))
    ends = [F.min("root").alias("low"), F.max("root").alias("high")]
    several = rows.groupBy("element").agg(*ends).where("low < high").select("element")
    rows = stored(rows.join(several, "element", "left_semi"))
    bounds = [F.min("n").alias("least"), F.max(F.col("m") - F.col("at")).alias("most")]
    spans = rows.groupBy("element", "band").agg(*ends, *bounds)
    beside = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band")
    spans = spans.select("element", "low", "high", "least", "most", beside).groupBy("element", "band")
    spans = spans.agg(*[F.min(c).alias(c) for c in ("low", "least")], *[F.max(c).alias(c) for c in ("high", "most")])
    # What a set and its partner have in common from here on is no more than either has left.
    partner = F.greatest("least", F.col("n") * percent / 100)
    enough = F.least(F.col("m") - F.col("at"), "most") * (100 + percent) >= (F.col("n") + partner) * percent - 0.001
    rows = rows.join(spans.where("low < high"), ["element", "band"]).where(enough)
    rows = stored(rows.select("element", "node", "m", "at", "band", "root"))
    # Postings of the same sets, told apart by 128 bits, are one tree, from the first of their elements on.
    key = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"key{k}") for k in (0, 1)]
    lists = rows.groupBy("element").agg(*key, *ends, F.count("*").alias("sets"), F.sum("m").alias("total")).where("low < high")
    lists = lists.select("element", F.concat_ws(":", "key0", "key1", "sets").alias("tree"), "sets", "total")
    once = rows.join(lists, "element").groupBy("tree", "node").agg(
        F.min("at").alias("at"), *[F.max(c).alias(c) for c in ("m", "band", "root", "sets", "total")]
    )
    once = stored(once)
    is_large = (F.col("sets") > TREE_SETS) | (F.col("total") > TREE_ELEMENTS)
    small = once.where(~is_large).select("tree", "node", "at", F.col("root").alias("known"))
    return small.unionAll(block_pairs(once.where(is_large)))


def block_pairs(rows: DataFrame) -> DataFrame:
    """(tree, node, at, known): every two sets of a large tree that may be an open link meet in a small one.

    A unit is a tree's sets of a band of sizes that are in its largest component, or that are not.
    """
    counts = rows.groupBy("tree", "root").agg(F.count("*").alias("sets"))
    main = counts.groupBy("tree").agg(F.max_by("root", F.struct("sets", "root")).alias("main"))
    rows = stored(
        rows.join(main, "tree").select("tree", "node", "at", "m", "band", "root", (F.col("root") == F.col("main")).alias("main"))
    )
    units = rows.groupBy("tree", "band", "main").agg(F.count("*").alias("sets"), F.sum("m").alias("total"))
    units = units.select("tree", "band", "main", _cut("sets", "total", 2).alias("cut"))
    right = units.select("tree", *[F.col(c).alias(f"{c}2") for c in ("band", "main", "cut")])
    pairs = units.join(right, "tree").where(
        "abs(band - band2) <= 1 and not (main and main2) and struct(band, main) <= struct(band2, main2)"
    )
    pairs = pairs.withColumn("pair", F.concat_ws(":", *[F.col(c).cast("string") for c in ("tree", "band", "main", "band2", "main2")]))
    pairs = pairs.withColumn("alike", F.expr("band = band2 and main = main2"))

    def met(side: DataFrame, cut: str, others: str) -> DataFrame:
        own, other = F.pmod(F.xxhash64("node"), F.col(cut)), F.explode(F.sequence(F.lit(0), F.col(others) - 1))
        return side.select("pair", "alike", "node", "at", F.col("root").alias("known"), own.alias("own"), other.alias("other"))

    first = met(rows.join(pairs, ["tree", "band", "main"]), "cut", "cut2")
    second = rows.withColumnsRenamed({"band": "band2", "main": "main2"}).join(pairs.where("not alike"), ["tree", "band2", "main2"])
    second = met(second, "cut2", "cut")
    low, high = F.least("own", "other"), F.greatest("own", "other")
    name = F.when(F.col("alike"), F.concat_ws(":", "pair", low, high)).otherwise(F.concat_ws(":", "pair", "own", "other"))
    keep = ["node", "at", "known"]
    return first.select(name.alias("tree"), *keep).unionAll(second.select(F.concat_ws(":", "pair", "other", "own").alias("tree"), *keep))


def tree_links(trees: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """(a, b): links within trees (tree, node, at, known) of sets (node, n, elements), from their element `at` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def walked(rows: list) -> pa.RecordBatch:
            nodes = [r[0] for r in rows]
            known = np.array([r[3] or r[0] for r in rows], np.int64)
            size, elements = np.array([r[1] for r in rows]), [r[2] for r in rows]
            pairs = links(size, elements, percent, known)
            columns = [pa.array([nodes[p[k]] for p in pairs], pa.int64()) for k in (0, 1)]
            return pa.RecordBatch.from_arrays(columns, ["a", "b"])

        held, current = [], None
        for batch in batches:
            tree, node, n, elements, known = batch.columns
            values, offsets = elements.values.to_numpy(), elements.offsets.to_numpy()
            columns = zip(tree.to_pylist(), node.to_pylist(), n.to_pylist(), offsets[:-1], offsets[1:], known.to_pylist())
            for key, v, size, a, b, hub in columns:
                if key != current and held:
                    yield walked(held)
                    held = []
                current = key
                held.append((v, size, values[a:b].copy(), hub))
        if held:
            yield walked(held)

    rest = F.slice("elements", F.col("at") + 1, F.size("elements"))
    trees = trees.join(near, "node").select("tree", "node", "n", rest.alias("elements"), "known")
    dealt = trees.repartition("tree").sortWithinPartitions("tree")
    return dealt.select("tree", "node", "n", "elements", "known").mapInArrow(run, "a bigint, b bigint")


def join_similar(docs: DataFrame, rule: Similar = Similar()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of all rows."""
    spark, seed = docs.sparkSession, int.from_bytes(os.urandom(8), "little")
    found = stored(document_sets(docs, rule.words, seed))
    sets = found.where("n >= 0")
    rows = sets.count()
    often = found.where("n < 0").groupBy("node").agg(F.sum(-F.col("n")).alias("n"))
    often = often.where(F.col("n") >= FREQUENT_SHARE * rows / 2).select("node").collect()  # at most 1000 sets' worth
    frequent = np.array([r["node"] for r in often], np.int64)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = shared_elements(docs, frequent, rule.words, parts, seed)
    full = sets.where("n > 0 and doc_id is not null")
    size = full.groupBy("node").agg(F.min("n").alias("n"))
    near = sequences(shared).join(size, "node").where(F.size("elements") >= _need(F.col("n"), rule.percent))
    near = stored(near.select("node", "n", "elements"))

    several = full.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
    same_doc = full.join(several, "doc_id").select("a", F.col("node").alias("b"))
    met = postings(near, rule.percent)
    found = stored(tree_links(hub_trees(met, rule.percent), near, rule.percent).unionAll(same_doc))
    rest = open_trees(met, components(found), rule.percent)
    roots = components(found.unionAll(tree_links(rest, near, rule.percent)))

    own = sets.join(roots.withColumnRenamed("v", "node"), "node", "left")
    own = own.select("doc_id", "n", F.coalesce("root", "node").alias("root"), (F.expr("n > 0 and doc_id is not null")).alias("full"))
    least = own.where("full").groupBy("root").agg(F.min("doc_id").alias("least"))
    joined = own.join(least, "root", "left")
    component = F.when(F.col("full"), F.col("least")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, rule: Similar = Similar()) -> DataFrame:
    """One document of every component: the one with the smallest doc_id; same columns.

    Of rows with the same doc_id the least stays. Documents without words and rows without doc_id stay.
    """
    found = stored(join_similar(docs, rule))
    extra = found.where("component_id < doc_id").select(F.col("doc_id").alias("__id")).distinct()
    again = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__id"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    same = F.col("doc_id") == F.col("__id")
    # What goes grows with the documents, so it is never broadcast; texts are shuffled once.
    left = docs.join(extra.hint("merge"), same, "left_anti").select(*own)
    if again.isEmpty():
        return left
    once = left.join(again, same, "left_anti")
    rest = left.join(again, same, "left_semi").select("doc_id", F.struct(*own).alias("__row"))
    rest = rest.groupBy("doc_id").agg(F.min("__row").alias("__row"))
    return once.select(*own).unionAll(rest.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns]))


def op9_prefix_tree_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of four words, similar from 0.85, of all documents."""
    return join_similar(table(spark, sf_dir, "documents"), Similar(words=4, percent=85))
