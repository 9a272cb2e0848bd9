"""Minimum-cost-flow resharding: from old shards to new capacities with the fewest bytes moved.

Rows of an old shard are dealt over `blocks` blocks by the hash of their key; blocks are what is
transferred. The bytes of every block are added up before the shuffle; the driver gets one row per
old shard and block, a number that does not grow with the data. There a minimum-cost flow from old
shard sizes to new capacities (cost 0 to stay, 1 per byte to move, or a given matrix) says how many
bytes go where. Blocks then realise the flow, the largest first, each to the destination of its shard
that lacks most, and a last pass moves or swaps single blocks while that brings sizes closer to the
capacities.

Files: a layout is a folder with shard=K folders of Parquet. Only affected shards are rewritten: those
that lose or get blocks; the others' files stay where they are and are named in the new layout's
manifest. Rows are written where they are read, without a shuffle: a task's rows of an old shard go to
the few shards its flow leads to.

A null text has the size 1 (no bytes, plus 1). Equal rows go together. Rows with a null key are one key.
Other columns pass through; names that begin with __reshard_ are this module's. No rows make a layout without files.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.common import table
from blockloom.session import scratch_path

BLOCKS = 256  # per old shard
BLOCK, TO, FILE, ROW = "__reshard_block", "__reshard_to", "__reshard_file", "__reshard_row"  # columns of its own


def row_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def with_block(docs: DataFrame, key: str = "doc_id", blocks: int = BLOCKS) -> DataFrame:
    return docs.withColumn(BLOCK, F.pmod(F.xxhash64(F.lit("block"), F.col(key)), F.lit(blocks)).cast("int"))


@dataclass
class Network:
    """Successive shortest paths on a small graph; capacities and costs are integers."""

    n: int
    edges: list[list[int]] = field(default_factory=list)  # [to, capacity left, cost], reverse edge at index ^ 1
    out: list[list[int]] = field(default_factory=list)

    def __post_init__(self):
        self.out = [[] for _ in range(self.n)]

    def add(self, a: int, b: int, capacity: int, cost: int) -> int:
        self.out[a].append(len(self.edges))
        self.edges.append([b, capacity, cost])
        self.out[b].append(len(self.edges))
        self.edges.append([a, 0, -cost])
        return len(self.edges) - 2

    def solve(self, source: int, sink: int) -> None:
        potential = [0] * self.n  # no cost is negative at first
        while True:
            dist, by = [float("inf")] * self.n, [-1] * self.n
            dist[source], queue = 0, [(0, source)]
            while queue:
                d, a = heapq.heappop(queue)
                if d > dist[a]:
                    continue
                for e in self.out[a]:
                    b, left, cost = self.edges[e]
                    near = d + cost + potential[a] - potential[b]
                    if left and near < dist[b]:
                        dist[b], by[b] = near, e
                        heapq.heappush(queue, (near, b))
            if by[sink] < 0:
                return
            potential = [p + d if d < float("inf") else p for p, d in zip(potential, dist)]
            path, at = [], sink
            while at != source:
                path.append(by[at])
                at = self.edges[by[at] ^ 1][0]
            amount = min(self.edges[e][1] for e in path)
            for e in path:
                self.edges[e][1] -= amount
                self.edges[e ^ 1][1] += amount


def min_cost_flow(sizes: Sequence[int], capacities: Sequence[int], cost=None) -> dict[tuple[int, int], int]:
    """{(old, new): bytes}. cost(old, new) per byte; by default 0 to stay and 1 to move."""
    cost = cost or (lambda i, j: int(i != j))
    old, new = len(sizes), len(capacities)
    net = Network(old + new + 2)
    source, sink = old + new, old + new + 1
    for i, s in enumerate(sizes):
        net.add(source, i, s, 0)
    ways = {(i, j): net.add(i, old + j, sizes[i], cost(i, j)) for i in range(old) for j in range(new) if sizes[i]}
    for j, c in enumerate(capacities):
        net.add(old + j, sink, c, 0)
    net.solve(source, sink)
    flow = {way: net.edges[e ^ 1][1] for way, e in ways.items()}
    return {way: amount for way, amount in flow.items() if amount}


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def assign_blocks(
    blocks: dict[tuple[int, int], int], flow: dict[tuple[int, int], int], capacities: Sequence[int]
) -> dict[tuple[int, int], int]:
    """{(old shard, block): new shard} that realises the flow by whole blocks."""
    lacking: dict[int, dict[int, int]] = {}
    for (i, j), amount in flow.items():
        lacking.setdefault(i, {})[j] = amount
    where, filled = {}, [0] * len(capacities)
    for (i, b), size in sorted(blocks.items(), key=lambda x: (-x[1], x[0])):
        ways = lacking[i]
        j = max(ways, key=lambda k: (ways[k], k == i, -k))
        where[i, b] = j
        ways[j] -= size
        filled[j] += size
    _even_out(where, blocks, filled, capacities)
    return where


def _even_out(where: dict, blocks: dict, filled: list[int], capacities: Sequence[int]) -> None:
    """Move or swap single blocks between the fullest and the emptiest shard while that helps."""
    at: dict[int, list] = {j: [] for j in range(len(capacities))}
    for key, j in where.items():
        at[j].append(key)
    for _ in range(64 * len(capacities)):
        over = [f - c for f, c in zip(filled, capacities)]
        a, b = max(range(len(over)), key=over.__getitem__), min(range(len(over)), key=over.__getitem__)
        gap = over[a] - over[b]
        wanted = gap // 2
        give = sorted((blocks[k], k) for k in at[a])
        take = [(0, None), *sorted((blocks[k], k) for k in at[b])]
        best, chosen, t = gap, None, 0
        for size, key in give:  # both lists ascend, so one pass finds the closest difference
            while t + 1 < len(take) and size - take[t + 1][0] >= wanted:
                t += 1
            for c in take[t : t + 2]:
                left = abs(gap - 2 * (size - c[0]))
                if left < best:
                    best, chosen = left, (key, c[1])
        if chosen is None or gap <= 1:
            return
        for key, source, target in ((chosen[0], a, b), (chosen[1], b, a)):
            if key is not None:
                at[source].remove(key)
                at[target].append(key)
                where[key] = target
                filled[source] -= blocks[key]
                filled[target] += blocks[key]


def plan(docs: DataFrame, old_shards: int, shards: int) -> dict[tuple[int, int], int]:
    """Where every block of docs (shard, the block, text) goes, for new shards of even size."""
    found = docs.groupBy("shard", BLOCK).agg(F.sum(row_size(F.col("text"))).alias("n")).collect()
    blocks = {(r["shard"], r[BLOCK]): r["n"] for r in found}
    sizes = [0] * old_shards
    for (i, _), n in blocks.items():
        sizes[i] += n
    capacities = even_capacities(sum(sizes), shards)
    return assign_blocks(blocks, min_cost_flow(sizes, capacities), capacities)


def write_layout(docs: DataFrame, path: str) -> None:
    """docs (shard, ...) as shard=K folders, written where the rows are."""
    docs.write.partitionBy("shard").parquet(path)


def reshard(spark: SparkSession, old: str, new: str, old_shards: int, shards: int) -> DataFrame:
    """Rewrite the affected shards of a layout below `new`; returns the new layout's rows.

    Columns of the layout, shard, and FILE and ROW: where in the shard's files a row stands. The
    manifest below `new` has a row per shard: its number and the folder of its files.
    """
    rows = spark.read.parquet(old)
    where = plan(rows, old_shards, shards)
    moved = {i for (i, _), j in where.items() if i != j} | {j for (i, _), j in where.items() if i != j}
    moves = spark.createDataFrame(
        [(i, b, j) for (i, b), j in sorted(where.items())], f"shard int, {BLOCK} int, {TO} int"
    )
    goes = rows.where(F.col("shard").isin(sorted(moved))) if moved else rows.where(F.lit(False))
    goes = goes.join(F.broadcast(moves), ["shard", BLOCK]).drop("shard").withColumnRenamed(TO, "shard")
    goes.write.partitionBy("shard").parquet(f"{new}/shards")
    folders = [(j, f"{new}/shards" if j in moved else old) for j in sorted(set(where.values()))]
    spark.createDataFrame(folders, "shard int, folder string").coalesce(1).write.parquet(f"{new}/manifest")
    return read_layout(spark, new, rows)


def read_layout(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The rows of a layout by its manifest, with FILE and ROW."""
    found = None
    folders: dict[str, list[int]] = {}
    for r in spark.read.parquet(f"{path}/manifest").collect():
        folders.setdefault(r["folder"], []).append(r["shard"])
    for folder, own in folders.items():
        part = spark.read.schema(like.schema).parquet(folder).where(F.col("shard").isin(own))
        part = part.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))
        found = part if found is None else found.unionByName(part)
    return like.where(F.lit(False)).selectExpr("*", f"'' AS {FILE}", f"0L AS {ROW}") if found is None else found


def with_slots(rows: DataFrame) -> DataFrame:
    """Rows with slot: their place in the shard, over its files in order of name. Files are counted, not sorted."""
    from pyspark.sql import Window

    files = rows.groupBy("shard", FILE).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy(FILE).rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("shard", FILE, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__reshard_before"))
    return rows.join(files, ["shard", FILE]).withColumn("slot", F.col("__reshard_before") + F.col(ROW))


OLD_SHARDS, NEW_SHARDS = 12, 16


def op6_min_cost_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents from 12 shards by source, of very different size, to 16 even ones, read back from the files."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    shard = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(OLD_SHARDS)).cast("int")
    old, new = scratch_path(spark, "shards-old"), scratch_path(spark, "shards-new")
    write_layout(with_block(docs.withColumn("shard", shard)), old)
    rows = reshard(spark, old, new, OLD_SHARDS, NEW_SHARDS)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    digest = rows.select(
        "doc_id", row_size(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"), "shard", FILE, ROW
    )
    return with_slots(digest).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
