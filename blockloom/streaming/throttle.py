"""Per-key throttle: an event passes if the last passed one is at least delay old.

A refused event does not move the clock. The rule is sequential within a key. The batch form sorts events
by range into even partitions, whatever their keys, so that a key holding a third of all events, at one
time or over years, is spread like any other. What begins inside a partition is settled there. The first
key of a partition may go on from the one before: its events stay open, and the partition reports how its
first key would end for every time it could be open from, as a step function. The reports, a row per
partition, are chained; then the open events are settled, each partition's by its own starting point. Of
events with the same key and time only the first can pass.

The stream form keeps one time per key, with a timer that drops it once it can refuse nothing any more.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from blockloom.session import stored

_NEVER = -(2**62)
#: A report's step function has at most so many steps; an end that needs more is looked up in the events.
STEPS = 64


def _micros(events: DataFrame, ts: str) -> Column:
    """Microseconds since 1970 of a time column, whatever the session's time zone.

    A time without zone is not cast to one with: around a change to daylight
    saving time that would shift differences.
    """
    if isinstance(events.schema[ts].dataType, T.TimestampNTZType):
        since = F.col(ts) - F.expr("timestamp_ntz'1970-01-01 00:00:00'")
        return (since.cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("bigint")
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _same(a, b) -> bool:
    """Whether two keys are one; nulls are one key."""
    return a == b or bool(pd.isna(a) is True and pd.isna(b) is True)


def _runs(keys: pd.Series) -> Iterator[tuple[object, int, int]]:
    """(key, start, stop) of the runs of equal keys in a sorted batch."""
    if not len(keys):
        return
    codes = pd.factorize(keys, use_na_sentinel=False)[0]
    edges = (np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist()
    for start, stop in zip([0, *edges], [*edges, len(codes)]):
        yield keys.iat[start], start, stop


def _walk(times: np.ndarray, opens: int, delay: int, passed: np.ndarray) -> int:
    """Mark what passes of ascending times from `opens` on; gives the time it is open from afterwards."""
    at = int(np.searchsorted(times, opens, side="left"))
    while at < len(times):
        passed[at] = True
        opens = int(times[at]) + delay
        at = int(np.searchsorted(times, opens, side="left"))
    return opens


def _exits(times: np.ndarray, delay: int) -> tuple[list[int], list[int]]:
    """upto, exit: opening no later than upto[i], the last time passed is exit[i].

    A throttle that is closed when the times begin opens within one delay of
    the first, so only the times in that span can be the first to pass.
    """
    jump = np.searchsorted(times, times + delay, side="left")
    last = np.where(jump < len(times), jump, np.arange(len(times)))
    while True:
        further = last[last]
        if (further == last).all():
            break
        last = further
    starts = min(int(jump[0]) + 1, len(times))
    exits = times[last[:starts]]
    keep = np.append(exits[1:] != exits[:-1], True)
    return times[:starts][keep].tolist(), exits[keep].tolist()


@dataclass
class _Chain:
    """Partitions whose first key is one and the same, in order; all but the last hold nothing else."""

    opens: int
    parts: list[Row] = field(default_factory=list)
    at: int = 0


def _chains(reports: list[Row]) -> list[_Chain]:
    chains: list[_Chain] = []
    for before, r in zip([None, *reports], reports):
        follows = before is not None and _same(before["end_key"], r["first_key"])
        if follows and before["whole"]:
            chains[-1].parts.append(r)
        else:
            chains.append(_Chain(before["opens"] if follows else _NEVER, [r]))
    return chains


def _entries(reports: list[Row], delay: int, exits) -> dict[int, int]:
    """{partition: the time from which its first key is open}.

    exits: a function {partition: opens} -> {partition: opens afterwards}, for pieces whose report has no
    steps. Chains ask it side by side, and only for a piece in which something passes; pieces as short as
    that hold less than some delays, so a key asks at most about once per delay that it spans.
    """
    chains, found = _chains(reports), {}
    while True:
        asked = {}
        for c in chains:
            while c.at < len(c.parts):
                r = c.parts[c.at]
                found[r["part"]] = c.opens
                if c.at + 1 < len(c.parts) and c.opens <= r["last"]:
                    if r["upto"] is None:
                        asked[r["part"]] = c
                        break
                    c.opens = r["exit"][bisect_left(r["upto"], c.opens)] + delay
                c.at += 1
        if not asked:
            return found
        for part, opens in exits({p: c.opens for p, c in asked.items()}).items():
            asked[part].opens = opens
            asked[part].at += 1


def throttle(events: DataFrame, key: str, ts: str, delay: int, order: str, out: str = "accepted") -> DataFrame:
    """(key, ts, order, accepted): delay in seconds; order breaks ties in time.

    An event without a time is neither accepted nor refused: its accepted is null. Events with a null key are
    those of one key. Without a delay all pass.
    """
    timeless = events.where(F.col(ts).isNull()).select(key, ts, order, F.lit(None).cast("boolean").alias(out))
    events = events.where(F.col(ts).isNotNull())
    if delay <= 0:
        return events.select(key, ts, order, F.lit(True).alias(out)).unionByName(timeless)
    micros, spark = delay * 1_000_000, events.sparkSession
    names = ["__key", "__us", "__order", "__ts"]
    rows = events.select(
        F.col(key).alias("__key"), _micros(events, ts).alias("__us"), F.col(order).alias("__order"), F.col(ts).alias("__ts"),
        F.monotonically_increasing_id().alias("__row"),  # equal events are dealt out, too
    )
    sort = ["__key", "__us", "__order", "__row"]
    ranged = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).select(*names)

    key_type, longs = events.schema[key].dataType, T.ArrayType(T.LongType())
    event_fields = [T.StructField(n, ranged.schema[n].dataType) for n in names]
    event_fields += [T.StructField("__passed", T.BooleanType()), T.StructField("part", T.IntegerType())]
    report_fields = [
        T.StructField("first_key", key_type), T.StructField("end_key", key_type), T.StructField("whole", T.BooleanType()),
        T.StructField("opens", T.LongType()), T.StructField("last", T.LongType()),
        T.StructField("upto", longs), T.StructField("exit", longs),
    ]
    schema = T.StructType(event_fields + report_fields)

    def settle(source: Iterator) -> Iterator:
        """Events with what is known of them, and the partition's report (a row with `whole`)."""
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, part = to_arrow_schema(schema), TaskContext.get().partitionId()
        first, current, opens, held, any_rows, whole = None, None, _NEVER, [], False, True
        for batch in source:
            times = batch.column(1).to_numpy()
            passed, known = np.zeros(len(times), bool), np.ones(len(times), bool)
            for name, start, stop in _runs(batch.column(0).to_pandas()):
                own = times[start:stop]
                if not any_rows:
                    first, any_rows = name, True
                if whole and _same(name, first):
                    known[start:stop] = False
                    held.append(np.unique(own))
                    current = name
                    continue
                if whole or not _same(name, current):
                    opens = _NEVER
                whole, current = False, name
                opens = _walk(own, opens, micros, passed[start:stop])
            if len(times):
                settled = pa.array(passed, mask=~known)
                numbers = pa.array(np.full(len(times), part, np.int32))
                columns = [*batch.columns, settled, numbers, *[pa.nulls(len(times), f.type) for f in list(arrow)[6:]]]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)
        if any_rows:
            times = np.unique(np.concatenate(held))
            steps = _exits(times, micros) if whole else ([], [])  # only a whole partition is passed through
            steps = (None, None) if len(steps[0]) > STEPS else steps
            report = [first, current, whole, None if whole else opens, int(times[-1]), *steps]
            row = [None] * 5 + [part] + report
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow)], schema=arrow)

    held = stored(ranged.mapInArrow(settle, schema))
    report_names = ["part", *[f.name for f in report_fields]]
    reports = held.where(F.col("whole").isNotNull()).select(*report_names).orderBy("part").collect()
    opened = held.where(F.col("whole").isNull() & F.col("__passed").isNull()).select(*names, "part")

    def started(opens: dict[int, int]) -> DataFrame:
        """Open events of some partitions, in order, with the time from which each partition's key is open."""
        starts = spark.createDataFrame(list(opens.items()), "part int, __opens bigint")
        of_part = opened.join(F.broadcast(starts), "part").repartition("part")
        return of_part.sortWithinPartitions("part", "__us", "__order").select("part", "__opens", *names)

    def exits(opens: dict[int, int]) -> dict[int, int]:
        def run(source: Iterator) -> Iterator:
            import pyarrow as pa

            part, at = None, _NEVER
            for batch in source:
                times, given = batch.column(3).to_numpy(), batch.column(1).to_numpy()
                for name, start, stop in _runs(batch.column(0).to_pandas()):
                    if name != part:
                        if part is not None:
                            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "opens": [at]})
                        part, at = int(name), int(given[start])
                    at = _walk(times[start:stop], at, micros, np.zeros(stop - start, bool))
            if part is not None:
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "opens": [at]})

        return {r["part"]: r["opens"] for r in started(opens).mapInArrow(run, "part int, opens bigint").collect()}

    entries = _entries(reports, micros, exits)
    out_schema = T.StructType(
        [
            T.StructField(key, key_type), T.StructField(ts, events.schema[ts].dataType),
            T.StructField(order, events.schema[order].dataType), T.StructField(out, T.BooleanType()),
        ]
    )

    def finish(source: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out_schema)
        part, opens = None, _NEVER
        for batch in source:
            times, given = batch.column(3).to_numpy(), batch.column(1).to_numpy()
            passed = np.zeros(len(times), bool)
            for name, start, stop in _runs(batch.column(0).to_pandas()):
                if name != part:
                    part, opens = name, int(given[start])
                opens = _walk(times[start:stop], opens, micros, passed[start:stop])
            columns = [batch.column(2), batch.column(5), batch.column(4), pa.array(passed)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    done = held.where(F.col("__passed").isNotNull()).select(
        F.col("__key").alias(key), F.col("__ts").alias(ts), F.col("__order").alias(order), F.col("__passed").alias(out)
    )
    if entries:
        done = done.unionByName(started(entries).mapInArrow(finish, out_schema))
    return done.unionByName(timeless)


class _Throttle(StatefulProcessor):
    """Events of a key, a micro-batch at a time; the state is the time from which the key is open again."""

    def __init__(self, names: list[str], delay: int):
        self.names, self.delay = names, delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.opens = handle.getValueState("opens", "opens bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.opens.get()
        before = _NEVER if known is None else known[0]
        late = timerValues.getCurrentWatermarkInMs() * 1000
        least = max(before, late) if late > 0 else before
        held: pd.DataFrame | None = None
        for piece in rows:  # of bounded length; what is refused anyhow goes at once
            piece = piece.set_axis([*self.names, "__us", "__at"], axis=1)  # other names may have been made plain
            piece = self._first(piece[piece["__us"] >= least])
            held = piece if held is None else self._merged(held, piece)
        if held is None or held.empty:
            return
        passed = np.zeros(len(held), bool)
        opens = _walk(held["__us"].to_numpy(), before, self.delay, passed)
        if known is not None:
            self.handle.deleteTimer(before // 1000 + 1)
        self.opens.update((opens,))
        self.handle.registerTimer(opens // 1000 + 1)
        yield held.loc[passed, self.names]

    def _first(self, piece: pd.DataFrame) -> pd.DataFrame:
        """The first event of every time, in order."""
        return piece.sort_values(["__us", self.names[2]], kind="stable").drop_duplicates("__us")

    def _merged(self, held: pd.DataFrame, piece: pd.DataFrame) -> pd.DataFrame:
        """Two sorted pieces as one; of a time that both have, the first event."""
        return self._first(pd.concat([held, piece])) if len(piece) else held

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Nothing that still arrives can be refused."""
        self.opens.clear()
        return iter(())

    def close(self) -> None:
        pass


def throttle_stream(
    events: DataFrame, key: str, ts: str, delay: int, order: str, watermark: str | None = None
) -> DataFrame:
    """Passed events of a stream, as (key, ts, order).

    Within a micro-batch a key's events are taken in time order, so batches that arrive in order give the
    batch form's result. Of a key's events in a micro-batch those that can still pass are held, one per
    time; bound the batch at the source (maxFilesPerTrigger, maxBytesPerTrigger).

    An event before the watermark (the latest time seen, less `watermark`, by default the delay) never
    passes, nor does one from before its key is open again, wherever it belongs; what has passed stays. A
    key's state goes once the watermark is beyond the time from which the key is open. Events without a
    time never pass. Needs the session's state store to be RocksDB (see rocksdb_state()).
    """
    if delay <= 0:
        return events.where(F.col(ts).isNotNull()).select(key, ts, order)
    rows = events.where(F.col(ts).isNotNull()).select(key, ts, order, _micros(events, ts).alias("__us"))
    rows = rows.withColumn("__at", F.timestamp_micros("__us")).withWatermark("__at", watermark or f"{delay} seconds")
    schema = T.StructType([events.schema[c] for c in (key, ts, order)])
    processor = _Throttle(schema.names, delay * 1_000_000)
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "append", "EventTime")


def rocksdb_state(spark: SparkSession) -> None:
    """Let streams that start from now on keep their state in RocksDB, as stateful processors need."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
