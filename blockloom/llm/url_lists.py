"""Dated URL lists against dated captures: an as-of join by intervals of validity.

A list is a history of entries (kind, value, action, since): a host, a domain with all below it, or a
path prefix of a host is blocked or released from a time on. The entries of one value become intervals
[since, until) in which it is blocked: an entry holds until the next one of the same value, so there is
at most one interval for a value and a time. A capture is checked with every value its URL can match,
and is blocked if any of them is blocked when it was fetched.

Intervals are cut at fixed time slots of `slot_days` days, and the join's key is (value, slot). A value
of long history or many captures is so dealt over its slots, only intervals of the same slot meet a
capture, and Spark may split a hot key; no window runs over captures. Whether the list is broadcast is
Spark's choice by size.

Captures without URL or time match nothing. Entries without value, time or known action are left out;
of entries of the same value and time, the release counts. Equal captures are judged alike;
other columns pass through. An empty list blocks nothing; no captures give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockloom.llm.common import table

SLOT_DAYS = 32
FOREVER = "9999-12-31 00:00:00"


def host(url: Column) -> Column:
    """Lower-case host without port and user; null if there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.when(F.length(found) > 0, F.rtrim(found, F.lit(".")))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(value, since, until): when a value is blocked. value has its kind in front.

    The history of a value is ordered in one task; entries, unlike captures, are few for a value.
    """
    known = entries.where("value is not null and since is not null and kind in ('host', 'domain', 'path')").where(
        "action in ('block', 'release')"
    )
    value = F.concat_ws(":", "kind", F.when(F.col("kind") == "path", F.col("value")).otherwise(F.lower("value")))
    last = known.groupBy(value.alias("value"), "since").agg(F.max("action").alias("action"))  # 'release' > 'block'
    order = Window.partitionBy("value").orderBy("since")
    held = last.withColumn("until", F.coalesce(F.lead("since").over(order), F.lit(FOREVER).cast("timestamp")))
    return held.where("action = 'block'").select("value", "since", "until")


def _slot(time: Column) -> Column:
    return F.floor(F.unix_seconds(time) / (SLOT_DAYS * 86400)).cast("bigint")


def values(url: Column) -> Column:
    """All values of entries that a URL can match."""
    name, way = host(url), F.filter(F.split(path(url), "/"), lambda x: x != "")
    labels = F.split(name, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    )
    paths = F.when(
        F.size(way) > 0,
        F.transform(
            F.sequence(F.lit(1), F.size(way)),
            lambda i: F.concat(F.lit("path:"), name, F.lit("/"), F.array_join(F.slice(way, F.lit(1), i), "/")),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return F.when(name.isNotNull(), F.array_distinct(F.concat(F.array(F.concat(F.lit("host:"), name)), domains, paths)))


def check_captures(captures: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """(key, url, fetched, blocked, blocked_by): a row per distinct capture.

    blocked_by has the values, in order, that were blocked at that time.
    """
    newest = captures.agg(F.max(_slot(F.col("fetched"))).alias("s")).first()["s"]
    slots = F.sequence(_slot(F.col("since")), F.least(_slot(F.col("until")), F.lit(newest)))
    in_time = F.col("since").isNotNull() & (_slot(F.col("since")) <= F.lit(newest))
    held = intervals(entries).where(in_time).select("value", "since", "until", F.explode(slots).alias("slot"))

    rows = captures.select(F.col(key).alias("__key"), "url", "fetched").distinct()
    asked = rows.select("*", F.explode(values(F.col("url"))).alias("value"), _slot(F.col("fetched")).alias("slot"))
    hits = asked.join(held, ["value", "slot"]).where("since <= fetched and fetched < until")
    found = hits.groupBy("__key", "url", "fetched").agg(F.sort_array(F.collect_set("value")).alias("blocked_by"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("__key", "url", "fetched")]
    both = rows.alias("r").join(found.alias("f"), same[0] & same[1] & same[2], "left")
    return both.select(
        F.col("r.__key").alias(key),
        "r.url",
        "r.fetched",
        F.col("blocked_by").isNotNull().alias("blocked"),
        F.coalesce("blocked_by", F.array().cast("array<string>")).alias("blocked_by"),
    )


def filter_captures(captures: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """The captures that were not blocked when they were fetched; same columns, repeated rows included."""
    bad = check_captures(captures, entries, key).where("blocked").select(
        F.col(key).alias("__key"), F.col("url").alias("__url"), F.col("fetched").alias("__fetched")
    )
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.col("url") == F.col("__url"))
    return captures.join(bad, same & (F.col("fetched") == F.col("__fetched")), "left_anti")


# The given pages have neither times nor lists: both are derived from them, by checksums of ids and values.


def _checksum(value: Column) -> Column:
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("bigint")


def dated_captures(pages: DataFrame) -> DataFrame:
    """Pages as captures of the year 2024, at a minute that the page_id decides."""
    minute = _checksum(F.col("page_id").cast("string")) % (366 * 1440)
    start = F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return pages.select("page_id", "url", F.timestamp_seconds(start + minute * 60).alias("fetched"))


def dated_list(pages: DataFrame) -> DataFrame:
    """Entries for hosts, parent domains and first path parts of the pages.

    A value is listed if its checksum is divisible by 3; it is blocked on a day, released, and
    blocked again, if the checksum is even, later in the year.
    """
    name, first = host(F.col("url")), F.get(F.filter(F.split(path(F.col("url")), "/"), lambda x: x != ""), 0)
    parent = F.regexp_extract(name, r"^[^.]+\.(.+\..+)$", 1)
    kinds = F.array(
        F.struct(F.lit("host").alias("kind"), name.alias("value")),
        F.struct(F.lit("domain").alias("kind"), parent.alias("value")),
        F.struct(F.lit("path").alias("kind"), F.concat(name, F.lit("/"), first).alias("value")),
    )
    listed = pages.select(F.explode(kinds).alias("v")).select("v.kind", "v.value").where("value <> ''").distinct()
    crc = _checksum(F.concat_ws(":", "kind", "value"))
    listed = listed.withColumn("crc", crc).where("crc % 3 = 0")
    day = (F.col("crc") / 3).cast("bigint") % 100
    steps = F.array(
        F.struct(F.lit("block").alias("action"), day.alias("day")),
        F.struct(F.lit("release").alias("action"), (day + 90).alias("day")),
        F.struct(F.lit("block").alias("action"), (day + 200).alias("day")),
    )
    steps = F.slice(steps, F.lit(1), F.when(F.col("crc") % 2 == 0, 3).otherwise(2))
    start = F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return listed.select("kind", "value", F.explode(steps).alias("s")).select(
        "kind", "value", "s.action", F.timestamp_seconds(start + F.col("s.day") * 86400).alias("since")
    )


def op8_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, blocked, blocked_by) of all pages, values joined by a blank."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = check_captures(dated_captures(pages), dated_list(pages), "page_id")
    return found.select("page_id", "blocked", F.array_join("blocked_by", " ").alias("blocked_by"))


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, url,
    regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1) AS name,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?', 1), '/'), lambda x: x <> '') AS way,
    ('0x' || substr(md5(page_id::VARCHAR), 1, 8))::BIGINT % (366 * 1440) * 60 AS fetched
  FROM pages
),
raw AS (
  SELECT 'host' AS kind, name AS value FROM p
  UNION SELECT 'domain', regexp_extract(name, '^[^.]+\.(.+\..+)$', 1) FROM p
  UNION SELECT 'path', name || '/' || way[1] FROM p
),
listed AS (
  SELECT kind || ':' || value AS value, ('0x' || substr(md5(kind || ':' || value), 1, 8))::BIGINT AS crc
  FROM raw WHERE value <> ''
),
days AS (SELECT value, crc, crc // 3 % 100 AS day FROM listed WHERE crc % 3 = 0),
held AS (
  SELECT value, day * 86400 AS since, (day + 90) * 86400 AS until FROM days
  UNION ALL SELECT value, (day + 200) * 86400, 1000000000 FROM days WHERE crc % 2 = 0
),
asked AS (
  SELECT page_id, fetched, 'host:' || name AS value FROM p
  UNION SELECT page_id, fetched, 'domain:' || array_to_string(string_split(name, '.')[i:], '.')
    FROM p, LATERAL unnest(range(1, len(string_split(name, '.')) + 1)) AS u(i)
  UNION SELECT page_id, fetched, 'path:' || name || '/' || array_to_string(way[1:i], '/')
    FROM p, LATERAL unnest(range(1, len(way) + 1)) AS u(i)
),
hits AS (
  SELECT page_id, string_agg(DISTINCT a.value, ' ' ORDER BY a.value) AS blocked_by
  FROM asked a JOIN held h ON a.value = h.value AND h.since <= a.fetched AND a.fetched < h.until GROUP BY page_id
)
SELECT page_id, blocked_by IS NOT NULL AS blocked, coalesce(blocked_by, '') AS blocked_by
FROM pages LEFT JOIN hits USING (page_id)
"""
