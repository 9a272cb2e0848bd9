"""Crawl bookkeeping on already fetched bodies: routing, outcome, ids, pacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions.text import strip
from blockloom.operators.flatten import page_text_column
from blockloom.operators.numbering import number_within
from blockloom.operators.quality import validate_pages

# Outcome texts, delay and initial browser domains.
MISSING_HREF = "Missing href"
EMPTY_BODY = "Empty or invalid HTML from both methods"
MISMATCH = "Page content did not match expectations"
BLOCKED_MARKS = ("not acceptable", "error 405")
THROTTLE_SECONDS = 60
BROWSER_DOMAINS = ("allrecipes.com",)
FILE_PATTERN = "recipe_%05d"


def url_host(url: Column) -> Column:
    """Lowercased host of a URL or of a bare host; null if there is none."""
    rest = F.regexp_replace(strip(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//", "")
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*\z", "")
    return F.nullif(F.lower(F.regexp_replace(host, r"\.+\z", "")), F.lit(""))


def registered_domain(
    df: DataFrame, suffixes: DataFrame, url: str = "url", out: str = "domain", suffix: str = "suffix"
) -> DataFrame:
    """Add the public suffix plus one label of the URL's host; '' if there is none.

    suffixes holds the rules of a public suffix list ("com", "co.uk", "*.ck",
    "!www.ck"). Each host's own endings are looked up by an equi-join and the
    longest match wins; a host without a match, an IP address or a bare suffix has no domain.
    Hosts are looked up once each, however often they occur.
    """
    rows = df.withColumn("__host", url_host(F.col(url)))
    hosts = rows.select("__host").where(F.col("__host").isNotNull()).distinct()
    labels = F.split("__host", r"\.")
    n = F.size("__labels")

    def tail(k: Column) -> Column:
        return F.array_join(F.slice(F.col("__labels"), n - k + 1, k), ".")

    endings = (
        hosts.select("__host", labels.alias("__labels"))
        .where(~F.col("__host").rlike(r"^\d+\.\d+\.\d+\.\d+\z"))
        .select("__host", "__labels", F.explode(F.sequence(F.lit(1), n)).alias("__k"))
        .select("__host", "__labels", "__k", tail(F.col("__k")).alias("__tail"))
    )
    rules = suffixes.select(
        F.regexp_replace(suffix, r"^(!|\*\.)", "").alias("__tail"),
        F.when(F.col(suffix).startswith("!"), -1)
        .when(F.col(suffix).startswith("*."), 1)
        .otherwise(0)
        .alias("__extra"),
    )
    # A wildcard covers one label more than it spells out, an exception one less.
    found = (
        endings.join(rules, "__tail")
        .groupBy("__host")
        .agg(
            F.max(F.col("__k") + F.greatest(F.col("__extra"), F.lit(0))).alias("__longest"),
            F.max(F.when(F.col("__extra") == -1, F.col("__k") - 1)).alias("__exception"),
            F.first("__labels").alias("__labels"),
        )
        .withColumn("__keep", F.coalesce("__exception", "__longest") + 1)
        .select(
            F.col("__host").alias("__found"),
            F.when(F.col("__keep") <= n, tail(F.col("__keep"))).alias(out),
        )
    )
    return (
        rows.join(found, rows["__host"] == found["__found"], "left")
        .withColumn(out, F.coalesce(out, F.lit("")))
        .drop("__host", "__found")
    )


def is_blocked(body: Column) -> Column:
    """The plain fetch was turned away; a browser has to try."""
    low = F.lower(body)
    hit = F.contains(low, F.lit(BLOCKED_MARKS[0]))
    for mark in BLOCKED_MARKS[1:]:
        hit = hit | F.contains(low, F.lit(mark))
    return hit


def crawl_outcome(
    fetched: DataFrame, labels: DataFrame, key: str = "file", body: str = "html", browser_first: str | None = None
) -> DataFrame:
    """One outcome per candidate: (labels..., url, status, reason, page columns).

    status is 'failed' (with a reason), 'pending' (no row in fetched yet), 'needs_browser' or 'valid'.
    fetched holds (key, body[, fetched_by]), one row per key; a body fetched by a browser is not sent there
    again. browser_first names a boolean column of labels: those are for the browser from the start.
    """
    columns = [c for c in fetched.columns if c != key]
    got = fetched.withColumn("__got", F.lit(True))
    rows = labels.join(got, key, "left").withColumn("url", strip(F.coalesce("href", F.lit(""))))
    by_browser = (
        F.coalesce(F.col("fetched_by") == "browser", F.lit(False))
        if "fetched_by" in columns
        else F.lit(False)
    )
    has_href = F.col("url") != ""
    waits = ~by_browser & F.coalesce(F.col(browser_first), F.lit(False)) if browser_first else F.lit(False)
    there = F.col("__got").isNotNull()
    blank = strip(F.coalesce(body, F.lit(""))) == ""
    # Only bodies that reach the content check are turned into text.
    rows = rows.withColumn(
        "__check", has_href & ~blank & ~waits & (by_browser | ~is_blocked(F.col(body)))
    ).withColumn(
        "page_text", page_text_column(F.when(F.col("__check"), F.col(body)), "document", False)
    )
    checked = validate_pages(rows)
    needs_browser = waits | (has_href & ~by_browser & F.coalesce(is_blocked(F.col(body)), F.lit(False)))
    status = (
        F.when(~has_href, "failed")
        .when(needs_browser, "needs_browser")
        .when(~there, "pending")
        .when(blank, "failed")
        .when(F.col("valid"), "valid")
        .otherwise("failed")
    )
    reason = (
        F.when(~has_href, MISSING_HREF)
        .when(needs_browser | ~there, F.lit(None))
        .when(blank, EMPTY_BODY)
        .when(~F.col("valid"), F.when(F.col("reasons") == "", MISMATCH).otherwise(F.col("reasons")))
    )
    return checked.select(
        *labels.columns,
        *[c for c in columns if c not in labels.columns and c != "url"],
        F.when(has_href, F.col("url")).alias("url"),
        status.alias("status"),
        reason.alias("reason"),
    )


def grow_browser_domains(
    whitelist: DataFrame, outcomes: DataFrame, domain: str = "domain"
) -> DataFrame:
    """The browser domains, with those whose body came back blank added."""
    blank = outcomes.where(F.col("reason") == EMPTY_BODY).select(domain)
    return whitelist.select(domain).unionByName(blank).distinct()


def needs_browser(df: DataFrame, whitelist: DataFrame, domain: str = "domain") -> DataFrame:
    """The rows whose domain is fetched by browser."""
    return df.join(whitelist.select(domain).distinct(), domain, "left_semi")


def assign_ids(
    df: DataFrame, start: int = 0, key: str = "file", out: str = "out_index", name: str = "out_name"
) -> DataFrame:
    """Add a dense running index in key order, from start, and the file stem made of it."""
    numbered = number_within(df.select(key), [], [key], out, start)
    if df.columns != [key]:
        numbered = df.join(numbered, key)
    return numbered.withColumn(name, F.format_string(FILE_PATTERN, F.col(out)))


def rate_limit_plan(
    df: DataFrame, key: str = "domain", order: str = "file", delay: int = THROTTLE_SECONDS
) -> DataFrame:
    """(key, order, wait): seconds until each item may start, one per key and delay."""
    ranked = number_within(df.select(key, order), [key], [order], "__k")
    return ranked.select(key, order, (F.col("__k") * delay).alias("wait"))
