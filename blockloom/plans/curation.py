"""The curation jobs: validate candidates against fetched bodies, clean the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.functions.text import strip
from blockloom.operators.crawl import MISSING_HREF, crawl_outcome, registered_domain
from blockloom.operators.flatten import page_text
from blockloom.operators.pairing import pending
from blockloom.operators.quality import clean_corpus, cleanup_report
from blockloom.session import stored
from blockloom.sources.labels import CORRUPT, bad_records, good_records


def validate(
    labels: DataFrame,
    fetched: DataFrame,
    suffixes: DataFrame,
    state: DataFrame | None = None,
    retry_failed: bool = False,
    browser_domains: DataFrame | None = None,
) -> DataFrame:
    """Outcome of every candidate that state does not close: label and page columns,
    url, domain, status, reason. Files that are no JSON fail.

    Domains are looked up on the labels, before any body is joined. Labels of browser_domains
    (domain) need a body that was fetched by browser. A label without href fails whatever body it may have,
    so none is looked up: its page columns are null.
    """
    todo = labels if state is None else pending(labels, state, retry_failed=retry_failed)
    good = good_records(todo) if CORRUPT in todo.columns else todo
    has_href = strip(F.coalesce("href", F.lit(""))) != ""
    failed = good.where(~has_href).withColumns({
        "url": F.lit(None).cast("string"), "domain": F.lit(""), "status": F.lit("failed"), "reason": F.lit(MISSING_HREF),
    })
    named = registered_domain(good.where(has_href), suffixes, "href")
    if browser_domains is not None:
        listed = browser_domains.select("domain").distinct().withColumn("__browser", F.lit(True))
        named = named.join(listed, "domain", "left")
        outcome = crawl_outcome(fetched, named, browser_first="__browser").drop("__browser")
    else:
        outcome = crawl_outcome(fetched, named)
    outcome = outcome.unionByName(failed, allowMissingColumns=True)
    if CORRUPT not in todo.columns:
        return outcome
    bad = bad_records(todo).withColumn("status", F.lit("failed"))
    return outcome.unionByName(bad, allowMissingColumns=True)


def clean(labels: DataFrame, pages: DataFrame, key: str = "file", page: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """(report, clean labels). The report is a stored table, made at once: pages are walked for it a single time."""
    texts = page_text(pages.select(key, page, "html"), "body").drop("html")
    report = stored(cleanup_report(labels, texts, key, page))
    return report, clean_corpus(labels, report, key)
