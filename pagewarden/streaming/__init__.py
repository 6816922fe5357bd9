"""Audits of pages as they come: the rules that a page alone decides, without state, and counts by time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.site_rules import COLUMNS
from ..plans import with_facts, with_severity
from ..plans.config import config
from ..sources import from_table


def page_findings(pages: DataFrame, settings: dict | None = None) -> DataFrame:
    """Findings (COLUMNS) of each page of a stream or table (url, html); rules that need other pages aren't run."""
    c = settings or config()
    own = with_facts(from_table(pages, **c["url_normalization"]), c).select("site", "file", F.explode("found").alias("x"))
    return with_severity(own.select("site", "file", "x.*").select(*COLUMNS), c)


def counts_by_time(pages: DataFrame, settings: dict | None = None, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Findings by rule and level in windows of the pages' times (url, html, ts); pages later than ``late`` aren't counted.

    One row for each window, rule and level, given when the watermark has passed the window's end.
    """
    c = settings or config()
    # the time travels in the page's address, since rules give findings of an address
    named = pages.withColumn("file", F.to_json(F.struct("ts", "url")))
    parsed = with_facts(named.select(F.lit("").alias("site"), "file", F.lit("/").alias("route"), F.lit(None).cast("string").alias("absolute_url"), "html"), c)
    found = with_severity(parsed.select("site", "file", F.explode("found").alias("x")).select("site", "file", "x.*").select(*COLUMNS), c)
    ts = F.from_json("file", "ts timestamp, url string")["ts"]
    return found.withColumn("ts", ts).withWatermark("ts", late).groupBy(F.window("ts", every).alias("window"), "rule_id", "level").agg(F.count(F.lit(1)).alias("n"))
