"""Registered queries over the pages table and, where SQL can predict them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.site_rules import Frames
from ..sources import from_table
from . import findings, made, overview, overview_stats, parsed
from .config import EVERYTHING, config
from .made import only


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", "html")
    # a file is one split however many pages it holds; parsing is what takes time
    return from_table(rows.repartition(max(8, spark.sparkContext.defaultParallelism)))


def audit(spark: SparkSession, sf_dir: str, settings: dict | None = None) -> DataFrame:
    return findings(Frames(parsed(pages(spark, sf_dir), settings)), settings)


def _rules(*ids: str, **user: dict) -> Callable[[SparkSession, str], DataFrame]:
    """Findings of some rules, of an audit in which only their sections are on."""
    return lambda s, d: audit(s, d, config(user, only(user))).where(F.col("rule_id").isin(*ids)).select("rule_id", "file", "level")


def _synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each order, made of its columns, so that SQL can tell from them what an audit must find."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority")
    n = F.col("o_orderkey")
    path = F.concat(F.lit("https://shop.example/o/"), n, F.lit("/"))
    html = F.concat(
        F.lit("<!DOCTYPE html><html"), F.when(n % 5 != 0, ' lang="en"').otherwise(""), F.lit("><head><title>"), F.when(n % 11 == 0, "").otherwise(F.col("o_orderpriority")), F.lit("</title>"),
        F.when(n % 3 == 0, F.concat(F.lit('<link rel="canonical" href="https://shop.example/o/'), F.col("o_custkey"), F.lit('/">'))).otherwise(""), F.when(n % 13 == 0, '<meta name="robots" content="noindex">').otherwise(""),
        F.lit("</head><body><main><h1>x</h1>"), F.when(n % 7 == 0, '<img src="/a.png">').otherwise(""), F.when(n % 4 == 0, "<h4>deep</h4>").otherwise(""),
        F.lit('<a href="/o/'), F.col("o_custkey"), F.lit('">next</a></main></body></html>'),
    )
    return from_table(orders.select(path.alias("url"), html.alias("html")).repartition(max(8, spark.sparkContext.defaultParallelism)))


def _synthetic_rules(*ids: str, **user: dict) -> Callable[[SparkSession, str], DataFrame]:
    def found(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = config(user, only(user))
        return findings(Frames(parsed(_synthetic(spark, sf_dir), c)), c).where(F.col("rule_id").isin(*ids)).select("rule_id", "file", "level")

    return found


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each page with links; pages may share an address."""
    rows = parsed(pages(spark, sf_dir)).select("file", F.size("anchors").cast("long").alias("n_links"), F.size(F.filter("anchors", lambda e: e.internal)).cast("long").alias("n_internal"))
    return rows.where("n_links > 0")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    full = config(None, EVERYTHING | {"max_errors": None, "write_baseline": False})
    facts = lambda s, d: parsed(pages(s, d))
    return made.queries() | {
        "audit": lambda s, d: audit(s, d).select("site", "file", "check_idx", "level", "rule_id", "selector"),
        "audit_everything": lambda s, d: audit(s, d, full).groupBy("rule_id", "level").agg(F.count(F.lit(1)).alias("n")),
        "summary_by_level": lambda s, d: audit(s, d).groupBy("level").agg(F.count(F.lit(1)).alias("n")),
        "overview": lambda s, d: overview(facts(s, d)).drop("site", "json_ld_types"),
        "overview_stats": lambda s, d: overview_stats(overview(facts(s, d))),
        "links_per_page": _links,
        "html_basics": _rules("html/lang-missing", "html/title-missing", "html/title-empty", "html/title-too-long", "html/viewport-missing", html_basics={"lang_attr_required": True, "title_required": True, "viewport_required": True}),
        "links_broken": _rules("links/broken", links={"check_internal": True, "fail_on_broken": True}),
        "links_orphan": _rules("links/orphan-page", links={"detect_orphan_pages": True}),
        "duplicate_titles": _rules("content/duplicate-title", content_quality={"detect_duplicate_titles": True}),
        "shop_basics": _synthetic_rules("html/lang-missing", "html/title-empty", "a11y/img-alt", "headings/skip-level", "images/missing-dimensions", html_basics={"lang_attr_required": True, "title_required": True}, a11y={"img_alt_required": True}, headings={"no_skip": True}, images={"check_missing_dimensions": True}),
        "shop_canonical": _synthetic_rules("canonical/missing", "canonical/cluster", "canonical/target-missing", canonical={"require": True, "detect_clusters": True}),
        "shop_links": _synthetic_rules("links/broken", "links/orphan-page", links={"check_internal": True, "fail_on_broken": False, "detect_orphan_pages": True}),
        "shop_crawl": _synthetic_rules("crawl-budget/noindex-with-internal-demand", crawl_budget={"enabled": True}),
        "shop_titles": _synthetic_rules("content/duplicate-title", content_quality={"detect_duplicate_titles": True}),
    }


def oracle_sql() -> dict[str, str]:
    # a title's length and value are those of its text, in which a character reference is one character
    title = "replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&')"
    every = lambda rule, level: f"SELECT '{rule}' AS rule_id, url AS file, '{level}' AS level FROM pages"
    # a tag of the raw pages: regular markup, so a pattern finds what the parser finds
    hrefs = "unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))"
    f = "'https://shop.example/o/' || o_orderkey || '/'"
    keys = "SELECT o_orderkey FROM orders"
    text = lambda tag: f"replace(trim(regexp_extract(html, '<{tag}>([^<]*)</{tag}>', 1)), '&amp;', '&')"
    path = r"regexp_replace(regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/(index\.html?)+$', '/'), '(\.html?)+$', '')"
    route = f"CASE WHEN {path} LIKE '%/' THEN {path} ELSE {path} || '/' END"
    site = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
    # all that the default settings find on the raw pages, which have no canonical, viewport, main or header
    one = lambda idx, level, rule, at: f"SELECT {site} AS site, url AS file, {idx} AS check_idx, '{level}' AS level, '{rule}' AS rule_id, '{at}' AS selector FROM pages"
    lost = f"SELECT site, file, 1, 'error', 'links/broken', concat('a[href=', chr(39), href, chr(39), ']') FROM (SELECT {site} AS site, url AS file, {hrefs} AS href FROM pages)"
    default = " UNION ALL ".join([one(0, "error", "canonical/missing", "head"), one(3, "error", "html/viewport-missing", "head"), f"{one(3, 'warning', 'html/title-too-long', 'title')} WHERE octet_length(encode(trim({title}))) > 60", one(2, "error", "a11y/landmark-main-missing", "body"), one(2, "info", "a11y/landmark-header-missing", "body"), lost])
    falsy = ", ".join(f"false AS {x}" for x in ("has_canonical", "has_og_title", "has_og_description", "has_og_image", "has_json_ld", "has_skip_link", "noindex"))
    shown = f"SELECT url AS file, {route} AS route, {text('title')} AS title, NULL AS meta_description, NULL AS canonical_url, {falsy}, CAST(1 AS INTEGER) AS h1_count, {text('h1')} AS h1_text, true AS has_lang_attr, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang_value FROM pages"
    none = ", ".join(f"CAST(0 AS BIGINT) AS pages_with_{x}" for x in ("description", "canonical", "og_title", "og_description", "og_image", "json_ld", "skip_link", "noindex"))
    linked = f"SELECT {site} AS site, {hrefs} || '/' AS target FROM pages"
    return made.oracle_sql() | {
        "audit": default,
        "summary_by_level": f"SELECT level, count(*) AS n FROM ({default}) GROUP BY level",
        "overview": shown,
        "overview_stats": f"SELECT count(*) AS total_pages, count(*) AS pages_with_h1, count(*) AS pages_with_lang, count(*) FILTER (title <> '') AS pages_with_title, {none} FROM ({shown})",
        "links_orphan": f"SELECT 'links/orphan-page' AS rule_id, file, 'warning' AS level FROM (SELECT {site} AS site, url AS file, {route} AS route FROM pages) p WHERE route <> '/' AND NOT EXISTS (SELECT 1 FROM ({linked}) l WHERE l.site = p.site AND l.target = p.route)",
        "html_basics": f"{every('html/viewport-missing', 'error')} UNION ALL {every('html/title-too-long', 'warning')} WHERE octet_length(encode(trim({title}))) > 60",
        "links_per_page": "SELECT url AS file, CAST(len(regexp_extract_all(html, '<a href=\"')) AS BIGINT) AS n_links, CAST(len(regexp_extract_all(html, '<a href=\"')) AS BIGINT) AS n_internal FROM pages WHERE html LIKE '%<a href=\"%'",
        "links_broken": f"SELECT 'links/broken' AS rule_id, file, 'error' AS level FROM (SELECT url AS file, {hrefs} AS href FROM pages)",
        "duplicate_titles": f"SELECT 'content/duplicate-title' AS rule_id, file, 'warning' AS level FROM (SELECT url AS file, count(*) OVER (PARTITION BY regexp_extract(url, '^(https?://[^/?#]+)', 1), trim({title})) AS n FROM pages) WHERE n > 1",
        "shop_basics": f"SELECT 'html/lang-missing' AS rule_id, {f} AS file, 'error' AS level FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT 'html/title-empty', {f}, 'error' FROM orders WHERE o_orderkey % 11 = 0 UNION ALL SELECT 'a11y/img-alt', {f}, 'error' FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT 'images/missing-dimensions', {f}, 'error' FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT 'headings/skip-level', {f}, 'warning' FROM orders WHERE o_orderkey % 4 = 0",
        "shop_canonical": f"SELECT 'canonical/missing' AS rule_id, {f} AS file, 'error' AS level FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT 'canonical/cluster', {f}, 'warning' FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_orderkey % 3 = 0) WHERE n > 1 UNION ALL SELECT 'canonical/target-missing', {f}, 'warning' FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey NOT IN ({keys})",
        "shop_links": f"SELECT 'links/broken' AS rule_id, {f} AS file, 'warning' AS level FROM orders WHERE o_custkey NOT IN ({keys}) UNION ALL SELECT 'links/orphan-page', {f}, 'warning' FROM orders WHERE o_orderkey NOT IN (SELECT o_custkey FROM orders)",
        "shop_crawl": f"SELECT 'crawl-budget/noindex-with-internal-demand' AS rule_id, {f} AS file, 'info' AS level FROM orders WHERE o_orderkey % 13 = 0 AND o_orderkey IN (SELECT o_custkey FROM orders)",
        "shop_titles": f"SELECT 'content/duplicate-title' AS rule_id, {f} AS file, 'warning' AS level FROM (SELECT *, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders WHERE o_orderkey % 11 <> 0) WHERE n > 1",
    }
