"""Pages made of the orders table, so that SQL over the same table can tell what an audit must find.

A page is put together of parts. Each part has some variants, of which the order's key chooses one, and each variant
says what must be found because of it. The SQL of a query is the union of these expectations.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.site_rules import Frames
from ..sources import from_table
from . import findings, parsed, type_histogram
from .config import config

BASE = "https://made.example"
#: Every thirteenth page lies in a folder named for a language.
FILE = f"'{BASE}' || CASE WHEN o_orderkey % 13 = 0 THEN '/de/p/' ELSE '/p/' END || o_orderkey || '/'"
#: Pages of a partition, about, once a table has enough for all cores.
TASK_PAGES = 20_000


@dataclass
class Part:
    """Markup in a place (html, head or body) by the order's key modulo the number of variants.

    A variant is its markup and what must be found: (rule, level) or (rule, level, further condition in SQL). {n} stands
    for the key and {own} for the page's own path.
    """

    place: str
    variants: list[tuple]

    def markup(self) -> Column:
        size, out = len(self.variants), F.lit("")
        for r, (text, *_) in enumerate(self.variants):
            out = F.when(F.col("n") % size == r, F.replace(F.replace(F.lit(text), F.lit("{own}"), F.col("own")), F.lit("{n}"), F.col("n").cast("string"))).otherwise(out)
        return out

    def expected(self, file: str) -> list[str]:
        rows = [(r, *one) for r, (_, *more) in enumerate(self.variants) for one in more]
        return [f"SELECT '{one[0]}' AS rule_id, {file} AS file, '{one[1]}' AS level FROM orders WHERE o_orderkey % {len(self.variants)} = {r}" + (f" AND {one[2]}" if len(one) > 2 else "") for r, *one in rows]


@dataclass
class Made:
    """A query over made pages: parts, settings, further frames by name, and SQL of what else must be found."""

    parts: list[Part]
    settings: dict
    frames: Callable[[DataFrame], dict[str, DataFrame]] = lambda orders: {}
    more: list[str] = field(default_factory=list)
    base: str = BASE
    also: tuple[str, ...] = ()

    def rules(self) -> list[str]:
        return sorted({one[0] for p in self.parts for _, *more in p.variants for one in more} | set(self.also))

    def file(self) -> str:
        return FILE.replace(BASE, self.base)

    def pages(self, spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, dict]:
        """(parsed pages, orders, settings)."""
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority")
        # kept facts go from one executor to another as whole partitions, so these must not grow with the table
        rows = orders.repartition(max(8, spark.sparkContext.defaultParallelism, orders.count() // TASK_PAGES)).withColumn("n", F.col("o_orderkey"))
        rows = rows.withColumn("url", F.expr(self.file())).withColumn("own", F.substr("url", F.lit(len(self.base) + 1)))
        for name in ("priority", "customer"):
            rows = rows.withColumn(name, F.col("o_orderpriority" if name == "priority" else "o_custkey").cast("string"))
        place = lambda name: F.concat(F.lit(""), *[p.markup() for p in self.parts if p.place == name])
        html = F.concat(F.lit("<!DOCTYPE html><html"), place("html"), F.lit("><head>"), place("head"), F.lit("</head><body>"), place("body"), F.lit("</body></html>"))
        html = F.replace(F.replace(html, F.lit("{priority}"), F.col("priority")), F.lit("{customer}"), F.col("customer"))
        c = config(self.settings, only(self.settings))
        return parsed(from_table(rows.select("url", html.alias("html"))), c), orders, c

    def found(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        pages, orders, c = self.pages(spark, sf_dir)
        frames = Frames(pages, **self.frames(orders))
        return findings(frames, c).where(F.col("rule_id").isin(*self.rules())).select("rule_id", "file", "level")

    def sql(self) -> str:
        return " UNION ALL ".join([x for p in self.parts for x in p.expected(self.file())] + self.more)


def only(settings: dict) -> dict:
    """A preset in which every flag is off, so that only the given settings turn rules on."""
    return {s: {k: False if isinstance(v, bool) else v for k, v in body.items()} for s, body in config().items() if isinstance(body, dict) and any(isinstance(v, bool) for v in body.values())}


def rows_of(sql: str) -> Callable[[DataFrame], DataFrame]:
    """A frame by SQL over the orders."""
    return lambda orders: orders.sparkSession.sql(sql.replace("FROM orders", "FROM {orders}"), orders=orders)


def when(rule: str, level: str, condition: str, file: str = FILE) -> str:
    return f"SELECT '{rule}' AS rule_id, {file} AS file, '{level}' AS level FROM orders WHERE {condition}"


E_, W, I = "error", "warning", "info"
_LD = '<script type="application/ld+json">{}</script>'
_ld = lambda body: _LD.replace("{}", body)
_LONG = "word " * 40

MADE: dict[str, Made] = {
    "made_seo": Made(
        [
            Part("head", [
                ("", ("canonical/missing", E_)),
                (f'<link rel="canonical" href="{BASE}{{own}}"><link rel="canonical" href="{BASE}/">', ("canonical/multiple", E_)),
                ('<link rel="canonical" href=" ">', ("canonical/empty", E_)),
                ('<link rel="canonical" href="p/{n}">', ("canonical/not-absolute", E_)),
                ('<link rel="canonical" href="https://other.example{own}">', ("canonical/cross-origin", E_), ("canonical/not-self", W)),
                (f'<link rel="canonical" href="{BASE}/gone/{{n}}/">', ("canonical/not-self", W), ("canonical/target-missing", W)),
                (f'<link rel="canonical" href="{BASE}{{own}}">',),
            ]),
            Part("head", [('<meta name="robots" content="NoIndex, follow">', ("robots/noindex", W)), ('<meta name="robots" content="index">',), ("",)]),
        ],
        {"canonical": {"require": True, "absolute": True, "same_origin": True, "self_reference": True}, "robots_meta": {"allow_noindex": False}},
    ),
    "made_links": Made(
        [
            Part("body", [('<a href="#top">a</a>', ("links/broken-fragment", W)), ('<a href="#here"><i id="here"></i></a>',), ('<a href="#a%20b">b</a><i id="a b"></i>',)]),
            Part("body", [
                ('<a href="{own}?q=1#x">a</a><i id="x"></i>', ("links/query-params", E_)),
                ('<a href="/nowhere/{n}/">a</a>', ("links/broken", E_)),
                ('<a href="mailto:x@made.example?subject=z">a</a><a href="javascript:void(0)">b</a>',),
                ('<a href="{own}#gone">a</a>', ("links/broken-fragment", W)),
                (f'<a href="{BASE}{{own}}../{{n}}/index.html">a</a>',),
                ('<a href="https://other.example/?a=1">a</a>',),
            ]),
        ],
        {"links": {"check_internal": True, "fail_on_broken": True, "check_fragments": True, "forbid_query_params_internal": True, "max_url_depth": 2}},
        more=[when("links/url-depth", W, "o_orderkey % 13 = 0")], also=("links/url-depth",),
    ),
    "made_plain_links": Made(
        [Part("body", [('<a href="http://plain.example{own}">a</a>', ("links/mixed-content", W)), ('<a href="{own}">a</a>',), ('<a href="https://plain.example/">a</a>',)])],
        {"links": {"check_internal": True, "check_mixed_content": True}}, base="http://plain.example",
    ),
    "made_names": Made(
        [
            Part("body", [
                ('<img src="/a.png">', ("a11y/img-alt", E_)),
                ('<img src="/a.png" alt="Photo">', ("a11y/invalid-img-alt", W)),
                ('<img src="/x/cat.png?v=1" alt="cat">', ("a11y/invalid-img-alt", W)),
                ('<img src="/a.png" role="presentation"><img src="/b.png" aria-hidden="true">',),
                ('<img src="/a.png" alt="A tree in bloom"><img src="/b.png" alt="">',),
                ('<img src="/a.png" alt="ab"><img src="/b.png" alt="DSC01.JPG">', ("a11y/invalid-img-alt", W), ("a11y/invalid-img-alt", W)),
            ]),
            Part("body", [
                ('<a href="/"> </a>', ("a11y/link-name", E_)),
                ('<a href="/">Read more</a>', ("a11y/generic-link-text", W)),
                ('<a href="/"><b><img alt="home page" src="/h.svg"></b></a>',),
                ('<a href="/" aria-label="prices">more</a>',),
                ('<a href="/">Our prices</a><a name="x"><img alt="" src="/h.svg"></a>', ("a11y/link-name", E_)),
            ]),
            Part("body", [('<button><img src="/h.svg" alt="menu icon of it"></button>', ("a11y/button-name", E_)), ('<button aria-label="x"></button>',), ("<button>Go</button>",)]),
            Part("body", [
                ("<input>", ("a11y/form-label", E_)), ('<input type="hidden"><input type="Submit">',), ("<label>x<span><input></span></label>",), ('<label for="q">x</label><input id="q">',),
                ("<select></select>", ("a11y/form-label", E_)), ('<textarea aria-label="x"></textarea>',), ('<textarea aria-label=" "></textarea><input id="r">', ("a11y/form-label", E_), ("a11y/form-label", E_)),
            ]),
        ],
        {"a11y": {"img_alt_required": True, "allow_decorative_images": True, "check_alt_quality": True, "a_accessible_name_required": True, "warn_generic_link_text": True, "button_name_required": True, "label_for_required": True}},
    ),
    "made_structure": Made(
        [
            Part("body", [('<a class="skip" href="#main">x</a>',), ("", ("a11y/skip-link", W)), ('<a href="#main">x</a>', ("a11y/skip-link", W)), ('<a href="#content">Skip it</a>',)]),
            Part("body", [('<a href="/x" aria-hidden="true">x</a>', ("a11y/aria-hidden-focusable", W)), ('<p aria-hidden="true" tabindex="0">x</p>', ("a11y/aria-hidden-focusable", W)), ('<p aria-hidden="true" tabindex="-1">x</p>',), ('<button aria-hidden="false">x</button>',), ("",)]),
            Part("body", [("<main>x</main>",), ("", ("a11y/landmark-main-missing", E_)), ("<main>x</main><main>y</main>", ("a11y/landmark-main-duplicate", E_)), ('<div role="main">x</div>',)]),
            Part("body", [("<nav></nav>",), ('<div role="navigation"></div>',), ("", ("a11y/landmark-nav-missing", W))]),
            Part("body", [("<header></header>",), ("<article><header></header></article>", ("a11y/landmark-header-missing", I)), ("", ("a11y/landmark-header-missing", I)), ('<p role="banner"></p>',)]),
            Part("body", [("<footer></footer>",), ("<section><div><footer></footer></div></section>", ("a11y/landmark-footer-missing", I)), ("", ("a11y/landmark-footer-missing", I)), ('<p role="contentinfo"></p>',), ("<aside><footer></footer></aside><footer></footer>",)]),
            Part("body", [('<i id="d"></i><i id="d"></i><i id="D"></i>', ("a11y/duplicate-id", E_)), ('<i id="e"></i><i id="e"></i><i id="e"></i><p aria-labelledby="x e"></p>', ("a11y/duplicate-id-aria", E_)), ('<i id="f"></i>',)]),
            Part("body", [
                ('<p role="widget"></p>', ("a11y/aria-role-abstract", E_)), ('<p role="buton"></p>', ("a11y/aria-role-invalid", E_)), ('<p role="checkbox"></p>', ("a11y/aria-required-attr", E_)), ('<p role="combobox"></p>', ("a11y/aria-required-attr", E_)),
                ('<p role="slider" aria-valuenow="1"></p>', ("a11y/aria-required-attr", E_)), ('<p role="tab switch" aria-checked="true"></p>',), ('<p role="Tab none"></p>', ("a11y/aria-role-invalid", E_)),
            ]),
        ],
        {"a11y": {"require_skip_link": True, "aria_hidden_focusable_check": True, "check_landmarks": True, "check_duplicate_ids": True, "check_aria_roles": True}},
    ),
    "made_html": Made(
        [
            Part("html", [("", ("html/lang-missing", E_)), (' lang="en"',), (' lang=" "', ("html/lang-missing", E_))]),
            Part("head", [("", ("html/title-missing", E_)), ("<title> \n</title>", ("html/title-empty", E_)), (f"<title>{_LONG}</title>", ("html/title-too-long", W)), ("<title>ok</title>",), (f"<title>{'&eacute;' * 31}</title>", ("html/title-too-long", W)), (f"<title>{'&amp;' * 60}</title>",)]),
            Part("head", [("", ("html/meta-description-missing", W)), (f'<meta name="description" content="{_LONG}">', ("html/meta-description-too-long", W)), ('<meta name="description" content="ok">',), ('<meta name="description" content="">', ("html/meta-description-missing", W))]),
            Part("head", [('<meta name="viewport" content="width=device-width">',), ("", ("html/viewport-missing", E_))]),
            Part("body", [
                ("", ("headings/no-h1", E_)), ("<h1>a</h1><h1>b</h1>", ("headings/multiple-h1", W)), ("<h1>a</h1><h3>b</h3>", ("headings/skip-level", W)),
                ("<h1>a</h1><h2>b</h2><h5>c</h5><h2>d</h2><h4>e</h4>", ("headings/skip-level", W), ("headings/skip-level", W)), ("<h1>a</h1><h2>b</h2><h2>c</h2>",), ("<h2>a</h2><h1>b</h1>",), ("<h1>a</h1>",),
            ]),
            Part("body", [("x</b>", ("html/syntax-error", W)), ('<p class="a" class="b">x</p></i></i>', ("html/syntax-error", W), ("html/syntax-error", W)), ("<p>x<p>y",), ("<ul><li>x<li>y</ul>",), ("<b><i>x</b>", ("html/syntax-error", W))]),
        ],
        {"html_basics": {"lang_attr_required": True, "title_required": True, "meta_description_required": True, "viewport_required": True}, "headings": {"require_h1": True, "single_h1": True, "no_skip": True}, "html_validation": {"enabled": True}},
    ),
    "made_opengraph": Made(
        [
            Part("head", [("", ("opengraph/title-missing", W)), ('<meta property="og:title" content="A fine page about trees">', ("opengraph/title-inconsistent", W)), ('<meta property="og:title" content="Tree">',), ('<meta property="og:title" content=" ">', ("opengraph/title-missing", W))]),
            Part("head", [("<title>Tree</title>",)]),
            Part("head", [("", ("opengraph/description-missing", W)), ('<meta property="og:description" content="x">',), ('<meta name="og:description" content="x">', ("opengraph/description-missing", W))]),
            Part("head", [("", ("opengraph/image-missing", W)), ('<meta property="og:image" content="/a.png">', ("opengraph/image-not-absolute", E_)), ('<meta property="og:image" content="">',), ('<meta property="og:image" content="https://other.example/a.png">',), ('<meta property="og:image">', ("opengraph/image-missing", W))]),
            Part("head", [("", ("opengraph/type-missing", W)), ('<meta property="og:type" content="website">',)]),
            Part("head", [("", ("opengraph/url-missing", W)), ('<meta property="og:url" content="x">',), ('<meta property="og:url" content="">', ("opengraph/url-missing", W))]),
            Part("head", [("", ("opengraph/twitter-card-missing", W)), ('<meta name="twitter:card" content="summary">',), ('<meta name="twitter:card" content="large">', ("opengraph/twitter-card-invalid", E_)), ('<meta name="twitter:card" content="">',)]),
            Part("head", [("", ("opengraph/twitter-image-missing", W)), ('<meta name="twitter:image" content="x">',)]),
        ],
        {"opengraph": {f"require_{x}": True for x in ("og_title", "og_description", "og_image", "og_type", "og_url", "twitter_card", "twitter_image")} | {"og_image_absolute_url": True, "twitter_card_valid_values": True, "og_title_consistency": True}},
    ),
    "made_jsonld": Made(
        [
            Part("body", [
                ("", ("structured-data/missing", W)),
                (_ld(" \n"), ("structured-data/empty", E_)),
                (_ld("{"), ("structured-data/invalid-json", E_)),
                (_ld('{"@type":"Thing"}'), ("structured-data/missing-context", W)),
                (_ld('{"@context":"https://other.example","@type":"Thing"}'), ("structured-data/unusual-context", W)),
                (_ld('{"@context":"https://schema.org","name":"x"}'), ("structured-data/missing-type", W)),
                (_ld('{"@context":"https://schema.org","@type":"Organization"}'), ("structured-data/missing-property", W), ("structured-data/organization-missing-url", W)),
                (_ld('{"@context":"https://schema.org","@type":"BlogPosting"}'), ("structured-data/missing-property", W), *((f"structured-data/article-missing-{x}", I if x == "date-modified" else W) for x in ("author", "date-published", "date-modified", "image"))),
                (_ld('{"@context":"https://schema.org","@type":"NewsArticle","headline":"x","author":null,"datePublished":1,"dateModified":1,"image":1}'), ("structured-data/news-article-missing-publisher", E_)),
                (_ld('{"@context":"https://schema.org","@type":"LocalBusiness","name":"x","url":"y"}'), ("structured-data/local-business-missing-telephone", I), ("structured-data/local-business-missing-address", I)),
                (_ld('{"@context":"https://schema.org","@type":"FAQPage","mainEntity":[{"acceptedAnswer":1},{}]}'), ("structured-data/faq-missing-answer", E_)),
                (_ld('{"@context":"https://schema.org","@type":"WebSite","name":"x","url":"y"}'), ("structured-data/website-missing-search-action", I)),
                (_ld('{"@context":"https://schema.org","@type":"BreadcrumbList","itemListElement":[{"position":1,"name":"x"},{},{"position":2,"item":{"name":"y"}}]}'), ("structured-data/breadcrumb-missing-position", E_), ("structured-data/breadcrumb-missing-name", E_)),
                (_ld('{"@context":"https://schema.org","@type":"Person","name":"x"}') * 2, ("structured-data/duplicate-type", W)),
                (_ld('{"@context":"https://schema.org","@graph":[{"@type":"Person","name":"x"},{"@type":["Product","Thing"]}]}'), ("structured-data/missing-property", W)),
                (_ld('[{"@context":"https://schema.org","@type":"Organization"}]'), ("structured-data/missing-context", W)),
                (_ld('{"@context":{"a":"b"},"@type":"Person","name":"x"}'),),
            ]),
        ],
        {"structured_data": {"check_json_ld": True, "require_json_ld": True, "detect_duplicate_types": True}},
    ),
    "made_entities": Made(
        [
            Part("body", [(_ld('{"@id":"/e/{customer}","@type":"Person","name":"{priority}","url":"{own}"}'),), (_ld('{"@id":"/e/{customer}","@type":"Thing","name":"{priority}","url":"/gone/{n}"}'), ("structured-data-graph/internal-url-missing", W))]),
        ],
        {"structured_data_graph": {"enabled": True}},
        more=[f"SELECT 'structured-data-graph/{x}-conflict' AS rule_id, min({FILE}) AS file, 'warning' AS level FROM orders GROUP BY o_custkey HAVING count(DISTINCT {of}) > 1" for x, of in (("type", "o_orderkey % 2"), ("name", "o_orderpriority"), ("url", "o_orderkey"))],
        also=tuple(f"structured-data-graph/{x}-conflict" for x in ("type", "name", "url")),
    ),
    "made_languages": Made(
        [
            Part("html", [(' lang="de-AT"',), ("", ("i18n/lang-missing-for-locale-route", W, "o_orderkey % 13 = 0")), (' lang="en"', ("i18n/lang-locale-mismatch", W, "o_orderkey % 13 = 0")), (' lang=""', ("i18n/lang-locale-mismatch", W, "o_orderkey % 13 = 0"))]),
            Part("head", [
                (f'<link rel="alternate" hreflang="en" href="{BASE}{{own}}">', ("hreflang/no-x-default", W), ("i18n/no-matching-hreflang-for-route-locale", W, "o_orderkey % 13 = 0")),
                (f'<link rel="alternate" hreflang="x-default" href="{BASE}{{own}}"><link rel="alternate" hreflang="de" href="{BASE}{{own}}?x#y">',),
                (f'<link rel="alternate" hreflang="x-default" href="{BASE}/other/">', ("hreflang/no-self-reference", W), ("i18n/canonical-not-in-hreflang-set", W, "o_orderkey % 5 = 0"), ("i18n/no-matching-hreflang-for-route-locale", W, "o_orderkey % 13 = 0")),
                (f'<link rel="alternate" hreflang="x-default" href="{BASE}{{own}}"><link rel="alternate" hreflang="de_CH" href="{BASE}/gone/{{n}}/">', ("hreflang/target-missing", W)),
                (f'<link rel="alternate" hreflang="x-default" href="{BASE}{{own}}"><link rel="alternate" hreflang="DE" href="{BASE}/p/1/">', ("hreflang/no-reciprocal", W)),
                ("",),
            ]),
            Part("head", [('<link rel="canonical" href="{own}">',), ("",), ("",), ("",), ("",)]),
        ],
        {"hreflang": {"check_hreflang": True, "require_x_default": True, "require_self_reference": True, "require_reciprocal": True, "require_target_exists": True}, "i18n_audit": {"enabled": True}},
    ),
    "made_security": Made(
        [
            Part("body", [('<a target="_BLANK" href="https://x.example">x</a>', ("security/target-blank-noopener", W)), ('<a target="_blank" rel="nofollow NoReferrer" href="/">x</a>',), ('<a href="/">x</a>',)]),
            Part("body", [('<img src="http://x.example/a.png">', ("security/mixed-content", W)), ('<iframe src="http://x.example/"></iframe><a href="http://x.example/">x</a>', ("security/mixed-content", W)), ('<img src="https://x.example/a.png">',), ('<link rel="author" href="http://x.example/">', ("security/mixed-content", W))]),
            Part("body", [("<script>a<b</script>", ("security/inline-scripts", W)), ('<script src="/a.js"></script>',), ('<script type="application/json">{}</script>',), ("<script></script><script>x</script>", ("security/inline-scripts", W)), ("",)]),
        ],
        {"security": {"check_target_blank": True, "check_mixed_content": True, "warn_inline_scripts": True}},
    ),
    "made_copies": Made(
        [Part("head", [("<title>{priority}</title>",), ('<meta name="description" content="{customer}">',), ("",)]), Part("body", [("<h1> {customer} </h1>",), ("<h1></h1>",)])],
        {"content_quality": {"detect_duplicate_titles": True, "detect_duplicate_descriptions": True, "detect_duplicate_h1": True, "detect_duplicate_pages": True}},
        more=[
            f"SELECT rule_id, file, level FROM (SELECT 'content/duplicate-{rule}' AS rule_id, {FILE} AS file, 'warning' AS level, count(*) OVER (PARTITION BY {by}) AS c FROM orders WHERE {where}) WHERE c > 1"
            for rule, by, where in (("title", "o_orderpriority", "o_orderkey % 3 = 0"), ("description", "o_custkey", "o_orderkey % 3 = 1"), ("h1", "o_custkey", "o_orderkey % 2 = 0"),
                                    ("page", "o_orderkey % 6, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 3 = 1 OR o_orderkey % 2 = 0 THEN o_custkey END", "true"))
        ],
        also=tuple(f"content/duplicate-{x}" for x in ("title", "description", "h1", "page")),
    ),
    "made_crawl": Made(
        [
            Part("body", [('<a href="/?a=1">x</a><a href="/?a=1">x</a>', ("crawl-budget/query-variants", W)), ('<a href="/p/x">x</a>', ("crawl-budget/non-canonical-link-variant", W)), ('<a href="/p/x/">x</a>',), ('<a href="https://other.example/?a=1">x</a>',), ('<a href="mailto:x@made.example?y">x</a>', ("crawl-budget/query-variants", W), ("crawl-budget/non-canonical-link-variant", W))]),
            Part("head", [('<meta http-equiv="Refresh" content="0; URL=\'/gone/{n}\'">', ("crawl-budget/redirect-target-missing", W)), ('<meta http-equiv="refresh" content="0;url={own}">',), ('<meta http-equiv="refresh" content="30">',)]),
            Part("head", [('<meta name="robots" content="noindex">', ("crawl-budget/noindex-in-sitemap", W, "o_orderkey % 4 = 0")), ("",), ("",)]),
            Part("head", [("",), (f'<link rel="canonical" href="{BASE}/c/{{customer}}/">',)]),
        ],
        {"crawl_budget": {"enabled": True}},
        lambda orders: {"sitemap": rows_of(f"SELECT '{BASE}' AS site, {FILE} AS url FROM orders WHERE o_orderkey % 4 = 0")(orders)},
        [f"SELECT 'crawl-budget/duplicate-cluster' AS rule_id, min({FILE}) AS file, 'warning' AS level FROM orders WHERE o_orderkey % 2 = 1 GROUP BY o_custkey HAVING count(*) > 1"], also=("crawl-budget/duplicate-cluster",),
    ),
    "made_loading": Made(
        [
            Part("head", [('<script src="/a.js"></script>', ("render-blocking/sync-head-scripts", W)), ('<script src="/a.js" defer></script><script src="/b.js" async></script>',), ('<script type="Module" src="/a.js"></script><script>x</script>',)]),
            Part("head", [('<link rel="stylesheet" href="/{n}.css">', ("render-blocking/missing-style-preload", I)), ('<link rel="preload" as="style" href="/a.css"><link rel="stylesheet" href="/a.css">',)]),
            Part("head", [('<link rel="preload" as="font" href="https://cdn.example/f.woff">', ("render-blocking/missing-preconnect", W)), ('<link rel="preconnect" href="https://cdn.example"><link rel="preload" as="font" href="https://cdn.example:8443/f.woff">',), ('<link rel="preload" as="font" href="/f.woff">',), ("",), ('<link rel="dns-prefetch" href="//cdn.example"><script async src="//cdn.example/a.js"></script>',)]),
        ],
        {"render_blocking": {"enabled": True}},
    ),
    "made_privacy": Made(
        [
            Part("body", [
                ("",),
                ('<script src="https://www.google-analytics.com/a.js" integrity="x"></script><p class="cookie-recipe"></p>', ("privacy-security/missing-consent-indicator", W)),
                ('<script src="https://www.google-analytics.com/a.js" integrity="x"></script><p class="Cookie-Banner"></p>',),
                ('<script src="https://www.google-analytics.com/a.js" integrity="x"></script><p data-consent></p>',),
                ('<script src="https://x.example/a.js"></script>', ("privacy-security/missing-sri-script", W)),
                ('<link rel="stylesheet" href="https://fonts.googleapis.com/css">', ("privacy-security/missing-sri-stylesheet", W), ("privacy-security/google-fonts-external", W)),
                ('<script integrity="x" src="https://cdn.jsdelivr.net/a.js"></script>', ("privacy-security/cdn-resources", W)),
                ('<img src="https://pictures.example/a.png">', ("privacy-security/external-images", W)),
                ('<iframe src="https://www.youtube.com/embed/x"></iframe>', ("privacy-security/youtube-direct-embed", W)),
                ('<iframe src="https://www.google.com/maps/embed"></iframe>', ("privacy-security/google-maps-embed", W)),
                ('<iframe src="https://www.youtube-nocookie.com/embed/x"></iframe>',),
            ]),
            Part("body", [("<script>x</script>", ("privacy-security/csp-readiness-inline-script", W)), ("",)]),
        ],
        {"privacy_security": {"enabled": True, "gdpr": True}},
        more=[when("privacy-security/third-party-domains", I, "o_orderkey % 11 <> 0")], also=("privacy-security/third-party-domains",),
    ),
    "made_live": Made(
        [
            Part("head", [('<meta name="robots" content="noindex"><meta name="robots" content="noindex">', ("golive/noindex", E_)), ("",), ("",)]),
            Part("head", [('<link rel="canonical" href="https://staging.example/">', ("golive/canonical-origin", E_), ("golive/forbidden-domain", E_)), ('<link rel="canonical" href="https://MADE.example:443/x">',), ('<link rel="canonical" href="/x">',), ('<link rel="canonical" href="https://made.example:8443/x">', ("golive/canonical-origin", E_))]),
            Part("head", [('<meta property="og:url" content="http://made.example/">', ("golive/og-origin", E_)), ('<meta property="og:image" content="https://other.example/a.png"><meta property="og:url" content="/x">', ("golive/og-origin", E_)), (f'<meta property="og:url" content="{BASE}/">',), ("",), ("",)]),
            Part("body", [('<a href="https://a.staging.example/">x</a>', ("golive/forbidden-domain", E_)), ('<a href="https://notstaging.example/">x</a>',), ('<script src="http://staging.example/a.js"></script>', ("golive/forbidden-domain", E_)), ('<a href="//staging.example/">x</a>',), ("",), ("",), ("",)]),
        ],
        {"go_live": {"enabled": True, "expected_site": BASE, "forbidden_domains": ["Staging.example"]}},
        lambda orders: {"sitemap": rows_of(f"SELECT '{BASE}' AS site, CASE WHEN o_orderkey % 3 = 0 THEN 'https://staging.example/' || o_orderkey ELSE {FILE} END AS url FROM orders")(orders)},
        [f"SELECT '{rule}' AS rule_id, 'sitemap.xml' AS file, 'error' AS level FROM orders WHERE o_orderkey % 3 = 0" for rule in ("golive/sitemap-origin", "golive/forbidden-domain")], also=("golive/sitemap-origin",),
    ),
    "made_images": Made(
        [
            Part("body", [('<img src="/a.webp">', ("images/missing-dimensions", E_), ("images/missing-srcset", I)), ('<img src="/a.webp" width="1" height="1" srcset="/b.webp 2x">',), ('<img src="/a.svg?x">',), ('<img src="/a.webp" width="1" srcset="/b.webp 2x">', ("images/missing-dimensions", E_))]),
            Part("body", [('<img src="/a.svg">', ("images/missing-lazy", W)), ('<img src="/a.svg" loading="lazy"><img src="/b.svg" loading="">', ("images/missing-lazy", W)), ("",)]),
            Part("body", [('<img loading="lazy" srcset="x" width="1" height="1" src="/a.PNG">', ("images/legacy-format", I)), ('<img loading="lazy" srcset="x" width="1" height="1" src="/a.png?x">',), ('<img loading="lazy" srcset="x" width="1" height="1" src="/a.avif">',), ("",), ('<img loading="lazy" srcset="x" width="1" height="1" src="/{n}.jpeg">', ("images/legacy-format", I))]),
        ],
        {"images": {"check_missing_dimensions": True, "warn_missing_lazy": True, "info_missing_srcset": True, "format_hints": True}},
    ),
    "made_assets": Made(
        [
            Part("body", [('<img src="/img/{n}.png" width="1" height="1">', ("assets/broken", E_, "o_orderkey % 3 <> 0")), ('<img src="../../img" width="1">', ("assets/img-dimensions", W), ("assets/broken", E_, "o_orderkey % 13 = 0")), ('<img src="https://x.example/a.png" width="1" height="1">',)]),
            Part("body", [('<img width="1" height="1" srcset="/no/{n}-1.png 1x, /no/{n}-2.png 2x">', ("assets/broken", E_), ("assets/broken", E_)), ("",), ("",), ("",), ("",)]),
            Part("head", [('<script src="/_astro/a.js"></script>', ("assets/broken", E_)), ('<script src="/js/ab.js"></script>', ("assets/unhashed-filename", W)), ('<link rel="stylesheet" href="/js/main.a1b2c3d4.css">', ("assets/broken", E_)), ('<link rel="stylesheet" href="/js/a-b.css">', ("assets/unhashed-filename", W), ("assets/broken", E_))]),
            Part("head", [(f'<meta property="og:image" content="{BASE}/img/{{n}}.png">', ("opengraph/image-broken", E_, "o_orderkey % 3 <> 0"), ("opengraph/image-too-large", W, "o_orderkey % 3 = 0 AND o_orderkey // 1024 > 5"), ("opengraph/image-invalid-dimensions", W, "o_orderkey % 3 = 0 AND o_orderkey < 1200")), ('<meta property="og:image" content="https://x.example/a.png">',)]),
            Part("body", [("<script>" + "x" * 2000 + "</script>",), ("<script>" + "x" * 1000 + "</script>",), ("",)]),
        ],
        {"assets": {"check_broken_assets": True, "check_image_dimensions": True, "require_hashed_filenames": True, "max_image_size_kb": 10, "max_js_size_kb": 1, "max_css_size_kb": 1}, "opengraph": {"check_image_exists": True, "check_image_dimensions": True, "og_image_max_size_kb": 5}, "js_bloat": {"enabled": True, "max_kb": 2}},
        lambda orders: {
            "files": rows_of(f"SELECT '{BASE}' AS site, 'img/' || o_orderkey || '.png' AS path, o_orderkey AS length FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT DISTINCT '{BASE}', 'js/ab.js', 2000L FROM orders UNION ALL SELECT '{BASE}', 'css/' || o_orderkey || '.CSS', o_orderkey FROM orders WHERE o_orderkey % 5 = 0")(orders),
            "images": rows_of(f"SELECT '{BASE}' AS site, 'img/' || o_orderkey || '.png' AS path, o_orderkey AS width, 630L AS height FROM orders WHERE o_orderkey % 3 = 0")(orders),
        },
        [
            "SELECT 'assets/large-image' AS rule_id, 'img/' || o_orderkey || '.png' AS file, 'warning' AS level FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey // 1024 > 10",
            "SELECT 'assets/large-css' AS rule_id, 'css/' || o_orderkey || '.CSS' AS file, 'warning' AS level FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey // 1024 > 1",
            when("performance/js-bloat", W, "o_orderkey % 4 = 1 AND o_orderkey % 3 = 0 OR o_orderkey % 4 = 1 AND o_orderkey % 3 = 1 AND 3000 // 1024 > 2"),
        ],
        also=("assets/large-image", "assets/large-css", "assets/large-js", "performance/js-bloat"),
    ),
    "made_visibility": Made(
        [
            Part("html", [("", ("ai-visibility/lang-missing", W)), (' lang=""',)]),
            Part("head", [("", ("ai-visibility/missing-og-title", W)), ('<meta property="og:title" content="x">',), ('<meta property="og:title" content=" ">', ("ai-visibility/missing-og-title", W))]),
            Part("head", [("", ("ai-visibility/missing-og-description", I)), ('<meta property="og:description" content="x">',)]),
            Part("head", [("", ("ai-visibility/missing-canonical", W)), ('<link rel="canonical" href="x">',), ('<link rel="canonical">', ("ai-visibility/missing-canonical", W))]),
            Part("head", [("", ("ai-visibility/missing-author-schema", I)), (_ld('{"author":1}'),), (_ld('{"author":1,"@graph":[{}]}'), ("ai-visibility/missing-author-schema", I)), (_ld('{"@graph":[{"creator":1}]}'),)]),
            Part("head", [('<meta name="robots" content="noindex">', ("ai-visibility/noindex-page", I)), ("",), ("",), ("",), ("",)]),
            Part("body", [("", ("ai-visibility/low-word-count", I)), ("w " * 400,), ("w " * 700, ("ai-visibility/no-subheadings", W)), ("w " * 700 + "<h2>x</h2>",)]),
            Part("body", [("", ("ai-visibility/no-semantic-sections", I)), ("<nav></nav>",), ("<section></section>",)]),
        ],
        {"ai_visibility": {"enabled": True}},
    ),
    "made_ux": Made(
        [
            Part("body", [("", ("ux/no-cta", W)), ("<button>Get started</button>",), ('<a href="/x">Jetzt ansehen</a>',), ('<p role="button">Order it</p>',)]),
            Part("body", [('<a href="/x">HERE</a>', ("ux/generic-link-text", W)), ('<a href="/x">there</a>',)]),
            Part("body", [("", ("ux/no-trust-signals", W)), ("<address>x</address>",), ('<a href="/legal">x</a>',)]),
            Part("body", [('<a href="/x">x</a>' * 9, ("ux/high-link-density", I)), ("",), ("",), ("",), ("",)]),
            Part("body", [("<input>" * 21, ("ux/high-interactive-density", I)), ("<input>" * 19,)]),
        ],
        {"ux_heuristics": {"enabled": True, "min_cta_per_page": 1, "max_links_per_page": 8}},
    ),
    "made_sitemap": Made(
        [Part("head", [('<link rel="canonical" href="{own}">',), (f'<link rel="canonical" href="{BASE}{{own}}">',), (f'<link rel="canonical" href="{BASE}/c/{{n}}/">',)])],
        {"sitemap": {"canonical_must_be_in_sitemap": True, "forbid_noncanonical_in_sitemap": True, "entries_must_exist_in_dist": True, "require": True}},
        lambda orders: {
            "sitemap": rows_of(f"SELECT '{BASE}' AS site, CASE WHEN o_orderkey % 10 = 0 THEN '{BASE}/lost/' || o_orderkey ELSE {FILE} END AS url FROM orders WHERE o_orderkey % 2 = 0")(orders),
            "sitemap_state": rows_of("SELECT 'https://s' || o_orderkey || '.example' AS site, CASE o_orderkey % 3 WHEN 0 THEN 'missing' WHEN 1 THEN 'malformed' ELSE 'ok' END AS state FROM orders")(orders),
        },
        [
            when("sitemap/canonical-missing", W, "o_orderkey % 3 = 0 OR o_orderkey % 3 = 2 OR o_orderkey % 3 = 1 AND (o_orderkey % 2 = 1 OR o_orderkey % 10 = 0)"),
            "SELECT 'sitemap/entry-not-in-dist' AS rule_id, 'sitemap.xml' AS file, 'warning' AS level FROM orders WHERE o_orderkey % 10 = 0",
            "SELECT 'sitemap/non-canonical-entry' AS rule_id, 'sitemap.xml' AS file, 'warning' AS level FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 10 <> 0 AND o_orderkey % 3 <> 1",
            "SELECT CASE o_orderkey % 3 WHEN 0 THEN 'sitemap/missing' ELSE 'sitemap/parse-error' END AS rule_id, 'sitemap.xml' AS file, 'error' AS level FROM orders WHERE o_orderkey % 3 < 2",
        ],
        also=("sitemap/canonical-missing", "sitemap/entry-not-in-dist", "sitemap/non-canonical-entry", "sitemap/missing", "sitemap/parse-error"),
    ),
    "made_redirects": Made(
        [
            Part("head", [('<meta http-equiv="refresh" content="0;url=/hop/{n}a/">',), ("",), (f'<meta http-equiv="refresh" content="0;url={BASE}/p/1/">',), ('<meta http-equiv="refresh" content="0;url=https://x.example/">',)]),
            Part("body", [("",), ('<a href="/p/2/">a</a><a href="/p/2/#x">b</a><a href="/p/3/">c</a>', ("links/redirect-target", W, "o_orderkey <> 2"))]),
        ],
        {"redirects": {"enabled": True}},
    ),
    "made_external": Made(
        [Part("body", [('<a href="https://x{n}.example/a#b">a</a><a href=" https://x{n}.example/a">b</a>', ("external-links/broken", E_, "o_orderkey % 5 < 2")), ('<a href="/x">a</a>',), ('<a href="https://sub.no.example/">a</a>',)])],
        {"external_links": {"enabled": True, "fail_on_broken": True, "block_domains": ["no.example"]}},
        lambda orders: {"statuses": rows_of("SELECT 'https://x' || o_orderkey || '.example/a' AS url, CASE o_orderkey % 5 WHEN 0 THEN 404 WHEN 1 THEN NULL ELSE 399 END AS status FROM orders UNION ALL SELECT DISTINCT 'https://sub.no.example/', 500 FROM orders")(orders)},
    ),
}


def redirect_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site for each six orders: pages 0 to 3 lead on to the next one, of which each seventh site's page 3 leads back to 1; 4 and 5 lead to each other."""
    n = F.col("o_orderkey")
    site = F.concat(F.lit("https://r"), F.floor(n / 6), F.lit(".example"))
    to = F.when(n % 6 < 3, n % 6 + 1).when((n % 6 == 3) & (F.floor(n / 6) % 7 == 0), F.lit(1)).when(n % 6 == 4, F.lit(5)).when(n % 6 == 5, F.lit(4))
    html = F.coalesce(F.concat(F.lit('<meta http-equiv="refresh" content="0;url=/'), to, F.lit('/">')), F.lit("<p>end</p>"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey").repartition(max(8, spark.sparkContext.defaultParallelism))
    settings = {"redirects": {"enabled": True}}
    c = config(settings, only(settings))
    pages = from_table(orders.select(F.concat(site, F.lit("/"), n % 6, F.lit("/")).alias("url"), html.alias("html")))
    return findings(Frames(parsed(pages, c)), c).select("rule_id", "file", "level")


REDIRECT_SITES = """
SELECT rule_id, 'https://r' || s || '.example/' || p || '/' AS file, level FROM (
  SELECT o_orderkey // 6 AS s, 'redirects/chain' AS rule_id, 0 AS p, 'warning' AS level FROM orders WHERE o_orderkey % 6 = 3
  UNION ALL SELECT o_orderkey // 6, 'redirects/loop', 0, 'error' FROM orders WHERE o_orderkey % 6 = 3 AND o_orderkey // 6 % 7 = 0
  UNION ALL SELECT o_orderkey // 6, 'redirects/loop', 4, 'error' FROM orders WHERE o_orderkey % 6 = 5)
"""

#: robots.txt of made sites: lines, and what must be found with a noindex page at /x/y.php and entries at /a.php.php and /b/c in the sitemap.
ROBOTS: list[tuple] = [
    ("User-agent: *|Disallow: /|Crawl-delay: 20|Sitemap: x", ("robots-txt/disallow-all", E_), ("robots-txt/crawl-delay-high", W), ("robots/blocked-noindex-contradiction", E_), ("sitemap/entry-blocked-by-robots", W), ("sitemap/entry-blocked-by-robots", W), ("golive/robots-blocked", E_)),
    ("User-agent: *|Disallow: /|Allow: /", ("robots-txt/no-sitemap", W), ("golive/robots-blocked", E_)),
    ("User-agent: *|Disallow:|User-agent: GPTBot|Disallow: /|SITEMAP: x",),
    ("User-agent: Googlebot|User-agent: bingbot|Disallow: /|Sitemap: x", ("robots-txt/disallow-search-bot", E_), ("robots-txt/disallow-search-bot", E_)),
    ("User-agent: PerplexityBot|Disallow: /||User-agent: CCBot|Allow: /|Sitemap: x", ("robots-txt/ai-citation-bot-blocked", W), ("robots-txt/ai-training-bot-allowed", I)),
    ("User-agent: *|Disallow: /*.php$|Allow: /x/|Sitemap: x", ("robots/blocked-noindex-contradiction", E_)),
    ("User-agent: *|Disallow: /*.php|Allow: /x|Sitemap: x", ("sitemap/entry-blocked-by-robots", W), ("robots/blocked-noindex-contradiction", E_)),
    ("User-agent: *|Disallow: /b*c|# a comment|Disallow: /x|Sitemap: x", ("sitemap/entry-blocked-by-robots", W)),
    ("User-agent: *|Disallow: /x/y.ph$|Disallow: /b/c$|Crawl-delay: ten|Sitemap: x", ("sitemap/entry-blocked-by-robots", W)),
    ("", ("robots-txt/missing", W)),
]


def robots_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site for each order with one of ROBOTS, a noindex page and two entries in its sitemap."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey").repartition(max(8, spark.sparkContext.defaultParallelism))
    rows = orders.select(F.concat(F.lit("https://b"), "o_orderkey", F.lit(".example")).alias("site"), F.get(F.array(*[F.lit(x[0]) for x in ROBOTS]), (F.col("o_orderkey") % len(ROBOTS)).cast("int")).alias("text"))
    robots = rows.where("text <> ''").select("site", F.posexplode(F.split("text", r"\|")).alias("line_no", "line"))
    sitemap = rows.select("site", F.explode(F.array(*[F.concat("site", F.lit(x)) for x in ("/a.php.php", "/b/c")])).alias("url"))
    settings = {"robots_txt": {"require": True, "require_sitemap_link": True, "check_disallow_all": True, "ai_bot_policy": True, "check_noindex_contradiction": True, "check_sitemap_blocked": True}, "go_live": {"enabled": True}, "url_normalization": {"trailing_slash": "ignore"}}
    c = config(settings, only(settings))
    page = from_table(rows.select(F.concat("site", F.lit("/x/y.php")).alias("url"), F.lit('<meta name="robots" content="noindex">').alias("html")), "ignore")
    found = findings(Frames(parsed(page, c), robots=robots, sitemap=sitemap), c)
    return found.where(F.col("rule_id").isin(*{one[0] for _, *more in ROBOTS for one in more})).select("rule_id", F.col("site").alias("file"), "level")


ROBOTS_SQL = " UNION ALL ".join(f"SELECT '{rule}' AS rule_id, 'https://b' || o_orderkey || '.example' AS file, '{level}' AS level FROM orders WHERE o_orderkey % {len(ROBOTS)} = {r}" for r, (_, *more) in enumerate(ROBOTS) for rule, level in more)


#: The JSON-LD types that the variants of made_jsonld declare.
TYPES = {3: "Thing", 4: "Thing", 6: "Organization", 7: "BlogPosting", 8: "NewsArticle", 9: "LocalBusiness", 10: "FAQPage", 11: "WebSite", 12: "BreadcrumbList", 13: "Person,Person", 14: "Person,Product,Thing", 15: "Organization", 16: "Person"}
TYPES_SQL = "SELECT type, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS type FROM orders WHERE o_orderkey % 17 = {r}" for r, names in TYPES.items() for t in names.split(",")) + ") GROUP BY type"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: made.found for name, made in MADE.items()} | {"made_redirect_sites": redirect_sites, "made_robots": robots_sites, "made_types": lambda s, d: type_histogram(MADE["made_jsonld"].pages(s, d)[0])}


def oracle_sql() -> dict[str, str]:
    return {name: made.sql() for name, made in MADE.items()} | {"made_redirect_sites": REDIRECT_SITES, "made_robots": ROBOTS_SQL, "made_types": TYPES_SQL}
