"""Rules that need more than one page: joins, groups and closures keyed by site, so many sites are audited at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import host, normalize_path, origin, url_path, within
from .shared import checkpointed, shuffled

COLUMNS = ["site", "file", "check_idx", "seq", "level", "rule_id", "selector", "message", "confidence"]
#: Names of robots, and the least width and height of a large preview.
CITATION_BOTS = ["oai-searchbot", "chatgpt-user", "perplexitybot", "claude-web", "claudebot", "google-extended"]
TRAINING_BOTS = ["ccbot", "common crawl", "commoncrawl"]
PREVIEW = (1200, 630)


@dataclass
class Frames:
    """What an audit reads. ``pages`` has the columns of FACTS; the others may be None.

    files (site, path, length), images (site, path, width, height), sitemap (site, url), robots (site, line_no, line),
    content (site, path, slug), statuses (url, status), sitemap_state (site, state: missing, malformed or ok).
    """

    pages: DataFrame
    files: DataFrame | None = None
    sitemap: DataFrame | None = None
    sitemap_state: DataFrame | None = None
    robots: DataFrame | None = None
    content: DataFrame | None = None
    statuses: DataFrame | None = None
    images: DataFrame | None = None
    #: What the rules keep of these while they run.
    kept: list[DataFrame] = field(default_factory=list)


def finding(df: DataFrame, idx: int, level, rule: str, message, selector="", confidence: str | None = None, seq=None, file="file") -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select("site", F.col(file).alias("file") if isinstance(file, str) else file.alias("file"), F.lit(idx).alias("check_idx"), (F.lit(0) if seq is None else seq).cast("int").alias("seq"), lit(level).alias("level"), F.lit(rule).alias("rule_id"), F.coalesce(lit(selector).cast("string"), F.lit("")).alias("selector"), lit(message).cast("string").alias("message"), F.lit(confidence).cast("string").alias("confidence"))


def joined(*parts) -> Column:
    """Texts and columns one after another."""
    return F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])


def anchors(pages: DataFrame) -> DataFrame:
    """One row per a[href]: site, file, route, seq, href, whether it is internal, and the raw and the normalized route that it leads to."""
    return pages.select("site", "file", "route", F.explode("anchors").alias("e")).select("site", "file", "route", "e.*")


def routes(pages: DataFrame) -> DataFrame:
    """One page per (site, route): of pages with the same route the last by file."""
    return pages.groupBy("site", "route").agg(F.max_by(F.struct("file", "element_ids", "canonical", "noindex"), "file").alias("page"))


def redirects(pages: DataFrame) -> DataFrame:
    rows = pages.where("refresh_internal AND refresh_route <> route").select("site", "route", "file", F.col("refresh_route").alias("next"))
    return rows.groupBy("site", "route").agg(F.max_by("next", "file").alias("next"), F.max("file").alias("file"))


def walks(edges: DataFrame) -> DataFrame:
    """Redirect paths from every route: site, route, file, path (routes in order), loop (the path came back to itself).

    Each round doubles the paths: one that ends at a route goes on with that route's own path so far. A path is done
    where no redirect leads on or at the first route met again, so there are as many rounds as the longest path's
    length has binary digits.
    """
    again = F.filter(F.sequence(F.lit(2), F.size("path")), lambda i: F.array_position("path", F.element_at("path", i)) < i)
    cut = F.get(again, F.lit(0))

    def trimmed(rows: DataFrame, done: Column) -> DataFrame:
        twice = F.size(F.array_distinct("path")) < F.size("path")
        rows = rows.withColumn("done", done).withColumn("cut", F.when(twice, cut))
        return rows.select("site", "route", "file", F.when(twice, F.slice("path", 1, F.coalesce("cut", F.lit(1)))).otherwise(F.col("path")).alias("path"), (F.col("done") | twice).alias("done"), twice.alias("loop"))

    now = trimmed(edges.select("site", "route", "file", F.array("route", "next").alias("path")), F.lit(False))
    now = checkpointed(now)
    while not now.where("NOT done").isEmpty():
        more = now.select("site", F.col("route").alias("at"), F.col("path").alias("more"), F.col("loop").alias("round"))
        open_ = now.where("NOT done").withColumn("at", F.element_at("path", -1)).join(more, ["site", "at"], "left")
        open_ = open_.withColumn("path", F.when(F.col("more").isNull(), F.col("path")).otherwise(F.concat("path", F.slice("more", 2, F.greatest(F.size("more") - 1, F.lit(0))))))
        now = checkpointed(now.where("done").unionByName(trimmed(open_, F.col("more").isNull())))
    return now.select("site", "route", "file", "path", "loop")


def robots_rules(robots: DataFrame) -> DataFrame:
    """Blocks of robots.txt lines as rows (site, block, agent, allow, pattern); agents without rules keep a null pattern.

    A blank or comment line closes a block; a user-agent line opens one if the block before has a disallow line, be it
    an empty one. What an empty line allows or disallows is nothing, so it has an empty pattern.
    """

    def parse(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rows: list[tuple] = []
        site, agents, rules, n = None, [], [], -1

        def close():
            nonlocal agents, rules, n
            if agents:
                n += 1
                rows.extend((site, n, a.lower(), allow, p) for a in agents for allow, p in (rules or [(None, None)]))
            agents, rules = [], []

        def taken():
            nonlocal rows
            cols, rows = list(zip(*rows, strict=True)) or [[]] * 5, []
            kinds = [pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=["site", "block", "agent", "allow", "pattern"])

        for batch in batches:
            for own, line in zip(batch.column("site").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if own != site:
                    close()
                    site, n = own, -1
                line = (line or "").strip()
                if not line or line.startswith("#"):
                    close()
                    continue
                name, _, value = line.partition(":")
                name, value = name.strip().lower(), value.strip()
                if name == "user-agent":
                    if any(not allow for allow, _ in rules):
                        close()
                    agents.append(value)
                elif name in ("disallow", "allow"):
                    rules.append((name == "allow", value))
            if len(rows) >= 10_000:
                yield taken()
        close()
        yield taken()

    # a partition has whole sites one after another: a call for each site costs far more than its lines
    lines = robots.select("site", "line_no", "line").repartition("site").sortWithinPartitions("site", "line_no")
    return lines.select("site", "line").mapInArrow(parse, "site string, block int, agent string, allow boolean, pattern string")


def rule_weight(pattern: Column, path: Column) -> Column:
    """How specific a robots pattern is that matches a path: its characters other than stars; null if it doesn't match.

    Parts between stars are looked for from left to right, each as early as can be; a dollar at the end wants the path
    to end there.
    """
    anchored = pattern.endswith("$")
    plain = F.when(anchored, F.left(pattern, F.length(pattern) - 1)).otherwise(pattern)
    parts = F.transform(F.split(plain, r"\*", -1), lambda x, i: F.struct(x.alias("part"), i.alias("i")))

    def step(at: Column, x: Column) -> Column:
        here = F.position(x["part"], path, F.greatest(at, F.lit(0)) + 1)
        found = F.when(x["i"] == 0, F.when(path.startswith(x["part"]), F.lit(1)).otherwise(F.lit(0))).otherwise(here)
        return F.when((at < 0) | (x["part"] == ""), at).when(found > 0, found - 1 + F.length(x["part"])).otherwise(F.lit(-1))

    end = F.aggregate(parts, F.lit(0), step)
    whole = ~anchored | plain.endswith("*") | (end == F.length(path))
    return F.when((pattern != "") & (end >= 0) & whole, F.length(F.replace(plain, F.lit("*"), F.lit(""))))


def blocked(rows: DataFrame, path: str, rules: DataFrame) -> DataFrame:
    """Rows whose path the wildcard agent may not fetch: the longest matching pattern decides, allow wins ties."""
    own = rules.where("agent = '*' AND pattern <> ''").select("site", F.struct("allow", "pattern").alias("rule"))
    per_site = own.groupBy("site").agg(F.collect_set("rule").alias("rules"))  # the lines of one file
    weighed = F.transform("rules", lambda r: F.struct(rule_weight(r["pattern"], F.col(path)).alias("weight"), r["allow"].alias("allow")))
    best = F.array_max(F.filter(weighed, lambda x: x["weight"].isNotNull()))
    return rows.join(per_site, "site").where(best.isNotNull() & ~best["allow"]).drop("rules")


def site_findings(f: Frames, c: dict) -> list[DataFrame]:
    """Findings of all rules that need joins and that the settings turn on."""
    norm = lambda x: normalize_path(x, **c["url_normalization"])
    pages, out = f.pages, []
    index = routes(pages)
    known = index.select("site", F.col("route").alias("target"))
    links = anchors(pages)
    there = None
    if f.files is not None:  # every file, and every folder that holds one
        folders = F.transform(F.sequence(F.lit(0), F.size(F.split("path", "/")) - 1), lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/"))
        there = f.files.select("site", F.explode(F.array_distinct(F.concat(folders, F.array("path")))).alias("path")).distinct()

    k = c["canonical"]
    canon_at = lambda x: joined("link[rel='canonical'][href='", F.col(x), "']")
    if k["require"]:
        lost = pages.where("canonical_route IS NOT NULL").select("site", "file", F.col("canonical_route").alias("target"), F.get("canonical_hrefs", F.lit(0)).alias("href")).join(known, ["site", "target"], "left_anti")
        out.append(finding(lost, 0, "warning", "canonical/target-missing", joined("No page at the canonical ", F.col("href")), canon_at("href")))
    if k["detect_clusters"] or c["crawl_budget"]["enabled"]:
        canon = pages.where("canonical IS NOT NULL").select("site", "file", "canonical")
        sizes = canon.groupBy("site", "canonical").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("first")).where("n > 1")
        if k["detect_clusters"]:
            out.append(finding(canon.join(sizes, ["site", "canonical"]), 0, "warning", "canonical/cluster", joined(F.col("n"), " pages share the canonical ", F.col("canonical")), canon_at("canonical")))
        if c["crawl_budget"]["enabled"]:
            out.append(finding(sizes, 14, "warning", "crawl-budget/duplicate-cluster", joined(F.col("n"), " pages share the canonical ", F.col("canonical")), "link[rel='canonical']", "low", file="first"))

    k = c["links"]
    link_at = joined("a[href='", F.col("href"), "']")
    if k["check_internal"]:
        followed = links.where(F.col("internal") & F.col("target").isNotNull() & ~F.lower("href").rlike("^(mailto:|tel:|javascript:)") & ~F.col("href").startswith("#"))
        broken = followed.join(known, ["site", "target"], "left_anti")
        if there is not None:
            broken = broken.withColumn("path", F.regexp_replace("raw", "^/+", "")).join(there, ["site", "path"], "left_anti")
        out.append(finding(broken, 1, "error" if k["fail_on_broken"] else "warning", "links/broken", joined("No page at ", F.col("href")), link_at, seq=F.col("seq")))
        if k["check_fragments"]:
            marked = followed.withColumn("mark", F.regexp_extract("href", "#(.*)$", 1)).where("mark <> ''").join(index.select("site", F.col("route").alias("target"), "page.element_ids"), ["site", "target"])
            plain = F.coalesce(F.try_url_decode(F.replace("mark", F.lit("+"), F.lit("%2B"))), F.col("mark"))
            lost = marked.where(~F.array_contains("element_ids", F.col("mark")) & ~F.array_contains("element_ids", plain))
            out.append(finding(lost, 1, "warning", "links/broken-fragment", joined("No element has the id of ", F.col("href")), link_at, seq=F.col("seq")))
    if k["detect_orphan_pages"]:
        linked = links.where(F.col("internal") & F.col("target").isNotNull() & ~F.lower("href").rlike("^(#|mailto:|tel:)")).select("site", F.col("target").alias("route")).distinct()
        out.append(finding(pages.where("route <> '/'").join(linked, ["site", "route"], "left_anti"), 1, "warning", "links/orphan-page", joined("No page links to ", F.col("route"))))

    k = c["sitemap"]
    loc = joined("<loc>", F.col("url"), "</loc>")
    if f.sitemap_state is not None:
        if k["require"]:
            out.append(finding(f.sitemap_state.where("state = 'missing'").withColumn("file", F.lit("sitemap.xml")), 5, "error", "sitemap/missing", "There is no sitemap.xml"))
        out.append(finding(f.sitemap_state.where("state = 'malformed'").withColumn("file", F.lit("sitemap.xml")), 5, "error" if k["require"] else "warning", "sitemap/parse-error", "sitemap.xml is malformed"))
    if f.sitemap is not None:
        full = lambda u: F.coalesce(F.concat(origin(u), norm(url_path(u)), F.regexp_extract(u, "([?#].*)$", 1)), u)
        entries = f.sitemap.select("site", "url", full(F.col("url")).alias("key"), norm(url_path(F.col("url"))).alias("target")).distinct().withColumn("file", F.lit("sitemap.xml"))
        if k["canonical_must_be_in_sitemap"]:
            wanted = pages.where("NOT noindex AND canonical IS NOT NULL").join(entries.select("site").distinct(), "site", "left_semi").withColumn("key", full(F.col("canonical")))
            out.append(finding(wanted.join(shuffled(entries), ["site", "key"], "left_anti"), 5, "warning", "sitemap/canonical-missing", joined("Not in the sitemap: ", F.col("canonical")), canon_at("canonical")))
        if k["entries_must_exist_in_dist"]:
            out.append(finding(entries.join(shuffled(known), ["site", "target"], "left_anti"), 5, "warning", "sitemap/entry-not-in-dist", joined("No page at ", F.col("url")), loc))
        if k["forbid_noncanonical_in_sitemap"]:
            at = entries.join(shuffled(index.select("site", F.col("route").alias("target"), F.col("page.canonical").alias("canonical"))), ["site", "target"])
            out.append(finding(at.where(full(F.col("canonical")) != F.col("key")), 5, "warning", "sitemap/non-canonical-entry", joined("Sitemap entry isn't canonical: ", F.col("url")), loc))
        if c["crawl_budget"]["enabled"]:
            hidden = pages.where("noindex").join(f.sitemap.select("site", F.col("url").alias("absolute_url")).distinct(), ["site", "absolute_url"], "left_semi")
            out.append(finding(hidden, 14, "warning", "crawl-budget/noindex-in-sitemap", "A noindex page is in the sitemap", "meta[name='robots']", "medium"))

    g = c["go_live"]
    expected = g["expected_site"] or c["site"]["base_url"]
    want = origin(F.lit(expected)) if expected else origin(F.col("site"))
    if g["enabled"]:
        nowhere = pages.select("site").distinct().where(want.isNull()).withColumn("file", F.lit("astro.config.mjs"))
        out.append(finding(nowhere, 18, "error", "golive/config-missing-site", "No site is configured that the pages could go live on", "goLive"))
        if f.sitemap is not None:
            out.append(finding(entries.where(origin(F.col("url")) != want), 18, "error", "golive/sitemap-origin", joined("Sitemap entry has another origin: ", F.col("url")), "<loc>"))
            if g["forbidden_domains"]:
                out.append(finding(entries.where(want.isNotNull() & within(host(F.col("url")), [d.lower() for d in g["forbidden_domains"]])), 18, "error", "golive/forbidden-domain", joined("Forbidden domain: ", F.col("url")), "<loc>"))

    k = c["robots_txt"]
    if f.robots is not None:
        lines = f.robots.withColumn("l", F.lower(F.trim("line"))).withColumn("file", F.lit("robots.txt"))
        rules = robots_rules(f.robots).persist(StorageLevel.MEMORY_AND_DISK)  # many rules read them
        f.kept.append(rules)
        parsed = rules.withColumn("file", F.lit("robots.txt"))
        slash = lambda allow: F.coalesce(F.bool_or((F.col("allow") == allow) & (F.col("pattern") == "/")), F.lit(False))
        all_off = parsed.groupBy("site", "file", "block", "agent").agg(slash(False).alias("off"), slash(True).alias("on"))
        shut = all_off.where("off AND NOT `on`")
        sites = pages.select("site").distinct().withColumn("file", F.lit("robots.txt"))
        if k["require"]:
            out.append(finding(sites.join(lines, "site", "left_anti"), 6, "warning", "robots-txt/missing", "There is no robots.txt"))
        if k["require_sitemap_link"]:
            named = lines.groupBy("site", "file").agg(F.bool_or(F.col("l").startswith("sitemap:")).alias("has")).where("NOT has")
            out.append(finding(named, 6, "warning", "robots-txt/no-sitemap", "robots.txt names no sitemap"))
        if k["check_disallow_all"]:
            out.append(finding(shut.where("agent = '*'").select("site", "file").distinct(), 6, "error", "robots-txt/disallow-all", "robots.txt blocks the whole site"))
            out.append(finding(shut.where(F.col("agent").isin("googlebot", "bingbot")), 6, "error", "robots-txt/disallow-search-bot", joined("robots.txt blocks ", F.col("agent"))))
        if k["max_crawl_delay"]:
            slow = lines.where(F.col("l").startswith("crawl-delay:")).withColumn("d", F.trim(F.split("l", ":")[1]).try_cast("double")).where(F.col("d") > k["max_crawl_delay"])
            out.append(finding(slow, 6, "warning", "robots-txt/crawl-delay-high", joined("Crawl delay is ", F.col("d"))))
        if k["ai_bot_policy"]:
            out.append(finding(shut.where(F.col("agent").isin(*CITATION_BOTS)), 6, "warning", "robots-txt/ai-citation-bot-blocked", joined("Blocks the citing bot ", F.col("agent"))))
            out.append(finding(all_off.where(F.col("agent").isin(*TRAINING_BOTS) & ~F.col("off")), 6, "info", "robots-txt/ai-training-bot-allowed", joined("Allows the training bot ", F.col("agent"))))
        if k["check_noindex_contradiction"]:
            out.append(finding(blocked(pages.where("noindex"), "route", parsed), 6, "error", "robots/blocked-noindex-contradiction", "A noindex page can't be fetched, so its noindex isn't seen", "meta[name='robots']"))
        if k["check_sitemap_blocked"] and f.sitemap is not None:
            listed = f.sitemap.select("site", "url", url_path(F.col("url")).alias("path")).distinct().withColumn("file", F.lit("sitemap.xml"))
            out.append(finding(blocked(listed, "path", parsed), 6, "warning", "sitemap/entry-blocked-by-robots", joined("Blocked by robots.txt: ", F.col("url"))))
        if g["enabled"]:
            agent = F.last(F.when(F.col("l").startswith("user-agent:"), F.trim(F.substring("l", 12, 200))), True).over(Window.partitionBy("site").orderBy("line_no"))
            shut_out = lines.withColumn("agent", agent).where((F.col("agent") == "*") & F.col("l").rlike(r"^disallow:\s*/\s*$") & want.isNotNull()).select("site", "file").distinct()
            out.append(finding(shut_out, 18, "error", "golive/robots-blocked", "robots.txt blocks the whole site", "Disallow: /"))

    k = c["assets"]
    if f.files is not None:
        named = f.files.withColumn("kb", F.floor(F.col("length") / 1024)).withColumn("file", F.col("path"))
        for flag, endings, rule in (("max_image_size_kb", "jpg|jpeg|png|gif|webp|avif|svg", "large-image"), ("max_js_size_kb", "js|mjs", "large-js"), ("max_css_size_kb", "css", "large-css")):
            if k[flag] is not None:
                out.append(finding(named.where(F.lower("path").rlike(rf"\.({endings})$") & (F.col("kb") > k[flag])), 7, "warning", f"assets/{rule}", joined(F.col("kb"), " KB")))
        if k["check_broken_assets"]:
            used = pages.select("site", "file", F.explode("assets").alias("x")).select("site", "file", "x.*")
            out.append(finding(used.join(there, ["site", "path"], "left_anti"), 7, "error", "assets/broken", joined("Missing asset: ", F.col("url")), joined(F.col("at"), "='", F.col("url"), "'"), seq=F.col("i")))
    if c["js_bloat"]["enabled"]:
        sized = pages.select("site", "file", F.explode("own_scripts").alias("path"))
        sized = sized.join(f.files, ["site", "path"]).groupBy("site", "file").agg(F.sum("length").alias("bytes")) if f.files is not None else sized.select("site", "file", F.lit(0).alias("bytes")).distinct()
        heavy = pages.select("site", "file", "inline_bytes", "islands").join(sized, ["site", "file"], "left").withColumn("kb", F.floor((F.col("inline_bytes") + F.coalesce("bytes", F.lit(0))) / 1024)).where(F.col("kb") > c["js_bloat"]["max_kb"])
        out.append(finding(heavy, 24, "warning", "performance/js-bloat", joined(F.col("kb"), " KB of scripts", F.when(F.col("islands") > 0, joined(" in ", F.col("islands"), " islands")).otherwise("")), "script", "medium"))
    k = c["opengraph"]
    if f.files is not None and (k["check_image_exists"] or k["check_image_dimensions"] or k["og_image_max_size_kb"] is not None):
        shown = pages.where("og_path IS NOT NULL").select("site", "file", F.col("og_image").alias("url"), F.col("og_path").alias("path"))
        image_at = "meta[property='og:image']"
        if k["check_image_exists"]:
            out.append(finding(shown.join(there, ["site", "path"], "left_anti"), 8, "error", "opengraph/image-broken", joined("Missing og:image: ", F.col("url")), image_at))
        if k["check_image_dimensions"] and f.images is not None:
            small = shown.join(f.images, ["site", "path"]).where((F.col("width") < PREVIEW[0]) | (F.col("height") < PREVIEW[1]))
            out.append(finding(small, 8, "warning", "opengraph/image-invalid-dimensions", joined("og:image is ", F.col("width"), " by ", F.col("height"), ", less than ", f"{PREVIEW[0]} by {PREVIEW[1]}"), image_at))
        if k["og_image_max_size_kb"] is not None:
            out.append(finding(shown.join(f.files, ["site", "path"]).where(F.floor(F.col("length") / 1024) > k["og_image_max_size_kb"]), 8, "warning", "opengraph/image-too-large", joined("og:image is too large: ", F.col("url")), image_at))

    k = c["hreflang"]
    if k["check_hreflang"] and (k["require_target_exists"] or k["require_reciprocal"]):
        every = pages.select("site", "file", "own_like", F.posexplode("hreflangs").alias("seq", "x")).select("site", "file", "own_like", "seq", "x.*")
        marks = every.where("lang <> 'x-default'")
        mark_at = joined("link[hreflang='", F.col("lang"), "'][href='", F.col("href"), "']")
        if k["require_target_exists"]:
            lost = marks.where("internal AND target IS NOT NULL").join(known, ["site", "target"], "left_anti")
            out.append(finding(lost, 10, "warning", "hreflang/target-missing", joined("No page at ", F.col("href")), mark_at, seq=F.col("seq")))
        if k["require_reciprocal"]:
            with_own = pages.where(F.size("hreflangs") > 0).select("site", F.col("own_like").alias("like")).distinct()
            back = every.select("site", F.col("own_like").alias("like"), F.col("like").alias("own_like")).distinct()
            alone = marks.join(with_own, ["site", "like"], "left_semi").join(back, ["site", "like", "own_like"], "left_anti")
            out.append(finding(alone, 10, "warning", "hreflang/no-reciprocal", joined("No entry leads back from ", F.col("href")), mark_at, seq=F.col("seq")))

    k = c["content_quality"]
    for flag, column, rule, at in (("detect_duplicate_titles", "title_text", "title", "title"), ("detect_duplicate_descriptions", "meta_description", "description", "meta[name='description']"), ("detect_duplicate_h1", "first_h1", "h1", "h1"), ("detect_duplicate_pages", "page_hash", "page", "")):
        if k[flag]:
            rows = pages.select("site", "file", F.col(column).alias("value")).where("value <> ''")
            sizes = rows.groupBy("site", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            shown = F.when(F.length("value") > 50, F.concat(F.left("value", F.lit(50)), F.lit("..."))).otherwise(F.col("value"))
            out.append(finding(rows.join(sizes, ["site", "value"]), 12, "warning", f"content/duplicate-{rule}", joined(F.col("n"), f" pages have the same {rule}", "" if rule == "page" else joined(": ", shown)), at))
    if c["content_sync"]["enabled"] and f.content is not None:
        parts = pages.select("site", F.explode(F.filter(F.split(F.lower("route"), "/"), lambda s: s != "")).alias("part")).distinct()
        wanted = f.content.select("site", "path", F.explode(F.filter(F.split(F.lower("slug"), "/"), lambda s: s != "")).alias("part"))
        missing = wanted.join(parts, ["site", "part"], "left_anti").select("site", "path").distinct()
        out.append(finding(missing, 25, "warning", "content/missing-page", "Content item has no page", "", "low", file="path"))

    if c["crawl_budget"]["enabled"]:
        refresh = pages.where("refresh_route IS NOT NULL").withColumn("target", F.col("refresh_route"))
        out.append(finding(refresh.join(known, ["site", "target"], "left_anti"), 14, "warning", "crawl-budget/redirect-target-missing", joined("Redirect leads nowhere: ", F.col("refresh_target")), "meta[http-equiv='refresh']", "medium"))
        demand = links.where("internal AND target IS NOT NULL").groupBy("site", F.col("target").alias("route")).agg(F.count(F.lit(1)).alias("n"))
        out.append(finding(pages.where("noindex").join(demand, ["site", "route"]), 14, "info", "crawl-budget/noindex-with-internal-demand", joined(F.col("n"), " links lead to a noindex page"), "meta[name='robots']", "medium"))

    if c["structured_data_graph"]["enabled"]:
        entities = pages.select("site", "file", F.explode("entities").alias("x")).select("site", "file", "x.*")
        at = "script[type='application/ld+json']"
        by_id = entities.groupBy("site", "id").agg(F.count(F.lit(1)).alias("refs"), F.min("file").alias("first"), *[F.count_distinct(x).alias(x) for x in ("type", "name", "url")])
        for x in ("type", "name", "url"):
            out.append(finding(by_id.where((F.col("refs") > 1) & (F.col(x) > 1)), 17, "warning", f"structured-data-graph/{x}-conflict", joined(f"Entity has several {x}s: ", F.col("id")), at, "medium", file="first"))
        inner = entities.where("route IS NOT NULL").withColumn("target", F.col("route"))
        out.append(finding(inner.join(known, ["site", "target"], "left_anti"), 17, "warning", "structured-data-graph/internal-url-missing", joined("No page at the entity's address ", F.col("url")), at, "medium"))

    if c["redirects"]["enabled"]:
        edges = checkpointed(redirects(pages))
        paths, at = walks(edges), "meta[http-equiv='refresh']"
        ends = paths.select("site", F.col("route").alias("target"), F.when(F.col("loop"), F.element_at("path", -2)).otherwise(F.element_at("path", -1)).alias("end"))
        hits = links.where(F.col("internal") & (F.col("target") != F.col("route"))).groupBy("site", "file", "target").agg(F.min(F.struct("seq", "href")).alias("x")).select("site", "file", "target", "x.*").join(ends, ["site", "target"])
        out.append(finding(hits, 23, "warning", "links/redirect-target", joined("Link leads to a redirect to ", F.col("end")), joined("a[href='", F.col("href"), "']"), "medium", F.col("seq")))
        cycle = F.array_sort(F.array_distinct(F.slice("path", F.array_position("path", F.element_at("path", -1)).cast("int"), F.size("path"))))
        loops = paths.where("loop").withColumn("cycle", cycle).groupBy("site", "cycle").agg(F.min("file").alias("file"))
        out.append(finding(loops, 23, "error", "redirects/loop", joined("Redirect loop: ", F.array_join("cycle", " -> ")), at))
        hops = F.size("path") - F.when(F.col("loop"), 1).otherwise(0)  # a loop's path names one route twice
        heads = paths.join(edges.select("site", F.col("next").alias("route")).distinct(), ["site", "route"], "left_anti").where(hops > 2)
        out.append(finding(heads, 23, "warning", "redirects/chain", joined(hops - 1, " redirects: ", F.array_join("path", " -> ")), at, "medium"))

    k = c["external_links"]
    if k["enabled"] and f.statuses is not None:
        dead = external_urls(f.pages, c).join(f.statuses, "url").where("status IS NULL OR status >= 400")
        out.append(finding(dead, 19, "error" if k["fail_on_broken"] else "warning", "external-links/broken", joined("External link is broken: ", F.col("url")), joined("a[href='", F.col("url"), "']")))
    return out


def external_urls(pages: DataFrame, c: dict) -> DataFrame:
    """Rows site, file, url: each external address that a page links to, without its fragment, as the settings' domains allow."""
    k = c["external_links"]
    away = anchors(pages).select("site", "file", "internal", F.trim("href").alias("href")).where(~F.col("internal") & F.col("href").rlike("^https?://"))
    away = away.select("site", "file", F.substring_index("href", "#", 1).alias("url")).distinct()
    if k["allow_domains"]:
        away = away.where(within(host(F.col("url")), k["allow_domains"]))
    if k["block_domains"]:
        away = away.where(~within(host(F.col("url")), k["block_domains"]))
    return away
