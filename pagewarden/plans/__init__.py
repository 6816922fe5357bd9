"""The audit as one plan: parse, rules, post-processing, summary and overview. Reports are in plans.reports."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..operators.help import HELP, SUGGESTION
from ..operators.page_rules import FACTS, facts
from ..operators.site_rules import COLUMNS, Frames, external_urls, site_findings
from .config import config

ORDER = ["check_idx", "site", "file", "seq", "rule_id", "selector", "message"]


def parsed(pages: DataFrame, settings: dict | None = None) -> DataFrame:
    """with_facts(), parsed once for all rules: the facts are kept in memory and on disk, since many joins read them.

    What a lost executor held is parsed again.
    """
    return with_facts(pages, settings).persist(StorageLevel.MEMORY_AND_DISK)


def with_facts(pages: DataFrame, settings: dict | None = None) -> DataFrame:
    """Pages (site, file, route, absolute_url, html) as facts and findings of their own (FACTS), in place of the html.

    A page that can't be worked out is a page without facts, and one finding html/syntax-error tells why.
    """
    c = settings or config()
    keys = ["site", "file", "route", "absolute_url"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                rows = [safely(*x, c) for x in zip(*(part.column(k).to_pylist() for k in [*keys, "html"]), strict=True)]
                columns = {k: part.column(k) for k in keys} | {k: pa.array([r[k] for r in rows], _ARROW[k]()) for k in FACTS}
                yield pa.RecordBatch.from_pydict(columns)

    schema = ", ".join([*(f"{k} string" for k in keys), *(f"{k} {v}" for k, v in FACTS.items())])
    return pages.select(*keys, "html").mapInArrow(run, schema)


def safely(site: str | None, file: str, route: str, absolute_url: str | None, html: str | None, c: dict) -> dict:
    try:
        return facts(site, file, route, absolute_url, html, c)
    except Exception as error:  # noqa: BLE001  whatever a page holds, the others must be audited
        empty = facts(site, file, route, absolute_url, None, c | {"canonical": c["canonical"] | {"require": False}})
        return empty | {"found": [{"check_idx": 26, "seq": 0, "level": "warning", "rule_id": "html/syntax-error", "selector": "", "message": f"Page can't be read: {error!r}"[:300], "confidence": "medium"}]}


def _arrow() -> dict[str, Callable]:
    """The Arrow types of FACTS."""
    import pyarrow as pa

    plain = {"string": pa.string, "boolean": pa.bool_, "int": pa.int32, "long": pa.int64}

    def kind(text: str):
        if text.startswith("array<"):
            return pa.list_(kind(text[6:-1]))
        if text.startswith("struct<"):
            return pa.struct([(name, kind(inner)) for name, inner in (x.split(":") for x in text[7:-1].split(","))])
        return plain[text]()

    return {k: (lambda v=v: kind(v)) for k, v in FACTS.items()}


_ARROW = _arrow()


def every_finding(frames: Frames, c: dict) -> DataFrame:
    """Findings of all rules as the rules give them."""
    own = frames.pages.select("site", "file", F.explode("found").alias("x")).select("site", "file", "x.*").select(*COLUMNS)
    return reduce(DataFrame.unionByName, [own, *site_findings(frames, c)])


def findings(frames: Frames, settings: dict | None = None, baseline: DataFrame | None = None) -> DataFrame:
    """All findings after post-processing: COLUMNS. ``settings`` must be those that the pages were parsed with."""
    c = settings or config()
    return post_process(every_finding(frames, c), c, baseline)


def with_severity(found: DataFrame, c: dict) -> DataFrame:
    """Levels as the settings override them; what is off goes."""
    if not c["severity"]:
        return found
    level = F.coalesce(F.try_element_at(F.from_json(F.lit(json.dumps(c["severity"])), "map<string,string>"), F.col("rule_id")), F.col("level"))
    return found.withColumn("level", level).where("level <> 'off'")


def early_stop(found: DataFrame, c: dict) -> DataFrame:
    """Findings up to the family in which the errors reach their limit."""
    if not c["max_errors"]:
        return found
    per_family = [(int(r[0]), int(r[1])) for r in found.where("level = 'error'").groupBy("check_idx").count().collect()]  # 27 rows at most
    total = 0
    for idx, n in sorted(per_family):
        total += n
        if total >= c["max_errors"]:
            return found.where(F.col("check_idx") <= idx)
    return found


def capped(found: DataFrame, c: dict) -> DataFrame:
    """All findings that aren't errors, and the first errors up to their limit."""
    if not c["max_errors"]:
        return found
    errors = found.where("level = 'error'").orderBy(*ORDER).limit(c["max_errors"])
    return found.where("level <> 'error'").unionByName(errors)


def post_process(found: DataFrame, c: dict, baseline: DataFrame | None = None) -> DataFrame:
    """Severity overrides, the early stop between families, the baseline, and the cap on errors, in that order."""
    found = early_stop(with_severity(found, c), c)
    return capped(without_baseline(found, baseline) if baseline is not None else found, c)


def without_baseline(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """Leaves out what a baseline (rule_id, file, selector) lists; an empty selector in it stands for every one."""
    known = baseline.select("rule_id", "file", F.coalesce("selector", F.lit("")).alias("selector")).distinct()
    exact = found.join(known, ["rule_id", "file", "selector"], "left_anti")
    return exact.join(known.where("selector = ''").select("rule_id", "file"), ["rule_id", "file"], "left_anti").select(*found.columns)


def read_baseline(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows rule_id, file, selector of a baseline file; none if there is no such file."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    whole = spark.read.schema("version int, findings array<struct<rule_id:string,file:string,selector:string>>").json(path, multiLine=True)
    return whole.select(F.explode("findings").alias("x")).select("x.*")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a file wherever Spark can."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_baseline(found: DataFrame, path: str) -> int:
    """Writes the findings as a baseline file; how many there are."""
    rows = [{"rule_id": r.rule_id, "file": r.file, "selector": r.selector} for r in found.orderBy(*ORDER).select("rule_id", "file", "selector").toLocalIterator()]
    write_text(found.sparkSession, path, json.dumps({"version": 1, "findings": rows}, indent=2, ensure_ascii=False))
    return len(rows)


def with_texts(found: DataFrame) -> DataFrame:
    """Adds what to do about each finding: help and suggestion."""
    by_rule = lambda texts: F.try_element_at(F.from_json(F.lit(json.dumps(texts)), "map<string,string>"), F.col("rule_id"))
    aria = F.when(F.col("rule_id") == "a11y/aria-required-attr", F.regexp_replace(F.regexp_extract("message", "(aria-checked|aria-expanded)$", 1), "(.+)", '$1="false"'))
    return found.withColumns({"help": by_rule(HELP), "suggestion": F.coalesce(F.nullif(aria, F.lit("")), by_rule(SUGGESTION))})


#: Where the source of a built page may lie, the likeliest first (fixed values).
SOURCES = ["src/pages/{}.astro", "src/pages/{}.md", "src/pages/{}.mdx", "src/pages/{}/index.astro", "src/pages/{}/index.md", "src/pages/{}/index.mdx", "src/content/{}.md", "src/content/{}.mdx"]


def with_source_hints(found: DataFrame, project: DataFrame) -> DataFrame:
    """Adds source_hint: the first of SOURCES that the project (a table with a column path) has for the finding's file."""
    slug = F.btrim(F.regexp_replace(F.regexp_replace("file", r"(/index\.html)+$", ""), r"(\.html)+$", ""), F.lit("/"))
    tried = F.array(*[F.replace(F.lit(x), F.lit("{}"), F.col("slug")) for x in SOURCES])
    wanted = found.select("file").distinct().withColumn("slug", slug).select("file", F.posexplode(tried).alias("n", "path"))
    first = wanted.join(project.select("path").distinct(), "path").groupBy("file").agg(F.min_by("path", "n").alias("source_hint"))
    return found.join(first, "file", "left")


def summary(found: DataFrame, pages: DataFrame, truncated: bool | Column = False) -> DataFrame:
    counts = [F.count_if(F.col("level") == x).alias(f"{x}s" if x != "info" else x) for x in ("error", "warning", "info")]
    flag = truncated if isinstance(truncated, Column) else F.lit(truncated)
    return found.agg(*counts, F.count(F.lit(1)).alias("total")).crossJoin(F.broadcast(pages.agg(F.count(F.lit(1)).alias("files_checked")))).withColumn("truncated", flag)  # a row on either side


def overview(pages: DataFrame) -> DataFrame:
    """Seventeen properties of each page, by file."""
    filled = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return pages.select(
        "site", "file", "route", F.nullif("title_text", F.lit("")).alias("title"), F.nullif("meta_description", F.lit("")).alias("meta_description"), F.col("canonical").isNotNull().alias("has_canonical"), F.col("canonical").alias("canonical_url"),
        filled("og_title").isNotNull().alias("has_og_title"), filled("og_description").isNotNull().alias("has_og_description"), filled("og_image").isNotNull().alias("has_og_image"),
        "h1_count", F.nullif("first_h1", F.lit("")).alias("h1_text"), F.col("html_lang").isNotNull().alias("has_lang_attr"), F.nullif("html_lang", F.lit("")).alias("lang_value"), "has_json_ld", F.col("types").alias("json_ld_types"), "has_skip_link", "noindex",
    ).orderBy("file", "site")


def overview_stats(shown: DataFrame) -> DataFrame:
    """One row of counts over an overview."""
    has = {"title": "title IS NOT NULL", "description": "meta_description IS NOT NULL", "canonical": "has_canonical", "og_title": "has_og_title", "og_description": "has_og_description", "og_image": "has_og_image", "h1": "h1_count > 0", "lang": "has_lang_attr", "json_ld": "has_json_ld", "skip_link": "has_skip_link", "noindex": "noindex"}
    return shown.agg(F.count(F.lit(1)).alias("total_pages"), *[F.count_if(F.expr(x)).alias(f"pages_with_{k}") for k, x in has.items()])


def type_histogram(pages: DataFrame) -> DataFrame:
    """How often each JSON-LD type is declared, the most frequent first."""
    return pages.select(F.explode("types").alias("type")).groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type")


def exit_code(total: dict, c: dict) -> int:
    over = c["max_warnings"] is not None and total["warnings"] > c["max_warnings"]
    return int(total["errors"] > 0 or (c["strict"] and total["warnings"] > 0) or over)


@dataclass
class Audit:
    """An audit that has been planned. ``close()`` lets go of the parsed pages."""

    frames: Frames
    settings: dict
    project: DataFrame | None = None
    _done: dict = field(default_factory=dict)

    def _once(self, name: str, make: Callable):
        if name not in self._done:
            self._done[name] = make()
        return self._done[name]

    @property
    def before_cap(self) -> DataFrame:
        c = self.settings

        def make() -> DataFrame:
            found = early_stop(with_severity(every_finding(self.frames, c), c), c)
            if c["baseline"] and not c["write_baseline"] and (known := read_baseline(found.sparkSession, c["baseline"])) is not None:
                found = without_baseline(found, known)
            return found.persist(StorageLevel.MEMORY_AND_DISK)

        return self._once("before_cap", make)

    @property
    def findings(self) -> DataFrame:
        """All findings with help, suggestion and source_hint."""

        def make() -> DataFrame:
            found = with_texts(capped(self.before_cap, self.settings))
            return with_source_hints(found, self.project) if self.settings["hints"]["source_files"] and self.project is not None else found.withColumn("source_hint", F.lit(None).cast("string"))

        return self._once("findings", make)

    @property
    def truncated(self) -> bool:
        most = self.settings["max_errors"]
        return self._once("truncated", lambda: bool(most) and self.before_cap.where("level = 'error'").limit(most + 1).count() > most)

    def summary(self) -> dict:
        return self._once("summary", lambda: summary(self.findings, self.frames.pages, self.truncated).first().asDict())

    def overview(self) -> DataFrame:
        return overview(self.frames.pages)

    def run(self) -> int:
        """Writes the baseline or the extra reports that the settings name; the exit code."""
        c, spark = self.settings, self.frames.pages.sparkSession
        if c["page_overview"]:
            return 0
        for extra in c["extra_reports"]:
            if extra["format"] not in ("json", "markdown", "sarif"):
                raise ValueError(f"extra report can't be {extra['format']}")
        if c["baseline"] and c["write_baseline"]:
            write_baseline(self.before_cap, c["baseline"])
        for extra in c["extra_reports"]:
            write_text(spark, extra["path"], self.report(extra["format"]))
        return 0 if c["baseline"] and c["write_baseline"] else exit_code(self.summary(), c)

    def report(self, kind: str | None = None, benchmark: dict | None = None) -> str:
        from .reports import overview_report, report

        kind = kind or self.settings["format"]
        if self.settings["page_overview"]:
            return overview_report(self.frames.pages, kind)
        return report(self.findings, self.summary(), kind, benchmark)

    def benchmark(self) -> dict:
        """Milliseconds of parsing, of each family's findings and of all, each run on its own; pages and pages a second."""
        from .benchmark import measure

        return measure(self.frames, self.settings)

    def close(self) -> None:
        for df in (self.frames.pages, *self.frames.kept, self._done.get("before_cap")):
            if df is not None:
                df.unpersist()


def audit(spark: SparkSession, source: DataFrame | str, settings: dict | None = None, probe: Callable | None = None, **more: DataFrame) -> Audit:
    """Plans an audit of a table of pages (url, html) or of a folder of built files, as the settings say.

    A folder's own files, sitemap.xml, robots.txt, images and, with ``project_root``, content items and sources are read
    with it. External links are asked for with ``probe`` (sources.links.fetch unless given) if the settings want them.
    ``more`` are further tables of Frames.
    """
    c = settings or config()
    slash, project = c["url_normalization"], None
    if isinstance(source, str):
        base = c["site"]["base_url"]
        pages, more["files"] = sources.from_folder(spark, source, base, c["filters"]["include"], c["filters"]["exclude"], **slash)
        more["sitemap"], more["sitemap_state"] = sources.sitemap(spark, source, base)
        more["robots"] = sources.robots(spark, source, base)
        if c["opengraph"]["check_image_dimensions"]:
            more["images"] = sources.image_sizes(spark, source, base)
        if c["project_root"]:
            more["content"] = sources.content(spark, c["project_root"], base)
            if c["hints"]["source_files"]:
                project = sources.project_files(spark, c["project_root"])
    else:
        pages = sources.from_table(source, **slash)
        if c["site"]["base_url"]:  # the pages are of this site, wherever they were read
            pages = pages.withColumns({"site": F.coalesce(sources.origin(F.lit(c["site"]["base_url"])), F.lit("")), "absolute_url": F.concat(sources.origin(F.lit(c["site"]["base_url"])), F.col("route"))})
        for globs, keep in ((c["filters"]["include"], True), (c["filters"]["exclude"], False)):
            if globs:
                pages = pages.where(sources.matches(globs, sources.url_path(F.col("file"))) == F.lit(keep))
    frames = Frames(parsed(pages, c), **more)
    if c["external_links"]["enabled"] and frames.statuses is None:
        frames.statuses = sources.statuses(external_urls(frames.pages, c), c, *([probe] if probe else []))
    return Audit(frames, c, project)


__all__ = ["Audit", "Frames", "audit", "exit_code", "findings", "overview", "overview_stats", "parsed", "post_process", "summary", "type_histogram", "with_facts", "without_baseline"]
