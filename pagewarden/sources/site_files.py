"""What lies beside a site's pages: sitemap.xml, robots.txt and the content items that pages are built from."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import origin

_SLUG = "slug:"


def locations(raw: bytes | None) -> tuple[str, list[str]]:
    """(state, addresses) of a sitemap: missing, malformed (no address) or ok.

    An address is the first run of text, not CDATA, in an element named loc without prefix, stripped. Elements still open at
    the end are no error; a tag cut short, crossing tags, unknown entities and bytes that aren't UTF-8 are.
    """
    from xml.parsers import expat

    if raw is None:
        return "missing", []
    found: list[str] = []
    inside = literal = False

    def start(name, _):
        nonlocal inside
        inside = inside or name == "loc"

    def end(name):
        nonlocal inside
        inside = inside and name != "loc"

    def cdata(on):
        nonlocal literal
        literal = on

    def text(data):
        nonlocal inside
        if inside and not literal:
            found.append(data.strip())
            inside = False

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.buffer_size = max(1, len(raw))  # a text arrives as a whole
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    parser.StartCdataSectionHandler, parser.EndCdataSectionHandler = lambda: cdata(True), lambda: cdata(False)
    try:
        raw.decode("utf-8")
        parser.Parse(raw, True)
    except UnicodeDecodeError:
        return "malformed", []
    except expat.ExpatError as error:
        if error.code != 3:  # 3: the text ended before its elements did
            return "malformed", []
    return "ok", found


def _root_file(spark: SparkSession, folder: str, name: str, site) -> DataFrame:
    """One row (site, content) of a file at the root of a folder, content null where there is none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", name).load(folder.rstrip("/")).select("content")
    return spark.range(1).select(site.alias("site")).join(F.broadcast(files), how="left")  # one row on either side


def _site(base_url: str | None):
    return F.coalesce(origin(F.lit(base_url).cast("string")), F.lit(""))


def sitemap(spark: SparkSession, folder: str, base_url: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(addresses as (site, url), state as (site, state)) of a folder's own sitemap.xml; each address once."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            both = [locations(x) for x in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_pydict({"site": batch.column("site"), "state": [s for s, _ in both], "urls": pa.array([u for _, u in both], pa.list_(pa.string()))})

    rows = _root_file(spark, folder, "sitemap.xml", _site(base_url)).mapInArrow(read, "site string, state string, urls array<string>")
    return rows.select("site", F.explode("urls").alias("url")).distinct(), rows.select("site", "state")


def robots(spark: SparkSession, folder: str, base_url: str | None = None) -> DataFrame:
    """Lines (site, line_no, line) of a folder's robots.txt; none where there is no such file."""
    rows = _root_file(spark, folder, "robots.txt", _site(base_url)).where("content IS NOT NULL AND is_valid_utf8(content)")
    return rows.select("site", F.posexplode(F.split(F.col("content").cast("string"), "\r?\n")).alias("line_no", "line"))


def content(spark: SparkSession, project: str, base_url: str | None = None) -> DataFrame:
    """Content items (site, path, slug) below src/content of a project.

    Markdown files count (md, mdx, markdown, mdoc), but for those named index and what lies under a name that begins with
    an underscore. The slug is the one in the front matter, or else the file's name in lower case without its ending.
    """
    root = f"{project.rstrip('/')}/src/content"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "site string, path string, slug string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM]*").load(root)
    path = F.concat(F.lit("src/content/"), F.substring_index("path", "/src/content/", -1))
    stem = F.lower(F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1))
    text = F.regexp_replace(F.when(F.expr("is_valid_utf8(content)"), F.col("content").cast("string")), r"^\s+", "")
    front = F.when(text.startswith("---") & (F.instr(F.substr(text, F.lit(4)), "\n---") > 0), F.substring_index(F.substr(text, F.lit(4)), "\n---", 1))
    lines = F.filter(F.transform(F.split(front, "\n"), F.trim), lambda x: x.startswith(_SLUG))
    bare = lambda x: F.trim(F.btrim(F.btrim(F.btrim(F.substr(x, F.lit(len(_SLUG) + 1)), F.lit(" \t\r")), F.lit('"')), F.lit("'")))
    slug = F.btrim(F.get(F.filter(F.transform(lines, bare), lambda x: x != ""), F.lit(0)), F.lit("/"))
    named = files.select(path.alias("path"), stem.alias("stem"), slug.alias("slug"))
    kept = named.where(F.col("path").rlike(r"(?i)\.(md|mdx|markdown|mdoc)$") & ~F.col("path").rlike("(^|/)_") & ~F.col("stem").isin("", "index"))
    return kept.select(_site(base_url).alias("site"), "path", F.coalesce("slug", "stem").alias("slug"))
