"""Collections of pages: a table of addresses and HTML, or a folder of built HTML files."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bare, normalize_path, origin, route_of_file, url_path
from .images import image_sizes
from .links import statuses
from .site_files import content, robots, sitemap


def from_table(pages: DataFrame, trailing_slash: str = "always", index_html: str = "forbid") -> DataFrame:
    """Pages (site, file, route, absolute_url, html) from rows (url, html); a site is an origin, a file is the address.

    An address without origin is a path of a site without a name; a null one is its root.
    """
    url = F.coalesce("url", F.lit(""))
    site = origin(url)
    route = route_of_file(F.when(site.isNotNull(), url_path(url)).otherwise(bare(url)), trailing_slash, index_html)
    return pages.select(F.coalesce(site, F.lit("")).alias("site"), url.alias("file"), route.alias("route"), F.concat(site, route).alias("absolute_url"), "html")


def from_folder(spark: SparkSession, folder: str, base_url: str | None = None, include: list[str] = (), exclude: list[str] = (), trailing_slash: str = "always", index_html: str = "forbid") -> tuple[DataFrame, DataFrame]:
    """(pages, all files as (site, path, length)) of a folder of one site; include and exclude are globs over paths."""
    root = folder.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.expr(f"substring(path, locate('{root.split('://')[-1]}/', path) + {len(root.split('://')[-1]) + 1})")
    base = F.lit(base_url).cast("string")
    named = files.select(F.coalesce(origin(base), F.lit("")).alias("site"), path.alias("file"), "length", "content")
    pages = named.where(F.col("file").rlike(r"\.html?$") & F.expr("is_valid_utf8(content)"))
    if include:
        pages = pages.where(matches(include, F.col("file")))
    if exclude:
        pages = pages.where(~matches(exclude, F.col("file")))
    route = route_of_file(F.col("file"), trailing_slash, index_html)
    pages = pages.select("site", "file", route.alias("route"), F.when(base.isNotNull(), F.concat("site", route)).alias("absolute_url"), F.col("content").cast("string").alias("html"))
    return pages, named.select("site", F.col("file").alias("path"), "length")


def matches(globs: list[str], path: Column) -> Column:
    """Whether a path, its leading slash aside, fits one of the globs."""
    return reduce(lambda x, y: x | y, [F.ltrim(path, F.lit("/")).rlike(_regex(g)) for g in globs])


def project_files(spark: SparkSession, project: str) -> DataFrame:
    """The paths of the files below src of a project, as a column path that begins with src/."""
    root = f"{project.rstrip('/')}/src"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    return files.select(F.concat(F.lit("src/"), F.substring_index("path", f"{root.split('://')[-1]}/", -1)).alias("path"))


def _regex(glob: str) -> str:
    out = ""
    for part in (glob.replace("**/", "\x00").replace("**", "\x01")):
        out += {"\x00": "(?:.*/)?", "\x01": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return f"^{out}$"


__all__ = ["content", "from_folder", "from_table", "image_sizes", "matches", "normalize_path", "origin", "project_files", "robots", "sitemap", "statuses", "url_path"]
