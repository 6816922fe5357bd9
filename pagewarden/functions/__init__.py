"""Column expressions for texts, paths and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once; without it, expressions that use one many times would multiply."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(x: Column) -> Column:
    """Trims Unicode white space."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def blank(x: Column) -> Column:
    return F.coalesce(strip(x) == "", F.lit(True))


def collapse_dots(path: Column) -> Column:
    """Drops `.` segments and lets `..` take the one before; a leading slash stays."""
    step = lambda kept, s: F.when(s == ".", kept).when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(s)))


    def collapsed(p: Column) -> Column:
        joined = F.array_join(F.aggregate(F.split(p, "/", -1), F.array().cast("array<string>"), step), "/")
        return F.when(p.contains("/.") | p.startswith("."), let(joined, lambda j: F.when(p.startswith("/") & ~j.startswith("/"), F.concat(F.lit("/"), j)).otherwise(j))).otherwise(p)

    return let(path, collapsed)


def normalize_path(path: Column, trailing_slash: str = "always", index_html: str = "forbid") -> Column:
    def ended(p: Column) -> Column:
        if trailing_slash == "always":
            return F.when(p.endswith("/"), p).otherwise(F.concat(p, F.lit("/")))
        if trailing_slash == "never":
            return F.when(p == "/", p).otherwise(F.regexp_replace(p, "/+$", ""))
        return p

    def without_index(p: Column) -> Column:
        if index_html != "forbid":
            return p
        return F.when(p.rlike(r"^index\.html?$"), F.lit("/")).otherwise(F.regexp_replace(p, r"/(index\.html)+$|/(index\.htm)+$", "/"))

    return let(let(collapse_dots(path), without_index), ended)


def route_of_file(path: Column, trailing_slash: str = "always", index_html: str = "forbid") -> Column:
    """Route of a file's path; an index file stands for its folder, .html and .htm endings go."""
    def stripped(p: Column) -> Column:
        return F.when(p.rlike(r"/index\.html?$"), F.regexp_replace(p, r"(index\.html)+$|(index\.htm)+$", "")).when(p.endswith(".html"), F.regexp_replace(p, r"(\.html)+$", "")).otherwise(F.regexp_replace(p, r"(\.htm)+$", ""))

    p = F.concat(F.lit("/"), F.ltrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/")))
    return normalize_path(let(let(p, stripped), lambda x: F.when(x == "", "/").otherwise(x)), trailing_slash, index_html)


def bare(href: Column) -> Column:
    """An address without fragment and query."""
    return F.substring_index(F.substring_index(href, "#", 1), "?", 1)


def has_query(href: Column) -> Column:
    return F.substring_index(href, "#", 1).contains("?")


def origin(url: Column) -> Column:
    """scheme://host[:port] in lower case without a default port; null for what isn't an absolute address."""
    found = F.lower(F.regexp_replace(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.-]*://[^/?#\\]+)", 1), "//[^@]*@", "//"))
    return F.nullif(F.regexp_replace(F.regexp_replace(found, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1"), F.lit(""))


def host(url: Column) -> Column:
    """Host in lower case of an absolute or scheme-relative address, else null."""
    found = F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\\]+)", 1))
    return F.nullif(found, F.lit(""))


def url_path(url: Column) -> Column:
    """Path of an absolute or scheme-relative address, `/` if it has none."""
    found = F.regexp_extract(bare(url), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#\\]*(.*)$", 1)
    return collapse_dots(let(found, lambda x: F.when(x == "", "/").otherwise(x)))


def is_internal(href: Column, base: Column) -> Column:
    """No scheme with // : internal (mailto: too). //host: same host. Absolute: same origin. Without a base not internal."""
    def test(h: Column) -> Column:
        relative = ~h.contains("://") & ~h.startswith("//")
        by_host = F.coalesce(host(h) == host(base), F.lit(False))
        return F.when(relative, True).when(h.startswith("//"), by_host).otherwise(F.coalesce(origin(h) == origin(base), F.lit(False)))

    return let(href, test)


def resolve(href: Column, route: Column) -> Column:
    """Path that an address on a page leads to."""
    def path(plain: Column) -> Column:
        away = plain.contains("://") | plain.startswith("//")
        inner = F.when(plain.startswith("/"), plain).otherwise(F.concat(F.regexp_replace(route, "[^/]*$", ""), plain))
        return F.when(plain == "", route).when(away, url_path(plain)).otherwise(collapse_dots(inner))

    return let(bare(href), path)


def decoded(fragment: Column) -> Column:
    """Percent-decoded, a plus stays a plus; undecodable ones stay as they are."""
    return F.coalesce(F.try_url_decode(F.replace(fragment, F.lit("+"), F.lit("%2B"))), fragment)


def within(name: Column, domains: list[str]) -> Column:
    """Whether a host is one of the domains or below one."""
    out = F.lit(False)
    for d in domains:
        out = out | (name == d) | name.endswith(f".{d}")
    return F.coalesce(out, F.lit(False))


def third_party(name: Column, base: Column) -> Column:
    return name.isNotNull() & ~F.coalesce((name == host(base)) | name.endswith(F.concat(F.lit("."), host(base))), F.lit(False))
