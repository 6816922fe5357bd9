import json
import struct
import time
from io import StringIO

import pytest
from pagewarden import functions
from pagewarden.__main__ import main
from pagewarden.functions import is_internal, normalize_path, resolve, route_of_file, urls
from pagewarden.operators.dom import linked_data, parse
from pagewarden.operators.help import HELP, SUGGESTION
from pagewarden.operators.page_rules import facts
from pagewarden.operators.site_rules import Frames, robots_rules, rule_weight, walks
from pagewarden.plans import audit as plan_audit
from pagewarden.plans import exit_code, findings, parsed, summary, without_baseline
from pagewarden.plans.config import DEFAULTS, EVERYTHING, ConfigError, config
from pagewarden.plans.options import settings
from pagewarden.plans import made
from pagewarden.plans.made import MADE, ROBOTS, Made, Part
from pagewarden.plans.queries import queries
from pagewarden.plans.reports import overview_report, report
from pagewarden.sources import content, from_folder, from_table, robots, sitemap, statuses
from pagewarden.sources.images import image_size
from pagewarden.sources.site_files import locations
from pagewarden.streaming import counts_by_time, page_findings
from pyspark.sql import functions as F

GOOD = '<!DOCTYPE html><html lang="en"><head><title>Home</title><meta name="viewport" content="w"><link rel="canonical" href="https://a.example/{0}"></head><body><header></header><nav><a href="/">home</a></nav><main><h1>x</h1></main><footer></footer></body></html>'


def audit(spark, pages, **user):
    return plan_audit(spark, spark.createDataFrame(pages, "url string, html string"), config(user)).findings


def ids(df):
    return sorted((r.rule_id, r.file.removeprefix("https://a.example")) for r in df.collect())


def test_good_page_has_no_error(spark):
    assert ids(audit(spark, [("https://a.example/", GOOD.format(""))]).where("level = 'error'")) == []


def test_bad_page(spark):
    html = '<html><head><title></title></head><body><img src="a.png"><a href="/gone?x=1"></a><button></button><input><h2>a</h2><h4>b</h4></body></html>'
    found = {r for r, _ in ids(audit(spark, [("https://a.example/", html)]))}
    assert {"html/lang-missing", "html/title-empty", "html/viewport-missing", "canonical/missing", "a11y/img-alt", "a11y/link-name", "a11y/button-name", "a11y/form-label", "headings/no-h1", "links/query-params", "links/broken"} <= found
    assert "headings/skip-level" not in found


def test_null_and_empty_pages_and_empty_table(spark):
    assert ("html/title-missing", "/") in ids(audit(spark, [("https://a.example/", None), (None, "x")]))
    assert ids(audit(spark, [])) == []


def test_redirect_loop_and_chain(spark):
    page = '<html><head><meta http-equiv="refresh" content="0;url={}"></head></html>'
    pages = [("https://a.example/x/", page.format("/y/")), ("https://a.example/y/", page.format("/x/")), ("https://a.example/o/", page.format("/m/")), ("https://a.example/m/", page.format("/n/")), ("https://a.example/n/", GOOD.format("n/"))]
    got = [x for x in ids(audit(spark, pages, redirects={"enabled": True})) if x[0].startswith("redirects/")]
    assert got == [("redirects/chain", "/o/"), ("redirects/loop", "/x/")]


def test_walks_of_any_length(spark):
    edges = [(i, i + 1) for i in range(300)] + [(400, 401), (401, 402), (402, 403), (403, 401)]
    rows = walks(spark.createDataFrame([("s", f"/{a}/", f"/{b}/", f"{a}.html") for a, b in edges], "site string, route string, next string, file string")).collect()
    got = {r.route: (r.path, r.loop) for r in rows}
    assert got["/0/"] == ([f"/{i}/" for i in range(301)], False) and got["/299/"] == (["/299/", "/300/"], False)
    assert got["/400/"] == (["/400/", "/401/", "/402/", "/403/", "/401/"], True) and got["/402/"][0][0] == got["/402/"][0][-1] and len(got) == len(edges)


def test_duplicate_ids_roles_and_alt(spark):
    html = '<html><body><p id="a"><p id="a"><div role="buton"></div><div role="slider"></div><img src="/x/cat.png" alt="cat" width="1" height="1"><img src="b.svg" alt="" ></body></html>'
    got = {r for r, _ in ids(audit(spark, [("https://a.example/", html)]))}
    assert {"a11y/duplicate-id", "a11y/aria-role-invalid", "a11y/aria-required-attr", "a11y/invalid-img-alt", "images/missing-lazy"} <= got


def test_linked_data():
    found, types, author, entities = linked_data(['{"@type":"FAQPage","mainEntity":{}}', "{", '{"@context":"https://schema.org","@type":"Person","name":"x","url":"/u","author":1}'])
    assert [x[1] for x in found] == ["structured-data/missing-context", "structured-data/faq-missing-answer", "structured-data/invalid-json"]
    assert types == ["FAQPage", "Person"] and author and entities[0]["id"] == "/u"


def test_parser_keeps_raw_text():
    tree = parse('<script>var t="</p>"</script><p>a<p>b<textarea><a href=x>&amp;</textarea><title>c&lt;<i></title>')
    assert [n.tag for n in tree.nodes] == ["html", "head", "script", "body", "p", "p", "textarea", "title"]
    assert tree.chunks == ['var t="</p>"', "a", "b", "<a href=x>&", "c<<i>"] and not tree.errors


def test_attributes():
    (node,) = [n for n in parse("<p a=1 A=2 b='x>y' c d = e&amp;f it's=\"&copy=1 &copy;\">").nodes if n.tag == "p"]
    assert node.attrs == {"a": "1", "b": "x>y", "c": "", "d": "e&f", "it's": "&copy=1 ©"}


HOSTILE = ["<![foo[x]]>", "<div>" * 8000, '<a "' * 20000, "<a href='" * 20001, "<!--" * 20000, "<" * 50000, "</b>" * 8000, "<a>" * 8000, "<title>" * 9000, "<p a= " * 20000, "\x00<p\x00>", "<script", "</", "<a href=//[x>x</a>", "<a href='http://a:99999999/'>x</a>", "&#xFFFFFFFF;&#0;", '<script type="application/ld+json">' + '{"@graph":[' * 3000 + "]}" * 3000 + "</script>", '<script type="application/ld+json">{"@type":["a",{"b":1}],"@graph":{"x":[1]}}</script>', "<svg><title>x</title></svg>", "<table><tr><td><ul><li>a<td>b</table>"]


def test_hostile_pages_are_pages(spark):
    began = time.time()
    everything = config(None, EVERYTHING)
    for page in HOSTILE:
        row = facts("https://a.example", "https://a.example/x", "/x/", "https://a.example/x/", page, everything)
        assert {"html", "head", "body"} <= {n.tag for n in parse(page).nodes} and row["found"]
    assert time.time() - began < 20
    found = audit(spark, [(f"https://a.example/{i}", page) for i, page in enumerate(HOSTILE)])
    assert found.select("file").distinct().count() == len(HOSTILE)


@pytest.mark.parametrize("path, route", [("index.html", "/"), ("a/index.html", "/a/"), ("a.html", "/a/"), ("a/../b.htm", "/b/")])
def test_routes(spark, path, route):
    assert spark.range(1).select(route_of_file(F.lit(path))).first()[0] == route


def test_addresses(spark):
    row = spark.range(1).select(resolve(F.lit("../c?x#y"), F.lit("/a/b/")), resolve(F.lit("https://q.example/z"), F.lit("/")), is_internal(F.lit("mailto:a@b"), F.lit("https://a.example")), is_internal(F.lit("//b.example/x"), F.lit("https://a.example")), normalize_path(F.lit("/x/index.html"))).first()
    assert tuple(row) == ("/a/c", "/z", True, False, "/x/")


def test_severity_baseline_reports_and_exit(spark):
    found = audit(spark, [("https://a.example/", "<html></html>")], severity={"canonical/missing": "off", "html/lang-missing": "warning"})
    rules = {(r.rule_id, r.level) for r in found.collect()}
    assert ("html/lang-missing", "warning") in rules and not any(r == "canonical/missing" for r, _ in rules)
    base = spark.createDataFrame([("html/lang-missing", "https://a.example/", "")], "rule_id string, file string, selector string")
    assert "html/lang-missing" not in {r for r, _ in ids(without_baseline(found, base))}
    pages = spark.createDataFrame([("x",)], "file string")
    total = summary(found, pages).first().asDict()
    shown = json.loads(report(found, total))
    assert shown["summary"] == {k: total[k] for k in ("errors", "warnings", "info", "files_checked")} and exit_code(total, config()) == 1
    assert all(x["help"] == HELP[x["rule_id"]] and "source_hint" not in x for x in shown["findings"])
    assert next(x for x in shown["findings"] if x["rule_id"] == "a11y/landmark-main-missing")["suggestion"] == SUGGESTION["a11y/landmark-main-missing"]
    run = json.loads(report(found, total, "sarif"))["runs"][0]
    assert [x["id"] for x in run["tool"]["driver"]["rules"]] == sorted({r for r, _ in rules}) and all(run["tool"]["driver"]["rules"][x["ruleIndex"]]["id"] == x["ruleId"] for x in run["results"])
    assert "| `html/lang-missing` |" in report(found, total, "markdown") and "help: " in report(found, total, "text")
    with pytest.raises(ConfigError):
        config({"max_errors": 0})


def test_text_report_names_top_issues(spark):
    found = audit(spark, [(f"https://a.example/{i}/", "<html></html>") for i in range(6)])
    text = report(found, summary(found, spark.range(6)).first().asDict() | {"truncated": True}, "text").splitlines()
    assert text[0] == "Top issues" and text[1].split() == ["6", "a11y/landmark-footer-missing"] and "more rule" in text[6] and text[-1] == "Errors beyond the limit are left out."


def test_baseline_comes_before_the_cap(spark, tmp_path):
    pages = spark.createDataFrame([(f"https://a.example/{i}/", "<html></html>") for i in (1, 2, 3)], "url string, html string")
    path = f"file://{tmp_path}/base.json"
    first = plan_audit(spark, pages.limit(1), config({"baseline": path, "write_baseline": True}))
    assert first.run() == 0 and json.loads((tmp_path / "base.json").read_text())["version"] == 1
    later = plan_audit(spark, pages, config({"baseline": path, "max_errors": 1}))
    left = later.findings.where("level = 'error'").collect()
    assert [r.file for r in left] == ["https://a.example/2/"] and later.truncated and later.summary()["truncated"] and later.run() == 1
    whole = plan_audit(spark, pages, config({"baseline": path + ".none"}))
    assert not whole.truncated and whole.findings.where("file like '%1/'").count() > 0
    whole.close()


def test_every_setting_has_a_reader():
    import pathlib

    code = "".join(p.read_text() for p in pathlib.Path(functions.__file__).parents[1].glob("*/*.py") if p.name not in ("config.py", "presets.py") and p.parent.name != "llm")
    for section, body in DEFAULTS.items():
        assert f'"{section}"' in code, section
        for key in body if isinstance(body, dict) and section not in ("opengraph", "url_normalization") else []:
            assert f'"{key}"' in code, (section, key)


def test_rules_have_help_and_are_in_queries():
    named = {r for m in MADE.values() for r in m.rules()} | {x[0] for _, *more in ROBOTS for x in more}
    named |= {"redirects/loop", "redirects/chain", "canonical/cluster", "links/orphan-page", "crawl-budget/noindex-with-internal-demand"}
    assert named <= HELP.keys() and len(named) >= 120
    assert HELP.keys() - named <= {"golive/config-missing-site", "content/missing-page"}


def test_max_errors(spark):
    found = audit(spark, [(f"https://a.example/{i}/", "<html></html>") for i in range(5)], max_errors=3)
    assert found.where("level = 'error'").count() == 3


def test_presets_and_groups():
    assert config(preset="strict") == config(preset="production") == config({"preset": "strict"})
    assert config(preset="strict")["strict"] and config(preset="strict")["robots_txt"]["check_disallow_all"]
    assert not config({"headings": {"require_h1": False}}, "strict")["headings"]["require_h1"]
    for name in ("relaxed", "standard", "seo", "accessibility", "performance"):
        config(preset=name)
    c = config({"severity": {"links/broken": "error"}, "links": {"check_fragments": False}}, groups={"links": "warn", "a11y": True, "seo": False})
    assert c["links"]["detect_orphan_pages"] and not c["links"]["check_fragments"] and c["a11y"]["require_skip_link"]
    assert c["severity"]["links/broken"] == "error" and c["severity"]["links/orphan-page"] == "warning" and "a11y/img-alt" not in c["severity"]
    for bad in ({"preset": "none"}, {"groups": {"none": True}}):
        with pytest.raises(ConfigError):
            config(**bad)


def test_sitemap_addresses():
    assert locations(None) == ("missing", [])
    assert locations(b"<urlset><url><loc> https://a.example/?a=1&amp;b=2 </loc></url><x:loc>no</x:loc><loc><![CDATA[no]]></loc><loc>b</loc>") == ("ok", ["https://a.example/?a=1&b=2", "b"])
    assert [locations(x)[0] for x in (b"<urlset><url><loc>x</lo", b"<a></b>", b"<loc>\xff</loc>", b"")] == ["malformed", "malformed", "malformed", "ok"]


def test_side_files_of_a_folder(spark, tmp_path):
    site, items = tmp_path / "dist", tmp_path / "src" / "content" / "blog"
    site.mkdir()
    (items / "_drafts").mkdir(parents=True)
    (site / "index.html").write_text(GOOD.format(""))
    (site / "sitemap.xml").write_text("<urlset><url><loc>https://a.example/gone/</loc></url><url><loc>https://a.example/gone/</loc></url></urlset>")
    (site / "robots.txt").write_text("User-agent: *\r\nDisallow: /\n")
    (items / "Post.md").write_text("text")
    (items / "other.mdx").write_text("---\ntitle: x\nslug: \"/a/b/\"\n---\nslug: no")
    for skipped in ("index.md", "_drafts/d.md", "note.txt"):
        (items / skipped).write_text("x")
    base = "https://a.example"
    urls_, state = sitemap(spark, str(site), base)
    assert [tuple(r) for r in urls_.collect()] == [(base, f"{base}/gone/")] and state.first().state == "ok"
    assert [r.line for r in robots(spark, str(site), base).orderBy("line_no").collect()][:2] == ["User-agent: *", "Disallow: /"]
    assert sorted((r.path, r.slug) for r in content(spark, str(tmp_path), base).collect()) == [("src/content/blog/Post.md", "post"), ("src/content/blog/other.mdx", "a/b")]
    assert sitemap(spark, str(items), base)[1].first().state == "missing" and robots(spark, str(items)).count() == 0 and content(spark, str(site)).count() == 0
    pages, files = from_folder(spark, str(site), base)
    c = config({"content_sync": {"enabled": True}})
    frames = Frames(parsed(pages, c), files, urls_, state, robots(spark, str(site), base), content(spark, str(tmp_path), base))
    found = {(r.rule_id, r.file) for r in findings(frames, c).collect()}
    assert {("sitemap/entry-not-in-dist", "sitemap.xml"), ("content/missing-page", "src/content/blog/Post.md"), ("content/missing-page", "src/content/blog/other.mdx")} <= found
    assert any(rule == "robots-txt/disallow-all" for rule, _ in found), sorted(found)


def folder(tmp_path, **files):
    root = tmp_path / "dist"
    for name, text in files.items():
        path = root / name.replace("__", "/").replace("_html", ".html").replace("_txt", ".txt").replace("_png", ".png").replace("_xml", ".xml")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(root)


PNG = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 1, 1) + b"\0" * 9


def test_folder_audit_with_all_that_lies_in_it(spark, tmp_path):
    """Relative files count from the page's folder, folders are there, images are measured, sources are found."""
    page = GOOD.format("about/").replace("</main>", '<img src="a.png" alt="A tree in bloom" width="1" height="1"><img src="img" alt="A tree in bloom" width="1" height="1" loading="lazy"><img src="no.png" alt="A tree in bloom" width="1" height="1" loading="lazy"></main>').replace("</head>", '<meta property="og:image" content="https://a.example/about/a.png"></head>')
    root = folder(tmp_path, index_html=GOOD.format(""), about__x_html=page, about__a_png=PNG, about__img__b_png=PNG, drafts__d_html="<p>", robots_txt="User-agent: *\nDisallow: /\nUser-agent: Bad\nDisallow:\n", sitemap_xml="<urlset></urlset>")
    (tmp_path / "src" / "pages" / "about").mkdir(parents=True)
    (tmp_path / "src" / "pages" / "about" / "x.md").write_text("x")
    (tmp_path / "src" / "pages" / "about" / "x.mdx").write_text("x")
    c = config({"site": {"base_url": "https://a.example"}, "filters": {"exclude": ["drafts/**", "it's?"]}, "assets": {"check_broken_assets": True}, "opengraph": {"check_image_dimensions": True, "check_image_exists": True}, "hints": {"source_files": True}, "project_root": str(tmp_path)})
    done = plan_audit(spark, root, c)
    rows = done.findings.collect()
    assert [(r.file, r.selector) for r in rows if r.rule_id == "assets/broken"] == [("about/x.html", "img[src]='no.png'")]
    assert [r.message for r in rows if r.rule_id == "opengraph/image-invalid-dimensions"] == ["og:image is 1 by 1, less than 1200 by 630"]
    assert {r.source_hint for r in rows if r.file == "about/x.html"} == {"src/pages/about/x.md"} and not any(r.file.startswith("drafts") for r in rows)
    assert "robots-txt/disallow-all" in {r.rule_id for r in rows} and done.summary()["files_checked"] == 2
    times = done.benchmark()
    assert times["pages_checked"] == 2 and len(times["check_timings"]) == 27 and json.loads(done.report("json", times))["benchmark"] == times


def test_extra_reports_and_overview(spark, tmp_path):
    pages = spark.createDataFrame([("https://a.example/b/", GOOD.format("b/")), ("https://a.example/a/", "<h1>x")], "url string, html string")
    extra = [{"format": k, "path": f"file://{tmp_path}/out.{k}"} for k in ("json", "markdown", "sarif")]
    assert plan_audit(spark, pages, config({"extra_reports": extra})).run() == 1
    assert json.loads((tmp_path / "out.json").read_text())["summary"]["files_checked"] == 2 and (tmp_path / "out.markdown").read_text().startswith("# Audit")
    with pytest.raises(ValueError):
        plan_audit(spark, pages, config({"extra_reports": [{"format": "text", "path": "x"}]})).run()
    shown = plan_audit(spark, pages, config({"page_overview": True}))
    assert shown.run() == 0 and shown.report().startswith("Page properties (2 pages)")
    body = json.loads(overview_report(shown.frames.pages, "json"))
    assert [p["route"] for p in body["pages"]] == ["/a/", "/b/"] and body["stats"]["pages_with_title"] == 1 and body["stats"]["total_pages"] == 2


def test_routes_follow_the_settings(spark):
    page = GOOD.format("").replace('href="/"', 'href="/b"')
    found = audit(spark, [("https://a.example/a/", page), ("https://a.example/b/", page)], url_normalization={"trailing_slash": "never"}, site={"base_url": "https://a.example"})
    assert not [x for x in ids(found) if x[0] == "links/broken"]
    assert [x for x in ids(audit(spark, [("https://a.example/a", page)], filters={"include": ["a*"]})) if x[0] == "links/broken"]


def test_pages_without_origin_are_pages(spark):
    assert ("html/lang-missing", "x.html") in ids(audit(spark, [("x.html", "<p>")]))


def test_canonicals_that_are_no_addresses(spark):
    found = ids(audit(spark, [("https://a.example/", GOOD.format("").replace("https://a.example/", "gone/"))], canonical={"absolute": False}))
    assert not [x for x in found if x[0].startswith("canonical/")]


def test_reciprocal_entries_may_be_the_default(spark):
    head = '<html><head><link rel="alternate" hreflang="{}" href="https://a.example/{}/"></head></html>'
    found = ids(audit(spark, [("https://a.example/a/", head.format("de", "b")), ("https://a.example/b/", head.format("x-default", "a"))], hreflang={"check_hreflang": True, "require_reciprocal": True}))
    assert not [x for x in found if x[0] == "hreflang/no-reciprocal"]


def test_go_live_without_a_site(spark, tmp_path):
    root = folder(tmp_path, index_html='<meta name="robots" content="noindex">')
    found = {r.rule_id for r in plan_audit(spark, root, config({"go_live": {"enabled": True}})).findings.collect() if r.rule_id.startswith("golive")}
    assert found == {"golive/config-missing-site"}


def test_external_links_are_asked_for_once(spark):
    page = '<a href="https://{0}.example/a#x">x</a><a href="https://{0}.example/a">x</a>'
    seen = lambda method, url, timeout: {"https://up.example/a": 200, "https://shy.example/a": 405 if method == "HEAD" else 200, "https://gone.example/a": 404}.get(url)
    done = plan_audit(spark, spark.createDataFrame([(f"https://a.example/{x}", page.format(x)) for x in ("up", "shy", "gone", "lost")], "url string, html string"), config({"external_links": {"enabled": True}}), probe=seen)
    assert [(r.file, r.selector) for r in done.findings.where("rule_id = 'external-links/broken'").orderBy("file").collect()] == [("https://a.example/gone", "a[href='https://gone.example/a']"), ("https://a.example/lost", "a[href='https://lost.example/a']")]
    assert statuses(spark.createDataFrame([("x",), ("x",), (None,)], "url string"), config(), lambda *_: 200).collect()[0].status == 200


def test_robots_blocks_and_weights(spark):
    lines = ["User-agent: *", "Disallow: /", "User-agent: Bad", "Disallow:", "Disallow: /x", "# comment", "Allow: /leaks", "User-agent: Good", "Allow: /y"]
    rows = robots_rules(spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "site string, line_no int, line string")).collect()
    got = {(r.block, r.agent, r.allow, r.pattern) for r in rows}
    assert got == {(0, "*", False, "/"), (1, "bad", False, ""), (1, "bad", False, "/x"), (2, "good", True, "/leaks"), (2, "good", True, "/y")}
    cases = [("/*.php$", "/a.php.php", None), ("/*.php$", "/a.php", 5), ("/*.php", "/a.php.php", 5), ("/a$b", "/a$b/c", 4), ("/", "/x", 1), ("", "/x", None), ("/a*", "/a", 2), ("/a*$", "/abc", 2), ("*/b", "/a/b", 2), ("/a.c", "/abc", None), ("/x/", "/x", None)]
    out = spark.createDataFrame(cases, "pattern string, path string, want int").select("pattern", "path", "want", rule_weight(F.col("pattern"), F.col("path")).alias("got")).collect()
    assert [(r.pattern, r.path, r.got) for r in out] == [(p, x, w) for p, x, w in cases]


def test_image_sizes():
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + struct.pack(">HH", 7, 9) + b"\0" * 9
    webp = b"RIFF\0\0\0\0WEBPVP8X\0\0\0\0\0\0\0\0" + (11).to_bytes(3, "little") + (12).to_bytes(3, "little")
    assert [image_size(x) for x in (PNG, b"GIF89a" + struct.pack("<HH", 3, 4), jpeg, webp, b"", b"\xff\xd8\xff", b"RIFF", PNG[:18])] == [(1, 1), (3, 4), (9, 7), (12, 13), None, None, None, None]


ADDRESSES = ["", "#x", "?q", "a", "../a", "/a/./b/../c", "/a/index.html", "mailto:a@b", "https://a.example", "https://A.example:443/x?y#z", "http://a.example:8080/", "https://u:p@a.example/x", "//a.example/x", "//b.example", "https://b.example/../x", "/x/", ".", "..", "index.html", "/x/index.htm"]


def test_columns_and_strings_agree_on_addresses(spark):
    base, h = F.lit("https://a.example"), F.col("h")
    columns = [functions.is_internal(h, base), functions.resolve(h, F.lit("/p/q/")), functions.normalize_path(h), functions.normalize_path(h, "never"), functions.has_query(h), functions.origin(h), functions.collapse_dots(h)]
    rows = spark.createDataFrame([(x,) for x in ADDRESSES], "h string").select("h", *[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()
    for r in rows:
        x, site = r.h, "https://a.example"
        want = [urls.is_internal(x, site), urls.resolve(x, "/p/q/", site), urls.normalize_path(x), urls.normalize_path(x, "never"), urls.has_query(x), urls.origin(x), urls.collapse_dots(x)]
        got = [r[f"c{i}"] for i in range(len(want))]
        assert got == want, (x, got, want)


def test_addresses_are_taken_apart_as_browsers_do():
    assert urls.parsed("HTTPS:\\\\bücher.example\\a b").origin() == "https://xn--bcher-kva.example" and urls.parsed("https://a.example/ü b/%41/../c").path == "/%C3%BC%20b/c"
    assert urls.parsed("https://a.example:99999/") is None and urls.parsed("https://") is None and urls.parsed("x/y") is None and urls.origin("mailto:a@b") is None


def test_streams_of_pages(spark, tmp_path):
    rows = [(f"https://a.example/{i}/", "<html></html>" if i % 2 else GOOD.format(f"{i}/"), f"2024-01-0{1 + i // 4} 10:00:00") for i in range(12)]
    spark.createDataFrame(rows, "url string, html string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("url string, html string, ts timestamp").parquet(f"{tmp_path}/in")

    def run(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start().awaitTermination()
        return spark.table(name)

    want = page_findings(spark.read.parquet(f"{tmp_path}/in"))
    assert sorted(run(page_findings(stream()), "found", "append").collect()) == sorted(want.collect()) and want.where("rule_id = 'canonical/missing'").count() == 6
    counts = {(r.window.start.day, r.n) for r in run(counts_by_time(stream(), every="1 day"), "counts", "update").where("rule_id = 'html/title-missing'").collect()}
    assert counts == {(1, 2), (2, 2), (3, 2)}


def test_command_and_options(spark, tmp_path):
    root, out, problems = folder(tmp_path, index_html=GOOD.format("")), StringIO(), StringIO()
    assert main([root], StringIO('{"site": {"base_url": "https://a.example"}, "format": "json"}'), out, problems) == 0
    assert json.loads(out.getvalue())["summary"]["files_checked"] == 1
    assert main([root], StringIO('{"html_basics": {"meta_description_required": true}, "strict": true, "site": {"base_url": "https://a.example"}}'), out, problems) == 1
    assert [main(x, StringIO(y), out, problems) for x, y in (([f"{tmp_path}/none"], ""), ([], ""), ([root], "{"), ([root], '{"max_errors": 0}'))] == [2] * 4 and problems.getvalue().count("error: ") == 4
    c = settings({"url_normalization": {"trailing_slash": "ignore"}}, site="https://a.example", trailing_slash="never", fail_on="warnings", baseline="b.json", project="/p", source_hints=True, ux_heuristics={"max_links_per_page": 3}, go_live={"enabled": True}, reports={"json": "o.json", "sarif": "/x/o.sarif"})
    assert (c["url_normalization"]["trailing_slash"], c["strict"], c["baseline"], c["project_root"], c["format"]) == ("ignore", True, "/p/b.json", "/p", "json")
    assert c["ux_heuristics"]["enabled"] and c["ux_heuristics"]["max_links_per_page"] == 3 and c["go_live"]["expected_site"] == "https://a.example" and [x["path"] for x in c["extra_reports"]] == ["/p/o.json", "/x/o.sarif"]
    assert not settings(fail_on="warnings", strict=False)["strict"] and not settings()["strict"] and settings(trailing_slash="never")["url_normalization"]["trailing_slash"] == "never"


def test_links_of_pages_with_one_address(spark, tmp_path):
    rows = [("https://a.example/x", '<a href="/y">y</a><a href="https://b.example/">b</a>'), ("https://a.example/x", '<a href="/z">z</a>'), ("https://a.example/y", "<p>none</p>")]
    spark.createDataFrame(rows, "url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries()["links_per_page"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("https://a.example/x", 1, 1), ("https://a.example/x", 2, 1)]


def test_robots_of_many_sites_are_read_in_one_call(spark):
    lines = [("User-agent: *", "Disallow: /a", "User-agent: x", "Allow: /"), ("", "User-agent: x", "# y", "User-agent: y", "Disallow:")]
    rows = [(f"s{n}", i, x) for n in range(40) for i, x in reversed(list(enumerate(lines[n % 2])))]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        parsed_rules = robots_rules(spark.createDataFrame(rows, "site string, line_no int, line string"))
        got = sorted(map(tuple, parsed_rules.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    expected = [[(0, "*", False, "/a"), (1, "x", True, "/")], [(0, "x", None, None), (1, "y", False, "")]]
    assert got == sorted([(f"s{n}", *x) for n in range(40) for x in expected[n % 2]], key=str)
    assert "FlatMapGroups" not in parsed_rules._jdf.queryExecution().executedPlan().toString()


def test_pages_of_a_partition_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(made, "TASK_PAGES", 50, raising=False)
    one = Made([Part("head", [("",), ("<title>x</title>",)])], {})
    spark.range(1000).selectExpr("id AS o_orderkey", "id AS o_custkey", "'x' AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    sizes = [r["n"] for r in one.pages(spark, str(tmp_path))[0].groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 60


def test_made_sitemap_broadcasts_neither_pages_nor_entries(spark):
    plan = queries()["made_sitemap"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan  # their tables grow with the site, whatever their files take
