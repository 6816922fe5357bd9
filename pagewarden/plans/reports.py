"""Findings and overviews as text. The driver writes them row by row; for bulk, write the DataFrames."""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import DataFrame

from . import ORDER, overview, overview_stats, type_histogram

PUBLIC = ("level", "rule_id", "file", "selector", "message", "help", "suggestion", "source_hint", "confidence")
#: From so many findings on a text begins with the most frequent rules, so many of them.
TOP_FROM, TOP = 20, 5
MARK = {"error": "x", "warning": "!", "info": "i"}


def report(found: DataFrame, total: dict, kind: str = "json", benchmark: dict | None = None) -> str:
    """A report of findings (with help, suggestion and source_hint) and their summary: json, markdown, sarif or text."""
    rows = [r.asDict() for r in found.orderBy(*ORDER).toLocalIterator()]
    if kind == "json":
        shown = {k: v for k, v in total.items() if k not in ("total", "truncated") or k == "truncated" and v}
        optional = ("suggestion", "source_hint", "confidence")
        body = {"findings": [{k: r[k] for k in PUBLIC if k not in optional or r[k] is not None} for r in rows], "summary": shown}
        return json.dumps(body | ({"benchmark": benchmark} if benchmark else {}), indent=2, ensure_ascii=False)
    if kind == "markdown":
        return _markdown(rows, total)
    if kind == "sarif":
        return _sarif(rows)
    if kind == "text":
        return _text(rows, total, benchmark)
    raise ValueError(f"unknown report {kind}")


def _markdown(rows: list[dict], total: dict) -> str:
    escape = lambda x: x.replace("|", "\\|").replace("\n", " ")
    out = ["# Audit", "", f"{total['files_checked']} pages checked, {total['errors']} errors, {total['warnings']} warnings, {total['info']} info"]
    if not rows:
        return "\n".join([*out, "", "Nothing was found.", ""])
    for level, heading in (("error", "Errors"), ("warning", "Warnings"), ("info", "Info")):
        if some := [r for r in rows if r["level"] == level]:
            out += ["", f"## {heading}", "", "| File | Rule | Message |", "|-|-|-|"]
            out += [f"| {escape(r['file'])} | `{escape(r['rule_id'])}` | {escape(r['message'])} |" for r in some]
    if total.get("truncated"):
        out += ["", "> Errors beyond the limit are left out."]
    return "\n".join([*out, ""])


def _sarif(rows: list[dict]) -> str:
    helps: dict[str, str] = {}
    for r in rows:
        helps.setdefault(r["rule_id"], r["help"] or "")
    index = {rule: i for i, rule in enumerate(sorted(helps))}
    level = {"error": "error", "warning": "warning", "info": "note"}
    where = lambda r: [{"physicalLocation": {"artifactLocation": {"uri": r["file"], "uriBaseId": "%SRCROOT%"}}}]
    results = [{"ruleId": r["rule_id"], "ruleIndex": index[r["rule_id"]], "level": level[r["level"]], "message": {"text": r["message"]}, "locations": where(r)} for r in rows]
    rules = [{"id": rule, "shortDescription": {"text": helps[rule]}} for rule in index]
    body = {"$schema": "https://docs.oasis-open.org/sarif/sarif/v2.1.0/errata01/os/schemas/sarif-schema-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": "pagewarden", "rules": rules}}, "results": results}]}
    return json.dumps(body, indent=2, ensure_ascii=False)


def _plural(n: int, what: str) -> str:
    return f"{n} {what}{'' if n == 1 else 's'}"


def _text(rows: list[dict], total: dict, benchmark: dict | None) -> str:
    if not rows:
        return "Nothing was found."
    out = []
    if len(rows) > TOP_FROM:
        counts = sorted(Counter(r["rule_id"] for r in rows).items(), key=lambda x: (-x[1], x[0]))
        out += ["Top issues", *(f"  {n:>4}  {rule}" for rule, n in counts[:TOP])]
        out += [f"  and {_plural(len(counts) - TOP, 'more rule')}"] * (len(counts) > TOP)
    by_file: dict[str, list[dict]] = {}
    for r in rows:
        by_file.setdefault(r["file"], []).append(r)
    for file in sorted(by_file):
        out += ["", file]
        if hint := by_file[file][0]["source_hint"]:
            out.append(f"  source: {hint} (a guess)")
        for r in by_file[file]:
            out.append(f"  {MARK[r['level']]} {r['level']} [{r['rule_id']}] {r['message']}" + (f" (confidence: {r['confidence']})" if r["confidence"] else ""))
            out += [f"    at {r['selector']}"] * bool(r["selector"]) + [f"    help: {r['help']}"] * bool(r["help"])
    counts = [_plural(total["errors"], "error")] * (total["errors"] > 0) + [_plural(total["warnings"], "warning")] * (total["warnings"] > 0) + [f"{total['info']} info"] * (total["info"] > 0)
    out += ["", f"{', '.join(counts)} ({_plural(total['files_checked'], 'file')} checked)"]
    out += ["Errors beyond the limit are left out."] * bool(total.get("truncated"))
    if benchmark:
        out += ["", f"{benchmark['total_ms']} ms for {benchmark['pages_checked']} pages, {benchmark['pages_per_second']:.1f} a second", f"  parsing: {benchmark['discovery_ms']} ms"]
        out += [f"  {x['name']}: {x['duration_ms']} ms" for x in benchmark["check_timings"]]
    return "\n".join(out)


def overview_report(pages: DataFrame, kind: str = "text") -> str:
    """An overview of parsed pages: json, or for any other kind a table."""
    shown = overview(pages)
    stats = overview_stats(shown).first().asDict() | {"json_ld_type_counts": [[r["type"], r["n"]] for r in type_histogram(pages).collect()]}  # as many as there are types
    rows = [r.asDict() for r in shown.drop("site").toLocalIterator()]
    if kind == "json":
        return json.dumps({"pages": rows, "stats": stats}, indent=2, ensure_ascii=False)
    width = min(50, max([20, *(len(r["file"]) for r in rows)]))
    tick = lambda x: "yes" if x else "no"
    names = ["File", "Title", "Desc", "Canon", "OG", "H1", "Lang", "LD", "Skip", "LD Types"]
    out = [f"Page properties ({_plural(len(rows), 'page')})", "", "  ".join([names[0].ljust(width), *names[1:]])]
    for r in rows:
        file = r["file"] if len(r["file"]) <= width else "…" + r["file"][1 - width :]
        og = r["has_og_title"] and r["has_og_description"] and r["has_og_image"]
        cells = [tick(r["title"] is not None), tick(r["meta_description"] is not None), tick(r["has_canonical"]), tick(og), str(r["h1_count"] or "no"), r["lang_value"] or "no", tick(r["has_json_ld"]), tick(r["has_skip_link"])]
        out.append("  ".join([file.ljust(width), *(c.center(len(n)) for c, n in zip(cells, names[1:], strict=False)), ", ".join(r["json_ld_types"]) or "-"]))
    label = {"Title": "title", "Desc": "description", "Canonical": "canonical", "OG": "og_title", "H1": "h1", "Lang": "lang", "JSON-LD": "json_ld", "Skip": "skip_link"}
    out += ["", "  ".join(f"{k} {stats[f'pages_with_{v}']}/{stats['total_pages']}" for k, v in label.items())]
    out += [f"Noindex: {stats['pages_with_noindex']} pages"] * (stats["pages_with_noindex"] > 0)
    out += ["JSON-LD types: " + ", ".join(f"{t} {n}" for t, n in stats["json_ld_type_counts"])] * bool(stats["json_ld_type_counts"])
    return "\n".join(out)
