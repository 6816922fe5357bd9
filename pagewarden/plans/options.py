"""Settings from the few options that a build gives."""

from __future__ import annotations

from posixpath import join

from .config import config


def _path(path: str | None, project: str | None) -> str | None:
    return path if path is None or project is None or "://" in path or path.startswith("/") else join(project, path)


def settings(
    rules: dict | None = None, *, site: str | None = None, trailing_slash: str | None = None, preset: str | None = None, groups: dict[str, bool | str] | None = None, fail_on: str | None = None, strict: bool | None = None,
    max_errors: int | None = None, max_warnings: int | None = None, baseline: str | None = None, write_baseline: bool = False, source_hints: bool = False, project: str | None = None, page_overview: bool = False,
    ai_visibility: bool | None = None, ux_heuristics: bool | dict | None = None, go_live: dict | None = None, reports: dict[str, str] | None = None,
) -> dict:
    """Full settings: the rules over the groups over the preset over the defaults, and the build's options over all.

    ``fail_on="warnings"`` is strict unless ``strict`` says otherwise; a trailing slash named in the rules stays; paths
    are taken from the project. ``reports`` are paths by format: with json among them the audit's own report is json,
    the others are written beside it. Going live on no other site is going live on ``site``.
    """
    user = dict(rules or {})
    if site:
        user["site"] = {"base_url": site}
    if trailing_slash and "trailing_slash" not in user.get("url_normalization", {}):
        user["url_normalization"] = user.get("url_normalization", {}) | {"trailing_slash": trailing_slash}
    if strict is not None or fail_on == "warnings":
        user["strict"] = strict is not False and (fail_on == "warnings" or bool(strict))
    given = {"max_errors": max_errors, "max_warnings": max_warnings, "baseline": _path(baseline, project)}
    user |= {k: v for k, v in given.items() if v is not None}
    user |= {k: True for k, v in {"write_baseline": write_baseline, "page_overview": page_overview}.items() if v}
    if project and (source_hints or user.get("content_sync", {}).get("enabled")):
        user["project_root"] = project
    if source_hints and project:
        user["hints"] = {"source_files": True}
    if ai_visibility is not None:
        user["ai_visibility"] = {"enabled": ai_visibility}
    if ux_heuristics:
        user["ux_heuristics"] = {"enabled": True} | (ux_heuristics if isinstance(ux_heuristics, dict) else {})
    if go_live is not None:
        user["go_live"] = {"enabled": False, "expected_site": site, "forbidden_domains": []} | {k: v for k, v in go_live.items() if v}
    for kind, path in (reports or {}).items():
        if kind == "json":
            user["format"] = "json"
        user["extra_reports"] = [*user.get("extra_reports", []), {"format": kind, "path": _path(path, project)}]
    return config(user, preset, groups)
