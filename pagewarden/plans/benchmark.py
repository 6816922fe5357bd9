"""How long the parts of an audit take."""

from __future__ import annotations

import time

from . import every_finding
from ..operators.site_rules import Frames

#: The families in the order in which they run.
FAMILIES = ["seo", "links", "a11y", "html_basics", "headings", "sitemap", "robots_txt", "assets", "opengraph", "structured_data", "hreflang", "security", "content_quality", "i18n_audit", "crawl_budget", "render_blocking", "privacy_security", "structured_data_graph", "golive", "external_links", "images", "ai_visibility", "ux_heuristics", "redirects", "js_bloat", "content_sync", "html_validation"]


def measure(frames: Frames, c: dict) -> dict:
    """Milliseconds of parsing and of each family's findings, each an action of its own over the parsed pages."""
    began = time.monotonic()
    pages = frames.pages.count()
    parsing = time.monotonic() - began
    found, timings = every_finding(frames, c), []
    for idx, name in enumerate(FAMILIES):
        start = time.monotonic()
        found.where(f"check_idx = {idx}").count()
        timings.append({"name": name, "duration_ms": round(1000 * (time.monotonic() - start))})
    total = time.monotonic() - began
    return {"discovery_ms": round(1000 * parsing), "check_timings": timings, "total_ms": round(1000 * total), "pages_checked": pages, "pages_per_second": pages / total if total else 0.0}
