"""Settings of an audit: defaults, presets, rule groups and validation. Unknown keys are ignored, unknown choices are errors."""

from __future__ import annotations

import copy
import json

from .presets import GROUPS, PRESETS

_OFF = {"enabled": False}
#: The settings that hold unless others are given (fixed values).
DEFAULTS: dict = {
    "site": {"base_url": None}, "filters": {"include": [], "exclude": []},
    "url_normalization": {"trailing_slash": "always", "index_html": "forbid"},
    "canonical": {"require": True, "absolute": True, "same_origin": True, "self_reference": False, "detect_clusters": True},
    "robots_meta": {"allow_noindex": True, "fail_if_noindex": False},
    "links": {"check_internal": True, "fail_on_broken": True, "forbid_query_params_internal": True, "check_fragments": False, "detect_orphan_pages": False, "check_mixed_content": True, "max_url_depth": None},
    "sitemap": {"require": False, "canonical_must_be_in_sitemap": True, "forbid_noncanonical_in_sitemap": False, "entries_must_exist_in_dist": True},
    "html_basics": {"lang_attr_required": True, "title_required": True, "meta_description_required": False, "viewport_required": True, "title_max_length": 60, "meta_description_max_length": 160},
    "headings": {"require_h1": True, "single_h1": True, "no_skip": False},
    "a11y": {"img_alt_required": True, "allow_decorative_images": True, "a_accessible_name_required": True, "button_name_required": True, "label_for_required": True, "warn_generic_link_text": True, "aria_hidden_focusable_check": True, "require_skip_link": False, "check_landmarks": True, "check_duplicate_ids": True, "check_aria_roles": True, "check_alt_quality": True},
    "opengraph": {"require_og_title": False, "require_og_description": False, "require_og_image": False, "require_twitter_card": False, "require_og_type": False, "require_og_url": False, "og_image_absolute_url": True, "require_twitter_image": False, "twitter_card_valid_values": True, "og_title_consistency": False, "check_image_exists": False, "check_image_dimensions": False, "og_image_max_size_kb": None},
    "structured_data": {"check_json_ld": False, "require_json_ld": False, "detect_duplicate_types": False},
    "structured_data_graph": _OFF, "hreflang": {"check_hreflang": False, "require_x_default": False, "require_self_reference": False, "require_reciprocal": False, "require_target_exists": False},
    "i18n_audit": _OFF, "crawl_budget": _OFF, "render_blocking": _OFF, "privacy_security": {"enabled": False, "gdpr": False},
    "security": {"check_target_blank": True, "check_mixed_content": True, "warn_inline_scripts": False},
    "content_quality": {"detect_duplicate_titles": False, "detect_duplicate_descriptions": False, "detect_duplicate_h1": False, "detect_duplicate_pages": False},
    "content_sync": _OFF, "go_live": {"enabled": False, "expected_site": None, "forbidden_domains": []},
    "robots_txt": {"require": False, "require_sitemap_link": False, "check_disallow_all": True, "max_crawl_delay": 10, "ai_bot_policy": False, "check_noindex_contradiction": False, "check_sitemap_blocked": False},
    "images": {"check_missing_dimensions": True, "warn_missing_lazy": True, "info_missing_srcset": True, "format_hints": False},
    "assets": {"check_broken_assets": False, "check_image_dimensions": False, "require_hashed_filenames": False, "max_image_size_kb": None, "max_js_size_kb": None, "max_css_size_kb": None},
    "js_bloat": {"enabled": False, "max_kb": 100}, "ai_visibility": _OFF, "ux_heuristics": {"enabled": False, "max_links_per_page": 80, "min_cta_per_page": 1},
    "redirects": _OFF, "html_validation": {"enabled": False, "max_per_page": 20},
    "external_links": {"enabled": False, "timeout_ms": 3000, "max_concurrent": 10, "fail_on_broken": False, "allow_domains": [], "block_domains": []},
    "severity": {}, "max_errors": None, "max_warnings": None, "strict": False, "baseline": None, "write_baseline": False, "page_overview": False,
    "format": "text", "extra_reports": [], "hints": {"source_files": False}, "project_root": None,
}
CHOICES = {("url_normalization", "trailing_slash"): ("always", "never", "ignore"), ("url_normalization", "index_html"): ("forbid", "allow")}
LEVELS = ("error", "warning", "info", "off")
#: The flags that switch a whole section on.
EVERYTHING = {s: {k: True for k, v in body.items() if isinstance(v, bool)} for s, body in DEFAULTS.items() if isinstance(body, dict) and any(isinstance(v, bool) for v in body.values())}


class ConfigError(ValueError):
    pass


def with_groups(user: dict, groups: dict[str, bool | str]) -> dict:
    """The user's settings over those of rule groups; a group set to "warn" lowers its own rules to warnings."""
    out, lowered = {}, {}
    for name, value in groups.items():
        if name not in GROUPS:
            raise ConfigError(f"unknown group {name}")
        if value:
            settings, rules = GROUPS[name]
            for section, body in settings.items():
                out[section] = out.get(section, {}) | body
            lowered |= dict.fromkeys(rules, "warning") if value == "warn" else {}
    for key, value in user.items():
        out[key] = out[key] | value if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out | ({"severity": lowered | (user.get("severity") or {})} if lowered else {})


def config(user: dict | str | None = None, preset: dict | str | None = None, groups: dict[str, bool | str] | None = None) -> dict:
    """Full settings: the user's over the groups' over the preset's over the defaults, two levels deep.

    A preset is a name or a dict; the user's settings may name one as "preset".
    """
    user = json.loads(user) if isinstance(user, str) else user or {}
    preset = preset or user.get("preset")
    if isinstance(preset, str):
        if preset not in PRESETS:
            raise ConfigError(f"unknown preset {preset}")
        preset = PRESETS[preset]
    user = with_groups(user, groups or {})
    out = copy.deepcopy(DEFAULTS)
    for layer in (preset or {}, user):
        for key, value in layer.items():
            if key in out and isinstance(out[key], dict) and isinstance(value, dict):
                out[key] = out[key] | copy.deepcopy(value)
            elif key in out:
                out[key] = copy.deepcopy(value)
    for (section, key), allowed in CHOICES.items():
        if out[section][key] not in allowed:
            raise ConfigError(f"{section}.{key} must be one of {', '.join(allowed)}")
    if bad := [x for x in out["severity"].values() if x not in LEVELS]:
        raise ConfigError(f"unknown severity {bad[0]}")
    if out["max_errors"] == 0:
        raise ConfigError("max_errors must be greater than 0")
    if out["write_baseline"] and not out["baseline"]:
        raise ConfigError("write_baseline needs baseline")
    for key in ("title_max_length", "meta_description_max_length"):
        if out["html_basics"][key] == 0:
            raise ConfigError(f"html_basics.{key} must be greater than 0")
    if out["external_links"]["enabled"] and 0 in (out["external_links"]["timeout_ms"], out["external_links"]["max_concurrent"]):
        raise ConfigError("external_links needs a timeout and a concurrency above 0")
    return out
