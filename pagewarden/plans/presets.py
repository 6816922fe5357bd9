"""Named settings: presets, which a user's settings override, and rule groups, which switch related rules on together."""

from __future__ import annotations


def _on(*names: str, **others) -> dict:
    return dict.fromkeys(names, True) | others


_ENABLED = {"enabled": True}
#: The settings that each preset makes.
PRESETS: dict[str, dict] = {
    "strict": {
        "strict": True,
        "canonical": _on("require", "absolute", "same_origin", "self_reference", "detect_clusters"),
        "links": _on("check_internal", "fail_on_broken", "forbid_query_params_internal", "check_fragments", "detect_orphan_pages", "check_mixed_content"),
        "html_basics": _on("lang_attr_required", "title_required", "meta_description_required", "viewport_required", title_max_length=60, meta_description_max_length=160),
        "headings": _on("require_h1", "single_h1", "no_skip"),
        "a11y": _on("img_alt_required", "allow_decorative_images", "a_accessible_name_required", "button_name_required", "label_for_required", "warn_generic_link_text", "aria_hidden_focusable_check", "require_skip_link", "check_landmarks", "check_duplicate_ids", "check_aria_roles"),
        "assets": _on("check_broken_assets", "check_image_dimensions"),
        "opengraph": _on("require_og_title", "require_og_description", "require_og_image", "require_twitter_card", "require_og_type", "require_og_url", "og_image_absolute_url", "twitter_card_valid_values"),
        "structured_data": _on("check_json_ld", "detect_duplicate_types"),
        "hreflang": _on("check_hreflang", "require_x_default", "require_self_reference", "require_reciprocal"),
        "security": _on("check_target_blank", "check_mixed_content", "warn_inline_scripts"),
        "content_quality": _on("detect_duplicate_titles", "detect_duplicate_descriptions", "detect_duplicate_h1", "detect_duplicate_pages"),
        "sitemap": _on("require", "canonical_must_be_in_sitemap", "forbid_noncanonical_in_sitemap", "entries_must_exist_in_dist"),
        "robots_txt": _on("require", "require_sitemap_link"),
        "i18n_audit": _ENABLED, "crawl_budget": _ENABLED, "render_blocking": _ENABLED, "privacy_security": _ENABLED, "structured_data_graph": _ENABLED,
    },
    "relaxed": {
        "strict": False,
        "canonical": _on("require", "absolute", "same_origin", self_reference=False, detect_clusters=False),
        "links": _on("check_internal", "check_mixed_content", fail_on_broken=False, forbid_query_params_internal=False, check_fragments=False, detect_orphan_pages=False),
        "html_basics": _on("lang_attr_required", "title_required", "viewport_required", meta_description_required=False),
        "headings": _on("require_h1", single_h1=False, no_skip=False),
        "a11y": _on("img_alt_required", "allow_decorative_images", "a_accessible_name_required", button_name_required=False, label_for_required=False, warn_generic_link_text=False, aria_hidden_focusable_check=False, require_skip_link=False),
        "security": _on("check_target_blank", "check_mixed_content", warn_inline_scripts=False),
    },
    "standard": {
        "canonical": _on("self_reference"), "headings": _on("no_skip"), "html_basics": _on("meta_description_required"),
        "opengraph": _on("require_og_title", "require_og_description", "require_og_image", "og_image_absolute_url", "twitter_card_valid_values"),
        "a11y": _on("require_skip_link", "img_alt_required", "button_name_required", "label_for_required", "check_landmarks", "check_duplicate_ids", "check_aria_roles"),
        "links": _on("check_fragments"), "sitemap": _on("require", "canonical_must_be_in_sitemap", "entries_must_exist_in_dist"), "security": _on("check_target_blank"),
        "hreflang": _on("check_hreflang", "require_x_default", "require_self_reference", "require_reciprocal"),
        "assets": _on("check_broken_assets"), "structured_data": _on("check_json_ld"),
        "content_quality": _on("detect_duplicate_titles", "detect_duplicate_descriptions", "detect_duplicate_h1"),
    },
    "seo": {
        "canonical": _on("require", "absolute", "same_origin", "self_reference", "detect_clusters"),
        "html_basics": _on("lang_attr_required", "title_required", "meta_description_required", "viewport_required", title_max_length=60, meta_description_max_length=160),
        "opengraph": _on("require_og_title", "require_og_description", "require_og_image", "require_twitter_card"),
        "structured_data": _on("check_json_ld", "detect_duplicate_types"),
        "sitemap": _on("require", "canonical_must_be_in_sitemap", "entries_must_exist_in_dist"),
    },
    "accessibility": {
        "html_basics": _on("lang_attr_required", "title_required", "viewport_required"), "headings": _on("require_h1", "single_h1", "no_skip"),
        "a11y": _on("img_alt_required", "allow_decorative_images", "a_accessible_name_required", "button_name_required", "label_for_required", "warn_generic_link_text", "aria_hidden_focusable_check", "require_skip_link"),
        "links": _on("check_fragments"),
    },
    "performance": {"assets": _on("check_broken_assets", "check_image_dimensions", "require_hashed_filenames"), "render_blocking": _ENABLED},
}
PRESETS["production"] = PRESETS["strict"]

#: What each group switches on, and the rules that it lowers to warnings when it is set to "warn".
GROUPS: dict[str, tuple[dict, list[str]]] = {
    "seo": (
        {"html_basics": _on("meta_description_required"), "opengraph": _on("require_og_title", "require_og_description", "require_og_image"), "structured_data": _on("check_json_ld")},
        ["canonical/missing", "canonical/multiple", "canonical/empty", "canonical/not-absolute", "canonical/cross-origin", "canonical/not-self", "canonical/target-missing", "canonical/cluster", "robots/noindex", "sitemap/missing", "sitemap/canonical-missing", "sitemap/entry-not-in-dist", "sitemap/non-canonical-entry", "opengraph/title-missing", "opengraph/description-missing", "opengraph/image-missing", "html/title-missing", "html/meta-description-missing", "html/meta-description-too-long", "structured-data/missing", "structured-data/invalid-json"],
    ),
    "a11y": (
        {"a11y": _on("require_skip_link"), "headings": _on("no_skip")},
        ["a11y/img-alt", "a11y/link-name", "a11y/generic-link-text", "a11y/button-name", "a11y/form-label", "a11y/skip-link", "a11y/aria-hidden-focusable", "headings/no-h1", "headings/multiple-h1", "headings/skip-level", "html/lang-missing"],
    ),
    "links": (
        {"links": _on("detect_orphan_pages", "check_fragments")},
        ["links/broken", "links/broken-fragment", "links/query-params", "links/mixed-content", "links/orphan-page", "external-links/broken"],
    ),
    "performance": (
        {"assets": _on("check_image_dimensions", "require_hashed_filenames"), "render_blocking": _ENABLED},
        ["assets/img-dimensions", "assets/unhashed-filename", "assets/large-image", "assets/large-js", "assets/large-css", "render-blocking/sync-head-scripts", "render-blocking/missing-style-preload", "render-blocking/missing-preconnect"],
    ),
    "privacy": (
        {"privacy_security": _ENABLED, "security": _on("warn_inline_scripts")},
        ["privacy-security/third-party-domains", "privacy-security/missing-sri-script", "privacy-security/missing-sri-stylesheet", "privacy-security/csp-readiness-inline-script", "privacy-security/missing-consent-indicator", "security/target-blank-noopener", "security/inline-scripts", "security/mixed-content"],
    ),
}
