"""What to do about a finding, by rule; and for some rules the markup to begin with."""

from __future__ import annotations

_TEXTS = """
canonical/missing|Give the page a link with rel=canonical.
canonical/multiple|Keep one canonical link and drop the others.
canonical/empty|Write the page's address into the canonical link.
canonical/not-absolute|Write the canonical address with scheme and host.
canonical/cross-origin|Let the canonical address stay on the site's own origin.
canonical/not-self|Let the canonical address be the page's own, unless it is a copy.
canonical/target-missing|Build the page that the canonical names, or name one that exists.
canonical/cluster|Give pages of their own contents a canonical of their own.
robots/noindex|Remove noindex if search engines should list the page.
links/broken|Correct the address or build the page.
links/broken-fragment|Name an id that the target page has.
links/query-params|Link to the address without its query.
links/mixed-content|Link by https.
links/orphan-page|Link to the page from another one.
links/url-depth|Move the page nearer to the root.
links/redirect-target|Link to where the redirect ends.
a11y/img-alt|Describe the image in an alt attribute, or mark it as decoration.
a11y/invalid-img-alt|Say what the image shows.
a11y/link-name|Give the link a text or an aria-label.
a11y/generic-link-text|Say in the link's text where it leads.
a11y/button-name|Give the button a text or an aria-label.
a11y/form-label|Tie a label to the field.
a11y/skip-link|Begin the page with a link to its main content.
a11y/aria-hidden-focusable|Take the element out of the tab order, or don't hide it.
a11y/landmark-main-missing|Put the main content into a main element.
a11y/landmark-main-duplicate|Keep a single main element.
a11y/landmark-nav-missing|Put the site's navigation into a nav element.
a11y/landmark-header-missing|Put the page's head matter into a header element.
a11y/landmark-footer-missing|Put the page's closing matter into a footer element.
a11y/duplicate-id|Use each id once.
a11y/duplicate-id-aria|Use each id once; an ARIA attribute refers to this one.
a11y/aria-role-abstract|Choose a concrete role.
a11y/aria-role-invalid|Choose a role that the ARIA standard has.
a11y/aria-required-attr|Add the attributes that the role needs.
html/lang-missing|Name the page's language in the html element.
html/title-missing|Give the page a title.
html/title-empty|Write a title.
html/title-too-long|Shorten the title.
html/meta-description-missing|Describe the page in a meta element.
html/meta-description-too-long|Shorten the description.
html/viewport-missing|Add a viewport meta element.
html/syntax-error|Mend the markup.
headings/no-h1|Begin the content with an h1.
headings/multiple-h1|Keep one h1.
headings/skip-level|Use the next heading level.
sitemap/missing|Write a sitemap.xml when building.
sitemap/parse-error|Write well-formed XML.
sitemap/canonical-missing|List the canonical address in the sitemap.
sitemap/entry-not-in-dist|Drop the entry or build the page.
sitemap/non-canonical-entry|List the page's canonical address instead.
sitemap/entry-blocked-by-robots|Drop the entry or allow its path.
robots-txt/missing|Add a robots.txt.
robots-txt/no-sitemap|Name the sitemap in robots.txt.
robots-txt/disallow-all|Allow what should be found.
robots-txt/disallow-search-bot|Allow the search engine's robot.
robots-txt/crawl-delay-high|Lower the delay.
robots-txt/ai-citation-bot-blocked|Allow the robot if its answers should cite the site.
robots-txt/ai-training-bot-allowed|Disallow the robot if texts shouldn't train models.
robots/blocked-noindex-contradiction|Allow the path so that noindex can be read, or drop noindex.
assets/broken|Correct the path or add the file.
assets/img-dimensions|Write the image's width and height.
assets/unhashed-filename|Put a hash of the contents into the file's name.
assets/large-image|Compress or shrink the image.
assets/large-js|Split the script or load less.
assets/large-css|Split the stylesheet or drop unused rules.
performance/js-bloat|Load scripts later, or do without some.
images/missing-dimensions|Write the image's width and height.
images/missing-lazy|Add a loading attribute.
images/missing-srcset|Offer the image in several sizes.
images/legacy-format|Use WebP or AVIF.
opengraph/title-missing|Add og:title.
opengraph/description-missing|Add og:description.
opengraph/image-missing|Add og:image.
opengraph/image-not-absolute|Write og:image with scheme and host.
opengraph/image-broken|Correct the path or add the image.
opengraph/image-invalid-dimensions|Use an image of 1200 by 630 or more.
opengraph/image-too-large|Compress the image.
opengraph/type-missing|Add og:type.|<meta property="og:type" content="website">
opengraph/url-missing|Add og:url.
opengraph/twitter-card-missing|Add twitter:card.
opengraph/twitter-card-invalid|Use one of the known kinds of card.|summary_large_image
opengraph/twitter-image-missing|Add twitter:image.
opengraph/title-inconsistent|Let og:title and title say the same.
structured-data/missing|Describe the page in JSON-LD.
structured-data/empty|Fill the block or remove it.
structured-data/invalid-json|Mend the JSON.
structured-data/duplicate-type|Declare the type once.
structured-data/missing-context|Add @context.
structured-data/unusual-context|Use the schema.org context.
structured-data/missing-type|Add @type.
structured-data/missing-property|Add the property.
structured-data/article-missing-author|Name the author.
structured-data/article-missing-date-published|Give the date of publication.
structured-data/article-missing-date-modified|Give the date of the last change.
structured-data/article-missing-image|Name an image.
structured-data/news-article-missing-publisher|Name the publisher.
structured-data/organization-missing-url|Give the organisation's address.
structured-data/local-business-missing-telephone|Give a telephone number.
structured-data/local-business-missing-address|Give an address.
structured-data/faq-missing-answer|Answer each question.
structured-data/website-missing-search-action|Describe the site's search.
structured-data/breadcrumb-missing-position|Number the items.
structured-data/breadcrumb-missing-name|Name the items.
structured-data-graph/type-conflict|Use one type for the entity.
structured-data-graph/name-conflict|Use one name for the entity.
structured-data-graph/url-conflict|Use one address for the entity.
structured-data-graph/internal-url-missing|Build the page or correct the address.
hreflang/no-x-default|Add an entry for all other languages.
hreflang/no-self-reference|List the page itself.
hreflang/target-missing|Build the translation or correct the address.
hreflang/no-reciprocal|List this page on the other one.
i18n/lang-locale-mismatch|Let the route and the lang attribute agree.
i18n/lang-missing-for-locale-route|Name the language in the html element.
i18n/canonical-not-in-hreflang-set|List the canonical address among the entries.
i18n/no-matching-hreflang-for-route-locale|Add an entry for the route's language.
security/target-blank-noopener|Add rel=noopener.
security/mixed-content|Load it by https.
security/inline-scripts|Move the script into a file.
content/duplicate-title|Write a title of its own.
content/duplicate-description|Write a description of its own.
content/duplicate-h1|Write a heading of its own.
content/duplicate-page|Remove the copy or point its canonical to the original.
content/missing-page|Build a page for the item or mark it as a draft.
crawl-budget/query-variants|Link without queries.
crawl-budget/non-canonical-link-variant|Link to addresses in their normal form.
crawl-budget/redirect-target-missing|Let the redirect lead to a page that exists.
crawl-budget/duplicate-cluster|Merge the pages or tell them apart.
crawl-budget/noindex-in-sitemap|Drop the entry or noindex.
crawl-budget/noindex-with-internal-demand|Link to a page that may be listed, or drop noindex.
render-blocking/sync-head-scripts|Add defer or async.
render-blocking/missing-style-preload|Preload the stylesheet.
render-blocking/missing-preconnect|Connect early to the other origin.
privacy-security/third-party-domains|See that each of them is needed.
privacy-security/missing-sri-script|Add an integrity attribute.
privacy-security/missing-sri-stylesheet|Add an integrity attribute.
privacy-security/csp-readiness-inline-script|Move the script into a file, or give it a nonce.
privacy-security/missing-consent-indicator|Ask for consent before trackers load.
privacy-security/google-fonts-external|Serve the fonts from the site.
privacy-security/cdn-resources|Serve the files from the site.
privacy-security/external-images|Serve the images from the site.
privacy-security/youtube-direct-embed|Embed in privacy mode, or after a click.
privacy-security/google-maps-embed|Show a picture, or load the map after a click.
golive/config-missing-site|Set site.base_url or go_live.expected_site.
golive/noindex|Remove noindex.
golive/canonical-origin|Use the production origin.
golive/og-origin|Use the production origin.
golive/forbidden-domain|Replace the address.
golive/sitemap-origin|Use the production origin.
golive/robots-blocked|Allow the site.
external-links/broken|Correct or remove the link.
redirects/loop|Break the circle.
redirects/chain|Redirect straight to the end.
ai-visibility/low-word-count|Say more, or merge the page with another.
ai-visibility/lang-missing|Name the language in the html element.
ai-visibility/missing-og-title|Add og:title.
ai-visibility/missing-og-description|Add og:description.
ai-visibility/missing-canonical|Add a canonical link.
ai-visibility/missing-author-schema|Name author or publisher in JSON-LD.
ai-visibility/no-semantic-sections|Divide the page into sections.
ai-visibility/no-subheadings|Add subheadings.
ai-visibility/noindex-page|Remove noindex if the page should be found.
ux/no-cta|Say what a reader can do next.
ux/generic-link-text|Say in the link's text where it leads.
ux/no-trust-signals|Link to imprint, privacy or contact.
ux/high-link-density|Link to less.
ux/high-interactive-density|Offer fewer controls at once.
"""
_ROWS = [line.split("|") for line in _TEXTS.strip().splitlines()]
HELP = {rule: text for rule, text, *_ in _ROWS}
SUGGESTION = {rule: more[0] for rule, _, *more in _ROWS if more} | {
    "a11y/img-alt": 'alt="..."',
    "a11y/skip-link": '<a href="#main-content">Skip to content</a>',
    "a11y/landmark-main-missing": '<main id="main-content">...</main>',
}
