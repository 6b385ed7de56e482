"""Tables, enumerations and the issue catalogue of a crawl."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

# Fixed values that stored crawls contain.
HTML, IMAGE, CSS, JS, PDF, FONT, MEDIA, OTHER = "html", "image", "css", "js", "pdf", "font", "media", "other"
BODY, NAV, FOOTER, HEADER, IMAGE_PLACE = 0, 1, 2, 3, 4
LINK_INTERNAL, LINK_NOFOLLOW, LINK_UGC, LINK_SPONSORED, LINK_IMAGE, LINK_STYLESHEET, LINK_SCRIPT = 1, 2, 4, 8, 16, 32, 64
NOTICE, WARNING, CRITICAL = 1, 2, 3
ROW_INTERNAL, ROW_INDEXABLE, ROW_HAS_ISSUES, ROW_RENDERED, ROW_ORPHAN = 1, 2, 4, 8, 16
MAX_REDIRECTS = 5

#: Issue code, category, severity, in the order of reports. Fixed values.
ISSUES = [
    ("title-missing", "seo", CRITICAL), ("title-long", "seo", WARNING), ("title-short", "seo", WARNING), ("title-multiple", "seo", WARNING),
    ("title-duplicate", "seo", WARNING), ("title-same-as-h1", "seo", NOTICE), ("meta-missing", "seo", CRITICAL), ("meta-long", "seo", WARNING),
    ("meta-short", "seo", WARNING), ("meta-multiple", "seo", WARNING), ("meta-duplicate", "seo", WARNING), ("h1-missing", "seo", CRITICAL),
    ("h1-multiple", "seo", WARNING), ("h1-long", "seo", NOTICE), ("h1-duplicate", "seo", WARNING), ("h2-missing", "seo", NOTICE),
    ("thin-content", "content", WARNING), ("low-text-ratio", "content", NOTICE), ("duplicate-page", "duplication", WARNING), ("broken-image", "content", CRITICAL),
    ("dns-not-found", "technical", CRITICAL), ("connection-refused", "technical", CRITICAL), ("timeout", "technical", CRITICAL), ("ssl-error", "technical", CRITICAL),
    ("connection-error", "technical", CRITICAL), ("client-error", "technical", CRITICAL), ("server-error", "technical", CRITICAL), ("redirect", "technical", NOTICE),
    ("redirect-chain", "technical", WARNING), ("redirect-loop", "technical", CRITICAL), ("internal-redirect", "technical", WARNING), ("canonical-missing", "technical", WARNING),
    ("canonical-other", "technical", NOTICE), ("canonical-multiple", "technical", WARNING), ("canonical-chain", "technical", WARNING), ("canonical-loop", "technical", CRITICAL),
    ("canonical-to-non-200", "technical", CRITICAL), ("canonical-to-noindex", "technical", CRITICAL), ("meta-refresh", "technical", WARNING), ("bot-blocked", "technical", NOTICE),
    ("viewport-missing", "mobile", CRITICAL), ("lang-missing", "accessibility", WARNING), ("images-no-alt", "accessibility", WARNING), ("image-alt-long", "accessibility", NOTICE),
    ("og-missing", "social", WARNING), ("twitter-missing", "social", WARNING), ("no-structured-data", "structured-data", WARNING),
    ("slow-response", "performance", CRITICAL), ("moderate-response", "performance", WARNING), ("large-page", "performance", CRITICAL), ("moderate-page", "performance", WARNING),
    ("noindex", "indexability", CRITICAL), ("nofollow", "indexability", WARNING), ("robots-blocked", "indexability", CRITICAL), ("robots-unknown", "indexability", NOTICE), ("orphan-page", "indexability", WARNING),
    ("hreflang-no-return-tag", "hreflang", WARNING),
    ("hreflang-missing-self", "hreflang", WARNING),
    ("hreflang-invalid-code", "hreflang", WARNING),
    ("hreflang-to-non-200", "hreflang", CRITICAL),
    ("hreflang-non-canonical", "hreflang", WARNING),
]
SEVERITY = {code: severity for code, _, severity in ISSUES}
CATEGORY = {code: category for code, category, _ in ISSUES}
POSITION = {code: i for i, (code, *_) in enumerate(ISSUES)}


@dataclass(frozen=True)
class Crawl:
    """The tables of one or more crawls; each is keyed by run_id first."""

    pages: DataFrame
    urls: DataFrame | None = None
    links: DataFrame | None = None
    issues: DataFrame | None = None
    dupes: DataFrame | None = None
    psi: DataFrame | None = None
    psi_opps: DataFrame | None = None
    sitemaps: DataFrame | None = None
    sitemap_entries: DataFrame | None = None
    runs: DataFrame | None = None
    frontier: DataFrame | None = None
