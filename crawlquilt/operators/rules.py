"""The 47 atomic audit rules, each a decision over the states of a subject's fields.

A rule is one CASE column; all rules of a kind of subject are evaluated in one pass
over its states, and one explode makes the results. What a decision needs of another
subject (a canonical's target, a link's ends, an entry's page) is joined by its ref."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlquilt.operators import evidence as E
from crawlquilt.sources.store import with_checkpoints

PASS, WARN, FAIL, REVIEW, NONE, UNKNOWN = "PASS", "WARNING", "FAIL", "MANUAL_REVIEW", "NOT_APPLICABLE", "UNKNOWN"


class Subject:
    """Access to the fields of a map of states in column ``o``, and to policies in ``p``."""

    def __init__(self, o: str = "o", p: str = "p", s: str = "s"):
        self.o, self.p, self.s = o, p, s

    def state(self, field: str) -> Column:
        return F.try_element_at(F.col(self.o), F.lit(field))

    def n(self, field: str) -> Column:
        return F.coalesce(self.state(field)["n"], F.lit(0))

    def conflict(self, *fields: str) -> Column:
        return reduce(lambda a, b: a | b, (self.n(f) > 1 for f in fields))

    def text(self, field: str) -> Column:
        """The value if all rows agree on one that isn't blank."""
        return F.when((self.n(field) == 1) & (self.state(field)["value"] != ""), self.state(field)["value"])

    def all(self, field: str) -> Column:
        return F.coalesce(self.state(field)["all"], F.array().cast("array<string>"))

    def flag(self, field: str) -> Column:
        v = F.lower(self.text(field))
        return F.when(v == "true", True).when(v == "false", False)

    def number(self, field: str) -> Column:
        return self.text(field).try_cast("long")

    def policy(self, key: str) -> Column:
        """The value for the subject, else for its url, else for the site."""
        return F.coalesce(F.try_element_at(F.col(self.p), F.lit(key)), F.try_element_at(F.col(f"{self.p}_url"), F.lit(key)), F.try_element_at(F.col(self.s), F.lit(key)))

    def own_policy(self, key: str) -> Column:
        return F.try_element_at(F.col(self.p), F.lit(key))

    def identity(self) -> Column:
        """Whether the url is known, and one."""
        return self.text("url_identity").isNotNull()


def first(*cases: tuple[Column, str], otherwise: str = UNKNOWN) -> Column:
    """The status of the first condition that is true."""
    out = F.when(F.lit(False), "")
    for when, status in cases:
        out = out.when(F.coalesce(when, F.lit(False)), status)
    return out.otherwise(otherwise)


def between(c: Column, low: int, high: int) -> Column:
    return c.between(low, high)


S = Subject()
TARGET = Subject("to")  # the state of the subject that a ref leads to


# -- access ---------------------------------------------------------------------------

def https_reachable() -> Column:
    url, status, error = S.text("site_https_url"), S.number("fetch_status"), S.text("fetch_error_type")
    return first(
        (S.conflict("site_https_url", "fetch_attempted", "tls_valid", "fetch_status", "fetch_error_type"), UNKNOWN),
        (url.isNull() | ~F.lower(url).startswith("https://"), UNKNOWN),
        (S.flag("fetch_attempted").isNull() | ~S.flag("fetch_attempted"), UNKNOWN),
        ((S.flag("tls_valid") == F.lit(False)) | (error == "ssl-error"), FAIL),
        (error.isNotNull() & (F.coalesce(status, F.lit(0)) <= 0), FAIL),
        (status > 0, PASS),
    )


def robots_intent() -> Column:
    allowed = S.text("robots_allowed_default")
    return first((~S.identity(), UNKNOWN), (F.coalesce(S.policy("expected_crawlable"), F.lit("")) != "true", NONE), (allowed == "true", PASS), (allowed == "false", FAIL))


def expected_status() -> Column:
    want, status = S.policy("expected_url_state"), S.number("http_status")
    moved = between(status, 300, 399)
    final = F.when(moved & (want != "redirect"), TARGET.number("http_status")).otherwise(status)
    meets = F.when(want == "live", between(final, 200, 299)).when(want == "redirect", moved).when(want == "missing", final.isin(404, 410))
    return first((~S.identity(), UNKNOWN), (want.isNull() | (want == "unspecified"), NONE), (final.isNull() | (final <= 0) | meets.isNull(), UNKNOWN), (meets, PASS), otherwise=FAIL)


def server_error() -> Column:
    status = S.number("http_status")
    return first((~S.identity() | status.isNull(), UNKNOWN), (between(status, 500, 599), FAIL), otherwise=PASS)


def bot_policy(allowed: str, policy: str, mismatch: str = FAIL, unspecified_block: str = WARN, unspecified: str | None = None) -> Callable[[], Column]:
    def decide() -> Column:
        is_allowed, want = S.text(allowed), F.coalesce(S.policy(policy), F.lit("unspecified"))
        known = is_allowed.isin("true", "false")
        blocked = is_allowed == "false"
        return first(
            (~S.identity() | is_allowed.isNull() | ~known | ~want.isin("allow", "block", "unspecified"), UNKNOWN),
            ((want == "unspecified") & F.lit(unspecified is not None), unspecified or PASS),
            ((want == "unspecified") & blocked, unspecified_block),
            (want == "unspecified", PASS),
            ((want == "allow") == ~blocked, PASS),
            otherwise=mismatch,
        )

    return decide


def profile_anomaly(bot: str, agent: str | None = None) -> Callable[[], Column]:
    def decide() -> Column:
        on, there = S.flag("profile_comparison_enabled"), S.number("default_profile_status")
        theirs, wall, own_wall = S.number(f"{bot}_profile_status"), S.flag(f"{bot}_challenge_detected"), S.flag("default_challenge_detected")
        open_ = between(there, 200, 399) & ~F.coalesce(own_wall, F.lit(False))
        shut = theirs.isin(403, 429) | between(theirs, 500, 599) | F.coalesce(wall, F.lit(False))
        lacks = S.text(agent).isNull() if agent else F.lit(False)
        return first(
            (~S.identity(), UNKNOWN),
            (~F.coalesce(on, F.lit(False)) & (S.n(f"{bot}_profile_status") == 0), NONE),
            (there.isNull() | theirs.isNull() | lacks | S.conflict(f"{bot}_challenge_detected", "default_challenge_detected"), UNKNOWN),
            (open_ & shut, WARN),
            otherwise=PASS,
        )

    return decide


def blocked_resource() -> Column:
    kind, allowed = F.lower(S.text("resource_type")), S.text("resource_robots_allowed")
    needed, differs = S.text("render_dependency_observed"), S.flag("render_diff_evidence")
    return first(
        (~F.coalesce(S.flag("page_rendered"), S.flag("rendered"), F.lit(False)), NONE),
        (kind.isNotNull() & ~kind.isin("css", "js", "stylesheet", "script"), NONE),
        (kind.isNull() | allowed.isNull() | ~allowed.isin("true", "false"), UNKNOWN),
        (allowed == "true", PASS),
        (needed.isNull() | ~needed.isin("true", "false"), WARN),
        (needed == "false", PASS),
        (differs, FAIL),
        otherwise=WARN,
    )


# -- index ----------------------------------------------------------------------------

def indexability_intent() -> Column:
    noindex = S.flag("effective_noindex")
    return first((F.coalesce(S.own_policy("expected_indexable"), F.lit("")) != "true", NONE), (~S.identity() | noindex.isNull(), UNKNOWN), (noindex, FAIL), otherwise=PASS)


def _tokens(field: str) -> Column:
    return F.flatten(F.transform(S.all(field), lambda v: F.transform(F.split(F.lower(v), ","), lambda t: F.trim(t))))


def directive_conflict() -> Column:
    found = _tokens("robots_directive_tokens")
    both = F.array_contains(found, "noindex") & (F.array_contains(found, "index") | F.array_contains(found, "all"))
    unsure = S.n("directive_scope_unknown") > 0
    scoped = S.flag("directive_scope_conflict")
    return first((~S.identity(), UNKNOWN), (F.size(found) == 0, NONE), (F.coalesce(scoped, both & ~unsure), FAIL), (unsure, UNKNOWN), otherwise=PASS)


def _channels_complete() -> Column:
    html = F.lower(F.coalesce(S.text("content_type"), F.lit(""))).startswith("text/html")
    head = (S.text("http_header_status") == "complete") & (F.coalesce(S.text("x_robots_sample_truncated"), F.lit("false")) == "false") & (S.number("http_status") > 0) & S.text("content_type").isNotNull()
    body = between(S.number("http_status"), 200, 299) & (S.text("html_extraction_status") == "complete") & (F.coalesce(S.text("robots_meta_sample_truncated"), F.lit("false")) == "false")
    return F.coalesce(head & (~html | body), F.lit(False))


def malformed_directive() -> Column:
    errors = F.flatten(F.transform(S.all("robots_parse_errors"), lambda v: F.split(v, ",")))
    bad = F.exists(errors, lambda x: F.trim(x).startswith("parse_error") | F.trim(x).startswith("unsupported_directive"))
    unclear = F.exists(errors, lambda x: F.trim(x).startswith("ambiguous"))
    return first((~S.identity(), UNKNOWN), (bad, WARN), (unclear | ~_channels_complete(), UNKNOWN), (S.n("robots_directive_tokens") == 0, NONE), otherwise=PASS)


def missing_probe() -> Column:
    status = S.number("probe_status")
    return first((S.conflict("probe_status", "probe_attempted", "missing_probe_url"), UNKNOWN), (S.text("missing_probe_url").isNull() | ~F.coalesce(S.flag("probe_attempted"), F.lit(False)) | status.isNull() | (status <= 0), UNKNOWN), (status.isin(404, 410), PASS), otherwise=FAIL)


def snippet_policy() -> Column:
    want = F.coalesce(S.policy("snippet_policy"), F.lit("unspecified"))
    no, most, data = S.flag("nosnippet"), S.number("max_snippet"), S.number("data_nosnippet_count")
    hard = F.coalesce(no, F.lit(False)) | F.coalesce(most >= 0, F.lit(False))
    soft = F.coalesce(data > 0, F.lit(False))
    evidence = (S.n("nosnippet") + S.n("max_snippet") + S.n("data_nosnippet_count")) > 0
    sure = F.coalesce(no == F.lit(False), F.lit(False)) & _channels_complete()
    return first(
        (~S.identity() | ~want.isin("allow_unrestricted", "restrict", "unspecified") | ~evidence | S.conflict("nosnippet", "max_snippet", "data_nosnippet_count"), UNKNOWN),
        ((S.n("max_snippet") > 0) & most.isNull(), UNKNOWN),
        (~hard & ~soft & sure, PASS),
        (~hard & ~soft, UNKNOWN),
        (want == "allow_unrestricted", FAIL),
        (~hard & soft, REVIEW),
        (want == "restrict", PASS),
        otherwise=WARN,
    )


def soft_404() -> Column:
    status, own, known = S.number("http_status"), S.text("content_fingerprint"), F.coalesce(S.text("known_404_fingerprint"), Subject("site").text("known_404_fingerprint"))
    reliable = F.coalesce(S.text("known_404_reliable"), Subject("site").text("known_404_reliable")) == "true"
    return first((~S.identity() | status.isNull(), UNKNOWN), (status != 200, NONE), (own.isNull() | known.isNull() | ~F.coalesce(reliable, F.lit(False)), UNKNOWN), (own == known, WARN), otherwise=PASS)


# -- canonicals and redirects -----------------------------------------------------------

def origin_variant() -> Column:
    origin = lambda c: F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1))
    want = origin(F.coalesce(S.policy("preferred_origin"), S.text("preferred_origin")))
    variant, final, status = origin(S.text("origin_variant")), origin(S.text("variant_final_url")), S.number("variant_fetch_status")
    hops = F.transform(F.split(F.coalesce(S.text("variant_hop_statuses"), F.lit("")), ","), lambda x: F.trim(x))
    temporary = F.exists(hops, lambda x: x.isin("302", "303", "307"))
    return first(
        (want.isNull() | (want == "") | variant.isNull() | (variant == ""), UNKNOWN), (variant == want, NONE), (final.isNull() | (final == "") | status.isNull(), UNKNOWN),
        (final != want, FAIL), (S.n("variant_hop_statuses") == 0, FAIL), (temporary, WARN), (~F.exists(hops, lambda x: ~x.isin("301", "308")), PASS),
    )


def slash_pair() -> Column:
    url, status, other = S.text("url_identity"), S.number("http_status"), TARGET.number("http_status")
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    static = F.regexp_replace(path, "/$", "").rlike(r"\.(css|js|png|jpe?g|gif|svg|webp|ico|pdf|woff2?|ttf|mp4|xml|json|txt)$")
    a, b = S.text("normalized_content_hash"), TARGET.text("normalized_content_hash")
    moved = F.least(status, other), F.greatest(status, other)
    one_moved = between(moved[0], 200, 299) & between(moved[1], 300, 399)
    direct = (S.text("redirect_final_url") == TARGET.text("url_identity")) | (TARGET.text("redirect_final_url") == url)
    return first(
        (url.isNull(), UNKNOWN), (path.isin("", "/") | static | url.contains("?"), NONE), (F.col("to").isNull(), NONE), (status.isNull() | other.isNull(), UNKNOWN),
        (between(status, 200, 299) & between(other, 200, 299) & (S.conflict("normalized_content_hash") | TARGET.conflict("normalized_content_hash")), UNKNOWN),
        (between(status, 200, 299) & between(other, 200, 299) & (a == b), FAIL), (between(status, 200, 299) & between(other, 200, 299), WARN),
        (one_moved & moved[1].isin(301, 308) & F.coalesce(direct, F.lit(False)), PASS), (one_moved, WARN),
    )


def canonical_missing() -> Column:
    status, kind = S.number("http_status"), F.lower(S.text("content_type"))
    return first(
        (~S.identity() | status.isNull(), UNKNOWN), (~between(status, 200, 299), NONE), (kind.isNotNull() & ~kind.startswith("text/html"), NONE), (S.n("canonical_resolved") > 0, PASS),
        (S.text("html_extraction_status").isNull() | (S.text("html_extraction_status") != "complete"), UNKNOWN), otherwise=WARN,
    )


def _canonical_unusable() -> Column:
    return ~S.identity() | S.conflict("canonical_count", "canonical_distinct_normalized_count", "canonical_normalization_complete") | S.number("canonical_count").isNull()


def canonical_multiple() -> Column:
    n, distinct, whole = S.number("canonical_count"), S.number("canonical_distinct_normalized_count"), S.flag("canonical_normalization_complete")
    return first((_canonical_unusable(), UNKNOWN), (n == 0, NONE), (n == 1, PASS), (distinct >= 2, FAIL), ((distinct == 1) & whole, WARN))


def canonical_resolvable() -> Column:
    n, syntax = S.number("canonical_count"), S.text("canonical_syntax_status")
    return first(
        (_canonical_unusable() | (F.coalesce(S.text("html_extraction_status"), F.lit("")) != "complete"), UNKNOWN), ((n != 1) & F.coalesce(S.flag("canonical_sample_truncated"), F.lit(False)), UNKNOWN), (n != 1, NONE),
        ((syntax == "valid") & S.text("canonical_resolved").isNotNull(), PASS), (syntax.isin("parser_error", "resolution_error") & (S.n("canonical_resolved") == 0), FAIL),
    )


def canonical_target_status() -> Column:
    n, distinct, status = S.number("canonical_count"), S.number("canonical_distinct_normalized_count"), TARGET.number("http_status")
    return first(
        (_canonical_unusable(), UNKNOWN), (n == 0, NONE), (distinct > 1, NONE), (~F.coalesce(S.flag("canonical_normalization_complete"), F.lit(False)) | S.text("canonical_target_subject_ref").isNull(), UNKNOWN),
        (status == 200, PASS), (between(status, 300, 599), FAIL),
    )


def canonical_target_noindex() -> Column:
    n, distinct, status, noindex = S.number("canonical_count"), S.number("canonical_distinct_normalized_count"), TARGET.number("http_status"), TARGET.flag("effective_noindex")
    return first(
        (_canonical_unusable(), UNKNOWN), ((n == 0) | (distinct > 1) | S.text("canonical_target_subject_ref").isNull(), NONE), (status.isNull(), UNKNOWN), (status != 200, NONE),
        (noindex.isNull(), UNKNOWN), (noindex, FAIL), otherwise=PASS,
    )


def _redirect() -> tuple[Column, Column]:
    """Whether the subject is no redirect, and whether the evidence on that contradicts itself."""
    seen, status = S.flag("redirect_initial_observed"), S.number("http_status")
    return F.coalesce(~seen, ~between(status, 300, 399)), S.conflict("redirect_initial_observed") | F.coalesce(seen != between(S.number("initial_http_status"), 300, 399), F.lit(False))


def redirect_chain() -> Column:
    no, odd = _redirect()
    hops, rows = S.number("redirect_hop_count"), F.size(S.all("redirect_hop"))
    loop, whole = S.flag("redirect_loop_detected"), S.flag("redirect_traversal_complete")
    return first((~S.identity() | odd, UNKNOWN), (no, NONE), (hops.isNull() | ~F.coalesce(whole, F.lit(False)) | F.coalesce(loop, F.lit(True)), UNKNOWN), ((rows > 0) & (rows != hops), UNKNOWN), (hops == 1, PASS), (hops >= 2, FAIL))


def redirect_loop() -> Column:
    no, odd = _redirect()
    loop, whole = S.flag("redirect_loop_detected"), S.flag("redirect_traversal_complete")
    return first((~S.identity() | odd, UNKNOWN), (no, NONE), (loop.isNull() | (loop & F.coalesce(whole, F.lit(False))), UNKNOWN), (loop, FAIL), (whole, PASS))


def redirect_target() -> Column:
    no, odd = _redirect()
    loop, status = S.flag("redirect_loop_detected"), TARGET.number("http_status")
    return first((~S.identity() | odd | S.conflict("redirect_loop_detected"), UNKNOWN), (no, NONE), (loop, NONE), (S.text("redirect_final_target_subject_ref").isNull() | status.isNull(), UNKNOWN), (between(status, 200, 299), PASS), (between(status, 400, 599), FAIL))


def _crawlable(href: Column) -> Column:
    return F.coalesce(F.lower(href).rlike(r"^https?://[^/?#]+"), F.lit(False))


def pagination() -> Column:
    on, more, href = S.flag("pagination_detected"), S.flag("has_next_page"), F.coalesce(S.text("next_page_url"), S.text("next_page_href"))
    return first(
        (~S.identity() | S.conflict("pagination_detected", "has_next_page", "next_page_element_tag", "next_page_url"), UNKNOWN), (~F.coalesce(on, F.lit(False)), NONE), (more.isNull(), UNKNOWN), (~more, NONE),
        (S.text("next_page_element_tag").isNull(), UNKNOWN), ((F.lower(S.text("next_page_element_tag")) != "a") | ~_crawlable(href), WARN), otherwise=PASS,
    )


# -- links ----------------------------------------------------------------------------

def navigation_href() -> Column:
    inside, nav, tag = S.flag("link_is_internal"), S.flag("navigation_candidate"), F.lower(S.text("element_tag"))
    return first(
        (inside.isNull() | S.conflict("link_is_internal", "navigation_candidate", "element_tag", "href"), UNKNOWN), (~inside, NONE), (nav.isNull(), UNKNOWN), (~nav, NONE), (tag.isNull(), UNKNOWN),
        ((tag != "a") | ~_crawlable(S.text("href")), WARN), otherwise=PASS,
    )


def link_class(klass: int) -> Callable[[], Column]:
    def decide() -> Column:
        inside, target, status = S.flag("link_is_internal"), S.text("link_target"), TARGET.number("http_status")
        known = S.text("link_source_url").isNotNull() & S.text("link_source_subject_ref").isNotNull() & S.text("link_target_subject_ref").isNotNull() & TARGET.identity()
        return first(
            (inside.isNull(), UNKNOWN), (~inside, NONE), (target.isNotNull() & ~_crawlable(target), NONE), (target.isNull() | ~F.coalesce(known, F.lit(False)), UNKNOWN), (status.isNull() | ~between(status, 100, 599), UNKNOWN),
            (between(status, klass * 100, klass * 100 + 99), FAIL), otherwise=PASS,
        )

    return decide


def orphan_candidate() -> Column:
    inlinks = S.number("crawl_inlink_count")
    return first((~S.identity(), UNKNOWN), (S.n("discovery_sources") == 0, NONE), (F.coalesce(S.flag("is_start_url"), F.lit(False)), NONE), (~F.col("crawl_complete") | inlinks.isNull(), UNKNOWN), (inlinks > 0, PASS), otherwise=WARN)


def priority_depth() -> Column:
    return first((~S.identity(), UNKNOWN), (F.coalesce(S.policy("priority_page"), F.lit("")) != "true", NONE), (S.number("crawl_depth").isNull(), UNKNOWN), otherwise=REVIEW)


# -- discovery --------------------------------------------------------------------------

def sitemap_presence() -> Column:
    n, done, state = S.number("sitemaps_found_count"), S.flag("sitemap_discovery_complete"), S.text("sitemap_discovery_status")
    capped = reduce(lambda a, b: a | b, (F.coalesce(S.flag(f"sitemap_{x}_capped"), F.lit(False)) for x in ("depth", "urls", "byte")))
    want = S.policy("sitemap_expected")
    return first(
        (n.isNull() | (n < 0) | done.isNull() | state.isNull(), UNKNOWN), (done != (state == "COMPLETED"), UNKNOWN), (capped | (state != "COMPLETED"), UNKNOWN),
        (n > 0, PASS), (want == "true", WARN), (want == "false", NONE), otherwise=REVIEW,
    )


def sitemap_status() -> Column:
    initial, final = S.number("initial_http_status"), S.number("final_http_status")
    return first((S.text("sitemap_url").isNull() | S.conflict("final_http_status", "initial_http_status"), UNKNOWN), (final.isNull() | (final <= 0) | (F.coalesce(S.number("sitemap_redirect_hops"), F.lit(0)) == 0) & (initial != final), UNKNOWN), (final == 200, PASS), otherwise=FAIL)


def sitemap_parse() -> Column:
    final, state, kind = S.number("final_http_status"), S.text("sitemap_parse_status"), S.text("sitemap_document_type")
    return first(
        (S.text("sitemap_url").isNull() | final.isNull() | state.isNull(), UNKNOWN), ((final != 200) & (state == "not_attempted"), NONE), (final != 200, UNKNOWN),
        ((state == "parsed") & kind.isin("urlset", "sitemapindex"), PASS), (state.isin("xml_error", "unsupported_structure", "empty_input"), FAIL),
    )


def _entry_known() -> Column:
    return F.coalesce(S.text("loc_normalized").isNotNull() & S.text("url_subject_ref").isNotNull() & TARGET.identity(), F.lit(False))


def entry_status() -> Column:
    status = TARGET.number("http_status")
    return first((~_entry_known() | status.isNull(), UNKNOWN), (status == 200, PASS), (between(status, 300, 599), FAIL))


def entry_noindex() -> Column:
    status, noindex = TARGET.number("http_status"), TARGET.flag("effective_noindex")
    html = F.lower(F.coalesce(TARGET.text("content_type"), F.lit("text/html"))).startswith("text/html")
    return first((~_entry_known(), UNKNOWN), (TARGET.text("fetch_error_type").isNotNull(), NONE), (status.isNull() | (status <= 0), UNKNOWN), ((status != 200) | ~html, NONE), (noindex.isNull(), UNKNOWN), (noindex, FAIL), otherwise=PASS)


def entry_canonical() -> Column:
    n, target = TARGET.number("canonical_count"), TARGET.text("canonical_normalized_target")
    return first((~_entry_known() | n.isNull(), UNKNOWN), ((n == 0) | (n > 1), NONE), (target.isNull() | ~F.coalesce(TARGET.flag("canonical_normalization_complete"), F.lit(False)), UNKNOWN), (target == S.text("loc_normalized"), PASS), otherwise=FAIL)


# -- entities, rendering -------------------------------------------------------------------

def structured_data() -> Column:
    kind, state, raw = F.lower(S.text("structured_format")), S.text("structured_parse_status"), S.state("structured_raw")["value"]
    error = S.n("structured_parse_error") > 0
    known = (S.text("structured_block_id") == F.col("subject_ref")) & S.text("url_subject_ref").isNotNull() & (S.text("url") == TARGET.text("url_identity"))
    return first(
        (~F.coalesce(known, F.lit(False)) | kind.isNull() | state.isNull() | S.conflict("structured_raw", "structured_parse_status"), UNKNOWN), (kind.isin("microdata", "rdfa"), UNKNOWN), (raw.isNull(), UNKNOWN),
        ((raw == "") & (state == "EMPTY_INPUT"), FAIL), (raw == "", UNKNOWN), ((state == "PARSE_SUCCESS") & ~error, PASS), ((state == "PARSE_ERROR") & error, FAIL),
    )


def render_state() -> list[tuple[Column, str]]:
    asked, done, state = S.flag("render_requested"), S.flag("rendered"), S.text("render_status")
    return [
        (~S.identity() | S.conflict("render_requested", "rendered", "render_status"), UNKNOWN), (~F.coalesce(asked, F.lit(False)) & ~F.coalesce(done, F.lit(False)), NONE),
        (~F.coalesce(asked, F.lit(False)) | ~F.coalesce(done, F.lit(False)) | (F.coalesce(state, F.lit("")) != "complete"), UNKNOWN),
    ]


def render_text(raw: str, rendered: str) -> Callable[[], Column]:
    def decide() -> Column:
        squash = lambda f: F.trim(F.regexp_replace(F.coalesce(S.state(f)["value"], F.lit("")), r"(?U)\s+", " "))
        return first(*render_state(), (S.conflict(raw, rendered) | ((S.n(raw) == 0) & (S.n(rendered) == 0)), UNKNOWN), (squash(raw) == squash(rendered), PASS), otherwise=WARN)

    return decide


def render_set(raw: str, rendered: str, by: str, lower: bool = False, malformed: str = "") -> Callable[[], Column]:
    def decide() -> Column:
        def as_set(f: str) -> Column:
            v = F.coalesce(S.state(f)["value"], F.lit(""))
            parts = F.transform(F.split(F.lower(v) if lower else v, by), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
            return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))

        a, b = as_set(raw), as_set(rendered)
        broken = F.exists(F.concat(a, b), lambda x: ~x.rlike(malformed)) if malformed else F.lit(False)
        return first(*render_state(), (S.conflict(raw, rendered) | ((S.n(raw) == 0) & (S.n(rendered) == 0)) | broken, UNKNOWN), (a == b, PASS), otherwise=WARN)

    return decide


def render_flag(raw: str, rendered: str) -> Callable[[], Column]:
    def decide() -> Column:
        return first(*render_state(), (S.flag(raw).isNull() | S.flag(rendered).isNull(), UNKNOWN), (S.flag(raw) == S.flag(rendered), PASS), otherwise=WARN)

    return decide


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    automation: str  # det, ass or man
    severity: str
    subject: str
    decide: Callable[[], Column]


_URLS = r"(?i)^https?://[^/?#\s]+\S*$"

RULES = [
    Rule("AR-ACC-001", "HTTPS endpoint reachable", "det", "P0", E.SITE, https_reachable),
    Rule("AR-ACC-002", "Robots access matches explicit crawl intent", "ass", "P1", E.URL, robots_intent),
    Rule("AR-ACC-003", "HTTP status matches explicit expected URL state", "det", "P1", E.URL, expected_status),
    Rule("AR-ACC-004", "Unexpected server-error response", "det", "P1", E.URL, server_error),
    Rule("AR-ACC-005", "Googlebot robots access matches explicit policy", "ass", "P1", E.URL, bot_policy("robots_allowed_googlebot", "googlebot_access_policy")),
    Rule("AR-ACC-006", "Googlebot profile response anomaly", "ass", "P1", E.URL, profile_anomaly("googlebot")),
    Rule("AR-ACC-007", "Blocked CSS/JS resource affects rendered output", "ass", "P1", E.RESOURCE, blocked_resource),
    Rule("AR-ACC-008", "Bot-profile access restriction observed", "ass", "P1", E.URL, profile_anomaly("bot", "tested_user_agent")),
    Rule("AR-INDEX-001", "Effective noindex conflicts with explicit indexability intent", "ass", "P1", E.URL, indexability_intent),
    Rule("AR-INDEX-002", "Conflicting index directives", "det", "P1", E.URL, directive_conflict),
    Rule("AR-INDEX-003", "Malformed or unsupported robots directive", "det", "P1", E.URL, malformed_directive),
    Rule("AR-INDEX-004", "Known-missing probe resolves to 404/410", "det", "P1", E.PROBE, missing_probe),
    Rule("AR-INDEX-005", "Snippet restriction conflicts with snippet policy", "ass", "P1", E.URL, snippet_policy),
    Rule("AR-INDEX-006", "200 response matches known 404 template", "ass", "P1", E.URL, soft_404),
    Rule("AR-CANON-001", "Origin variants normalize to preferred origin", "det", "P1", E.SITE, origin_variant),
    Rule("AR-CANON-002", "Trailing-slash pair is consistently normalized", "det", "P1", E.URL, slash_pair),
    Rule("AR-CANON-003", "Canonical declaration missing", "ass", "P1", E.URL, canonical_missing),
    Rule("AR-CANON-004", "Multiple canonical declarations", "det", "P1", E.URL, canonical_multiple),
    Rule("AR-CANON-005", "Canonical URL is syntactically resolvable", "det", "P1", E.URL, canonical_resolvable),
    Rule("AR-CANON-006", "Canonical target returns final 200", "det", "P1", E.URL, canonical_target_status),
    Rule("AR-CANON-007", "Canonical target is not noindex", "det", "P1", E.URL, canonical_target_noindex),
    Rule("AR-CANON-008", "Redirect chain exceeds one hop", "det", "P1", E.URL, redirect_chain),
    Rule("AR-CANON-009", "Redirect loop detected", "det", "P1", E.URL, redirect_loop),
    Rule("AR-CANON-010", "Redirect final target is available", "det", "P1", E.URL, redirect_target),
    Rule("AR-CANON-011", "Pagination exposes crawlable next-page link", "ass", "P1", E.URL, pagination),
    Rule("AR-LINK-001", "Internal navigation target lacks crawlable href", "ass", "P1", E.LINK, navigation_href),
    Rule("AR-LINK-002", "Internal link targets 3xx", "det", "P1", E.LINK, link_class(3)),
    Rule("AR-LINK-003", "Internal link targets 4xx", "det", "P1", E.LINK, link_class(4)),
    Rule("AR-LINK-004", "Internal link targets 5xx", "det", "P1", E.LINK, link_class(5)),
    Rule("AR-LINK-005", "Orphan candidate relative to supplied discovery sources", "ass", "P1", E.URL, orphan_candidate),
    Rule("AR-LINK-006", "Priority-page crawl depth review", "man", "P1", E.URL, priority_depth),
    Rule("AR-DISC-001", "Sitemap presence matches project policy", "ass", "P1", E.SITE, sitemap_presence),
    Rule("AR-DISC-002", "Sitemap document returns 200", "det", "P1", E.SITEMAP, sitemap_status),
    Rule("AR-DISC-003", "Sitemap is parseable", "det", "P1", E.SITEMAP, sitemap_parse),
    Rule("AR-DISC-004", "Sitemap-listed URL returns final 200", "det", "P1", E.ENTRY, entry_status),
    Rule("AR-DISC-005", "Sitemap-listed URL is not noindex", "det", "P1", E.ENTRY, entry_noindex),
    Rule("AR-DISC-006", "Sitemap-listed URL canonicalizes to itself when canonical is declared", "det", "P1", E.ENTRY, entry_canonical),
    Rule("AR-ENTITY-001", "Structured-data block parses successfully", "det", "P2", E.BLOCK, structured_data),
    Rule("AR-RENDER-001", "Title changes after render", "det", "P1", E.URL, render_text("title_raw", "title_rendered")),
    Rule("AR-RENDER-002", "Canonical changes after render", "det", "P1", E.URL, render_set("canonical_raw", "canonical_rendered", "\n", malformed=_URLS)),
    Rule("AR-RENDER-003", "Robots directives change after render", "det", "P1", E.URL, render_set("meta_robots_raw", "meta_robots_rendered", "[,\n]", lower=True, malformed=r"^[a-z0-9_:. /+-]+$")),
    Rule("AR-RENDER-004", "H1 set changes after render", "det", "P1", E.URL, render_set("h1_raw", "h1_rendered", "\n")),
    Rule("AR-RENDER-005", "Main-text presence changes after render", "det", "P1", E.URL, render_flag("main_text_present_raw", "main_text_present_rendered")),
    Rule("AR-RENDER-006", "Crawlable internal-link set changes after render", "det", "P1", E.URL, render_set("internal_links_raw", "internal_links_rendered", "\n")),
    Rule("AR-AI-001", "OAI-SearchBot robots access matches project policy", "ass", "P2", E.URL, bot_policy("robots_allowed_oai_searchbot", "oai_searchbot_access_policy")),
    Rule("AR-AI-002", "OAI-SearchBot profile encounters access anomaly", "ass", "P2", E.URL, profile_anomaly("oai")),
    Rule("AR-AI-003", "GPTBot configuration matches explicit training policy", "ass", "P2", E.URL, bot_policy("robots_allowed_gptbot", "gptbot_training_policy", mismatch=WARN, unspecified=REVIEW)),
]
BY_ID = {r.id: r for r in RULES}

#: The field whose value is the subject that a rule also reads; others read their own.
LEADS_TO = {
    "AR-ACC-003": "redirect_final_target_subject_ref", "AR-CANON-006": "canonical_target_subject_ref", "AR-CANON-007": "canonical_target_subject_ref", "AR-CANON-010": "redirect_final_target_subject_ref",
    "AR-LINK-002": "link_target_subject_ref", "AR-LINK-003": "link_target_subject_ref", "AR-LINK-004": "link_target_subject_ref",
    "AR-DISC-004": "url_subject_ref", "AR-DISC-005": "url_subject_ref", "AR-DISC-006": "url_subject_ref", "AR-ENTITY-001": "url_subject_ref", "AR-CANON-002": "",
}


def _toggled(url: Column) -> Column:
    return F.when(url.endswith("/"), F.regexp_replace(url, "/$", "")).otherwise(F.concat(url, F.lit("/")))


def evaluate(observations: DataFrame, policies: DataFrame | None = None, crawl_complete: bool = True, rules: list[str] | None = None) -> DataFrame:
    """run_id, rule_id, subject_type, subject_ref, status, severity, automation, evidence.

    ``observations`` as of ``evidence.freeze``; ``policies`` has run_id, policy_key,
    policy_value, scope, target_ref and policy_assignment_id, without conflicts."""
    chosen = [r for r in RULES if rules is None or r.id in rules]
    unknown = set(rules or []) - set(BY_ID)
    if unknown:
        raise KeyError(f"no such rules: {sorted(unknown)}")
    with_checkpoints(observations.sparkSession)
    found = E.states(observations).checkpoint()  # read for each kind of subject and each ref
    empty = F.lit(None).cast("map<string,string>")
    out = []
    for kind in dict.fromkeys(r.subject for r in chosen):
        own = [r for r in chosen if r.subject == kind]
        subjects = found.where(F.col("subject_type") == kind)
        if policies is not None:
            by_url, site = E.policy_maps(policies)
            subjects = subjects.join(by_url.withColumnRenamed("target_ref", "subject_ref"), ["run_id", "subject_ref"], "left")
            subjects = subjects.withColumn("_url", S.text("url_identity")).join(by_url.select("run_id", F.col("target_ref").alias("_url"), F.col("p").alias("p_url")), ["run_id", "_url"], "left")
            subjects = subjects.join(F.broadcast(site.withColumnRenamed("p", "s")), "run_id", "left")
        else:
            subjects = subjects.withColumns({"p": empty, "p_url": empty, "s": empty})
        subjects = subjects.withColumn("crawl_complete", F.lit(crawl_complete))
        if any(r.id == "AR-INDEX-006" for r in own):
            sites = found.where(F.col("subject_type") == E.SITE).groupBy("run_id").agg(F.first("o").alias("site"))
            subjects = subjects.join(F.broadcast(sites), "run_id", "left")
        for field in dict.fromkeys(LEADS_TO.get(r.id) for r in own):
            part = [r for r in own if LEADS_TO.get(r.id) == field]
            rows = subjects
            if field is not None:
                ref = S.text(field) if field else _toggled(S.text("url_identity"))
                urls = found.where(F.col("subject_type") == E.URL)
                key = F.col("subject_ref") if field else S.text("url_identity")
                # Null and blank refs lead nowhere: they stay on this side of the join.
                target = urls.select("run_id", key.alias("_ref"), F.col("o").alias("to"))
                rows = rows.withColumn("_ref", ref).join(target if field else target.where("_ref IS NOT NULL").dropDuplicates(["run_id", "_ref"]), ["run_id", "_ref"], "left")
            out.append(rows.select("run_id", "subject_type", "subject_ref", F.explode(F.array(*(_result(r) for r in part))).alias("x")).select("run_id", "subject_type", "subject_ref", "x.*"))
    return reduce(DataFrame.unionByName, out)


def _result(r: Rule) -> Column:
    refs = F.array_sort(F.array_distinct(F.transform(F.map_values("o"), lambda s: s["obs"])))
    return F.struct(F.lit(r.id).alias("rule_id"), r.decide().alias("status"), F.lit(r.severity).alias("severity"), F.lit(r.automation).alias("automation"), refs.alias("evidence"))


def registry(spark) -> DataFrame:
    return spark.createDataFrame([(r.id, r.name, r.automation, r.severity, r.subject) for r in RULES], "rule_id string, name string, automation string, severity string, subject_type string")


def findings(results: DataFrame, samples: int = 5) -> DataFrame:
    """run_id, rule_id, status, severity, affected, samples: results that ask for attention,
    by rule. Samples are the first subjects by name, kept without gathering all."""
    bad = results.where(F.col("status").isin(FAIL, WARN, REVIEW))
    counts = bad.groupBy("run_id", "rule_id", "status", "severity").agg(F.count("*").alias("affected"))
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("run_id", "rule_id", "status").orderBy("subject_ref"))
    few = bad.withColumn("_k", order).where(F.col("_k") <= samples).groupBy("run_id", "rule_id", "status").agg(F.sort_array(F.collect_list("subject_ref")).alias("samples"))
    return counts.join(few, ["run_id", "rule_id", "status"])


def manual_reviews(results: DataFrame) -> DataFrame:
    return results.where(F.col("status") == REVIEW).select("run_id", F.concat_ws(":", F.lit("mrt"), "rule_id", "subject_ref").alias("task_id"), "rule_id", "subject_type", "subject_ref", F.lit("OPEN").alias("state"))
