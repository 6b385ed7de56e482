"""Decisions of the audit rules over hand-made observations."""

from __future__ import annotations

import pytest

from crawlquilt.operators import evidence, rules
from crawlquilt.schema import Crawl

U = "url:r:1"


def observed(spark, *rows):
    """Rows (subject_type, subject_ref, field, value)."""
    data = [("r", *r, f"src{i}", f"obs{i}") for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "run_id string, subject_type string, subject_ref string, field string, value string, source string, observation_id string")


def page(**fields):
    return [("URL", U, k, v) for k, v in {"url_identity": "https://e.com/a", **fields}.items()]


CASES = [
    ("AR-ACC-004", {"http_status": "200"}, "PASS"), ("AR-ACC-004", {"http_status": "503"}, "FAIL"), ("AR-ACC-004", {}, "UNKNOWN"), ("AR-ACC-004", {"http_status": "x"}, "UNKNOWN"),
    ("AR-CANON-003", {"http_status": "404"}, "NOT_APPLICABLE"), ("AR-CANON-003", {"http_status": "200", "content_type": "text/html", "html_extraction_status": "complete"}, "WARNING"),
    ("AR-CANON-003", {"http_status": "200", "content_type": "text/html", "canonical_resolved": "https://e.com/a"}, "PASS"), ("AR-CANON-003", {"http_status": "200", "content_type": "image/png"}, "NOT_APPLICABLE"),
    ("AR-CANON-004", {"canonical_count": "0"}, "NOT_APPLICABLE"), ("AR-CANON-004", {"canonical_count": "1"}, "PASS"), ("AR-CANON-004", {"canonical_count": "2", "canonical_distinct_normalized_count": "2"}, "FAIL"),
    ("AR-CANON-004", {"canonical_count": "2", "canonical_distinct_normalized_count": "1", "canonical_normalization_complete": "true"}, "WARNING"), ("AR-CANON-004", {"canonical_count": "2", "canonical_distinct_normalized_count": "1"}, "UNKNOWN"),
    ("AR-CANON-008", {"http_status": "200"}, "NOT_APPLICABLE"), ("AR-CANON-008", {"http_status": "301", "redirect_hop_count": "1", "redirect_traversal_complete": "true", "redirect_loop_detected": "false"}, "PASS"),
    ("AR-CANON-008", {"http_status": "301", "redirect_hop_count": "3", "redirect_traversal_complete": "true", "redirect_loop_detected": "false"}, "FAIL"), ("AR-CANON-008", {"http_status": "301", "redirect_hop_count": "3"}, "UNKNOWN"),
    ("AR-CANON-009", {"http_status": "302", "redirect_loop_detected": "true"}, "FAIL"), ("AR-CANON-009", {"http_status": "302", "redirect_loop_detected": "true", "redirect_traversal_complete": "true"}, "UNKNOWN"), ("AR-CANON-009", {"http_status": "302", "redirect_loop_detected": "false", "redirect_traversal_complete": "true"}, "PASS"),
    ("AR-CANON-011", {"pagination_detected": "true", "has_next_page": "true", "next_page_element_tag": "button", "next_page_url": "https://e.com/2"}, "WARNING"), ("AR-CANON-011", {"pagination_detected": "true", "has_next_page": "true", "next_page_element_tag": "a", "next_page_url": "https://e.com/2"}, "PASS"), ("AR-CANON-011", {}, "NOT_APPLICABLE"),
    ("AR-ACC-006", {}, "NOT_APPLICABLE"), ("AR-ACC-006", {"profile_comparison_enabled": "true", "default_profile_status": "200", "googlebot_profile_status": "403"}, "WARNING"), ("AR-ACC-006", {"profile_comparison_enabled": "true", "default_profile_status": "200", "googlebot_profile_status": "200"}, "PASS"),
    ("AR-ACC-008", {"profile_comparison_enabled": "true", "default_profile_status": "200", "bot_profile_status": "500"}, "UNKNOWN"), ("AR-AI-002", {"profile_comparison_enabled": "true", "default_profile_status": "200", "oai_profile_status": "503"}, "WARNING"),
    ("AR-INDEX-002", {}, "NOT_APPLICABLE"), ("AR-INDEX-002", {"robots_directive_tokens": "index,noindex"}, "FAIL"), ("AR-INDEX-002", {"robots_directive_tokens": "noindex"}, "PASS"),
    ("AR-INDEX-003", {"robots_parse_errors": "unsupported_directive:noodp"}, "WARNING"), ("AR-INDEX-003", {"robots_directive_tokens": "noindex"}, "UNKNOWN"),
    ("AR-INDEX-003", {"robots_directive_tokens": "noindex", "robots_parse_errors": "none", "http_status": "200", "content_type": "text/html", "http_header_status": "complete", "html_extraction_status": "complete"}, "PASS"),
    ("AR-INDEX-006", {"http_status": "404"}, "NOT_APPLICABLE"), ("AR-INDEX-006", {"http_status": "200", "content_fingerprint": "x", "known_404_fingerprint": "x", "known_404_reliable": "true"}, "WARNING"), ("AR-INDEX-006", {"http_status": "200", "content_fingerprint": "x"}, "UNKNOWN"),
    ("AR-RENDER-001", {}, "NOT_APPLICABLE"), ("AR-RENDER-001", {"render_requested": "true", "rendered": "false"}, "UNKNOWN"),
    ("AR-RENDER-001", {"render_requested": "true", "rendered": "true", "render_status": "complete", "title_raw": "A  b", "title_rendered": "A b"}, "PASS"), ("AR-RENDER-001", {"render_requested": "true", "rendered": "true", "render_status": "complete", "title_raw": "A", "title_rendered": "B"}, "WARNING"),
    ("AR-RENDER-003", {"render_requested": "true", "rendered": "true", "render_status": "complete", "meta_robots_raw": "noindex, follow", "meta_robots_rendered": "FOLLOW,noindex"}, "PASS"),
    ("AR-RENDER-006", {"render_requested": "true", "rendered": "true", "render_status": "complete", "internal_links_raw": "https://e.com/1", "internal_links_rendered": "https://e.com/1\nhttps://e.com/2"}, "WARNING"),
    ("AR-LINK-005", {}, "NOT_APPLICABLE"), ("AR-LINK-005", {"discovery_sources": "sitemap", "crawl_inlink_count": "0"}, "WARNING"), ("AR-LINK-005", {"discovery_sources": "sitemap", "crawl_inlink_count": "2"}, "PASS"), ("AR-LINK-005", {"discovery_sources": "sitemap", "is_start_url": "true"}, "NOT_APPLICABLE"),
    ("AR-INDEX-005", {"nosnippet": "true"}, "WARNING"), ("AR-INDEX-005", {"data_nosnippet_count": "2"}, "MANUAL_REVIEW"), ("AR-INDEX-005", {}, "UNKNOWN"),
]


def test_url_rules(spark):
    rows, want = [], {}
    for i, (rule, fields, status) in enumerate(CASES):
        rows += [("URL", f"url:r:{i}", k, v) for k, v in {"url_identity": f"https://e.com/{i}", **fields}.items()]
        want[f"url:r:{i}", rule] = status
    out = {(r.subject_ref, r.rule_id): r.status for r in rules.evaluate(observed(spark, *rows), rules=sorted({r for r, *_ in CASES})).collect()}
    assert {k: out[k] for k in want} == want


def test_conflicts_are_unknown(spark):
    out = rules.evaluate(observed(spark, *page(http_status="200"), ("URL", U, "http_status", "500")), rules=["AR-ACC-004"]).collect()
    assert [r.status for r in out] == ["UNKNOWN"]
    twice = rules.evaluate(observed(spark, *page(http_status="200"), ("URL", U, "http_status", " 200")), rules=["AR-ACC-004"]).collect()
    assert [r.status for r in twice] == ["PASS"] and twice[0].evidence


@pytest.mark.parametrize(("rule", "field", "key", "table"), [
    ("AR-ACC-005", "robots_allowed_googlebot", "googlebot_access_policy", {("true", "allow"): "PASS", ("true", "block"): "FAIL", ("false", "block"): "PASS", ("false", "allow"): "FAIL", ("false", "unspecified"): "WARNING", ("true", "unspecified"): "PASS", ("unknown", "allow"): "UNKNOWN"}),
    ("AR-AI-003", "robots_allowed_gptbot", "gptbot_training_policy", {("true", "allow"): "PASS", ("true", "block"): "WARNING", ("false", "unspecified"): "MANUAL_REVIEW", ("unknown", "block"): "UNKNOWN"}),
])
def test_bot_policies(spark, rule, field, key, table):
    rows, policies, want = [], [], {}
    for i, ((allowed, policy), status) in enumerate(table.items()):
        rows += [("URL", f"url:r:{i}", "url_identity", f"https://e.com/{i}"), ("URL", f"url:r:{i}", field, allowed)]
        target = f"url:r:{i}" if i % 2 else f"https://e.com/{i}"
        policies.append((f"p{i}", "r", key, policy, "URL", target))
        want[f"url:r:{i}"] = status
    policies.append(("ps", "r", key, "block", "SITE", "site"))
    rows += [("URL", "url:r:99", "url_identity", "https://e.com/99"), ("URL", "url:r:99", field, "false")]
    want["url:r:99"] = "PASS"
    frame = spark.createDataFrame(policies, "policy_assignment_id string, run_id string, policy_key string, policy_value string, scope string, target_ref string")
    assert {r.subject_ref: r.status for r in rules.evaluate(observed(spark, *rows), frame, rules=[rule]).collect()} == want
    assert evidence.policy_conflicts(frame).count() == 0


def test_rules_that_follow_refs(spark):
    a, b = "url:r:1", "url:r:2"
    rows = [
        ("URL", a, "url_identity", "https://e.com/a"), ("URL", a, "http_status", "200"), ("URL", a, "canonical_count", "1"), ("URL", a, "canonical_distinct_normalized_count", "1"), ("URL", a, "canonical_normalization_complete", "true"), ("URL", a, "canonical_target_subject_ref", b),
        ("URL", a, "canonical_normalized_target", "https://e.com/b"), ("URL", b, "url_identity", "https://e.com/b"), ("URL", b, "http_status", "301"), ("URL", b, "effective_noindex", "true"),
        *[("LINK", "link:r:1:1", k, v) for k, v in (("link_is_internal", "true"), ("link_target", "https://e.com/b"), ("link_source_url", "https://e.com/a"), ("link_source_subject_ref", a), ("link_target_subject_ref", b), ("navigation_candidate", "true"), ("element_tag", "div"), ("href", "x"))],
        *[("SITEMAP_ENTRY", "sme:r:1:1", k, v) for k, v in (("loc_normalized", "https://e.com/a"), ("url_subject_ref", a))],
        *[("SITEMAP", "sm:r:1", k, v) for k, v in (("sitemap_url", "https://e.com/s"), ("initial_http_status", "200"), ("final_http_status", "200"), ("sitemap_parse_status", "xml_error"))],
        *[("SITE", "site", k, v) for k, v in (("site_https_url", "https://e.com/"), ("fetch_attempted", "true"), ("tls_valid", "false"), ("sitemaps_found_count", "0"), ("sitemap_discovery_complete", "true"), ("sitemap_discovery_status", "COMPLETED"))],
        *[("STRUCTURED_DATA_BLOCK", "sdb:1", k, v) for k, v in (("structured_block_id", "sdb:1"), ("url_subject_ref", a), ("url", "https://e.com/a"), ("structured_format", "json-ld"), ("structured_parse_status", "PARSE_SUCCESS"), ("structured_raw", "{}"))],
        *[("PROBE", "probe:1", k, v) for k, v in (("missing_probe_url", "https://e.com/none"), ("probe_attempted", "true"), ("probe_status", "200"))],
        *[("RESOURCE", "res:1", k, v) for k, v in (("page_rendered", "true"), ("resource_type", "css"), ("resource_robots_allowed", "false"), ("render_dependency_observed", "true"), ("render_diff_evidence", "true"))],
    ]
    out = {(r.rule_id, r.subject_ref): r.status for r in rules.evaluate(observed(spark, *rows)).collect()}
    want = {
        ("AR-CANON-006", a): "FAIL", ("AR-CANON-007", a): "NOT_APPLICABLE", ("AR-LINK-001", "link:r:1:1"): "WARNING", ("AR-LINK-002", "link:r:1:1"): "FAIL", ("AR-LINK-003", "link:r:1:1"): "PASS", ("AR-DISC-004", "sme:r:1:1"): "PASS", ("AR-DISC-006", "sme:r:1:1"): "FAIL",
        ("AR-DISC-002", "sm:r:1"): "PASS", ("AR-DISC-003", "sm:r:1"): "FAIL", ("AR-ACC-001", "site"): "FAIL", ("AR-DISC-001", "site"): "MANUAL_REVIEW", ("AR-ENTITY-001", "sdb:1"): "PASS", ("AR-INDEX-004", "probe:1"): "FAIL", ("AR-ACC-007", "res:1"): "FAIL",
    }
    assert {k: out[k] for k in want} == want
    assert {rule for rule, _ in out} == {r.id for r in rules.RULES}
    assert len(rules.RULES) == 47 and [sum(r.automation == x for r in rules.RULES) for x in ("det", "ass", "man")] == [30, 16, 1]


def test_findings_and_problems(spark):
    rows = [("URL", f"url:r:{i}", k, v) for i in range(9) for k, v in (("url_identity", f"https://e.com/{i}"), ("http_status", "500" if i < 7 else "200"))]
    results = rules.evaluate(observed(spark, *rows), rules=["AR-ACC-004"])
    found = rules.findings(results, samples=3).collect()
    assert [(r.rule_id, r.status, r.affected, r.samples) for r in found] == [("AR-ACC-004", "FAIL", 7, ["url:r:0", "url:r:1", "url:r:2"])]
    assert rules.manual_reviews(results).count() == 0
    bad = observed(spark, ("URL", "", "x", "1")).unionByName(observed(spark, ("URL", U, "x", "1")))
    assert {r.problem for r in evidence.problems(bad).collect()} == {"missing", "not unique"}
    with pytest.raises(KeyError):
        rules.evaluate(results, rules=["AR-NONE"])


def test_entries_lead_to_the_url_that_they_name(spark):
    """Two pages share a url, so only the id tells which of them an entry is of."""
    urls = [(1, "https://e.com/a"), (2, "https://e.com/a"), (3, "https://e.com/c"), (4, "")]
    pages = spark.createDataFrame([("r", i, u) for i, u in urls], "run_id string, url_id long, url string")
    crawl = Crawl(pages=pages, urls=pages.withColumnRenamed("url_id", "id"))
    named = [(1, 1, "https://e.com/a"), (2, 2, "HTTPS://E.com/a"), (3, 3, "https://e.com/other"), (4, 0, "https://e.com/c"), (5, None, "https://e.com/c"), (6, 9, "https://e.com/c"), (7, 4, "")]
    entries = spark.createDataFrame([("r", 1, *x) for x in named], "run_id string, sitemap_id int, seq int, url_id long, loc string")
    subject = lambda rows: {r.subject_ref: r.value for r in evidence.entry_observations(rows, crawl).where("field = 'url_subject_ref'").collect()}
    assert subject(entries) == {"sme:r:1:1": "url:r:1", "sme:r:1:2": "url:r:2"}
    assert subject(entries.drop("url_id").where("seq in (1, 5)")) == {"sme:r:1:5": "url:r:3"}
