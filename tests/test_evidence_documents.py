from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from crawlquilt.functions.directives import header_bundles, meta_bundle
from crawlquilt.operators import evidence, rules
from crawlquilt.operators import evidence_documents as D
from crawlquilt.sources import html

HEAD = '<html><head><title>{t}</title><meta name="robots" content="{r}"><link rel="next" href="/2"><script type="application/ld+json">{j}</script></head><body><nav><div data-href="/menu">m</div></nav><h1>h</h1><p itemscope itemtype="T">some words here</p></body></html>'


@pytest.mark.parametrize(("header", "joined", "want"), [
    ("noindex, nofollow", False, [("*", ["noindex"], [], "false"), ("*", ["nofollow"], [], "false")]),
    ("googlebot: noindex, nofollow", False, [("googlebot", ["noindex"], [], "false"), ("googlebot", ["nofollow"], [], "false")]),
    ("googlebot: noindex, nofollow", True, [("googlebot", ["noindex"], [], "false"), ("*", ["nofollow"], ["ambiguous:joined_header_continuation"], "true")]),
    ("googlebot: noindex, gptbot: nofollow", False, [("googlebot", ["noindex"], [], "false"), ("gptbot", ["nofollow"], ["ambiguous:multiple_agent_prefixes"], "true")]),
    ("googlebot:", False, [("googlebot", [], ["parse_error:missing_directive_after_prefix"], "false")]),
    ("max-snippet: 5", False, [("*", ["max-snippet: 5"], [], "false")]),
    ("somebot: noindex", False, [("*", ["noindex"], ["ambiguous:unverified_agent_prefix"], "true")]),
])
def test_header_bundles(header, joined, want):
    assert header_bundles(header, joined) == want


def test_meta_bundles():
    assert meta_bundle("robots", "noindex, noodp") == ("*", ["noindex"], ["unsupported_directive:noodp"], "false")
    assert meta_bundle("robots", " ") is None and meta_bundle("Googlebot", None)[2] == ["parse_error:missing_content"]


def test_documents_to_results(spark):
    pages = [(1, "a", "noindex, index", '{"a": 1}'), (2, "b", "noodp", "{"), (3, "c", "all", "")]
    raw = spark.createDataFrame([("r", i, f"https://e.com/{i}", HEAD.format(t=t, r=r, j=j)) for i, t, r, j in pages], "run_id string, url_id long, url string, html string")
    docs = html.documents(raw).withColumn("x_robots_headers", F.array(F.lit("max-snippet: 7"))).checkpoint()
    later = html.documents(raw.withColumn("html", F.regexp_replace("html", "<title>b", "<title>changed"))).checkpoint()
    known = evidence._rows(docs, "URL", evidence.url_ref(), {"url_identity": F.col("url"), "http_status": F.lit(200), "content_type": F.lit("text/html"), "http_header_status": F.lit("complete"), "html_extraction_status": F.lit("complete")}, F.lit("s"))
    robots = spark.createDataFrame([("r", "e.com", 200, "User-agent: GPTBot\nDisallow: /\nUser-agent: *\nDisallow: /2")], "run_id string, host string, status int, body string")
    discovery = spark.createDataFrame([("r", "COMPLETED", "", 2, 5, False, False, False)], "run_id string, status string, stop_reason string, sitemaps_found int, entries_found int, depth_capped boolean, urls_capped boolean, byte_capped boolean")
    pages_ = raw.select("run_id", "url_id", "url", F.lit(200).alias("status"), F.lit("").alias("error_type"))
    parts = [known, D.robots_observations(raw, robots), D.directive_observations(docs), D.block_observations(docs), D.document_observations(docs, "e.com"), D.render_observations(docs, later, raw.select("run_id", "url_id", F.lit("complete").alias("status"))), D.discovery_observations(discovery), D.https_observations(pages_, "https://e.com/1")]
    found = evidence.freeze(parts, "s1").checkpoint()
    assert evidence.problems(found).count() == 0
    policies = spark.createDataFrame([("p", "r", "expected_crawlable", "true", "SITE", "site"), ("q", "r", "gptbot_training_policy", "allow", "SITE", "site")], "policy_assignment_id string, run_id string, policy_key string, policy_value string, scope string, target_ref string")
    out = {(r.rule_id, r.subject_ref): r.status for r in rules.evaluate(found, policies).collect()}
    of = lambda rule, *refs: [out[rule, ref] for ref in refs]
    urls = ["url:r:1", "url:r:2", "url:r:3"]
    assert of("AR-ACC-002", *urls) == ["PASS", "FAIL", "PASS"] and of("AR-AI-003", *urls) == ["WARNING"] * 3
    assert of("AR-INDEX-002", *urls) == ["FAIL", "PASS", "PASS"] and of("AR-INDEX-003", *urls) == ["PASS", "WARNING", "PASS"] and of("AR-INDEX-005", *urls) == ["WARNING"] * 3
    assert of("AR-ENTITY-001", "sdb:r:1:jsonld:0", "sdb:r:2:jsonld:0", "sdb:r:3:jsonld:0", "sdb:r:1:microdata:0") == ["PASS", "FAIL", "FAIL", "UNKNOWN"]
    assert of("AR-RENDER-001", *urls) == ["PASS", "WARNING", "PASS"] and of("AR-RENDER-004", *urls) == ["PASS"] * 3
    assert of("AR-CANON-011", *urls) == ["PASS"] * 3 and of("AR-LINK-001", "link:r:1:nav:0") == ["WARNING"] and of("AR-DISC-001", "site") == ["PASS"] and of("AR-ACC-001", "site") == ["PASS"]
    assert {r.gap for r in D.gaps(docs).collect()} == {"NOT_RECORDED"}


HOP = "array<struct<url:string,location:string,status:int>>"


def _statuses(spark, found, rules_):
    none = spark.createDataFrame([], "policy_assignment_id string, run_id string, policy_key string, policy_value string, scope string, target_ref string")
    out = {rule: {} for rule in rules_}
    for r in rules.evaluate(found, none, rules=rules_).collect():
        out[r.rule_id][int(r.subject_ref.rsplit(":", 1)[1])] = r.status
    return out


def test_redirect_chains_decide_rules(spark):
    hop = lambda a, b: (f"https://e.com/{a}", b, 301)
    rows = [
        (1, 301, 1, "", [hop(1, "/9#top")]), (2, 301, 2, "", [hop(2, "/1"), hop(1, "https://E.com/8")]), (3, 301, 1, "redirect loop", [hop(3, "/3")]), (4, 301, 2, "", [hop(4, "/9")]),
        (5, 301, 0, "", None), (6, 301, 1, "", [hop(6, "/gone")]), (8, 404, 0, "", []), (9, 200, 0, "", []), (10, 301, 1, "timeout", [hop(10, "/9")]),
    ]
    pages = spark.createDataFrame([("r", i, f"https://e.com/{i}", s, n, e, h) for i, s, n, e, h in rows], f"run_id string, url_id long, url string, status int, redirect_hops int, error string, redirects {HOP}")
    known = evidence._rows(pages, "URL", evidence.url_ref(), {"url_identity": F.col("url"), "http_status": F.col("status"), "redirect_initial_observed": F.col("status").between(300, 399)}, F.lit("s"))
    found = evidence.freeze([known, evidence.redirect_observations(pages)], "s1").checkpoint()
    assert evidence.problems(found).count() == 0
    got = _statuses(spark, found, ["AR-CANON-008", "AR-CANON-009", "AR-CANON-010"])
    assert got["AR-CANON-008"] == {1: "PASS", 2: "FAIL", 3: "UNKNOWN", 4: "UNKNOWN", 5: "UNKNOWN", 6: "PASS", 8: "NOT_APPLICABLE", 9: "NOT_APPLICABLE", 10: "UNKNOWN"}
    assert got["AR-CANON-009"] == {1: "PASS", 2: "PASS", 3: "FAIL", 4: "UNKNOWN", 5: "UNKNOWN", 6: "PASS", 8: "NOT_APPLICABLE", 9: "NOT_APPLICABLE", 10: "UNKNOWN"}
    assert got["AR-CANON-010"] == {1: "PASS", 2: "FAIL", 3: "NOT_APPLICABLE", 4: "UNKNOWN", 5: "UNKNOWN", 6: "UNKNOWN", 8: "NOT_APPLICABLE", 9: "NOT_APPLICABLE", 10: "UNKNOWN"}
    hops = {(r.subject_ref, r.value) for r in found.where("field = 'redirect_hop'").collect()}
    assert len(hops) == 7 and ("url:r:1", '{"hop_index":0,"source_url":"https://e.com/1","status":301,"resolved_target_url":"https://e.com/9"}') in hops
    unfollowed = {r.subject_ref: r.value for r in evidence.redirect_observations(pages, follow=False).where("field = 'redirect_traversal_complete'").collect()}
    assert unfollowed == {f"url:r:{i}": "false" for i in (1, 2, 3, 5, 6, 10)}
    assert evidence.redirect_observations(pages.limit(0)).count() == 0


def test_declared_canonicals_decide_rules(spark):
    heads = {1: '<link rel="canonical" href="/2#x">', 2: "", 3: '<link rel="canonical" href="http://[bad">', 4: '<link rel="canonical" href="/2"><link rel="canonical" href="https://e.com/2">', 5: '<link rel="canonical" href="/1"><link rel="canonical" href="/2">', 6: '<base href="/a/"><base href="/b/"><link rel="canonical" href="c">', 7: '<link rel="canonical" href="/2">' * 7}
    raw = spark.createDataFrame([("r", i, f"https://e.com/{i}", f"<html><head>{h}</head><body>x</body></html>") for i, h in heads.items()], "run_id string, url_id long, url string, html string")
    docs = html.documents(raw).checkpoint()
    known = evidence._rows(raw, "URL", evidence.url_ref(), {"url_identity": F.col("url"), "http_status": F.lit(200), "content_type": F.lit("text/html"), "html_extraction_status": F.lit("complete")}, F.lit("s"))
    found = evidence.freeze([known, evidence.canonical_observations(docs, raw)], "s1").checkpoint()
    got = _statuses(spark, found, ["AR-CANON-004", "AR-CANON-005", "AR-CANON-006"])
    assert got["AR-CANON-005"] == {1: "PASS", 2: "NOT_APPLICABLE", 3: "FAIL", 4: "NOT_APPLICABLE", 5: "NOT_APPLICABLE", 6: "UNKNOWN", 7: "UNKNOWN"}
    assert [got["AR-CANON-004"][i] for i in (1, 2, 4, 5)] == ["PASS", "NOT_APPLICABLE", "WARNING", "FAIL"]
    assert [got["AR-CANON-006"][i] for i in (1, 2, 3, 4, 5, 7)] == ["PASS", "NOT_APPLICABLE", "UNKNOWN", "PASS", "NOT_APPLICABLE", "UNKNOWN"]
