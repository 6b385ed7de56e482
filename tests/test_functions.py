from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from crawlquilt.functions import text, urls
from crawlquilt.operators import duplicates
from crawlquilt.sources import html, robots


def values(spark, rows, *cols, schema="a string, b string, c string"):
    width = len(schema.split(","))
    df = spark.createDataFrame([(r if isinstance(r, tuple) else (r,)) + (None,) * (width - (len(r) if isinstance(r, tuple) else 1)) for r in rows], schema)
    return [tuple(r) if len(cols) > 1 else r[0] for r in df.select(*cols).collect()]


def test_frontier_keys(spark):
    cases = {
        "HTTP://Example.com:80/A/": "http://example.com/A/", "https://www.example.com": "https://www.example.com/", "https://e.com:8443/x#f": "https://e.com:8443/x", "https://e.com/?b=2&utm_source=x&a=1&GCLID=3&a=0": "https://e.com/?a=1&a=0&b=2",
        "https://e.com/p?fbclid=1": "https://e.com/p", "not a url": "\x00not a url", " https://u:p@e.com:443/q?x ": "https://e.com/q?x=",
    }
    assert values(spark, list(cases), urls.frontier_key("a")) == list(cases.values())
    assert values(spark, ["https://e.com/a?b=1#c"], urls.frontier_key("a", ignore_query=True)) == ["https://e.com/a"]


def test_evidence_urls(spark):
    cases = {
        "HTTPS://EXAMPLE.COM/Page": "https://example.com/Page", "https://example.com": "https://example.com/", "https://example.com/section#heading": "https://example.com/section",
        "http://example.com:80/about": "http://example.com/about", "https://example.com:443/about": "https://example.com/about", "https://example.com:8443/custom": "https://example.com:8443/custom",
    }
    assert values(spark, list(cases), urls.evidence_url("a")) == list(cases.values())
    assert values(spark, ["HTTP://A.com/x?Q#z", "nope"], urls.redirect_key("a")) == ["http://a.com/x?Q", "nope"]


def test_hosts_and_extensions(spark):
    assert values(spark, ["https://WWW.a.co.uk/x.HTML?y.pdf", "http://b.c.d:9/"], urls.registrable_host(urls.host("a")), urls.root_domain(urls.registrable_host(urls.host("a"))), urls.url_extension("a")) == [("a.co.uk", "a.co.uk", "html"), ("b.c.d", "c.d", "")]
    assert values(spark, [("a.com", "www.a.com"), ("a.com", "blog.a.com")], urls.same_site(F.col("a"), F.col("b")), urls.same_site(F.col("a"), F.col("b"), True)) == [(True, True), (False, True)]
    assert values(spark, ["example.com/x", "//e.com", "mailto:a@b", "", "http://x", "e.com:8080/a"], urls.normalize_input("a")) == ["https://example.com/x", "https://e.com", None, None, "http://x", "https://e.com:8080/a"]


def test_resolution_of_links_and_canonicals(spark):
    rows = [("https://e.com/a/b", "../c#d"), ("https://e.com/", "mailto:x@y"), ("https://e.com/", "#top"), ("https://e.com/", "//f.com/g"), ("https://e.com/", "http://[bad")]
    assert values(spark, rows, urls.resolve_link("a", "b")) == ["https://e.com/c", None, None, "https://f.com/g", None]
    rows = [("https://e.com/p", None, "/c"), ("https://e.com/p", "https://f.com/d/", "c"), ("https://e.com/p", None, "http://h:99999/"), ("https://e.com/p", None, "ftp://e.com/x"), (None, None, "/c"), ("https://e.com/p", None, "")]
    assert [r["status"] for r in values(spark, rows, urls.classify_canonical("a", "b", "c"))] == ["valid", "valid", "parser_error", "resolution_error", "insufficient_evidence", "parser_error"]


@pytest.mark.parametrize(("base", "bases", "raw", "want"), [
    ("", 0, "", ("parser_error", "empty_href")), ("", 0, "/a b", ("parser_error", "malformed_url")), ("", 0, "http://[bad", ("parser_error", "malformed_url")),
    ("", 0, "mailto:x@y", ("resolution_error", "unsupported_scheme")), ("", 0, "http:///p", ("resolution_error", "missing_host")), ("", 0, "///p", ("resolution_error", "missing_host")),
    ("/d/", 2, "c", ("insufficient_evidence", "missing_base_context")), ("/d/", 2, "https://f.com/c", "https://f.com/c"), ("/d/", 1, "c", "https://e.com/d/c"), ("#t", 1, "c#x", "https://e.com/a/c"),
    ("/d /", 1, "c", ("insufficient_evidence", "ambiguous_base_fallback")), ("mailto:x", 1, "c", ("resolution_error", "non_hierarchical_base")), ("ftp://f.com/", 1, "c", ("resolution_error", "unsupported_scheme")),
    ("http:///d/", 1, "c", ("insufficient_evidence", "ambiguous_base_fallback")), ("//cdn.e.com/d/", 1, "c", "https://cdn.e.com/d/c"),
])
def test_declared_canonicals(base, bases, raw, want):
    got = urls._declared("https://e.com/a/b", base, bases, raw)
    assert got == (("valid", want, None) if isinstance(want, str) else (want[0], None, ":".join(want)))


@pytest.mark.parametrize(("directives", "want", "found"), [("noindex, follow", "noindex", True), ("googlebot: noindex", "noindex", True), ("max-snippet:-1", "noindex", False), ("unavailable_after: noindex", "noindex", False), (None, "noindex", False)])
def test_robots_tokens(spark, directives, want, found):
    assert values(spark, [directives], text.robots_has_token("a", want)) == [found]


def test_directives(spark):
    rows = ["noindex, follow", "max-snippet:-1", "max-snippet:-2", "unavailable_after: Mon, 02 Jan 2006 15:04:05 GMT, noindex", "noodp", "noindex;nofollow", None]
    got = values(spark, rows, text.parse_directives("a"))
    assert [(len(r["tokens"]), len(r["unsupported"]), len(r["errors"])) for r in got] == [(2, 0, 0), (1, 0, 0), (0, 0, 1), (2, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0)]


def test_lang_codes_and_rel(spark):
    codes = {"en": True, "EN-us": True, "x-default": True, "zh-hant-tw": True, "english": False, "e": False, "en-": False, "es-419": True}
    assert values(spark, list(codes), text.valid_lang_code("a")) == list(codes.values())
    assert values(spark, ["nofollow UGC", "sponsored", None], text.rel_flags("a")) == [6, 8, 0]


def test_json_ld(spark):
    rows = ['{"a": 1}', "[]", "", "  ", '{"a": 1} x', "{", '{"a": NaN}', "﻿{}"]
    assert [r["status"] for r in values(spark, rows, text.parse_json_ld("a"))] == ["PARSE_SUCCESS", "PARSE_SUCCESS", "EMPTY_INPUT", "EMPTY_INPUT", "PARSE_ERROR", "PARSE_ERROR", "PARSE_ERROR", "PARSE_SUCCESS"]


@pytest.mark.parametrize(("a", "b", "want"), [("abcd", "bcde", 0.75), ("abc", "abc", 1.0), ("", "", 1.0), ("abc", "", 0.0), ("kitten", "sitting", 0.6153846153846154), ("the quick brown fox", "the quick brown dog", 0.8947368421052632), ("a" * 250 + "xyz", "a" * 250 + "abc", 0.9881422924901185)])
def test_text_ratios(a, b, want):
    assert abs(duplicates.ratio(a, b) - want) < 1e-9


def test_weighted_similarity():
    page = ("title", "meta", "h1", 50)
    assert abs(duplicates.similarity(page, page) - 1) < 1e-12
    assert abs(duplicates.similarity(("t", "", "", 50), ("t", "", "", 50)) - 0.45) < 1e-12
    assert abs(duplicates.similarity(("", "", "", 50), ("", "", "", 100)) - 0.05) < 1e-12


def test_simhash_is_close_for_close_texts():
    import pandas as pd

    h = duplicates.simhash(pd.Series(["the quick brown fox jumps", "the quick brown fox jumped", "entirely other words here", "", "ab"]))
    near, far = (bin(int(h[0]) ^ int(h[k])).count("1") for k in (1, 2))
    assert near < far and h[3] == 0 and h[4] != 0


BODY = "User-agent: *\nDisallow: /private/\nAllow: /private/ok\nUser-agent: goodbot\nDisallow: /*.pdf$\nCrawl-delay: 2\nSitemap: https://e.com/s.xml # here\n"


@pytest.mark.parametrize(("agent", "path", "allowed"), [("any", "/private/x", False), ("any", "/private/ok", True), ("GoodBot/1.0", "/private/x", True), ("goodbot", "/a.pdf", False), ("goodbot", "/a.pdf?x", True), ("any", "/", True)])
def test_robots_rules(agent, path, allowed):
    assert robots.matched_rule(BODY, agent, path)[0] is allowed


def test_robots_columns(spark):
    rows = [(200, BODY), (404, None), (503, None)]
    df = spark.createDataFrame(rows, "status int, body string")
    out = df.select(robots.robots_decision("status", "body", F.lit("x"), F.lit("/private/a")).alias("d"), robots.sitemap_lines(F.col("body")).alias("s"), robots.crawl_delay(F.col("body")).alias("c")).collect()
    assert [r.d.allowed for r in out] == ["false", "true", "unknown"] and out[0].s == ["https://e.com/s.xml"] and out[0].c == 2.0


def test_sitemaps(spark):
    import gzip

    good = b'<urlset xmlns="http://x"><url><loc> https://e.com/ </loc><lastmod>2026-01-01</lastmod></url><url><loc>https://e.com/b</loc></url></urlset>'
    bodies = {"a": good, "b": gzip.compress(good), "c": b"<sitemapindex><sitemap><loc>x</loc></sitemap></sitemapindex>", "d": b"", "e": b"<urlset>", "f": b"<html/>", "g": None}
    out = {r.url: r for r in robots.sitemaps(spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in bodies.items()], "url string, body binary")).collect()}
    assert [out[k].parse_status for k in "abcdefg"] == ["parsed", "parsed", "parsed", "empty_input", "xml_error", "unsupported_structure", "unavailable"]
    assert [e.loc for e in out["b"].entries] == ["https://e.com/", "https://e.com/b"] and out["c"].doc_type == "sitemapindex"


def test_gzip_data_is_unpacked_up_to_a_limit():
    import gzip

    two = gzip.compress(b"ab" * 50) + gzip.compress(b"cd")
    assert robots.gunzipped(two, 1000) == b"ab" * 50 + b"cd" and robots.gunzipped(two, 7) == b"abababa"
    assert len(robots.gunzipped(gzip.compress(bytes(10**7)), 1 << 10)) == 1 << 10
    assert robots.parse_sitemap(two[:20])[1] == "xml_error"


PAGE = """<!doctype html><html lang="en"><head><meta charset="utf-8"><title> A &amp; B </title><title>second</title><base href="/sub/">
<meta name="description" content=" Some  text "><meta name="robots" content="noindex"><meta property="og:title" content="o"><link rel="canonical" href="c.html"><link rel="alternate" hreflang="vi" href="/vi">
<script type="application/ld+json">{"a": 1}</script><script>gtag('G-ABCDEF1'); hjid</script><style>p{}</style></head>
<body><nav><a href="/n" rel="nofollow">Menu item</a></nav><h1>Head <b>line</b></h1><p>three little words</p><a href="x#y"><img data-src="i.png" alt="pic"></a><a href="mailto:a@b">no</a><footer><a href="https://o.com/">out</a></footer></body></html>"""


def test_extraction():
    d = html.extract(PAGE, "https://e.com/p")
    assert d["titles"] == ["A & B", "second"] and d["meta_descs"] == ["Some text"] and d["h1s"] == ["Head line"] and d["lang"] == "en" and d["charset"] == "utf-8"
    assert d["canonicals"] == ["https://e.com/sub/c.html"] and d["hreflang"] == [{"lang": "vi", "url": "https://e.com/vi"}] and d["meta_robots"] == "noindex" and d["og_tags"] == {"og:title": "o"}
    assert [(a["href"], a["text"], a["placement"], a["flags"]) for a in d["anchors"]] == [("https://e.com/n", "Menu item", 1, 2), ("https://e.com/sub/x", "pic", 0, 0), ("https://o.com/", "out", 2, 0)]
    assert d["images"] == [{"src": "https://e.com/sub/i.png", "alt": "pic"}] and d["json_ld"] == ['{"a": 1}'] and d["analytics"] == {"ga4_id": "G-ABCDEF1", "hotjar": "true"}
    assert 0 < d["text_ratio"] < 1 and d["word_count"] >= d["main_text_words"] >= 5
    assert html.extract(None, "https://e.com/")["word_count"] == 0


@pytest.mark.parametrize(("body", "want"), [
    ('<a rel="next" href="/2">n</a>', ("https://e.com/2", "a", False, True)), ('<button data-next-page="2">n</button>', ("", "button", False, True)), ('<a rel="previous" href="/0">p</a>', ("", "", False, True)),
    ('<li aria-label="Next page">n</li><a rel="next" href="/2">n</a>', ("https://e.com/2", "a", False, True)), ('<a rel="next" href="/2">n</a><a rel="next" href="/3">n</a>', ("https://e.com/2", "a", True, True)),
    ('<a rel="next" href="/2">n</a><a data-next-page href="/2">n</a>', ("https://e.com/2", "a", False, True)), ('<a href="/2">n</a>', ("", "", False, False)),
])
def test_pagination_of_documents(body, want):
    d = html.extract(f"<html><body>{body}</body></html>", "https://e.com/1")
    assert (d["next_url"], d["next_tag"], d["next_conflict"], d["paged"]) == want


@pytest.mark.parametrize(("control", "want"), [
    ('<div data-route="/r">x</div>', [("div", "https://e.com/r")]), ('<a href="#" data-link="/r">x</a>', [("a", "https://e.com/r")]), ("<a href=\"javascript:go('/r')\">x</a>", [("a", "https://e.com/r")]),
    ("<li onclick=\"location='https://o.com/z'\">x</li>", [("li", "https://o.com/z")]), ('<a href="/r" data-link="/s">x</a>', []), ('<button data-target="#menu">x</button>', []), ('<span onclick="toggle()">x</span>', []),
])
def test_controls_in_navigation(control, want):
    found = lambda place: [(c["tag"], c["target"]) for c in html.extract(f"<html><body><{place}>{control}</{place}></body></html>", "https://e.com/1")["nav_candidates"]]
    assert found("nav") == found("header") == want and found("main") == []


def test_robots_elements_of_documents():
    names = {"robots": True, "slurp": True, "google-extended": True, "googlebot-other": True, "somebot": False, "viewport": False}
    assert {n: bool(html.extract(f'<meta name="{n}" content="noindex">', "https://e.com/")["robots_meta"]) for n in names} == names


def test_document_columns(spark):
    df = spark.createDataFrame([(1, "https://e.com/p", PAGE, "x"), (2, "https://e.com/q", None, "y")], "page_id long, url string, html string, extra string")
    out = {r.page_id: r for r in html.facts(html.documents(df)).collect()}
    assert out[1].title == "A & B" and out[1].title_count == 2 and out[1].has_og and out[1].has_structured_data and out[1].images_noalt == 0 and out[2].title == "" and out[1].extra == "x"


def test_robots_groups_are_chosen_by_prefix_and_next_pages_by_label():
    from crawlquilt.sources.html import extract
    from crawlquilt.sources.robots import matched_rule

    body = "User-agent: bot\nDisallow: /\n\nUser-agent: google\nDisallow: /a\n\nUser-agent: *\nDisallow: /b"
    assert matched_rule(body, "Googlebot", "/c") == (True, "") and matched_rule(body, "Googlebot", "/a") == (False, "disallow: /a")
    assert matched_rule(body, "crawler", "/b") == (False, "disallow: /b") and matched_rule(body, "bot", "/c")[0] is False
    labels = {"Next article": "", "Next page": "https://x.org/2", " go to  next page": "https://x.org/2"}
    assert {k: extract(f'<a href="/2" aria-label="{k}">x</a>', "https://x.org/")["next_url"] for k in labels} == labels


def test_exclusions(spark):
    from crawlquilt.operators.issues import DEFAULT_EXCLUSIONS

    cases = {
        ("/wp-admin/x", ""): True, ("/login", ""): True, ("/a/login", ""): False, ("/amp", ""): True, ("/amp2", ""): False, ("/a/search/b", ""): True, ("/data.json", ""): True, ("/data.jsonp", ""): False,
        ("/a", "s=q"): True, ("/a", "x=1&s=q"): False, ("", ""): False, ("/.envx", ""): False, ("/old/\n", ""): True, ("/a", "f=x.json"): True, (None, None): False,
    }
    assert len(DEFAULT_EXCLUSIONS) == len(set(DEFAULT_EXCLUSIONS))
    assert values(spark, list(cases), text.excluded(F.col("a"), F.col("b"), DEFAULT_EXCLUSIONS)) == list(cases.values())
    assert values(spark, [("/a", "x=1"), ("/b", "")], text.excluded(F.col("a"), F.col("b"), [" # /a", "", "/a?x=*"])) == [True, False]
    assert values(spark, [("/a", "x=1")], text.excluded(F.col("a"), F.col("b"), ["#"])) == [False]
