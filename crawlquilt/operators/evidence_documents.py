"""Observations from document columns, robots.txt, renders and sitemap discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlquilt.functions.directives import ANY, directive_bundles
from crawlquilt.functions.text import parse_json_ld
from crawlquilt.functions.urls import host, path
from crawlquilt.operators.evidence import BLOCK, LINK, SITE, URL, _known, _rows, url_ref
from crawlquilt.sources.robots import robots_decision

# Agents whose access is observed, and the field's ending of each.
AGENTS = {"crawler": "default", "Googlebot": "googlebot", "OAI-SearchBot": "oai_searchbot", "GPTBot": "gptbot"}
BLOCK_CAP = {"json_ld": 20, "microdata": 40}


def _page() -> Column:
    return F.concat(F.lit("pages:"), F.col("run_id"), F.lit(":"), F.col("url_id").cast("string"))


def robots_observations(pages: DataFrame, robots: DataFrame) -> DataFrame:
    """Access of each agent to each page, by the robots.txt (run_id, host, status, body) of
    its host; unknown without one."""
    rows = pages.select("run_id", "url_id", host("url").alias("host"), F.when(path("url") == "", "/").otherwise(path("url")).alias("path")).join(robots, ["run_id", "host"], "left")
    for agent, name in AGENTS.items():
        rows = rows.withColumn(f"d_{name}", robots_decision(F.col("status").cast("int"), "body", F.lit(agent), "path"))
    fields = {}
    for name in AGENTS.values():
        fields[f"robots_allowed_{name}"] = F.col(f"d_{name}.allowed")
        fields["matched_robots_rule" + ("" if name == "default" else f"_{name}")] = _known(F.col(f"d_{name}.rule"))
    return _rows(rows, URL, url_ref(), fields, _page())


def directive_observations(docs: DataFrame) -> DataFrame:
    """Directives of pages with robots_meta (name, content) and x_robots_headers: a group
    of rows for each bundle, with the bundle's ref as their source, and what follows."""
    names = F.transform("robots_meta", lambda m: m["name"])
    contents = F.transform("robots_meta", lambda m: m["content"])
    each = docs.select("run_id", "url_id", directive_bundles(names, contents, "x_robots_headers").alias("b"))
    bundles = each.select("run_id", "url_id", F.posexplode("b").alias("k", "x"))
    ref = F.concat(F.lit("directive:"), url_ref(), F.lit(":"), F.col("k").cast("string"))
    errors = F.when(F.size("x.errors") > 0, F.array_join("x.errors", ",")).otherwise("none")
    rows = _rows(bundles, URL, url_ref(), {"directive_target": F.col("x.agent"), "robots_directive_tokens": _known(F.array_join("x.tokens", ",")), "robots_parse_errors": errors, "directive_scope_unknown": F.when(F.col("x.unknown_scope") == "true", "true")}, ref)
    mine = lambda b: b["agent"].isin(ANY, "googlebot")
    tokens = F.flatten(F.transform(F.filter("b", mine), lambda b: b["tokens"]))
    unclear = F.exists("b", lambda b: b["unknown_scope"] == "true")
    noindex = F.exists(tokens, lambda t: t.isin("noindex", "none"))
    limits = F.transform(F.filter(tokens, lambda t: t.rlike("^max-snippet: *[0-9]+$")), lambda t: F.trim(F.regexp_replace(t, "^max-snippet:", "")).cast("long"))
    # Per agent, index and noindex together are a conflict, whichever part each is from.
    same = F.exists("b", lambda b: F.array_contains(b["tokens"], "noindex") & F.exists("b", lambda c: (c["agent"] == b["agent"]) & (F.array_contains(c["tokens"], "index") | F.array_contains(c["tokens"], "all"))))
    derived = {
        "effective_noindex": F.when(noindex, "true").when(~unclear, "false"), "nosnippet": F.when(F.exists(tokens, lambda t: t.isin("nosnippet", "none")), "true").when(~unclear, "false"),
        "max_snippet": F.array_min(limits), "directive_scope_conflict": F.when(same, "true"),
    }
    return rows.unionByName(_rows(each, URL, url_ref(), derived, _page()))


def block_observations(docs: DataFrame) -> DataFrame:
    """Structured-data blocks: JSON-LD is parsed strictly, microdata is known in part only."""
    base = docs.select("run_id", "url_id", "url", "json_ld", "microdata")
    json = base.select("run_id", "url_id", "url", F.posexplode("json_ld").alias("k", "raw")).withColumn("p", parse_json_ld("raw"))
    micro = base.select("run_id", "url_id", "url", F.posexplode("microdata").alias("k", "raw"))
    ref = lambda kind: F.concat_ws(":", F.lit("sdb"), "run_id", F.col("url_id").cast("string"), F.lit(kind), F.col("k").cast("string"))
    common = lambda kind, form: {"structured_block_id": ref(kind), "structured_format": F.lit(form), "url": F.col("url"), "url_subject_ref": url_ref()}
    out = _rows(json, BLOCK, ref("jsonld"), {**common("jsonld", "json-ld"), "structured_raw": F.col("raw"), "structured_parse_status": F.col("p.status"), "structured_parse_error": F.col("p.error")}, _page())
    out = out.unionByName(_rows(micro, BLOCK, ref("microdata"), {**common("microdata", "microdata"), "structured_parse_status": F.lit("PARTIAL_ACQUISITION")}, _page()))
    refs = _rows(json, URL, url_ref(), {"structured_block_ref": ref("jsonld")}, ref("jsonld")).unionByName(_rows(micro, URL, url_ref(), {"structured_block_ref": ref("microdata")}, ref("microdata")))
    return out.unionByName(refs)


def document_observations(docs: DataFrame, seed_host: str) -> DataFrame:
    """Pagination (links that lead to different next pages leave the element unknown),
    snippets and main text of documents; controls in navigation that lead
    somewhere without a link are links of their own, internal on the seed's host."""
    more = (F.col("next_url") != "") | (F.col("next_tag") != "")
    paged = more | F.col("paged") | (F.col("prev_url") != "")
    fields = {
        "pagination_detected": paged, "has_next_page": F.when(paged, more), "next_page_url": _known(F.col("next_url")), "next_page_element_tag": F.when(more & ~F.col("next_conflict"), F.coalesce(_known(F.col("next_tag")), F.lit("a"))),
        "data_nosnippet_count": F.col("data_nosnippet_count"), "main_text_present_raw": F.col("main_text_words") > 0,
    }
    out = _rows(docs, URL, url_ref(), fields, _page())
    nav = docs.select("run_id", "url_id", "url", F.posexplode("nav_candidates").alias("k", "c"))
    ref = F.concat_ws(":", F.lit("link"), "run_id", F.col("url_id").cast("string"), F.lit("nav"), F.col("k").cast("string"))
    target = _known(F.col("c.target"))
    links = {
        "link_source_url": F.col("url"), "link_source_subject_ref": url_ref(), "link_is_internal": host(F.col("c.target")) == seed_host, "navigation_candidate": F.lit(True), "element_tag": F.col("c.tag"), "resolved_internal_target": target,
    }
    return out.unionByName(_rows(nav, LINK, ref, links, ref))


def render_observations(raw: DataFrame, rendered: DataFrame, asked: DataFrame) -> DataFrame:
    """What pages say before and after rendering; ``asked`` has run_id, url_id and status of
    every page that was to be rendered. Lists are one value, joined by line ends."""
    keys = ["run_id", "url_id"]
    first = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit(""))
    side = lambda df, s: df.select(*keys, *(c.alias(f"{k}_{s}") for k, c in {
        "title": first("titles"), "canonical": F.array_join("canonicals", "\n"), "meta_robots": F.col("meta_robots"), "h1": F.array_join("h1s", "\n"),
        "main_text_present": F.col("main_text_words") > 0, "internal_links": F.array_join(F.array_sort(F.array_distinct(F.transform("anchors", lambda a: a["href"]))), "\n"),
    }.items()))
    rows = asked.join(side(raw, "raw"), keys, "left").join(side(rendered, "rendered"), keys, "left")
    done = F.col("status") == "complete"
    fields = {"render_requested": F.lit(True), "rendered": done, "render_status": F.col("status")}
    for name in ("title", "canonical", "meta_robots", "h1", "main_text_present", "internal_links"):
        for s in ("raw", "rendered"):
            fields[f"{name}_{s}"] = F.when(done, F.col(f"{name}_{s}").cast("string"))
    return _rows(rows, URL, url_ref(), fields, _page())


def discovery_observations(discovery: DataFrame) -> DataFrame:
    """Sitemap discovery of a run, on its site."""
    fields = {
        "sitemap_discovery_status": _known(F.col("status")), "sitemap_discovery_complete": F.col("status") == "COMPLETED", "sitemaps_found_count": F.col("sitemaps_found"), "sitemap_entries_found_count": F.col("entries_found"),
        "sitemap_depth_capped": F.col("depth_capped"), "sitemap_urls_capped": F.col("urls_capped"), "sitemap_byte_capped": F.col("byte_capped"), "sitemap_discovery_stop_reason": _known(F.col("stop_reason")),
    }
    return _rows(discovery, SITE, F.lit("site"), fields, F.concat(F.lit("sitemap_discovery:"), F.col("run_id")))


def https_observations(pages: DataFrame, seed_url: str) -> DataFrame:
    """Whether the site answers by https: the page of the seed's host root over https."""
    site = F.concat(F.lit("https://"), host(F.lit(seed_url)), F.lit("/"))
    rows = pages.where(F.col("url").isin(seed_url) | (F.lower("url") == site)).where(F.lower("url").startswith("https://")).groupBy("run_id").agg(F.min_by(F.struct("url", "status", "error_type"), "url_id").alias("x"))
    fields = {
        "site_https_url": F.col("x.url"), "fetch_attempted": F.lit(True), "fetch_status": F.col("x.status"), "tls_valid": F.when(F.col("x.status") > 0, "true").when(F.col("x.error_type") == "ssl-error", "false"), "fetch_error_type": _known(F.col("x.error_type")),
    }
    return _rows(rows, SITE, F.lit("site"), fields, F.concat(F.lit("pages:"), F.col("run_id"), F.lit(":site")))


def gaps(docs: DataFrame) -> DataFrame:
    """What evidence doesn't hold: capped lists by page, and what a crawl never records."""
    capped = [F.struct(F.lit(f"{k}_extraction_cap").alias("field"), (F.size(k) >= n).alias("hit")) for k, n in BLOCK_CAP.items()]
    hit = docs.select("run_id", url_ref().alias("subject_ref"), F.explode(F.array(*capped)).alias("x")).where("x.hit").select("run_id", "subject_ref", F.col("x.field").alias("field"), F.lit("LIST_CAPPED").alias("gap"))
    never = ["href_raw", "retry_attempts", "challenge_detected", "response_headers_ref", "body_artifact_ref", "rdfa_observation", "probe_observation", "profile_comparison_observation"]
    runs = docs.select("run_id").distinct().select("run_id", F.lit("run").alias("subject_ref"), F.explode(F.array(*map(F.lit, never))).alias("field"), F.lit("NOT_RECORDED").alias("gap"))
    return hit.unionByName(runs)
