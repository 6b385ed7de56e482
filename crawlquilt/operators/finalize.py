"""Whole-crawl facts: functions of the tables, so running them again changes nothing.

Each returns issue rows (run_id, url_id, code, category, severity, detail) or facts by
page. Pages are found by their frontier key; the last page with a key stands for it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlquilt import schema as S
from crawlquilt.functions.text import valid_lang_code
from crawlquilt.functions.urls import frontier_key
from crawlquilt.schema import Crawl
from crawlquilt.sources.store import with_checkpoints


def _issue(code: str, detail: Column | None = None) -> list[Column]:
    return ["run_id", "url_id", F.lit(code).alias("code"), F.lit(S.CATEGORY[code]).alias("category"), F.lit(S.SEVERITY[code]).alias("severity"), (F.lit("") if detail is None else detail).alias("detail")]


def inlinks(crawl: Crawl) -> DataFrame:
    """run_id, url_id, inlinks, inlinks_uniq of every page, over all kinds of edges."""
    found = crawl.links.groupBy("run_id", F.col("dst_id").alias("url_id")).agg(F.count("*").alias("inlinks"), F.countDistinct("src_id").alias("inlinks_uniq"))
    return crawl.pages.select("run_id", "url_id").join(found, ["run_id", "url_id"], "left").na.fill(0, ["inlinks", "inlinks_uniq"])


def orphans(crawl: Crawl) -> DataFrame:
    """Internal 2xx pages known from a sitemap or by hand that nothing links to."""
    linked = crawl.links.select("run_id", F.col("dst_id").alias("url_id"))
    alone = crawl.pages.where(F.col("is_internal") & (F.col("status_class") == 2) & F.col("discovered_by").isin("sitemap", "manual"))
    return alone.join(linked, ["run_id", "url_id"], "left_anti").select(*_issue("orphan-page"))


def redirect_sources(crawl: Crawl) -> DataFrame:
    """Pages that link to an internal redirect."""
    moved = crawl.pages.where(F.col("is_internal") & (F.col("status_class") == 3)).select("run_id", F.col("url_id").alias("dst_id"))
    return crawl.links.join(moved, ["run_id", "dst_id"], "left_semi").select("run_id", F.col("src_id").alias("url_id")).distinct().select(*_issue("internal-redirect"))


def broken_images(crawl: Crawl) -> DataFrame:
    """Pages with an image that can't be had; the detail is the first such url by name."""
    gone = (F.col("status") >= 400) | ((F.col("status") == 0) & ~F.col("error_type").isin("", "file-too-large"))
    images = crawl.pages.where(gone).select("run_id", F.col("url_id").alias("dst_id"), "url")
    found = crawl.links.where(F.col("flags").bitwiseAND(S.LINK_IMAGE) != 0).join(images, ["run_id", "dst_id"])
    return found.groupBy("run_id", F.col("src_id").alias("url_id")).agg(F.min("url").alias("_url")).select(*_issue("broken-image", F.col("_url")))


def keyed(pages: DataFrame) -> DataFrame:
    """One page for each frontier key, the last by id, with the key of its canonical."""
    facts = F.struct("url_id", "url", "status", F.col("indexable").alias("indexable"), "canonical")
    one = pages.withColumn("key", frontier_key("url")).groupBy("run_id", "key").agg(F.max_by(facts, "url_id").alias("f"))
    canonical = F.when(F.col("f.canonical") == "", F.lit(None)).otherwise(frontier_key(F.col("f.canonical")))
    return one.select("run_id", "key", F.col("f.url").alias("k_url"), F.col("f.status").alias("k_status"), F.col("f.indexable").alias("k_indexable"), F.col("f.canonical").alias("k_canonical"), canonical.alias("next"))


def _canonical_starts(crawl: Crawl) -> DataFrame:
    rows = crawl.pages.where(F.col("is_internal") & (F.col("canonical") != "")).select("run_id", "url_id", frontier_key("url").alias("own"), frontier_key("canonical").alias("key"))
    return rows.where("own <> key")


def canonical_targets(crawl: Crawl) -> DataFrame:
    """Canonicals inside the crawl whose target isn't 2xx, or can't be indexed."""
    found = _canonical_starts(crawl).join(keyed(crawl.pages), ["run_id", "key"])
    bad = ~F.col("k_status").between(200, 299)
    return found.where(bad).select(*_issue("canonical-to-non-200", F.col("k_url"))).unionByName(found.where(~bad & ~F.col("k_indexable")).select(*_issue("canonical-to-noindex", F.col("k_url"))))


def canonical_walks(crawl: Crawl, hops: int = S.MAX_REDIRECTS) -> DataFrame:
    """Canonicals that lead on: each further hop is a chain (the detail is the last hop's
    target), a key seen before a loop (the detail is the page that closes it). The
    fixed number of hops is unrolled as joins on the key."""
    with_checkpoints(crawl.pages.sparkSession)
    table = keyed(crawl.pages).checkpoint()  # each hop joins it
    start = _canonical_starts(crawl).join(table.select("run_id", "key"), ["run_id", "key"], "left_semi").checkpoint()
    walk = start.select("run_id", "url_id", "key", F.array("own", "key").alias("seen"))
    out = []
    for hop in range(hops):
        step = walk.join(table, ["run_id", "key"]).where(F.col("next").isNotNull() & (F.col("next") != F.col("key")))
        back = F.array_contains("seen", F.col("next"))
        out.append(step.where(back).select("run_id", "url_id", F.lit(hop).alias("hop"), F.lit("canonical-loop").alias("code"), F.col("k_url").alias("detail")))
        on = step.where(~back)
        out.append(on.select("run_id", "url_id", F.lit(hop).alias("hop"), F.lit("canonical-chain").alias("code"), F.col("k_canonical").alias("detail")))
        walk = on.select("run_id", "url_id", F.col("next").alias("key"), F.array_append("seen", F.col("next")).alias("seen"))
    found = reduce(DataFrame.unionByName, out).groupBy("run_id", "url_id", "code").agg(F.max_by("detail", "hop").alias("detail"))
    pick = lambda table: F.when(F.col("code") == "canonical-loop", table["canonical-loop"]).otherwise(table["canonical-chain"])
    return found.select("run_id", "url_id", "code", pick(S.CATEGORY).alias("category"), pick(S.SEVERITY).alias("severity"), "detail")


def hreflang(crawl: Crawl) -> DataFrame:
    """Issues of the alternates (``hreflang``: array of lang and url) of internal 2xx pages."""
    page = F.col("is_internal") & (F.col("kind") == S.HTML) & (F.col("status_class") == 2)
    have = crawl.pages.where(page & (F.size("hreflang") > 0)).withColumn("own", frontier_key("url"))
    alts = have.select("run_id", "url_id", "url", "own", F.explode("hreflang").alias("a")).select("run_id", "url_id", "url", "own", "a.lang", F.col("a.url").alias("alt"))
    alts = alts.withColumn("key", frontier_key("alt")).withColumn("self", F.col("key") == F.col("own"))
    table = keyed(crawl.pages)
    links = alts.select("run_id", F.col("own").alias("key"), F.col("key").alias("own")).distinct().withColumn("back", F.lit(True))
    speaks = alts.select("run_id", F.col("own").alias("key")).distinct().withColumn("speaks", F.lit(True))
    found = alts.join(table, ["run_id", "key"], "left").join(speaks, ["run_id", "key"], "left").join(links, ["run_id", "key", "own"], "left")
    other = ~F.col("self") & F.col("k_status").isNotNull()
    live = other & F.col("k_status").between(200, 299)
    elsewhere = F.col("next").isNotNull() & (F.col("next") != F.col("key"))
    rules = [
        ("hreflang-invalid-code", ~valid_lang_code("lang"), F.col("lang")),
        ("hreflang-to-non-200", other & ~F.col("k_status").between(200, 299), F.col("k_url")),
        ("hreflang-non-canonical", live & elsewhere, F.col("k_url")),
        ("hreflang-no-return-tag", live & F.col("speaks").isNotNull() & F.col("back").isNull(), F.col("k_url")),
    ]
    rows = [found.where(when).groupBy("run_id", "url_id").agg(F.max(detail).alias("_d")).select(*_issue(code, F.col("_d"))) for code, when, detail in rules]
    alone = alts.groupBy("run_id", "url_id").agg(F.bool_or("self").alias("self")).where("NOT self").select(*_issue("hreflang-missing-self"))
    return reduce(DataFrame.unionByName, [*rows, alone])


def seed_outcome() -> Column:
    """Why a crawl ended at its seed, the first reason that holds; null if it didn't."""
    return (
        F.when(F.col("error_type") == "dns-not-found", "dns-blocked")
        .when(F.col("robots_state") == "blocked", "robots-blocked")
        .when(F.col("status") == 0, "unreachable")
        .when(F.col("seed_redirected"), "seed-redirect")
        .when(F.col("hit_url_cap"), "max-urls")
        .when(F.col("hit_depth_cap"), "max-depth")
    )
