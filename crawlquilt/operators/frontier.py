"""What a crawler would do next: admission, depths, edges, sitemap trees and tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlquilt import schema as S
from crawlquilt.functions.urls import frontier_key, host, same_site, url_extension
from crawlquilt.sources.store import with_checkpoints


def admission(offers: DataFrame, seed_host: str, max_depth: int = 10, max_urls: int = 50000, external: bool = False, subdomains: bool = False, include_ext: list[str] = (), exclude_ext: list[str] = (), include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """url, depth, seq of offered links with key, id and decline_reason (null: queued).

    Ids number the keys by first sight; the first reason that holds is given. A key is
    queued by its first offer that nothing else declines."""
    key = frontier_key("url")
    ext = url_extension("url")
    listed = lambda exts: ext.isin(list(exts)) if exts else F.lit(False)
    fits = lambda patterns: F.col("url").rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)
    own = (
        F.when(host("url") == "", "unparseable")
        .when(F.col("depth") > max_depth, "max-depth")
        .when(~same_site(F.lit(seed_host), host("url"), subdomains) & F.lit(not external), "external")
        .when(listed(exclude_ext) | (F.lit(bool(include_ext)) & (ext != "") & ~listed(include_ext)), "extension")
        .when(fits(exclude) | (F.lit(bool(include)) & ~fits(include)), "pattern")
    )
    keyed = offers.withColumn("key", key).withColumn("_own", own)
    first = keyed.groupBy("key").agg(F.min("seq").alias("first"), F.min(F.when(F.col("_own").isNull(), F.col("seq"))).alias("queued"))
    # Ids: the number of keys seen before. Sights are counted by range of seq, not in one task.
    numbered = dense_ids(first, "first", "id")
    rows = keyed.join(numbered, "key")
    full = F.col("id") > max_urls
    reason = F.when(full, "url-cap").when(F.col("seq") > F.coalesce("queued", F.lit(1 << 62)), "queued-before").otherwise(F.col("_own"))
    return rows.select("url", "depth", "seq", "key", F.when(full, 0).otherwise(F.col("id")).alias("id"), reason.alias("decline_reason"))


def dense_ids(rows: DataFrame, order: str, name: str, width: int = 1 << 16) -> DataFrame:
    """Numbers 1, 2, ... in the order of a column of distinct integers. Counts by stretch
    of the column, and by stretch of stretches, give each its first number, so that no
    task needs all rows, or all stretches where the column is sparse."""
    stretch = F.floor(F.col(order) / width)
    counts = rows.groupBy(stretch.alias("_s")).agg(F.count("*").alias("_n")).withColumn("_g", F.floor(F.col("_s") / width))
    earlier = lambda w, n: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = counts.groupBy("_g").agg(F.sum("_n").alias("_m")).select("_g", earlier(Window.orderBy("_g"), "_m").alias("_first"))
    before = counts.join(groups, "_g").select("_s", (F.col("_first") + earlier(Window.partitionBy("_g").orderBy("_s"), "_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_s").orderBy(order))
    numbered = rows.withColumn("_s", stretch).withColumn("_k", within).join(before, "_s")
    return numbered.withColumn(name, F.col("_before") + F.col("_k")).drop("_s", "_k", "_before")


def depths(seeds: DataFrame, links: DataFrame, max_depth: int = 30) -> DataFrame:
    """id, depth: the least number of links from a seed, by breadth-first rounds. Each
    round joins only what the last one reached."""
    with_checkpoints(seeds.sparkSession)
    edges = links.select("src_id", "dst_id").distinct()
    reached = seeds.select("id", F.lit(0).alias("depth")).distinct().checkpoint()
    front = reached
    for depth in range(1, max_depth + 1):
        front = front.join(edges, front["id"] == edges["src_id"]).select(F.col("dst_id").alias("id")).distinct().join(reached, "id", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    return reached


def collect_links(pages: DataFrame, seed_host: str = "", subdomains: bool = False) -> DataFrame:
    """Edges of pages from their anchors, images, css and js arrays, numbered in that order;
    those to the site of ``seed_host``, if given, are internal."""
    edge = lambda to, placement, flags, anchor: F.struct(to.alias("url"), placement.cast("int").alias("placement"), flags.cast("int").alias("flags"), anchor.alias("anchor"))
    anchors = F.transform("anchors", lambda a: edge(a["href"], a["placement"], a["flags"], a["text"]))
    plain = lambda c, placement, flag: F.transform(c, lambda u: edge(u, F.lit(placement), F.lit(flag), F.lit("")))
    images = F.transform("images", lambda i: edge(i["src"], F.lit(S.IMAGE_PLACE), F.lit(S.LINK_IMAGE), i["alt"]))
    every = F.concat(anchors, images, plain("css", S.BODY, S.LINK_STYLESHEET), plain("js", S.BODY, S.LINK_SCRIPT))
    edges = pages.select("run_id", F.col("url_id").alias("src_id"), F.posexplode(every).alias("seq", "e")).select("run_id", "src_id", "seq", "e.url", "e.placement", "e.flags", "e.anchor")
    if not seed_host:
        return edges
    inside = F.when(same_site(F.lit(seed_host), host("url"), subdomains), S.LINK_INTERNAL).otherwise(0)
    return edges.withColumn("flags", F.col("flags").bitwiseOR(inside))


def referenced_urls(pages: DataFrame) -> DataFrame:
    """Urls that pages declare: canonicals, alternates, next and previous."""
    every = F.concat("canonicals", F.transform("hreflang", lambda h: h["url"]), F.array("next_url", "prev_url"))
    return pages.select("run_id", "url_id", F.explode(every).alias("url")).where("url <> ''").distinct()


def redirect_facts(redirects: Column | str = "redirects") -> list[Column]:
    """hops, the last location, and whether a location came twice, of an array of hops."""
    r = F.col(redirects) if isinstance(redirects, str) else redirects
    places = F.transform(r, lambda h: h["location"])
    return [F.size(r).alias("redirect_hops"), F.coalesce(F.try_element_at(places, F.lit(-1)), F.lit("")).alias("redirect_to"), (F.size(F.array_distinct(places)) < F.size(places)).alias("redirect_loop")]


def sitemap_tree(sitemaps: DataFrame, max_depth: int = 10) -> DataFrame:
    """url, depth of the sitemaps that can be reached from those without a parent, each
    once at its least depth. ``sitemaps``: url, parent (a url, or null)."""
    return depths(sitemaps.where("parent IS NULL").select(F.col("url").alias("id")), sitemaps.where("parent IS NOT NULL").select(F.col("parent").alias("src_id"), F.col("url").alias("dst_id")), max_depth).select(F.col("id").alias("url"), "depth")


def render_selection(pages: DataFrame, pattern: str = "", cap: int = 500) -> DataFrame:
    """The pages to render: the first ``cap`` internal html ones without redirects."""
    ok = (F.col("kind") == S.HTML) & F.col("is_internal") & (F.col("redirect_hops") == 0) & (F.col("status_class") == 2)
    return pages.where(ok & F.col("url").rlike(pattern) if pattern else ok).orderBy("url_id").limit(cap).select("run_id", "url_id", "url")


def status_tally(pages: DataFrame) -> DataFrame:
    """run_id, bucket, n by outcome."""
    bucket = (
        F.when(F.col("robots_state") == "blocked", "blocked").when(F.col("status_class") == 2, "success").when(F.col("status_class") == 3, "redirect")
        .when(F.col("status_class") == 4, "clientError").when(F.col("status_class") == 5, "serverError").otherwise("noResponse")
    )
    return pages.groupBy("run_id", bucket.alias("bucket")).agg(F.count("*").alias("n"))
