"""A crawl over the test tables: what ``pages`` lacks is arithmetic on its key, so that
any engine computes the same crawl."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlquilt.functions.text import robots_has_token, word_count
from crawlquilt.operators.issues import indexability
from crawlquilt.schema import Crawl

RUN = "r1"
EDGES = 6


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crawl(spark: SparkSession, sf_dir: str) -> Crawl:
    raw = read(spark, sf_dir, "pages")
    n = raw.count()
    pages = page_table(raw, n)
    return Crawl(pages=pages, urls=raw.select(F.lit(RUN).alias("run_id"), (F.col("page_id") + 1).alias("id"), "url"), links=links(raw, n))


def page_table(raw: DataFrame, n: int) -> DataFrame:
    i = F.col("page_id")
    case = lambda c, a, b: F.when(c, a).otherwise(b)
    facts = raw.select(
        F.lit(RUN).alias("run_id"),
        i,
        (i + 1).alias("url_id"),
        "url",
        F.trim(F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), r"[ \t\r\n]+", " ")).alias("title"),
        F.trim(F.regexp_replace(F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1), r"[ \t\r\n]+", " ")).alias("h1"),
        F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang"),
        word_count(F.regexp_replace("html", "<[^>]*>", " ")).alias("word_count"),
        F.when(i % 23 == 0, "image").when(i % 23 == 1, "css").when(i % 23 == 2, "js").when(i % 23 == 3, "pdf").when(i % 23 == 4, "font").otherwise("html").alias("kind"),
        F.when(i % 17 == 0, 404).when(i % 13 == 0, 301).when(i % 29 == 0, 503).when(i % 31 == 0, 0).otherwise(200).alias("status"),
        (i % 7 != 0).alias("is_internal"),
        (i % 6).cast("int").alias("depth"),
        ((i * 37) % 4000).cast("int").alias("response_ms"),
        ((i * 7919) % 4000000).alias("size_bytes"),
        (i % 4).cast("int").alias("h2_count"),
        case(i % 19 == 0, "noindex, follow", case(i % 21 == 0, "nofollow", "")).alias("meta_robots"),
        F.lit("").alias("x_robots"),
        F.lit(False).alias("rendered"),
        case(i % 37 == 0, "blocked", "allowed").alias("robots_state"),
        F.when(i % 8 == 0, "sitemap").when(i == 1, "seed").otherwise("link").alias("discovered_by"),
        (i % 5).cast("int").alias("images_count"),
        (i % 3).cast("int").alias("images_noalt"),
        (((i * 7) % 100) / 100.0).alias("text_ratio"),
        F.least(F.when(i % 27 == 1, i + 9).when(i % 27 == 10, i + 9).when(i % 27 == 19, i - 18).otherwise(i), F.lit(n - 1)).alias("_target"),
    )
    target = raw.select(F.col("page_id").alias("_target"), F.col("url").alias("_target_url"))
    known = facts.join(target, "_target").withColumns({
        "status_class": F.expr("cast(status div 100 as int)"),
        "error_type": F.when(F.col("status") != 0, "").when(i % 2 == 0, "timeout").otherwise("dns-not-found"),
        "meta_desc": F.when(i % 5 == 0, "").otherwise(F.trim(F.left(F.repeat(F.concat(F.col("title"), F.lit(" ")), F.lit(4)), ((i * 13) % 200).cast("int")))),
        "canonical": F.when(i % 9 == 0, "").when((i % 27 == 19) & (i % 2 == 1), F.col("url")).when(i % 9 == 1, F.col("_target_url")).otherwise(F.col("url")),
        "redirect_to": F.when(F.col("status") == 301, "https://example.com/next").otherwise(""),
        "redirect_hops": F.when(F.col("status") == 301, (i % 3).cast("int")).otherwise(0),
    })
    counted = known.withColumns({
        "title_len": F.char_length("title"),
        "meta_desc_len": F.char_length("meta_desc"),
        "h1_len": F.char_length("h1"),
        "title_count": F.when(F.col("title") == "", 0).when(i % 41 == 0, 2).otherwise(1),
        "meta_count": F.when(F.col("meta_desc") == "", 0).when(i % 43 == 0, 2).otherwise(1),
        "h1_count": F.when(F.col("h1") == "", 0).when(i % 47 == 0, 2).otherwise(1),
        "canonical_count": F.when(F.col("canonical") == "", 0).when(i % 25 == 0, 2).otherwise(1),
        "h2": F.when(F.col("h2_count") > 0, F.col("title")).otherwise(""),
        "_noindex": robots_has_token("meta_robots", "noindex"),
    })
    return counted.withColumn("indexability", indexability(F.col("url"))).withColumn("indexable", F.col("indexability") == "").drop("_target", "_target_url", "_noindex")


def links(raw: DataFrame, n: int) -> DataFrame:
    i, k = F.col("page_id"), F.col("k")
    edges = raw.select("page_id", F.explode(F.sequence(F.lit(1), F.lit(EDGES))).alias("k")).withColumn("_x", (i * 31 + k * k * 7) % n).withColumn("_dst", F.when(F.col("_x") % 8 == 0, (F.col("_x") + 1) % n).otherwise(F.col("_x")))
    flags = F.when(F.col("_dst") % 7 != 0, 1).otherwise(0) + F.when((i + k) % 10 == 0, 2).otherwise(0) + F.when(k == EDGES, 16).otherwise(0)
    return edges.select(
        F.lit(RUN).alias("run_id"), (i + 1).alias("src_id"), (F.col("_dst") + 1).alias("dst_id"), k.alias("seq"),
        F.when(k == EDGES, 4).otherwise((i + k) % 4).cast("int").alias("placement"), flags.alias("flags"), F.concat(F.lit("link "), k.cast("string")).alias("anchor"),
    )


#: The same crawl as DuckDB views: ``p`` pages, ``l`` links.
CRAWL_SQL = f"""
raw AS (SELECT *, count(*) OVER () AS n FROM pages),
facts AS (
  SELECT '{RUN}' AS run_id, page_id, page_id + 1 AS url_id, url, n,
    trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[ \\t\\r\\n]+', ' ', 'g')) AS title,
    trim(regexp_replace(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1), '[ \\t\\r\\n]+', ' ', 'g')) AS h1,
    regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
    len(regexp_extract_all(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[\\p{{L}}\\p{{N}}_]+')) AS word_count,
    CASE page_id % 23 WHEN 0 THEN 'image' WHEN 1 THEN 'css' WHEN 2 THEN 'js' WHEN 3 THEN 'pdf' WHEN 4 THEN 'font' ELSE 'html' END AS kind,
    CASE WHEN page_id % 17 = 0 THEN 404 WHEN page_id % 13 = 0 THEN 301 WHEN page_id % 29 = 0 THEN 503 WHEN page_id % 31 = 0 THEN 0 ELSE 200 END AS status,
    page_id % 7 <> 0 AS is_internal, page_id % 6 AS depth, (page_id * 37) % 4000 AS response_ms, (page_id * 7919) % 4000000 AS size_bytes, page_id % 4 AS h2_count,
    CASE WHEN page_id % 19 = 0 THEN 'noindex, follow' WHEN page_id % 21 = 0 THEN 'nofollow' ELSE '' END AS meta_robots, '' AS x_robots,
    CASE WHEN page_id % 37 = 0 THEN 'blocked' ELSE 'allowed' END AS robots_state,
    CASE WHEN page_id % 8 = 0 THEN 'sitemap' WHEN page_id = 1 THEN 'seed' ELSE 'link' END AS discovered_by,
    page_id % 5 AS images_count, page_id % 3 AS images_noalt, ((page_id * 7) % 100) / 100.0 AS text_ratio, least(CASE page_id % 27 WHEN 1 THEN page_id + 9 WHEN 10 THEN page_id + 9 WHEN 19 THEN page_id - 18 ELSE page_id END, n - 1) AS target
  FROM raw
),
known AS (
  SELECT f.*, t.url AS target_url, f.status // 100 AS status_class,
    CASE WHEN f.status <> 0 THEN '' WHEN f.page_id % 2 = 0 THEN 'timeout' ELSE 'dns-not-found' END AS error_type,
    CASE WHEN f.page_id % 5 = 0 THEN '' ELSE trim(substr(repeat(title || ' ', 4), 1, ((f.page_id * 13) % 200)::INT)) END AS meta_desc,
    CASE WHEN f.page_id % 9 = 0 THEN '' WHEN f.page_id % 27 = 19 AND f.page_id % 2 = 1 THEN f.url WHEN f.page_id % 9 = 1 THEN t.url ELSE f.url END AS canonical,
    CASE WHEN f.status = 301 THEN 'https://example.com/next' ELSE '' END AS redirect_to, CASE WHEN f.status = 301 THEN f.page_id % 3 ELSE 0 END AS redirect_hops
  FROM facts f JOIN pages t ON t.page_id = f.target
),
p AS (
  SELECT *, length(title) AS title_len, length(meta_desc) AS meta_desc_len, length(h1) AS h1_len,
    CASE WHEN title = '' THEN 0 WHEN page_id % 41 = 0 THEN 2 ELSE 1 END AS title_count,
    CASE WHEN meta_desc = '' THEN 0 WHEN page_id % 43 = 0 THEN 2 ELSE 1 END AS meta_count,
    CASE WHEN h1 = '' THEN 0 WHEN page_id % 47 = 0 THEN 2 ELSE 1 END AS h1_count,
    CASE WHEN canonical = '' THEN 0 WHEN page_id % 25 = 0 THEN 2 ELSE 1 END AS canonical_count,
    CASE WHEN h2_count > 0 THEN title ELSE '' END AS h2,
    CASE WHEN robots_state = 'blocked' THEN 'blocked-by-robots' WHEN page_id % 19 = 0 THEN 'noindex' WHEN status_class = 3 THEN 'redirected'
      WHEN status_class <> 2 THEN 'non-200' WHEN page_id % 9 = 1 AND {{other}} THEN 'canonicalised' ELSE '' END AS indexability
  FROM known
),
edge AS (SELECT *, CASE WHEN x % 8 = 0 THEN (x + 1) % n ELSE x END AS dst FROM (SELECT page_id, n, k, (page_id * 31 + k * k * 7) % n AS x FROM raw, range(1, {EDGES + 1}) AS r(k))),
l AS (
  SELECT '{RUN}' AS run_id, page_id + 1 AS src_id, dst + 1 AS dst_id, k AS seq, CASE WHEN k = {EDGES} THEN 4 ELSE (page_id + k) % 4 END AS placement,
    CASE WHEN dst % 7 <> 0 THEN 1 ELSE 0 END + CASE WHEN (page_id + k) % 10 = 0 THEN 2 ELSE 0 END + CASE WHEN k = {EDGES} THEN 16 ELSE 0 END AS flags, 'link ' || k AS anchor
  FROM edge
)"""

# Parameters that only track visits.
_TRACKS = "('gclid', 'fbclid', 'yclid', 'msclkid', 'mc_eid', 'mc_cid', 'igshid', '_ga', 'gbraid', 'wbraid', 'dclid', 'ttclid')"


def key_sql(url: str) -> str:
    """The frontier key of a url column as DuckDB SQL."""
    pattern = "'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?(?:#(?:.|\\n)*)?$'"
    get = lambda k: f"regexp_extract(trim({url}), {pattern}, {k})"
    scheme, place, path = f"lower({get(1)})", f"lower({get(2)})", get(3)
    host = f"CASE WHEN ({scheme} = 'http' AND {place} LIKE '%:80') OR ({scheme} = 'https' AND {place} LIKE '%:443') THEN regexp_replace({place}, ':[0-9]*$', '') ELSE {place} END"
    keep = f"list_filter(string_split({get(4)}, '&'), lambda x: x <> '' AND NOT (lower(string_split(x, '=')[1]) IN {_TRACKS} OR starts_with(lower(string_split(x, '=')[1]), 'utm_')))"
    ordered = f"list_transform(list_sort(list_transform({keep}, lambda x, i: {{'n': string_split(x, '=')[1], 'i': i, 'x': CASE WHEN contains(x, '=') THEN x ELSE x || '=' END}})), lambda s: s.x)"
    query = f"array_to_string({ordered}, '&')"
    return f"({scheme} || '://' || ({host}) || CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END)"


CRAWL_SQL = CRAWL_SQL.replace("{other}", f"{key_sql('canonical')} <> {key_sql('url')}")
