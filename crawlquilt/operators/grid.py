"""Grid views of a crawl: filtered, searched, sorted and paged rows, facets, links and graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlquilt import schema as S
from crawlquilt.functions.text import percent, search_tokens
from crawlquilt.functions.urls import host, registrable_host
from crawlquilt.schema import Crawl

DEFAULT_LIMIT, MAX_LIMIT, MAX_IDS = 100, 500, 2000

# Column ids of the grid.
SORTS = {
    "url": "url", "status": "status", "kind": "kind", "contentType": "content_type", "size": "size_bytes", "responseMs": "response_ms", "depth": "depth",
    "title": "title", "titleLen": "title_len", "metaDesc": "meta_desc", "metaDescLen": "meta_desc_len", "h1": "h1", "h1Len": "h1_len", "h1Count": "h1_count",
    "h2": "h2", "wordCount": "word_count", "textRatio": "text_ratio", "lang": "lang", "canonical": "canonical", "indexable": "indexable", "indexability": "indexability",
    "inlinks": "inlinks", "inlinksUniq": "inlinks_uniq", "outlinks": "outlinks", "outlinksExt": "outlinks_ext", "images": "images_count", "imagesNoAlt": "images_noalt",
    "issues": "issue_count", "severity": "issue_max_sev", "redirectTo": "redirect_to", "redirectHops": "redirect_hops", "lastMod": "last_mod", "crawledAt": "crawled_at",
}
CELLS = {k: v for k, v in SORTS.items() if k not in ("indexable", "severity")} | {"h2Count": "h2_count", "metaRobots": "meta_robots", "xRobots": "x_robots", "robotsState": "robots_state", "errorType": "error_type", "discoveredBy": "discovered_by"}


def _flag(name: str) -> Column:
    return F.col(name) == F.lit(True)


def _class(n: int) -> Column:
    return F.col("status_class") == n




def base(tab: str) -> Column:
    """The pages that a tab is about."""
    internal = _flag("is_internal")
    html = F.col("kind") == S.HTML
    if tab == "external":
        return ~internal
    if tab == "response":
        return F.lit(True)
    if tab == "images":
        return F.col("kind") == S.IMAGE
    if tab == "sitemaps":
        return F.col("discovered_by") == "sitemap"
    if tab == "directives":
        return internal & html
    if tab in ("titles", "meta", "h1", "h2", "canonicals", "hreflang", "schema"):
        return internal & html & _class(2)
    return internal


def predicates() -> dict[str, dict[str, Column]]:
    """Filters by tab that read the page alone."""
    kind, n = F.col("kind"), F.col
    sides = {
        **{k: kind == k for k in (S.HTML, S.CSS, S.JS, S.PDF)},
        "images": kind == S.IMAGE,
        "other": kind.isin(S.OTHER, S.FONT, S.MEDIA),
        "indexable": _flag("indexable"),
        "nonIndexable": ~_flag("indexable"),
        "orphan": _flag("orphan"),
        "issues": n("issue_count") > 0,
    }
    return {
        "internal": sides,
        "external": sides,
        "response": {
            "success": _class(2), "redirect": _class(3), "clientError": _class(4), "serverError": _class(5),
            "noResponse": (n("status") == 0) & (n("error_type") != "file-too-large"), "blocked": n("robots_state") == "blocked",
        },
        "titles": {"missing": n("title") == "", "long": n("title_len") > 60, "short": n("title_len").between(1, 29)},
        "meta": {"missing": n("meta_desc") == "", "long": n("meta_desc_len") > 160, "short": n("meta_desc_len").between(1, 119)},
        "h1": {"missing": n("h1_count") == 0, "multiple": n("h1_count") > 1, "long": n("h1_len") > 70},
        "h2": {"missing": n("h2_count") == 0, "multiple": n("h2_count") > 1},
        "images": {},
        "canonicals": {"missing": n("canonical") == "", "self": (n("canonical") != "") & (n("indexability") != "canonicalised"), "canonicalised": n("indexability") == "canonicalised"},
        "sitemaps": {"orphan": _flag("orphan"), "nonIndexable": ~_flag("indexable")},
    }


#: Filters by tab that ask for an issue of the page, or for its group of duplicates. Fixed values.
BY_ISSUE = {
    ("titles", "multiple"): "title-multiple", ("titles", "sameAsH1"): "title-same-as-h1", ("meta", "multiple"): "meta-multiple",
    ("directives", "noindex"): "noindex", ("directives", "nofollow"): "nofollow", ("directives", "refresh"): "meta-refresh",
    ("hreflang", "noReturn"): "hreflang-no-return-tag", ("hreflang", "missingSelf"): "hreflang-missing-self", ("hreflang", "invalidCode"): "hreflang-invalid-code",
    ("hreflang", "nonOK"): "hreflang-to-non-200", ("hreflang", "nonCanonical"): "hreflang-non-canonical", ("schema", "missing"): "no-structured-data",
}
BY_DUPLICATE = {("titles", "duplicate"): "title", ("meta", "duplicate"): "meta", ("h1", "duplicate"): "h1"}


def filtered(crawl: Crawl, tab: str = "internal", filter: str = "", search: str = "", ids: Sequence[str] = ()) -> DataFrame:
    """The pages of a tab that a filter lets through. ``issue:<code>`` filters any tab;
    an unknown filter lets all through. Every word of ``search`` must start a word of
    the url, title or description, diacritics aside. ``ids`` pins urls; none pin nothing."""
    rows = crawl.pages.where(base(tab))
    code = filter[6:] if filter.startswith("issue:") else BY_ISSUE.get((tab, filter))
    if code:
        rows = rows.join(crawl.issues.where(F.col("code") == code).select("run_id", "url_id"), ["run_id", "url_id"], "left_semi")
    elif (tab, filter) in BY_DUPLICATE:
        rows = rows.join(crawl.dupes.where(F.col("kind") == BY_DUPLICATE[tab, filter]).select("run_id", "url_id"), ["run_id", "url_id"], "left_semi")
    elif (own := predicates().get(tab, predicates()["internal"])).get(filter) is not None:
        rows = rows.where(own[filter])
    for token in search_tokens(search):
        rows = rows.where(_starts_a_word(token))
    if ids:
        rows = rows.where(F.col("url").isin(list(ids)[:MAX_IDS]))
    return rows


_ACCENTED, _PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def _starts_a_word(token: str) -> Column:
    fold = lambda c: F.translate(F.lower(c), _ACCENTED, _PLAIN)
    words = F.split(F.concat_ws(" ", fold(F.col("url")), fold(F.col("title")), fold(F.col("meta_desc"))), r"[^\p{L}\p{N}]+")
    return F.exists(words, lambda w: w.startswith(fold(F.lit(token))))


def cells(rows: DataFrame, cols: Sequence[str]) -> list[Column]:
    """Columns as text; an id that isn't known, or that a crawl lacks, is empty."""

    def cell(c: str) -> Column:
        name = CELLS.get(c)
        if name is None or name not in rows.columns:
            return F.lit("").alias(c)
        value = F.round(name, 3) if c == "textRatio" else F.col(name)
        return F.coalesce(value.cast("string"), F.lit("")).alias(c)

    return [cell(c) for c in (cols or ["url"])]


def row_flags() -> Column:
    bit = lambda c, n: F.when(c, n).otherwise(0)
    return bit(_flag("is_internal"), S.ROW_INTERNAL) + bit(_flag("indexable"), S.ROW_INDEXABLE) + bit(F.col("issue_count") > 0, S.ROW_HAS_ISSUES) + bit(_flag("rendered"), S.ROW_RENDERED) + bit(_flag("orphan"), S.ROW_ORPHAN)


def rows(crawl: Crawl, tab: str = "internal", filter: str = "", search: str = "", cols: Sequence[str] = (), sort: str = "", desc: bool = False, offset: int = 0, limit: int = 0, ids: Sequence[str] = (), by_text: bool = False) -> DataFrame:
    """One window of a grid: url_id, flags and the asked cells. Ties go by url_id in the
    direction of the sort; Spark keeps the first rows of each partition only. ``by_text``
    sorts by a cell's text, so that 6 comes after 12."""
    found = filtered(crawl, tab, filter, search, ids)
    by = [F.col(SORTS[sort]).cast("string") if by_text else SORTS[sort], "url_id"] if SORTS.get(sort) in found.columns else ["url_id"]
    order = [F.desc(c) if desc else F.asc(c) for c in by]
    limit = min(limit, MAX_LIMIT) if limit > 0 else DEFAULT_LIMIT
    window = found.orderBy(*order).offset(max(offset, 0)).limit(limit)
    return window.select("url_id", row_flags().alias("flags"), *cells(found, cols))


def filter_counts(crawl: Crawl) -> DataFrame:
    """tab, filter, n for each filter that reads pages alone, in one scan."""
    found = [(tab, name, base(tab) & p) for tab, own in predicates().items() for name, p in {"": F.lit(True), **own}.items()]
    counted = crawl.pages.agg(*(F.count_if(p).alias(f"c{i}") for i, (_, _, p) in enumerate(found)))
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("tab"), F.lit(f).alias("filter"), F.col(f"c{i}").alias("n")) for i, (t, f, _) in enumerate(found))))
    return counted.select(each.alias("x")).select("x.*")


def facets(crawl: Crawl) -> DataFrame:
    """run_id, facet, n: counts by side, kind, status, indexability, orphans, links and
    issues; a facet that counts nothing has no row."""
    p = crawl.pages
    side = F.when(_flag("is_internal"), "internal").otherwise("external")
    kind = F.when(F.col("kind") == S.IMAGE, "images").when(F.col("kind").isin(S.FONT, S.MEDIA), "other").otherwise(F.col("kind"))
    bucket = F.when(_class(2), "success").when(_class(3), "redirect").when(_class(4), "clientError").when(_class(5), "serverError").otherwise("noResponse")
    dot = lambda a, b: F.concat_ws(".", a, b)
    grouped = p.groupBy("run_id", side.alias("side"), kind.alias("k"), bucket.alias("b"), _flag("indexable").alias("ix"), _flag("orphan").alias("o")).agg(F.count("*").alias("n"), F.count_if(F.col("issue_count") > 0).alias("w"))
    n = F.col("n")
    some = lambda c: F.when(c, n).otherwise(0)
    pair = lambda name, count: F.struct(name.alias("facet"), count.cast("long").alias("n"))
    folded = F.array(
        pair(F.col("side"), n), pair(dot(F.col("side"), F.col("k")), n), pair(F.lit("images"), some(F.col("k") == "images")), pair(dot(F.lit("response"), F.col("b")), n), pair(F.lit("response"), n),
        pair(dot(F.col("side"), F.when(F.col("ix"), "indexable").otherwise("nonIndexable")), n), pair(F.lit("sitemaps.orphan"), some(F.col("o"))), pair(dot(F.col("side"), F.lit("issues")), F.col("w")),
    )
    out = grouped.select("run_id", F.explode(folded).alias("x")).groupBy("run_id", F.col("x.facet").alias("facet")).agg(F.sum("x.n").alias("n"))
    if crawl.links is not None:
        bit = lambda b: F.count_if(F.col("flags").bitwiseAND(b) != 0)
        one = crawl.links.groupBy("run_id").agg(F.count("*").alias("t"), bit(S.LINK_INTERNAL).alias("i"), bit(S.LINK_NOFOLLOW).alias("f"))
        each = F.array(*(F.struct(F.lit(name).alias("facet"), count.alias("n")) for name, count in (("links", F.col("t")), ("links.internal", F.col("i")), ("links.external", F.col("t") - F.col("i")), ("links.nofollow", F.col("f")))))
        out = out.unionByName(one.select("run_id", F.explode(each).alias("x")).select("run_id", "x.facet", "x.n"))
    if crawl.issues is not None:
        out = out.unionByName(crawl.issues.groupBy("run_id", F.concat(F.lit("issue."), F.col("code")).alias("facet")).agg(F.count("*").alias("n")))
    return out.where("n > 0 OR facet LIKE 'links%'")


def issue_rows(crawl: Crawl, severity: str = "") -> DataFrame:
    """code, severity, category, urls, pct (of all pages of the run), most urls first."""
    total = crawl.pages.groupBy("run_id").agg(F.count("*").alias("_all"))
    wanted = {"critical": S.CRITICAL, "warning": S.WARNING, "notice": S.NOTICE}.get(severity)
    found = crawl.issues if wanted is None else crawl.issues.where(F.col("severity") == wanted)
    grouped = found.groupBy("run_id", "code", "severity", "category").agg(F.count("*").alias("urls"))
    return grouped.join(F.broadcast(total), "run_id").select("run_id", "code", "severity", "category", "urls", percent(F.col("urls"), F.col("_all")).alias("pct")).orderBy(F.desc("urls"), "code")


def _ends(crawl: Crawl) -> DataFrame:
    """Links with both urls and the status of both ends; links to nowhere go."""
    url = lambda end: crawl.urls.select("run_id", F.col("id").alias(f"{end}_id"), F.col("url").alias(f"{end}_url"))
    status = lambda end: crawl.pages.select("run_id", F.col("url_id").alias(f"{end}_id"), F.col("status").alias(f"{end}_status"))
    both = crawl.links.join(url("src"), ["run_id", "src_id"]).join(url("dst"), ["run_id", "dst_id"])
    return both.join(status("dst"), ["run_id", "dst_id"], "left").join(status("src"), ["run_id", "src_id"], "left")


def links(crawl: Crawl, filter: str = "", search: str = "", offset: int = 0, limit: int = 0) -> DataFrame:
    """The links tab: source, target, anchor, placement, flags and the target's status."""
    found = _ends(crawl)
    internal = F.col("flags").bitwiseAND(S.LINK_INTERNAL) != 0
    by = {"internal": internal, "external": ~internal, "nofollow": F.col("flags").bitwiseAND(S.LINK_NOFOLLOW) != 0}
    if filter in by:
        found = found.where(by[filter])
    if search:
        found = found.where(F.col("src_url").contains(search) | F.col("dst_url").contains(search) | F.col("anchor").contains(search))
    limit = min(limit, MAX_LIMIT) if limit > 0 else DEFAULT_LIMIT
    out = found.select("src_id", "seq", "src_url", "dst_url", "anchor", "placement", "flags", F.coalesce("dst_status", F.lit(0)).alias("status"))
    return out.orderBy("src_id", "seq").offset(max(offset, 0)).limit(limit)


def _neighbours(crawl: Crawl, url: str, here: str, there: str, limit: int) -> DataFrame:
    one = crawl.urls.where(F.col("url") == url).select("run_id", F.col("id").alias(f"{here}_id"))
    some = crawl.links.join(F.broadcast(one), ["run_id", f"{here}_id"])
    other = crawl.urls.select("run_id", F.col("id").alias(f"{there}_id"), "url")
    status = crawl.pages.select("run_id", F.col("url_id").alias(f"{there}_id"), "status")
    out = some.join(other, ["run_id", f"{there}_id"]).join(status, ["run_id", f"{there}_id"], "left")
    return out.select("url", "anchor", "placement", "flags", F.coalesce("status", F.lit(0)).alias("status"), F.col(f"{there}_id").alias("url_id"), "seq").orderBy("seq", "url_id").limit(min(limit or MAX_LIMIT, MAX_LIMIT))


def inlinks(crawl: Crawl, url: str, limit: int = 0) -> DataFrame:
    return _neighbours(crawl, url, "dst", "src", limit)


def outlinks(crawl: Crawl, url: str, limit: int = 0) -> DataFrame:
    return _neighbours(crawl, url, "src", "dst", limit)


def page(crawl: Crawl, url: str) -> DataFrame:
    return crawl.pages.where(F.col("url") == url)


def graph_nodes(crawl: Crawl, n: int = 3000) -> DataFrame:
    """The pages with most links to them, at most 3000."""
    return crawl.pages.orderBy(F.desc("inlinks"), "url_id").limit(min(n, 3000)).select("run_id", "url_id", "url", "inlinks", "depth", "status")


def graph_edges(crawl: Crawl, n: int = 3000, most: int = 15000) -> DataFrame:
    """Distinct edges among the nodes of the graph, the first ones by source and place."""
    nodes = graph_nodes(crawl, n).select("run_id", F.col("url_id").alias("node"))
    end = lambda c: nodes.select("run_id", F.col("node").alias(c))
    among = crawl.links.where("src_id <> dst_id").join(end("src_id"), ["run_id", "src_id"], "left_semi").join(end("dst_id"), ["run_id", "dst_id"], "left_semi")
    return among.groupBy("run_id", "src_id", "dst_id").agg(F.min("seq").alias("seq")).orderBy("src_id", "seq", "dst_id").limit(most).select("src_id", "dst_id")


def lookup_local(crawl: Crawl, term: str, seed_host: str, limit: int = 20) -> DataFrame:
    """Indexable internal pages of a site that hold a term, the most linked first."""
    t = F.lower(F.lit(term))
    fields = [c for c in ("url", "title", "meta_desc", "h1", "h2") if c in crawl.pages.columns]
    hit = F.lit(False)
    for c in fields:
        hit = hit | F.lower(F.col(c)).contains(t)
    good = _flag("is_internal") & (F.col("kind") == S.HTML) & _flag("indexable") & _class(2) & (registrable_host(host("url")) == registrable_host(F.lit(seed_host)))
    return crawl.pages.where(good & hit).orderBy(F.desc("inlinks"), "url_id").limit(min(limit, 20)).select("url_id", "url", "title", "inlinks")


#: Estimated bytes of a stored row.
PAGE_BYTES, LINK_BYTES, URL_BYTES = 2400, 90, 90


def run_sizes(crawl: Crawl) -> DataFrame:
    count = lambda df, name: df.groupBy("run_id").agg(F.count("*").alias(name))
    out = crawl.runs.select(F.col("id").alias("run_id"), "state", "started_at")
    for df, name in ((crawl.pages, "pages"), (crawl.links, "links"), (crawl.urls, "urls")):
        out = out.join(count(df, name), "run_id", "left")
    out = out.na.fill(0, ["pages", "links", "urls"])
    return out.withColumn("bytes", F.col("pages") * PAGE_BYTES + F.col("links") * LINK_BYTES + F.col("urls") * URL_BYTES).orderBy(F.desc("started_at"), "run_id")


def recover_runs(crawl: Crawl) -> DataFrame:
    """Runs that were cut off: paused if a frontier is left, else stopped."""
    cut = crawl.runs.where(F.col("state").isin("running", "pausing", "stopping"))
    left = crawl.frontier.select(F.col("run_id").alias("id")).distinct().withColumn("_left", F.lit(True))
    return cut.join(left, "id", "left").select("id", F.when(F.col("_left"), "paused").otherwise("stopped").alias("state"), F.coalesce("_left", F.lit(False)).alias("resumable"))
