from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from crawlquilt.operators import duplicates, frontier, pagespeed
from crawlquilt.schema import Crawl
from crawlquilt.sources import store
from crawlquilt.streaming import crawl as streams


def test_upsert_keeps_the_last(spark):
    old = spark.createDataFrame([("r", 1, "a", 1), ("r", 2, "b", 1)], "run_id string, url_id long, v string, batch int")
    new = spark.createDataFrame([("r", 2, "c", 2), ("r", 3, "d", 2)], "run_id string, url_id long, v string, batch int")
    assert sorted((r.url_id, r.v) for r in store.upsert(old, new, ["run_id", "url_id"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    urls = lambda rows: spark.createDataFrame(rows, "run_id string, id long, url string")
    assert sorted((r.id, r.url) for r in store.append_urls(urls([("r", 1, "x")]), urls([("r", 1, "y"), ("r", 2, "z")])).collect()) == [(1, "x"), (2, "z")]


def test_store_round_trip_and_run_partitions(spark, tmp_path):
    pages = spark.createDataFrame([("r1", 1, "u"), ("r2", 1, "v")], "run_id string, url_id long, url string")
    store.write(pages, str(tmp_path), "pages")
    store.write(pages.where("run_id = 'r2'").withColumn("url", F.lit("w")), str(tmp_path), "pages")
    crawl = store.read(spark, f"file://{tmp_path}")
    assert sorted((r.run_id, r.url) for r in crawl.pages.collect()) == [("r1", "u"), ("r2", "w")] and crawl.links is None
    assert "PartitionFilters: [isnotnull(run_id" in store.read(spark, f"file://{tmp_path}", "r1").pages._jdf.queryExecution().toString()
    assert [r.run_id for r in store.delete_run(crawl, "r1").pages.collect()] == ["r2"]
    assert len(store.schema_digest(crawl)) == 64


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "=1+1", 'a "b"'), (2, None, "c,d")], "n int, `t x` string, u string")
    store.export_csv(df, f"file://{tmp_path}/c", single=True)
    text = next((tmp_path / "c").glob("part-*")).read_bytes().decode()
    assert text == 'n,t x,u\r\n1,\'=1+1,"a ""b"""\r\n2,,"c,d"\r\n'
    store.export_json(df, f"file://{tmp_path}/j")
    assert spark.read.json(f"file://{tmp_path}/j").count() == 2
    store.export_xml(df, f"file://{tmp_path}/x")
    assert {r["t_x"] for r in spark.read.format("xml").option("rowTag", "row").load(f"file://{tmp_path}/x").collect()} >= {"=1+1"}
    assert store.json_envelope(df.limit(1)).first().json == '{"columns":["n","t x","u"],"rows":[{"n":"1","t x":"=1+1","u":"a \\"b\\""}]}'


def test_issue_replacement(spark):
    rows = lambda *x: spark.createDataFrame([(r, u, c, "k", 1, "") for r, u, c in x], "run_id string, url_id long, code string, category string, severity int, detail string")
    old, new = rows(("r", 1, "a"), ("r", 2, "b"), ("s", 1, "a")), rows(("r", 9, "a"))
    assert sorted((r.run_id, r.url_id, r.code) for r in store.replace_issues(old, new, ["a"]).collect()) == [("r", 2, "b"), ("r", 9, "a"), ("s", 1, "a")]


def test_dense_ids_do_not_depend_on_stretches(spark):
    df = spark.createDataFrame([(x,) for x in (5, 900, 17, 40, 41, 3)], "k long")
    for width in (4, 1 << 16):
        assert sorted((r.k, r.id) for r in frontier.dense_ids(df, "k", "id", width).collect()) == [(3, 1), (5, 2), (17, 3), (40, 4), (41, 5), (900, 6)]


def test_links_and_references(spark):
    row = ("r", 1, [("https://e.com/a", 1, 2, "x")], [("https://e.com/i.png", "alt")], ["https://e.com/c.css"], [], ["https://e.com/self"], [("vi", "https://e.com/vi")], "https://e.com/2", "")
    page = spark.createDataFrame([row], "run_id string, url_id long, anchors array<struct<href:string,placement:int,flags:int,text:string>>, images array<struct<src:string,alt:string>>, css array<string>, js array<string>, canonicals array<string>, hreflang array<struct<lang:string,url:string>>, next_url string, prev_url string")
    assert [(r.seq, r.url, r.placement, r.flags, r.anchor) for r in frontier.collect_links(page).orderBy("seq").collect()] == [(0, "https://e.com/a", 1, 2, "x"), (1, "https://e.com/i.png", 4, 16, "alt"), (2, "https://e.com/c.css", 0, 32, "")]
    assert [r.flags for r in frontier.collect_links(page, "www.e.com").orderBy("seq").collect()] == [3, 17, 33] and [r.flags for r in frontier.collect_links(page, "o.com").orderBy("seq").collect()] == [2, 16, 32]
    assert {r.url for r in frontier.referenced_urls(page).collect()} == {"https://e.com/self", "https://e.com/vi", "https://e.com/2"}


def test_sitemap_tree(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("c", "a"), ("x", "nowhere")], "url string, parent string")
    assert {r.url: r.depth for r in frontier.sitemap_tree(df).collect()} == {"a": 0, "b": 1, "c": 1}


def test_measurements(spark):
    body = '{"lighthouseResult":{"categories":{"performance":{"score":0.915}},"audits":{"first-contentful-paint":{"title":"FCP","numericValue":1200.4},"unused-js":{"title":"Unused","details":{"type":"opportunity","overallSavingsMs":300,"overallSavingsBytes":2000}}}},"originLoadingExperience":{"metrics":{"CUMULATIVE_LAYOUT_SHIFT_SCORE":{"percentile":12}}}}'
    raw = spark.createDataFrame([("r", "u", "mobile", "t1", body), ("r", "v", "mobile", "t1", "broken")], "run_id string, url string, strategy string, fetched_at string, body string")
    out = {r.url: r for r in pagespeed.flatten(raw).collect()}
    assert (out["u"].score, out["u"].seo_score, out["u"].fcp_ms, out["u"].crux_source, out["u"].crux_cls) == (92, -1, 1200, "origin", 0.12) and out["v"].score == -1
    assert [(r.audit_id, r.savings_ms, r.savings_bytes) for r in pagespeed.flatten_opportunities(raw).collect()] == [("unused-js", 300, 2000)]
    psi = spark.createDataFrame([("r", "u", "m", "1"), ("r", "u", "m", "2")], "run_id string, url string, strategy string, fetched_at string")
    assert [r.fetched_at for r in pagespeed.latest(psi).collect()] == ["2"]


def test_penalties():
    p, c, seen = 0.0, 0, []
    for status in (200, 503, 503, 429, 503, 503, 503, 200, 200, 503, 200, 200, 200, 200):
        p, c = streams.penalty_after(p, c, status, "")
        seen.append(p)
    assert seen == [0, 0.5, 1, 2, 4, 8, 10, 10, 10, 10, 10, 10, 0, 0]
    assert streams.eta(10, 2.0) == 5 and streams.eta(1, 0) is None


def answers(spark):
    t = datetime.datetime(2026, 1, 1)
    return spark.createDataFrame([(f"h{i % 3}", i, t + datetime.timedelta(seconds=i), 503 if i % 4 == 0 else 200, "") for i in range(60)], "host string, event_id long, ts timestamp, status int, error_type string")


def test_streams_equal_batches(spark, tmp_path):
    df = answers(spark)
    path = f"{tmp_path}/in"
    df.coalesce(1).write.parquet(path)
    source = spark.readStream.schema(df.schema).parquet(path)
    query = streams.crawl_rate(source, late="0 seconds").writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("rates").collect())) == sorted(map(tuple, streams.crawl_rate(df).collect()))
    want = {}
    state = {}
    for r in sorted(df.collect(), key=lambda r: r.ts):
        state[r.host] = streams.penalty_after(*state.get(r.host, (0.0, 0)), r.status, r.error_type)
        want[r.event_id] = state[r.host][0]
    assert {r.event_id: r.penalty for r in streams.host_penalties_batch(df).collect()} == want


def test_flush_upserts_by_batch(spark, tmp_path):
    schema = "run_id string, url_id long, v string"
    for n, rows in enumerate(([("r", 1, "a"), ("r", 2, "b")], [("r", 2, "c")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        query = streams.flush_to(f"file://{tmp_path}/store", "pages", source, f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert sorted((r.url_id, r.v, r.batch) for r in spark.read.parquet(f"{tmp_path}/store/pages").collect()) == [(1, "a", 0), (2, "c", 1)]


def test_last_attempts(spark):
    df = spark.createDataFrame([("r", "u", 1, 503), ("r", "u", 2, 200)], "run_id string, url string, attempt int, status int")
    assert [r.status for r in streams.last_attempts(df).collect()] == [200]


def test_crawl_of_nothing(spark):
    from crawlquilt.operators import finalize, issues

    pages = spark.createDataFrame([], "run_id string, url_id long, url string, kind string, is_internal boolean, status int, status_class int, error_type string, robots_state string, canonical string, discovered_by string, indexable boolean")
    links = spark.createDataFrame([], "run_id string, src_id long, dst_id long, seq int, flags int, placement int")
    c = Crawl(pages=pages, links=links)
    assert issues.evaluate(pages).count() == 0 and finalize.orphans(c).count() == 0 and finalize.canonical_targets(c).count() == 0


def test_near_duplicate_issues_equal_brute_force(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    title = lambda i: " ".join(words[(i // 4 + k) % 10] for k in range(4))
    rows = [("r1", i, f"https://e.com/{i}", title(i) + (" more" if i % 4 == 1 else ""), f"About {title(i)}", title(i).upper() if i % 4 < 3 else "Other", 100 + i % 4, "html", 2, i % 7 != 6, True) for i in range(1, 40)]
    rows += [("r1", 40, "https://e.com/40", "", "", "", 100, "html", 2, True, True), *[("r1", i, f"https://e.com/{i}", "Solo" if i > 41 else None, None, None, None, "html", 2, True, True) for i in (41, 42, 43)]]
    pages = spark.createDataFrame(rows, "run_id string, url_id long, url string, title string, meta_desc string, h1 string, word_count int, kind string, status_class int, indexable boolean, is_internal boolean")
    got = {r.url_id: (r.code, r.detail) for r in duplicates.near_issues(Crawl(pages=pages)).collect()}
    fields = {r[1]: (r[3].lower(), (r[4] or "").lower(), (r[5] or "").lower(), r[6] or 0) for r in rows if r[9] and r[3]}
    best: dict[int, tuple[float, int]] = {}
    for a in fields:
        for b in fields:
            if a < b and (score := duplicates.similarity(fields[a], fields[b])) >= duplicates.THRESHOLD:
                for x, y in ((a, b), (b, a)):
                    best[x] = max(best.get(x, (0.0, 0)), (score, -y))
    assert got == {i: ("duplicate-page", f"https://e.com/{-y}") for i, (_, y) in best.items()} and len(got) > 10


def test_measured_pages_are_told_apart_by_id(spark):
    """Two pages share a url, and one of them is measured."""
    pages = spark.createDataFrame([("r", i, u, "html", 2, True, 0, 0) for i, u in ((1, "u"), (2, "u"), (3, "v"))], "run_id string, url_id long, url string, kind string, status_class int, is_internal boolean, inlinks long, depth int")
    psi = spark.createDataFrame([("r", 1, "u", "mobile", ""), ("r", 1, "u", "mobile", ""), ("r", 3, "v", "mobile", "failed")], "run_id string, url_id long, url string, strategy string, error string")
    left = lambda psi: [r.url_id for r in pagespeed.pending(Crawl(pages=pages, psi=psi), "mobile").collect()]
    tally = lambda psi: [tuple(r) for r in pagespeed.progress(Crawl(pages=pages, psi=psi), "mobile").collect()]
    assert left(psi) == [2, 3] and tally(psi) == [("r", 3, 1, 2)]
    assert left(psi.drop("url_id")) == [3] and tally(psi.drop("url_id")) == [("r", 3, 2, 1)]


def test_grid_sorts_by_number_or_by_text(spark):
    from crawlquilt.operators import grid

    rows = [("r", i, f"https://e.com/{i}", n, True, True, 0, False, False) for i, n in ((1, 12), (2, 6), (3, 6), (4, 100))]
    pages = spark.createDataFrame(rows, "run_id string, url_id long, url string, inlinks long, is_internal boolean, indexable boolean, issue_count int, rendered boolean, orphan boolean")
    window = lambda **kw: [r.url_id for r in grid.rows(Crawl(pages=pages), sort="inlinks", desc=True, limit=3, **kw).collect()]
    assert window() == [4, 1, 3] and window(by_text=True) == [3, 2, 1]
