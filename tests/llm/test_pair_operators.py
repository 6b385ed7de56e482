"""Jaccard join, nearest neighbours, url filters, components, the pipeline and the registry."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from crawlquilt.llm import ann, common, jaccard, urlfilter
from crawlquilt.llm.components import components


def find_components(nodes, links):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize("n", [0, 1, 40])
def test_components_equal_union_find(spark, n):
    rng = random.Random(n)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(n)] + [(100 + i, 101 + i) for i in range(30 if n == 40 else 0)]
    out = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert out == find_components(nodes, links)


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def near_corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(40)]
    docs = []
    for g in range(6):
        base = [word() for _ in range(rng.choice([2, 30, 120, 200]))] + (passage if g % 2 else [])
        for _ in range(rng.choice([1, 5, 25])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
                text[rng.randrange(len(text))] = word()
            docs.append(" ".join(text))
    docs += ["É x\x0by  Z", "é X y z", "", " \n", None, "one", "ONE", "one two", "x" * 30_000]
    return [(i * 3 + 1, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 3, 90), (2, 3, 90), (3, 5, 80), (4, 1, 70)])
def test_jaccard_components_equal_brute_force(spark, seed, n, percent):
    docs = near_corpus(seed)
    sets = {i: shingles(t, n) for i, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    out = {r.doc_id: r for r in jaccard.similar(spark.createDataFrame(docs, "doc_id long, text string"), n, percent).collect()}
    want = find_components(list(sets), links)
    assert {i: (r.n_shingles, r.component_id) for i, r in out.items()} == {i: (len(s), want[i]) for i, s in sets.items()}
    assert {i for i, r in out.items() if r.first} == set(want.values())


def test_jaccard_of_odd_rows(spark):
    rows = [(None, "a b c d e"), (None, "q r s t"), (5, "a b c d e"), (5, "a b c d e"), (5, "other words are here"), (6, None), (6, ""), (None, None)]
    docs = spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], "doc_id long, text string, n int, token string, id int, _id int, key int")
    out = [tuple(r) for r in jaccard.similar(docs).select("doc_id", "n_shingles", "component_id", "first").collect()]
    assert sorted(out, key=str) == sorted([(None, 3, 5, False), (None, 2, None, True), (5, 3, 5, True), (5, 3, 5, True), (5, 2, 5, True), (6, 0, 6, True), (6, 0, 6, True), (None, 0, None, True)], key=str)
    assert jaccard.one_of_each(docs).count() == 7 and jaccard.one_of_each(docs).columns == docs.columns
    assert jaccard.similar(docs.limit(0)).count() == 0


def test_jaccard_deals_tokens_once_and_folds_repeats(spark):
    """Token 1 is in two classes, one of which two tasks met; token 2 is in one class alone."""
    emitted = spark.createDataFrame([(1, 10, 0), (1, 10, 0), (1, 20, 3), (2, 20, 1), (2, 20, 1), (None, 10, None)], "token long, d1 long, place long")
    classes = spark.createDataFrame([(10, 0, 5, 7, 7), (20, 1, 6, 8, 8)], "d1 long, id long, n long, s1 long, s2 long")
    found = jaccard._members(emitted, classes)
    assert sorted(map(tuple, found.collect())) == [(1, 0, 5, 0, 7, 7), (1, 1, 6, 3, 8, 8)]
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("REPARTITION_BY_COL") == 1 or "ReusedExchange" in plan


def test_jaccard_leaders_take_one_exchange_and_wide_buckets_cross_components(spark):
    """Token 1 has a leader, one that may link, and one that is too small; token 2 is a bucket of two."""
    rows = [(1, 11, 20, 0, 0, 0), (1, 12, 20, 1, 0, 0), (1, 13, 5, 1, 0, 0), (1, 14, 20, 1, 0, 0), (2, 21, 20, 0, 0, 0), (2, 22, 20, 1, 0, 0)]
    led = jaccard._led(spark.createDataFrame(rows, "token long, id long, n long, pos int, s1 long, s2 long"), 90)
    assert led._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(token") == 1
    assert {r.id: (r.other, r.wide) for r in led.collect()} == {11: (None, True), 12: (11, True), 13: (None, True), 14: (11, True), 21: (None, False), 22: (21, False)}
    component = {11: 11, 12: 11, 13: 13, 14: 14}
    placed = spark.createDataFrame([(*r, component[r[1]]) for r in rows if r[0] == 1], "token long, id long, n long, pos int, s1 long, s2 long, component long")
    assert sorted(map(tuple, jaccard._cross_component(placed, 90).collect())) == [(11, 14), (12, 14)]
    assert jaccard._cross_component(placed.where("id < 13"), 90).count() == 0


class Held:
    """Stands for a table: gives the function that a scan runs in a task."""

    sparkSession = property(lambda self: self)
    sparkContext = property(lambda self: self)
    broadcast = lambda self, value: type("Sent", (), {"value": value})
    select = lambda self, *columns: self
    mapInArrow = lambda self, run, schema: run


def test_a_jaccard_scan_holds_little_more_than_a_window(spark):
    """Every token of a full window is reported: the task holds it once, and sends short batches."""
    import tracemalloc

    import pyarrow as pa

    size = jaccard.WINDOW_TOKENS // 4 // 10 + 4
    texts = [" ".join(f"{k}x{i}" for i in range(size)) for k in range(10)] * 4
    batches = (pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t]), pa.array([i])], ["doc_id", "text", "key"]) for i, t in enumerate(texts))
    tracemalloc.start()
    try:
        found = [(b.num_rows, len(b) - b.column(7).null_count, (b.column(8).to_numpy(zero_copy_only=False) == 4).sum()) for b in jaccard._scan(Held(), 3)(batches)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    reported = 10 * (size - 2)
    assert [sum(x) for x in zip(*found, strict=True)] == [40 + reported, reported, reported]
    assert max(n for n, *_ in found) <= 1 << 16 and peak < 28 * jaccard.WINDOW_TOKENS, peak

    texts = [" ".join(f"{k}x{i}" for i in range(200)) for k in range(20_000)]
    orders = jaccard.Orders(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), 3)
    sent = [b.num_rows for b in jaccard._prefixes(Held(), 3, 90, orders)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))]
    assert sum(sent) == 20_000 * (jaccard.prefix_size(198, 90) + 1) and max(sent) < (1 << 16) + 200


def test_reported_tokens_equal_counts(monkeypatch):
    monkeypatch.setattr(jaccard, "WINDOW_TOKENS", 50)
    rng = np.random.default_rng(14)
    for n, high in [(0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (50, 1), (300, 1), (50, 3), (300, 20), (300, 1000), (300_000, 60_000)]:
        tokens, window = rng.integers(0, high, n).astype(np.uint64), jaccard.TokenWindow()
        for _ in range(2):  # it is empty after a report
            for part in np.array_split(tokens, 3):
                window.add(part)
            found, counts = np.unique(tokens, return_counts=True)
            assert [x.tolist() for x in window.report()] == [found[counts >= 4].tolist(), counts[counts >= 4].tolist()]


def test_word_hashes_tell_words_apart_in_any_cut(spark, monkeypatch):
    import pyarrow as pa

    rng = random.Random(12)
    texts = ["".join(rng.choice("aAbBé \n\tz") for _ in range(rng.randint(0, 300))) for _ in range(50)] + ["", "x" * 1000]
    whole = [h.tolist() for h in common.FoldedWords().batch(pa.array([*texts, None]))]
    monkeypatch.setattr(common, "SEGMENT", 64)
    assert [h.tolist() for h in common.FoldedWords().batch(pa.array(texts))] == whole[:-1] and whole[-1] == []
    names: dict[int, bytes] = {}
    for t, hashes in zip(texts, whole, strict=False):
        found = t.encode().lower().split()
        assert len(found) == len(hashes)
        assert all(names.setdefault(h, w) == w for h, w in zip(hashes, found, strict=True))
    assert len(set(names.values())) == len(names)


def test_prefixes_of_linked_sets_meet_under_every_order():
    rng = np.random.default_rng(13)
    orders = jaccard.Orders(np.sort(rng.integers(0, 2**63, 50).astype(np.uint64)), np.arange(50) + 10, 3)
    for _ in range(100):
        base = np.unique(np.concatenate((rng.integers(0, 2**63, 80).astype(np.uint64), rng.choice(orders.frequent, 30))))
        other = np.unique(np.concatenate((base[rng.random(len(base)) > 0.05], rng.integers(0, 2**63, 3).astype(np.uint64))))
        if 100 * len(np.intersect1d(base, other)) >= 90 * len(np.union1d(base, other)):
            for a, b in zip(orders.prefixes(base, jaccard.prefix_size(len(base), 90)), orders.prefixes(other, jaccard.prefix_size(len(other), 90)), strict=True):
                assert len(np.intersect1d(a, b))


def nearest_brute(ids, x, queries, k):
    unit = x / np.sqrt((x**2).sum(1))[:, None]
    out = {}
    for q in queries:
        s = unit @ unit[ids.index(q)]
        order = [i for i in np.lexsort((ids, -s.round(12))) if ids[i] != q][:k]
        out[q] = [(ids[i], s[i]) for i in order]
    return out


def test_nearest_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(3000, 16))
    x[1000:1400] = x[7]  # a hot vector
    ids = list(range(3000))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").repartition(5)
    out = ann.nearest(df, df.where("vec_id % 50 = 0"), block=200).collect()
    want = nearest_brute(ids, x, range(0, 3000, 50), 5)
    got: dict[int, list] = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert all([r.rank for r in out if r.query_id == q] and len(v) == 5 for q, v in got.items()) and len(got) == 60
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in got)
    assert hits >= 0.9 * 300
    unit = x / np.sqrt((x**2).sum(1))[:, None]
    assert all(abs(s - unit[q] @ unit[i]) < 1e-12 and i != q for q, v in got.items() for i, s in v)
    assert [i for i, _ in got[1000]] == [7, 1001, 1002, 1003, 1004]


def test_nearest_neighbours_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (7, [0.0, 2.0]), (7, [0.0, 3.0]), (50, [5.0, 0.0]), (100, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, tree string, id int")
    out = [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in ann.nearest(df, df.where("vec_id % 50 = 0")).collect()]
    near = round(0.9 / np.sqrt(0.82), 6)
    assert sorted(out) == [(0, 1, 50, 1.0), (0, 2, 1, near), (0, 3, 7, 0.0), (50, 1, 0, 1.0), (50, 2, 1, near), (50, 3, 7, 0.0)]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0 and ann.nearest(df, df.limit(0)).count() == 0


@pytest.mark.parametrize("copies", [2, 6])
def test_nearest_neighbours_of_repeated_ids_are_all_there(spark, copies):
    rng = np.random.default_rng(17)
    x = rng.normal(size=(12, 4))
    x[7:] = x[7]  # ids that share a vector
    repeated = [(i, v.tolist()) for i, v in enumerate(x)] * copies
    turned = [(i, (v + k * 1e-3 * rng.normal(size=4)).tolist()) for i, v in enumerate(x) for k in range(copies)]
    for rows in (repeated, turned):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
        got = {q: [] for q in range(12)}
        for r in sorted(ann.nearest(df, df).collect()):
            got[r.query_id].append((r.vec_id, r.score))
        for q in got:
            vectors = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows]
            best = {i: max(a @ b for k, a in vectors if k == i for n, b in vectors if n == q) for i in range(12) if i != q}
            want = sorted(best, key=lambda i: (-round(best[i], 12), i))[:5]
            assert [i for i, _ in got[q]] == want and all(abs(s - best[i]) < 1e-9 for i, s in got[q])


def test_nearest_neighbours_of_huge_and_tiny_components(spark):
    rows = [(50, [1e200, 1e200]), (1, [1e-200, 1.1e-200]), (2, [1e308, -1e308]), (3, [5e-324, 0.0]), (4, [3.0, 4.0])]
    out = sorted((r.rank, r.vec_id, r.score) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame(rows[:1], "vec_id long, embedding array<double>")).collect())
    assert [i for _, i, _ in out] == [1, 4, 3, 2] and all(abs(s - w) < 1e-12 for (*_, s), w in zip(out, [2.1 / np.sqrt(2 * 2.21), 7 / np.sqrt(50), np.sqrt(0.5), 0], strict=True))


def test_places_of_leaves_are_the_order_of_the_queue():
    rng = np.random.default_rng(18)
    x = ann._units(rng.normal(size=(500, 6)))
    forest = ann.Forest(x, 3, 16, 5)
    for q in x[:20]:
        margins = np.stack([forest.margins(q[None], t)[0] for t in range(3)])
        place = forest.places(margins)
        order = [place[t, leaf] for t, leaf in forest.search(margins.tolist())]
        assert order == sorted(order) and len(order) == 48 and order[-1] >= 40


def share_compared(spark, x):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    asked = df.where("vec_id % 50 = 0")
    out = ann.nearest(df, asked, leaf=32).collect()
    queries = list(range(0, len(x), 50))[:100]
    want = nearest_brute(list(range(len(x))), x, queries, 5)
    got = {(r.query_id, r.vec_id) for r in out}
    recall = sum((q, i) in got for q in queries for i, _ in want[q]) / (5 * len(queries))
    rows = ann.usable(df, "embedding", x.shape[1])
    forest = ann._fit(rows, len(x), x.shape[1], ann.TREES, 32, ann.SAMPLE, ann.SEED)
    return recall, ann.visits_for(ann.RECALL, forest, rows, ann.usable(asked, "embedding", x.shape[1]), 5) / forest.leaves, forest.leaves


def test_nearest_neighbours_compare_a_falling_share(spark):
    rng = np.random.default_rng(19)
    made = lambda n: rng.normal(size=(n // 40, 24))[rng.integers(0, n // 40, n)] + 0.15 * rng.normal(size=(n, 24))
    few, many = share_compared(spark, made(2500)), share_compared(spark, made(50_000))
    assert few[0] >= 0.9 and many[0] >= 0.9 and many[2] == 16 * few[2]
    assert many[1] < few[1] / 4 and many[1] < 0.05


def test_nearest_neighbours_of_the_test_tables(spark):
    import os

    if not os.path.exists("/root/testdata/sf0.1"):
        pytest.skip("no test tables")
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], dtype=np.float64)
    queries = [i for i in ids if i % 50 == 0]
    want = nearest_brute(ids, x, queries, 5)
    out = {(r.query_id, r.vec_id) for r in ann.op4_nearest_neighbours(spark, "/root/testdata/sf0.1").collect()}
    assert len(out) == 5 * len(queries) and sum((q, i) in out for q in queries for i, _ in want[q]) >= 0.9 * len(out)


def test_nearest_neighbours_of_mixed_lengths_go_by_the_whole_table(spark):
    rows = [(i, [1.0, i / 10]) for i in range(1, 8)] + [(50, [1.0, 0.11]), (100, [1.0, 0.0, 0.0]), (150, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = sorted((r.query_id, r.rank, r.vec_id) for r in ann.nearest(df, df.where("vec_id % 50 = 0")).collect())
    assert out == [(50, 1, 1), (50, 2, 2), (50, 3, 3), (50, 4, 4), (50, 5, 5)]


def judge_brute(url, rules):
    host, path = urlfilter.host_path(url)
    fits = [(len(r), r, v) for r, v in rules for h, p in [(r[: r.index("/")], r[r.index("/") :])] if (host == h or host.endswith("." + h)) and path.startswith(p) and host]
    return max(fits)[1:] if fits else (None, urlfilter.DEFAULT)


@pytest.mark.parametrize("most_bytes", [1 << 20, 12])
def test_url_verdicts_equal_brute_force(spark, most_bytes):
    rng = random.Random(15)
    rules = urlfilter.RULES + [("a.net/x", "allow"), ("b.example.com/de/1", "allow"), ("net/en", "block")]
    urls = ["://".join([rng.choice(["http", "HTTPS"]), ".".join(rng.choice(["a", "b", "example", "net", "com", "org", "EN"]) for _ in range(rng.randint(1, 4))) + rng.choice(["", "/", "/en/1", "/de/1?q=/en/", "/fr/#x", "?/en/", "/x/y"])]) for _ in range(400)]
    rows = list(enumerate(urls + [None, "", "no url", "://", "http://", "x://a.net"]))
    rows += [rows[3], rows[3], (None, "http://a.net/x")]
    out = urlfilter.judge(spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, rule string"), spark.createDataFrame(rules, "rule string, verdict string"), most_bytes=most_bytes).collect()
    want = [(i, *urlfilter.host_path(u), *judge_brute(u, rules)) for i, u in rows]
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)


def test_cascade_is_exact(spark):
    listed = spark.createDataFrame([(f"k{i}",) for i in range(0, 3000, 7)] + [("outside",), (None,), ("k0",)], "key string")
    universe = spark.createDataFrame([(f"k{i}",) for i in range(3000)] + [(None,)], "key string")
    both = listed.selectExpr("0 AS which", "key").unionByName(listed.selectExpr("1 AS which", "concat(key, '5') AS key"))
    for most_levels in (64, 2, 1):
        one, two, nothing = urlfilter.cascades(both, universe, 3, (0.2, 0.5), most_levels)
        assert all((f"k{i}" in one) == (i % 7 == 0) and (f"k{i}" in two) == (i % 10 == 5 and i > 5 and i // 10 % 7 == 0) and f"k{i}" not in nothing for i in range(3000))
        assert "outside" in one and (len(one.levels) > 2 if most_levels == 64 else len(one.levels) == most_levels)
    assert [urlfilter._group(r.key, 5) for r in universe.where("key IS NOT NULL").collect()[:50]] == [r.g for r in universe.where("key IS NOT NULL").selectExpr("pmod(xxhash64(key), 5) AS g").collect()[:50]]
    assert urlfilter.judge(universe.selectExpr("1L AS page_id", "key AS url").limit(0), listed.selectExpr("key AS rule", "'block' AS verdict")).count() == 0


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(16)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(5))
    common_words = [word() for _ in range(150)]
    line = lambda n: " ".join(rng.choice(common_words) for _ in range(n))
    item = line(40)
    passage = line(60)
    docs = {i: "\n".join(line(25) for _ in range(4)) for i in range(60)}
    for i in range(10):
        docs[100 + i] = " ".join(f"{w}*** ###" for w in line(40).split())
    docs[200], docs[201] = f"{line(20)}\n{passage}\n{line(20)}", f"{line(20)}\n{passage}\n{line(30)}"
    docs[202] = docs[0]
    near = docs[1].split()
    near[50] = "changed"
    docs[203] = " ".join(near)
    docs[204] = f"{line(30)} {item} {line(30)}"
    table = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i in docs if i < 105], "doc_id long, quality int, toxic int")
    for name, df in (("documents", table), ("labels", labels), ("benchmark", spark.createDataFrame([(1, item)], "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    stages = [f for _, f in corpus_pipeline.STAGES]
    good = common.written(stages[0](spark, table, str(tmp_path)))
    first = {r.doc_id for r in good.collect()}
    assert not first & set(range(100, 110)) and len(first & set(range(60))) >= 50 and good.columns == table.columns
    # The other stages work on all good documents here, as few documents tell little of quality.
    at, kept = table.where("doc_id NOT BETWEEN 100 AND 110"), []
    for stage in stages[1:-1]:
        at = common.written(stage(spark, at, str(tmp_path)))
        assert at.columns == table.columns
        kept.append({r.doc_id: r.text for r in at.collect()})
    second, third, last = kept
    assert 202 not in second and passage in second[200] and passage not in second[201]
    assert 203 not in third and 1 in third and 204 in third and 204 not in last
    assert set(last) == set(range(60)) | {200, 201}
    packed = stages[-1](spark, at, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(last)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= first
    sizes: dict[int, int] = {}
    for r in out:
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
    assert max(sizes.values()) <= 2048


def test_pipeline_line_dedup_takes_short_repeated_runs(spark):
    import corpus_pipeline

    footer, copy = "all rights reserved by the owners of this site", " ".join(f"w{i}" for i in range(40))
    docs = [(i, f"text number {i} stands here alone\n{footer}\nthe end\nown words of {i}\nthe end") for i in range(20)] + [(50, copy), (51, copy)]
    table = spark.createDataFrame([(i, t, len(t)) for i, t in docs], "doc_id long, text string, n_chars long")
    out = {r.doc_id: r for r in corpus_pipeline.line_dedup(spark, table, "").collect()}
    assert set(out) == {*range(20), 50} and all((footer in r.text) == (i == 0) for i, r in out.items() if i < 50)
    assert all(r.n_chars == len(r.text) and (i == 50 or (r.text.endswith("the end") and r.text.count("the end") == 1 + (i == 0))) for i, r in out.items())


def test_pipeline_jaccard_join_keeps_one_row_of_each_document(spark):
    import corpus_pipeline

    a, b = "one two three four five six seven", "other words stand in this text here"
    rows = [(None, a)] * 3 + [(5, b), (5, b), (6, b), (7, "alone"), (8, None), (8, None), (8, "")]
    docs = spark.createDataFrame([(*r, "s", k) for k, r in enumerate(rows)], "doc_id long, text string, source string, n_chars long")
    out = corpus_pipeline.jaccard_join(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(None, a), (5, b), (7, "alone"), (8, None), (8, "")], key=str)


def test_registry_has_one_query_for_each_operator():
    from crawlquilt.llm import registry

    names = list(registry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 11)) and "pipeline" in names
    assert set(registry.oracle_sql()) <= set(names)


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    for path in root.joinpath("crawlquilt").rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "crawlquilt.llm" not in path.read_text(), path
