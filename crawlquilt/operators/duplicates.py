"""Exact and near duplicates among the pages of a crawl."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlquilt import schema as S
from crawlquilt.functions import INTS
from crawlquilt.functions.text import norm
from crawlquilt.schema import Crawl
from crawlquilt.sources.store import with_checkpoints

THRESHOLD = 0.85
#: A bucket of more pages is skipped: what fills it is a template, not a copy.
BUCKET_CAP = 2000
# Weights of title, description, heading and word count.
WEIGHTS = (0.35, 0.35, 0.20, 0.10)


def comparable(crawl: Crawl) -> DataFrame:
    """The pages that duplicates are looked for among."""
    good = F.col("is_internal") & F.col("indexable") & (F.col("kind") == S.HTML) & (F.col("status_class") == 2)
    return crawl.pages.where(good)


def exact(crawl: Crawl) -> DataFrame:
    """run_id, kind, group_id, url_id, size: pages with the same title, description or
    first heading. A group's id is the smallest url_id in it."""
    keys = F.array(*(F.struct(F.lit(kind).alias("kind"), norm(c).alias("key")) for kind, c in (("title", "title"), ("meta", "meta_desc"), ("h1", "h1"))))
    each = comparable(crawl).select("run_id", "url_id", F.explode(keys).alias("k")).select("run_id", "url_id", "k.kind", "k.key").where("key <> ''")
    groups = each.groupBy("run_id", "kind", "key").agg(F.count("*").alias("size"), F.min("url_id").alias("group_id")).where("size > 1")
    return each.join(groups, ["run_id", "kind", "key"]).select("run_id", "kind", "group_id", "url_id", "size")


def exact_issues(crawl: Crawl) -> DataFrame:
    code = F.concat(F.col("kind"), F.lit("-duplicate"))
    return exact(crawl).select("run_id", "url_id", code.alias("code"), F.lit("seo").alias("category"), F.lit(S.WARNING).alias("severity"), F.col("size").cast("string").alias("detail"))


def simhash(texts: pd.Series) -> np.ndarray:
    """64-bit fingerprints: each bit is the majority of it over the hashes (FNV-1a of the
    code points as four bytes each) of all character triples."""
    out = np.zeros(len(texts), dtype=np.uint64)
    bits = np.arange(64, dtype=np.uint64)
    prime = np.uint64(0x100000001B3)
    for i, text in enumerate(texts):
        runes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if not len(runes):
            continue
        size = min(3, len(runes))
        h = np.full(len(runes) - size + 1, 0xCBF29CE484222325, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size):
                r = runes[k : len(runes) - size + 1 + k].astype(np.uint64)
                for byte in range(4):
                    h = (h ^ ((r >> np.uint64(8 * byte)) & np.uint64(255))) * prime
        votes = ((h[:, None] >> bits) & np.uint64(1)).sum(0) * 2 > len(h)
        out[i] = (votes.astype(np.uint64) << bits).sum(dtype=np.uint64)
    return out


@F.pandas_udf(INTS)
def simhash_bands(texts: pd.Series) -> pd.Series:
    h = simhash(texts)
    return pd.Series([[int(b << 16 | (int(x) >> (16 * b)) & 0xFFFF) for b in range(4)] for x in h])


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def similarity(a: tuple[str, str, str, int], b: tuple[str, str, str, int], least: float = 0.0) -> float:
    """Weighted similarity of (title, description, heading, words). A field that either
    lacks counts nothing. Below ``least`` the result may be an upper bound instead, as
    cheap bounds stop the work early."""
    total = WEIGHTS[3] * min(a[3], b[3]) / max(a[3], b[3]) if a[3] > 0 and b[3] > 0 else 0.0
    fields = [(w, SequenceMatcher(None, x, y)) for w, x, y in zip(WEIGHTS, a, b, strict=False) if isinstance(x, str) and x and y]
    bound = total + sum(w * m.real_quick_ratio() for w, m in fields)
    if bound < least:
        return bound
    return total + sum(w * m.ratio() for w, m in fields)


def _scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        least = float(df["least"].iloc[0]) if len(df) else 0.0
        scores = [similarity((a, b, c, int(d)), (e, f, g, int(h)), least) for a, b, c, d, e, f, g, h in zip(*(df[x] for x in ("a_t", "a_m", "a_h", "a_w", "b_t", "b_m", "b_h", "b_w")), strict=True)]
        yield pd.DataFrame({"run_id": df["run_id"], "a": df["a"], "b": df["b"], "score": scores})


def candidates(rows: DataFrame, cap: int = BUCKET_CAP) -> DataFrame:
    """run_id, a, b: pairs that share a band of the fingerprint or a whole field, from
    buckets of 2 to ``cap`` pages."""
    field = lambda tag, c: F.when(F.col(c) != "", F.concat(F.lit(tag), F.col(c)))
    bands = F.transform(simhash_bands(F.concat_ws(" ", "t", "m", "h")), lambda b: b.cast("string"))
    keys = F.filter(F.concat(bands, F.array(field("t:", "t"), field("m:", "m"), field("h:", "h"))), lambda k: k.isNotNull())
    each = rows.select("run_id", "id", F.explode(keys).alias("key")).distinct()
    size = each.groupBy("run_id", "key").agg(F.count("*").alias("n")).where(F.col("n").between(2, cap)).select("run_id", "key")
    some = each.join(size, ["run_id", "key"])
    left, right = some.withColumnRenamed("id", "a"), some.withColumnRenamed("id", "b")
    return left.join(right, ["run_id", "key"]).where("a < b").select("run_id", "a", "b").distinct()


def near_pairs(crawl: Crawl, threshold: float = THRESHOLD, cap: int = BUCKET_CAP) -> DataFrame:
    """run_id, a, b, score of the candidate pairs that are near enough. The order of a
    pair is that of its ids, as the ratio isn't symmetric."""
    rows = comparable(crawl).select("run_id", F.col("url_id").alias("id"), norm("title").alias("t"), norm("meta_desc").alias("m"), norm("h1").alias("h"), F.coalesce(F.col("word_count").cast("int"), F.lit(0)).alias("w")).where("t <> '' OR m <> '' OR h <> ''")
    side = lambda s: rows.select("run_id", F.col("id").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in "tmhw"))
    pairs = candidates(rows, cap).join(side("a"), ["run_id", "a"]).join(side("b"), ["run_id", "b"]).withColumn("least", F.lit(threshold))
    return pairs.mapInPandas(_scores, "run_id string, a long, b long, score double").where(F.col("score") >= threshold)


def components(pairs: DataFrame, rounds: int = 50) -> DataFrame:
    """run_id, id, component (the smallest id), by passing on the least label, written out
    each round so that the plan stays short and a lost executor costs one round."""
    edges = pairs.select("run_id", F.col("a").alias("x"), F.col("b").alias("y"))
    edges = edges.unionByName(edges.select("run_id", F.col("y").alias("x"), F.col("x").alias("y"))).distinct().checkpoint()
    label = edges.groupBy("run_id", F.col("x").alias("id")).agg(F.least(F.min("y"), F.col("id")).alias("component")).checkpoint()
    for _ in range(rounds):
        least = edges.join(label.withColumnRenamed("id", "y"), ["run_id", "y"]).groupBy("run_id", F.col("x").alias("id")).agg(F.min("component").alias("m"))
        jump = label.select("run_id", F.col("id").alias("component"), F.col("component").alias("up"))
        new = label.join(least, ["run_id", "id"]).join(jump, ["run_id", "component"], "left")
        new = new.select("run_id", "id", F.least("component", "m", "up").alias("component"), F.col("component").alias("old")).checkpoint()
        label = new.drop("old")
        if new.where("component <> old").isEmpty():
            return label
    raise RuntimeError("the components did not settle")


def near_groups(crawl: Crawl, threshold: float = THRESHOLD) -> DataFrame:
    """run_id, url_id, group_id, other, score: each near duplicate with its best partner,
    the smallest id among equals."""
    with_checkpoints(crawl.pages.sparkSession)
    pairs = near_pairs(crawl, threshold).checkpoint()
    sides = pairs.select("run_id", F.col("a").alias("id"), F.col("b").alias("other"), "score").unionByName(pairs.select("run_id", F.col("b").alias("id"), F.col("a").alias("other"), "score"))
    best = sides.groupBy("run_id", "id").agg(F.max(F.struct("score", (-F.col("other")).alias("o"))).alias("b"))
    return best.join(components(pairs), ["run_id", "id"]).select("run_id", F.col("id").alias("url_id"), F.col("component").alias("group_id"), (-F.col("b.o")).alias("other"), F.col("b.score").alias("score"))


def near_issues(crawl: Crawl, threshold: float = THRESHOLD) -> DataFrame:
    """Issue rows (run_id, url_id, code, category, severity, detail) of the near duplicates;
    the detail is the best partner's url."""
    code = "duplicate-page"
    partner = crawl.pages.select("run_id", F.col("url_id").alias("other"), F.col("url").alias("detail"))
    return near_groups(crawl, threshold).join(partner, ["run_id", "other"]).select("run_id", "url_id", F.lit(code).alias("code"), F.lit(S.CATEGORY[code]).alias("category"), F.lit(S.SEVERITY[code]).alias("severity"), "detail")
