"""URL filters with a Bloom filter cascade.

The listed keys are rules ``host/path``; a url's keys are its host and each parent
domain, with each prefix of its path that is as long as some rule's path. Level 1
of a cascade holds the listed keys. Level 2 holds the false positives of level 1
among all keys of the corpus, level 3 those listed keys that level 2 wrongly holds,
and so on until no false positives are left. For every key of the corpus the first
level that lacks it then tells exactly whether it is listed: a lookup needs neither
a join nor the list.

Only the filters go to the tasks. Keys are dealt by their hash to as many groups as it
takes for the filters of one to stay under ``most_bytes``, and there is one pass over
the pages for each group: it looks only for keys of its group, and hands on the best rule
found so far. The cascades of a group, one for each verdict, are built level by level
together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlquilt.llm.common import arrow_schema, columns_batch, table, written

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Verdict on a url that no rule fits.
DEFAULT = "allow"
#: False-positive rate of level 1 and of all others.
RATES = (0.01, 0.5)
#: Bytes of the filters that one pass over the pages holds, about.
MOST_BYTES = 64 << 20
#: Keys that so many levels don't tell apart are listed; 128-bit hashes leave none in practice.
MOST_LEVELS = 64
#: Bits of a filter that one row carries to the driver.
BLOCK_BITS = 1 << 19
VERDICTS = ["block", "allow"]

SCHEMA = "page_id long, host string, path string, rule string, verdict string"
_STATE = "page_id long, url string, place int, rule string, verdict string"
_LOWER = {c: c + 32 for c in range(65, 91)}


def host_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    for end in "?#":
        rest = rest.partition(end)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def keys(host: str, path: str, lengths: list[int]) -> list[str]:
    """The rules that would fit, longest host first, then longest path."""
    if not host:
        return []
    hosts = [host]
    while (dot := hosts[-1].find(".")) >= 0:
        hosts.append(hosts[-1][dot + 1 :])
    return [h + path[:n] for h in hosts if h for n in lengths if n <= len(path)]


class Bloom:
    """Bits as bytes; ``positions`` is the same on the driver and in the tasks."""

    def __init__(self, n: int, rate: float, level: int):
        self.bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
        self.hashes = max(1, round(self.bits / max(n, 1) * math.log(2)))
        self.hashes = min(self.hashes, 16)
        self.level = level
        self.data = b""

    def positions(self, key: str) -> list[int]:
        h = xxhash.xxh3_128_intdigest(key.encode("utf-8", "replace"), seed=self.level)
        a, b = h & 0xFFFFFFFFFFFFFFFF, (h >> 64) | 1
        return [(a + i * b) % self.bits for i in range(self.hashes)]

    def __contains__(self, key: str) -> bool:
        return all(self.data[p >> 3] >> (p & 7) & 1 for p in self.positions(key))


def _fill(found: DataFrame, filters: dict[int, Bloom]) -> None:
    """Set the bits of all keys (which, key) in the filters of their lists. Bits are gathered
    by block over the cluster; the driver gets whole blocks, as bytes."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema("which int, block long, at int")
        for batch in batches:
            yield columns_batch([(w, p // BLOCK_BITS, p % BLOCK_BITS) for w, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p in filters[w].positions(x)], schema)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            which, block, at = (c.to_numpy() for c in batch.columns)
            for w, b in set(zip(which.tolist(), block.tolist(), strict=True)):
                bits = blocks.setdefault((w, b), np.zeros(BLOCK_BITS, dtype=bool))
                bits[at[(which == w) & (block == b)]] = True
        for (w, b), bits in blocks.items():
            yield columns_batch([(w, b, np.packbits(bits, bitorder="little").tobytes())], arrow_schema("which int, block long, bits binary"))

    rows = found.select("which", "key").mapInArrow(places, "which int, block long, at int").repartition("which", "block").mapInArrow(gather, "which int, block long, bits binary").toArrow()
    data = {w: np.zeros(-(-x.bits // BLOCK_BITS) * (BLOCK_BITS >> 3), dtype=np.uint8) for w, x in filters.items()}
    for w, b, bits in zip(*(c.to_pylist() for c in rows.columns), strict=True):
        data[w][b * (BLOCK_BITS >> 3) : (b + 1) * (BLOCK_BITS >> 3)] = np.frombuffer(bits, dtype=np.uint8)
    for w, x in filters.items():
        x.data = data[w][: (x.bits >> 3) + 1].tobytes()


class Cascade:
    """Exact membership of the keys of a universe in a list."""

    def __init__(self):
        self.levels: list[Bloom] = []
        self.last: set[str] | None = None

    def __contains__(self, key: str) -> bool:
        for i, level in enumerate(self.levels):
            if key not in level:
                return i % 2 == 1
        listed = len(self.levels) % 2 == 1
        return listed if self.last is None else (key in self.last) != listed


def cascades(lists: DataFrame, universe: DataFrame, count: int = 1, rates: tuple[float, float] = RATES, most_levels: int = MOST_LEVELS) -> list[Cascade]:
    """The cascades of ``count`` lists (which from 0, key) over one universe (key), level by
    level. Null keys are left out, repeated ones count once; a listed key outside the
    universe is held as well."""
    spark = universe.sparkSession
    inside = lists.where("key IS NOT NULL").select("which", "key").distinct()
    every = universe.where("key IS NOT NULL").select("key").distinct().select(F.explode(F.array(*map(F.lit, range(count)))).alias("which"), "key")
    out = [Cascade() for _ in range(count)]
    wanted, others = written(inside), written(every.join(inside, ["which", "key"], "left_anti"))
    left = list(range(count))
    while left:
        n = {r["which"]: r["count"] for r in wanted.groupBy("which").count().collect()}
        level = len(out[left[0]].levels)
        left = [w for w in left if n.get(w) or not level]
        if level == most_levels:
            for w in left:
                out[w].last = set()
            for r in wanted.collect():
                out[r["which"]].last.add(r["key"])
            break
        fresh = {w: Bloom(n.get(w, 0), rates[bool(level)], level) for w in left}
        if not fresh:
            break
        _fill(wanted.where(F.col("which").isin(left)), fresh)
        for w, x in fresh.items():
            out[w].levels.append(x)
        left = [w for w in left if n.get(w)]
        held = spark.sparkContext.broadcast(fresh)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                yield columns_batch([(w, x) for w, x in pairs if x in held.value[w]], arrow_schema("which int, key string"))

        if left:
            wanted, others = written(others.where(F.col("which").isin(left)).mapInArrow(run, "which int, key string")), wanted
    return out


def _group(key: str, groups: int) -> int:
    """The group of a key; the same as ``pmod(xxhash64(key), groups)``."""
    h = xxhash.xxh64_intdigest(key.encode("utf-8", "replace"), seed=42)
    return (h - (1 << 64) if h >> 63 else h) % groups


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, most_bytes: int = MOST_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url).

    ``rules``: rule (``host/path``, path from its first ``/``) and verdict (allow or
    block); a rule listed for both blocks. A rule fits its host and all subdomains if
    the url's path starts with the rule's; the longest rule wins. A null url or one
    without ``://`` has an empty host and path, fits no rule and gets the default.
    Ids may be null or repeated: each row is judged alone. An empty table gives no
    rows, an empty rule list the default; further columns are not read."""
    spark = pages.sparkSession
    known = written(rules.select(F.col("rule").alias("key"), "verdict").where("rule IS NOT NULL AND instr(rule, '/') > 0"))
    lengths = sorted((r[0] for r in known.select(F.expr("length(key) - instr(key, '/') + 1")).distinct().collect()), reverse=True)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield columns_batch([(k,) for k in {k for url in batch.column(0).to_pylist() for k in keys(*host_path(url), lengths)}], arrow_schema("key string"))

    universe = written(pages.select("url").mapInArrow(expand, "key string").distinct())
    lists = known.select(F.when(F.col("verdict") == "block", 0).when(F.col("verdict") == "allow", 1).alias("which"), "key").where("which IS NOT NULL")
    # Bits of all levels: those of listed keys, and of the false positives among the others.
    size = (11 * known.count() + 0.03 * len(VERDICTS) * universe.count()) / 8
    groups = max(1, math.ceil(size / most_bytes))
    schema = arrow_schema(_STATE)
    out = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for g in range(groups):
        mine = F.pmod(F.xxhash64("key"), F.lit(groups)) == g
        held = spark.sparkContext.broadcast(cascades(lists.where(mine), universe.where(mine), len(VERDICTS)))

        def run(batches: Iterator[pa.RecordBatch], g=g, held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for page_id, url, place, rule, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    for i, key in enumerate(sorted(keys(*host_path(url), lengths), key=len, reverse=True)[:place]):
                        if (groups == 1 or _group(key, groups) == g) and (hit := next((v for v, x in zip(VERDICTS, held.value, strict=True) if key in x), None)):
                            place, rule, verdict = i, key, hit
                            break
                    rows.append((page_id, url, place, rule, verdict))
                yield columns_batch(rows, schema)

        out = out.mapInArrow(run, _STATE)
        if g + 1 < groups:
            out = written(out)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield columns_batch([(page_id, *host_path(url), rule, verdict or default) for page_id, url, _, rule, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True)], arrow_schema(SCHEMA))

    return out.mapInArrow(parts, SCHEMA)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "rule string, verdict string"))


_FITS = "(h = '{host}' OR ends_with(h, '.{host}')) AND starts_with(p, '{path}')"

OP6_SQL = (
    "WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages), "
    "b AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h, "
    "regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS p FROM a), "
    "c AS (SELECT page_id, h, p, CASE "
    + " ".join(f"WHEN {_FITS.format(host=rule[: rule.index('/')], path=rule[rule.index('/') :])} THEN '{rule}'" for rule, _ in sorted(RULES, key=lambda x: -len(x[0])))
    + " END AS rule FROM b) "
    "SELECT page_id, coalesce(h, '') AS host, coalesce(p, '') AS path, rule, CASE "
    + " ".join(f"WHEN rule = '{rule}' THEN '{verdict}'" for rule, verdict in RULES)
    + f" ELSE '{DEFAULT}' END AS verdict FROM c"
)
