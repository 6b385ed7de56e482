"""Line dedup: later copies of repeated line runs are deleted.

A document is a sequence of line ids, and its suffixes are ordered by distributed
prefix doubling. At level ``k`` every suffix that shares its first ``2^k`` lines with
another has a rank: the distinct pairs (rank of the first ``2^(k-1)`` lines, rank of
the next) are range-sorted over the cluster, and a pair's place in that order is the
rank. Suffixes that share them with none leave, as they open no repeated run.

A run must hold ``min_words`` words. Its windows are, from each line, the fewest lines
with so many words, and to each line likewise. They cover a run whole: a line of it
either has ``min_words`` words of the run up to it, and then the window that ends there
lies in the run, or has fewer, and then the window from the run's first line holds it.
So the later copies of the maximal runs, in the longest common prefix intervals of the
suffix array, are the union of the windows that occur earlier, whatever their length.
A window has ``min_words`` lines at most, which bounds the levels by ``log2(min_words) + 1``.
Windows with the same ranks over their lines are one interval; all but its first are
later copies.

Nothing is grouped into one task: classes are counted by partial aggregation, and
ranks come back to the suffixes by joins that Spark can split.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlquilt.llm.common import MOST_SENT, arrow_schema, columns_batch, scratch, table, text_key, unused, written

MIN_WORDS = 50
#: Copies of a window that one task joins, about; more are dealt to several.
HOT = 2000

_LINES = "doc_id long, key long, pos int, line int, sizes array<int>, lasts array<int>, h1 long, h2 long"
_AT = ["doc_id", "key", "pos"]


def lines(text: str | None) -> list[tuple[int, bytes]]:
    """(number, trimmed line) of the lines that aren't blank; lines end at line feeds,
    and ASCII white space around them doesn't count."""
    if not text:
        return []
    return [(i, s) for i, x in enumerate(text.encode("utf-8", "replace").split(b"\n")) if (s := x.strip())]


def windows(found: list[bytes], min_words: int) -> list[list[int]]:
    """For each line, the lengths of the windows that start there, the shortest first:
    the fewest lines from it with ``min_words`` words, and the lines up to each later one
    that has so many before it in them and not in fewer."""
    ends = np.cumsum([len(x.split()) for x in found])
    starts = np.concatenate(([0], ends[:-1]))
    sizes: list[set[int]] = [set() for _ in found]
    for a, b in enumerate(np.searchsorted(ends, starts + min_words).tolist()):
        if b < len(found):
            sizes[a].add(b - a + 1)
    for b, a in enumerate((np.searchsorted(starts, ends - min_words, side="right") - 1).tolist()):
        if a >= 0:
            sizes[a].add(b - a + 1)
    return [sorted(x) for x in sizes]


def _suffixes(docs: DataFrame, min_words: int) -> DataFrame:
    """Every line of the documents that can lie in a run, with its 128-bit id, its number
    and the windows that start there: their lengths and the numbers of their last lines."""
    schema = arrow_schema(_LINES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, (doc_id, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                numbered = lines(batch.column(1)[i].as_py())
                found, numbers = [x for _, x in numbered], [k for k, _ in numbered]
                if not found or not any(sizes := windows(found, min_words)):
                    continue
                for pos, (x, n) in enumerate(zip(found, sizes, strict=True)):
                    h = xxhash.xxh3_128_digest(x)
                    rows.append((doc_id, key, pos, numbers[pos], n, [numbers[pos + k - 1] for k in n], int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)))
                    if len(rows) > 20_000:
                        yield columns_batch(rows, schema)
                        rows = []
            yield columns_batch(rows, schema)

    return docs.select("doc_id", "text", text_key(F.col("text")).alias("key")).mapInArrow(run, _LINES)


def _ranked(pairs: DataFrame) -> DataFrame:
    """Classes of (a, b) with two suffixes or more, ranked in the order of (a, b).

    Range partitions follow each other and ids grow with the partition and the place
    in it, so the id of a sorted row is an order-preserving name; it is written at
    once, as a second run could cut the ranges elsewhere."""
    classes = pairs.groupBy("a", "b").count().where("count > 1").select("a", "b")
    return written(classes.repartitionByRange("a", "b").sortWithinPartitions("a", "b").withColumn("rank", F.monotonically_increasing_id()))


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, key, first, last: the lines from ``first`` to ``last`` (numbers among all
    lines of the document) are later copies, in the order of doc_id (null first), text
    key and line. Stretches of a document don't overlap; they come in no order."""
    with scratch(docs.sparkSession) as keep:
        found = written(_suffixes(docs, min_words))
        ranks = _ranked(found.select(F.col("h1").alias("a"), F.col("h2").alias("b")))
        # A row that is given twice has the same suffixes: they count as one from here on.
        level = written(found.join(ranks, (found["h1"] == ranks["a"]) & (found["h2"] == ranks["b"])).select(*_AT, "line", F.arrays_zip("sizes", "lasts").alias("windows"), "rank").dropDuplicates(_AT))
        length, ready = 1, []
        while True:
            there = level.select(*(F.col(c).alias(f"_{c}") for c in _AT), F.col("rank").alias("_rank"))

            def at(side: DataFrame, offset) -> DataFrame:
                return side.join(there, side["doc_id"].eqNullSafe(there["_doc_id"]) & (side["key"] == there["_key"]) & (side["pos"] + offset == there["_pos"]))  # noqa: B023

            long = lambda w: w["sizes"] >= 2 * length  # noqa: E731, B023
            ending = level.select(*_AT, "line", F.explode(F.filter("windows", lambda w: ~long(w))).alias("w"), F.col("rank").alias("a"))
            ending = ending.select(*_AT, "line", F.col("w.sizes").alias("size"), F.col("w.lasts").alias("last"), "a")
            ready.append(written(at(ending, F.col("size") - length).select(*_AT, "line", "last", "size", "a", F.col("_rank").alias("b"))))
            if level.where(F.exists("windows", long)).isEmpty():
                break
            pairs = written(at(level, F.lit(length)).select(*_AT, "line", F.filter("windows", long).alias("windows"), F.col("rank").alias("a"), F.col("_rank").alias("b")))
            ranks = _ranked(pairs)
            level = written(pairs.join(ranks, ["a", "b"]).select(*_AT, "line", "windows", "rank"))
            length *= 2
        every = reduce(DataFrame.unionByName, ready)
        interval = ["size", "a", "b"]
        firsts = written(every.groupBy(*interval).agg(F.min(F.struct(*_AT)).alias("first"), F.count("*").alias("n")).where("n > 1"))
        later = _at_intervals(every, firsts, interval).where(~F.struct(*_AT).eqNullSafe(F.col("first"))).select("doc_id", "key", F.col("line").alias("first"), "last")
        return keep(_merged(later))


def _at_intervals(every: DataFrame, firsts: DataFrame, interval: list[str]) -> DataFrame:
    """The windows of intervals with two copies or more, with the first of each. The copies
    of a hot interval, one with more than ``HOT``, are dealt by their positions to several
    tasks, and its row is given to each. Should hot ones be too many to broadcast, only
    larger ones count as hot."""
    sizes = sorted((r["s"], r["count"]) for r in firsts.where(F.col("n") > HOT).groupBy(F.floor(F.log2("n")).alias("s")).count().collect())
    total, least = sum(n for _, n in sizes), HOT + 1
    for s, n in sizes:
        if total <= MOST_SENT:
            break
        total, least = total - n, 2 ** (s + 1)
    parts = F.when(F.col("n") >= least, F.ceil(F.col("n") / HOT).cast("int")).otherwise(1)
    hot = F.broadcast(firsts.where(F.col("n") >= least).select(*interval, parts.alias("parts")))
    salted = every.join(hot, interval, "left").withColumn("part", F.pmod(F.xxhash64(*_AT), F.coalesce("parts", F.lit(1))).cast("int"))
    given = firsts.select(*interval, "first", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return salted.join(given, [*interval, "part"])


def _merged(stretches: DataFrame) -> DataFrame:
    """Overlapping or adjoining stretches (first, last) of a document as one, by a sorted
    pass over each document's; no list of them is held."""
    of = Window.partitionBy("doc_id", "key").orderBy("first", "last")
    reach = F.max("last").over(of.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("first") <= F.coalesce(reach, F.lit(-2)) + 1, 0).otherwise(1)
    island = F.sum("new").over(of.rowsBetween(Window.unboundedPreceding, 0))
    return stretches.distinct().withColumn("new", new).withColumn("island", island).groupBy("doc_id", "key", "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text`` less its later copies, and n_lines, n_removed and removed
    (numbers of the deleted lines, from 0).

    Runs of ``min_words`` words or more count, over any number of lines, and go to their
    last line; blank lines neither count nor go. A null text stays null with no lines; an empty one has one
    line. Rows that share a doc_id are documents of their own unless their text is
    equal too: those count once and get the same result. Further columns stay, clashes
    with the three new ones are replaced. An empty table gives an empty table."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed", "removed")]
    of, hashed, key, cut, parts = unused(names, "of", "hashed", "key", "cut", "parts")
    stretch = F.array_sort(F.collect_list(F.struct("first", "last")))
    with scratch(docs.sparkSession) as keep:
        copies = keep(later_copies(docs, min_words).groupBy(F.col("doc_id").alias(of), F.col("key").alias(key)).agg(F.flatten(F.transform(stretch, lambda x: F.sequence(x["first"], x["last"]))).alias(cut)))
    left = docs.select(*names, text_key(F.col("text")).alias(hashed))
    # How long the copies' arrays are is not bounded by their count: never broadcast them.
    joined = left.join(copies.hint("merge"), left["doc_id"].eqNullSafe(copies[of]) & (left[hashed] == copies[key]), "left")
    # The lines are split outside of lambdas alone: within one it would be once for each element.
    rows = joined.select(*names, cut, F.split("text", "\n").alias(parts))
    blanks = F.transform(parts, lambda x, i: F.when(F.trim(F.translate(x, "\t\r\x0b\x0c", "    ")) == "", i))
    rows = rows.withColumn(cut, F.when(F.col(cut).isNull(), F.array().cast("array<int>")).otherwise(F.array_except(cut, blanks)))
    # What stays is what stands between the deleted lines: one slice of the lines for each.
    ends = F.concat(F.col(cut), F.array(F.size(parts)))
    after = lambda k: F.coalesce(F.get(cut, k - 1) + 1, F.lit(0))
    left_over = F.flatten(F.transform(ends, lambda end, k: F.slice(parts, after(k) + 1, end - after(k))))
    kept = F.when(F.size(cut) == 0, F.col("text")).otherwise(F.array_join(left_over, "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long")
    return rows.select(*(kept.alias("text") if c == "text" else c for c in names), n_lines.alias("n_lines"), F.size(cut).cast("long").alias("n_removed"), F.col(cut).alias("removed"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"), F.length("text").cast("long").alias("n_chars_kept"))


_WHITE = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"

OP1_SQL = f"""
WITH l AS (
  SELECT doc_id, x, CAST(i - 1 AS BIGINT) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS xs, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL), LATERAL (SELECT xs[i] AS x)
), s AS (
  SELECT doc_id, line, t, len(list_filter(regexp_split_to_array(t, '[ \\t\\v\\f\\r]+'), lambda y: y <> '')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS pos
  FROM (SELECT doc_id, line, trim(x, {_WHITE}) AS t FROM l) WHERE t <> ''
), m AS (
  SELECT a.doc_id AS one, b.doc_id AS two, b.pos - a.pos AS apart, b.pos, b.line, b.n, b.pos - row_number() OVER (PARTITION BY a.doc_id, b.doc_id, b.pos - a.pos ORDER BY b.pos) AS run
  FROM s a JOIN s b ON a.t = b.t AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.pos < b.pos))
), g AS (
  SELECT DISTINCT doc_id, line FROM (SELECT two AS doc_id, line, sum(n) OVER (PARTITION BY one, two, apart, run) AS words FROM m) WHERE words >= {MIN_WORDS}
), r AS (
  SELECT l.doc_id, count(*) FILTER (g.line IS NOT NULL) AS n_removed, string_agg(CAST(g.line AS VARCHAR), ',' ORDER BY g.line) AS gone, sum(CASE WHEN g.line IS NULL THEN length(x) + 1 ELSE 0 END) AS kept
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.line = g.line GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines,
  CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(gone, '') AS removed_lines,
  CASE WHEN d.text IS NULL THEN NULL ELSE CAST(greatest(kept - 1, 0) AS BIGINT) END AS n_chars_kept
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id
"""
