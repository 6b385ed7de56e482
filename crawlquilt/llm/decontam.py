"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as normal bytes: A-Z in lower case, every run of other ASCII
characters than letters and digits as one space. An item of ``m`` normal bytes may
occur with up to ``e = floor(rate * m)`` edits. Split into ``e + 1`` pieces, at least
one piece of it must then stand unchanged in the text (pigeonhole). One automaton
finds the exact hits of all pieces in one pass over a whole text; hits at nearby
offsets make one window, which Myers' bit-parallel distance verifies. Before that a
window must hold as many of the item's q-grams as ``e`` edits leave, which loses no
match.

Documents are neither shuffled nor cut; the items are broadcast in chunks of a bounded
number of bytes, one pass over the documents for each chunk. A worker builds the
automaton of a chunk once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlquilt.llm.common import arrow_schema, columns_batch, matching, table, text_key, written

RATE = 0.08
#: Items with fewer normal bytes count where they stand unchanged, as whole words.
MIN_BYTES = 32
#: Normal bytes of the items that one pass looks for.
CHUNK_BYTES = 8 << 20
Q = 4

SCHEMA = "doc_id long, item_id long, distance long, start long, stop long, text_hash long"

_NORMAL = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def normal(text: str | None) -> str:
    """The normal bytes of a text, each as one character."""
    return b" ".join((text or "").encode("utf-8", "replace").translate(_NORMAL).split()).decode("latin-1")


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` pieces of nearly the same length, with their places."""
    n, m = edits + 1, len(item)
    return [(a := m * i // n, item[a : m * (i + 1) // n]) for i in range(n)]


def myers(pattern: str, text: str, most: int) -> tuple[int, int]:
    """The least edit distance of the pattern to a substring of the text, and the
    end of the first such substring; distances over ``most`` give (most + 1, -1)."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, most + 1, -1
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        pv = ((mh << 1) & full) | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
            if not best:
                break
    return best, end


class Matcher:
    """Finds the items in normal texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float, min_bytes: int = 0):
        import ahocorasick

        self.items = [(i, s, int(rate * len(s)) if len(s) >= min_bytes else 0) for i, s in items]
        self.whole = [len(s) < min_bytes for _, s in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, s, e) in enumerate(self.items):
            for a, piece in pieces(s, e):
                places.setdefault(piece, []).append((k, a + len(piece) - 1))
        self.find = ahocorasick.Automaton()
        for piece, where in places.items():
            self.find.add_word(piece, where)
        self.find.make_automaton()
        self.grams: dict[int, list[str]] = {}

    def __call__(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, stop) of the nearest occurrence of each item,
        the first among equals. The start is exact for the reported stop."""
        offsets: dict[int, set[int]] = {}
        words: dict[int, int] = {}
        for end, where in self.find.iter(text):
            for k, a in where:
                if not self.whole[k]:
                    offsets.setdefault(k, set()).add(end - a)
                elif k not in words and (end == a or text[end - a - 1] == " ") and (end + 1 == len(text) or text[end + 1] == " "):
                    words[k] = end - a
        out = [(self.items[k][0], 0, a, a + len(self.items[k][1])) for k, a in sorted(words.items())]
        for k, starts in sorted(offsets.items()):
            item_id, s, e = self.items[k]
            best = (e + 1, 0, 0)
            for a, b in _windows(sorted(starts), e, len(s), len(text)):
                window = text[a:b]
                if not self._enough(k, window):
                    continue
                d, end = myers(s, window, min(e, best[0] - 1))
                if d < best[0]:
                    back, length = myers(s[::-1], window[:end][::-1], d)
                    best = (d, a + end - length, a + end) if back == d else (d, max(a, a + end - len(s)), a + end)
                    if not d:
                        break
            if best[0] <= e:
                out.append((item_id, *best))
        return out

    def _enough(self, k: int, window: str) -> bool:
        _, s, e = self.items[k]
        least = len(s) - Q + 1 - e * Q
        if least <= 0:
            return True
        if (grams := self.grams.get(k)) is None:
            grams = self.grams[k] = [s[i : i + Q] for i in range(len(s) - Q + 1)]
        there = {window[i : i + Q] for i in range(len(window) - Q + 1)}
        return sum(g in there for g in grams) >= least


#: The matcher that a worker used last, and the name of its chunk.
_last: list = [None, None]


def _matcher(name: str, items: list[tuple[int, str]], rate: float, min_bytes: int) -> Matcher:
    if _last[0] != name:
        _last[:] = [name, Matcher(items, rate, min_bytes)]
    return _last[1]


def _windows(starts: list[int], e: int, m: int, n: int) -> Iterator[tuple[int, int]]:
    """Stretches of the text that hold every match with one of the starts, up to ``e`` off."""
    a = b = None
    for x in starts:
        if b is not None and x - e <= b + 1 and b - a < 8 * m:
            b = min(n, x + m + e)
            continue
        if b is not None:
            yield a, b
        a, b = max(0, x - e), min(n, x + m + e)
    if b is not None:
        yield a, b


def _chunks(benchmark: DataFrame, chunk_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items as normal texts, at most about ``chunk_bytes`` at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // chunk_bytes))
    for i in range(n):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i) if n > 1 else items
        found = sorted((r[0], s) for r in part.collect() if (s := normal(r[1])))
        if found:
            yield found


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_bytes: int = MIN_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, item_id, distance, start, stop (in the normal text), text_hash: the
    nearest occurrence of each item in each document that holds it. Items under
    ``min_bytes`` count without edits and between word boundaries only.

    A null or empty text holds nothing; null ids of documents are kept as they are,
    items with a null id or text, or no letter or digit, are left out, and an item given twice counts once.
    Rows that share a doc_id are searched each for itself, and the text hash tells
    them apart; a document given twice gives its rows twice. Empty tables give no
    rows, and further columns are not read."""
    schema = arrow_schema(SCHEMA)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("text_hash"))
    out = None
    for items in _chunks(benchmark, chunk_bytes):

        held = source.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], held=held, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            match = _matcher(name, held.value, rate, min_bytes)
            for batch in batches:
                rows: list[tuple] = []
                for i, key in enumerate(batch.column(2).to_pylist()):
                    text = normal(batch.column(1)[i].as_py())
                    if text and (found := match(text)):
                        doc_id = batch.column(0)[i].as_py()
                        rows += [(doc_id, *x, key) for x in found]
                yield columns_batch(rows, schema)

        part = source.mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return source.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    hits = written(matches(docs, benchmark, rate).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_key")).distinct())
    return matching(docs, hits, "left_anti")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "distance", "start", "stop")
