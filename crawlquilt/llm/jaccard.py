"""N-gram Jaccard join with multiple-global-order filtering.

A document is the set of its word shingles; two link when 100 * |A & B| >= 90 * |A | B|.

* Equal sets are one class, found by a 128-bit digest; only classes are compared.
* Under any global order of the tokens, two sets that link share a token among the
  ``n - ceil(0.9 n) + 1`` first ones of each. Several orders are used: each puts
  frequent tokens last, by their estimated frequency, and scatters the rest with
  another hash. Candidates share a prefix token of the first order; only those that
  do under every other order as well reach the exact check.
* A group whose members are near each other is not expanded to its pairs: in each
  bucket of a token all are first compared with the member in which the fewest tokens
  stand before it. What that links is a component; only members of a bucket in
  different components are then paired. A pair within a component could not change
  the components, so no link between components is lost.
* With ``i`` and ``j`` tokens before their first common one, two sets share at most
  ``min(n - i, m - j)``. A bucket pairs only members whose places allow a link there;
  the bucket of the first common token of a pair that links always does.

Words and shingles are known by 64-bit hashes, sets by 128 bits of digest: results are
exact but for equal hashes, which texts that weren't made for it hardly have.

Frequent tokens are those that several windows of documents report; their list is
bounded by the total number of tokens, and any order is correct, so it only needs to
be the same everywhere. Texts are scanned once for the classes, once for the
prefixes, once for the sets of the candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlquilt.llm.common import MOST_SENT, FoldedWords, arrow_schema, columns_batch, matching, mix, scratch, table, text_key, written
from crawlquilt.llm.components import components

N = 3
PERCENT = 90
ORDERS = 3
#: Tokens that are put last as frequent ones, at most.
MOST_FREQUENT = 1 << 20
#: Tokens in a window of documents, and the count in it from which a token is reported.
WINDOW_TOKENS = 4_000_000
REPORT = 4
#: Tokens in a batch of rows that a task sends on, or a few more.
SENT = 1 << 16

_SCANNED = "doc_id long, key long, n long, d1 long, d2 long, s1 long, s2 long, token long, reported long"
_PREFIX = "token long, d1 long, place long, d2 long, others array<array<int>>"
_SETS = "id long, tokens array<long>"


class Shingles:
    """The sets of texts, as sorted hashes."""

    def __init__(self, n: int):
        self.n, self.words = n, FoldedWords()

    def batch(self, column: pa.Array) -> Iterator[np.ndarray]:
        for h in self.words.batch(column):
            yield self.of_hashes(h)

    def of_hashes(self, h: np.ndarray) -> np.ndarray:
        """Fewer words than a shingle has make one."""
        if not len(h):
            return h
        size = min(self.n, len(h))
        out = np.full(len(h) - size + 1, size, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size):
                out = (out ^ h[k : len(h) - size + 1 + k]) * _MULTIPLIER
                out ^= out >> np.uint64(29)
        out.sort()
        keep = np.empty(len(out), dtype=bool)
        keep[0] = True
        np.not_equal(out[1:], out[:-1], out=keep[1:])
        return out[keep]


_MULTIPLIER = np.uint64(0xBF58476D1CE4E5B9)


def digest(tokens: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128_digest(tokens.tobytes())
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def sketch(tokens: np.ndarray) -> tuple[int, int]:
    """How many tokens have each value of their highest four bits, 16 counts modulo 256
    in two longs. The counts of two sets differ by no more than the sets do."""
    counts = np.bincount((tokens >> np.uint64(60)).astype(np.int64), minlength=16).astype(np.uint8).tobytes()
    return int.from_bytes(counts[:8], "little", signed=True), int.from_bytes(counts[8:], "little", signed=True)


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


class Orders:
    """The first tokens of a set under each global order: rare ones by a hash, then the
    frequent ones by their count and that hash."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray, orders: int):
        self.frequent, self.counts, self.orders = frequent, counts, orders

    def weights(self, tokens: np.ndarray) -> np.ndarray:
        """Counts of the frequent tokens, 0 for others. A bitmap spares most look-ups."""
        out = np.zeros(len(tokens), dtype=np.int64)
        if len(self.frequent):
            if not hasattr(self, "map"):
                self.map = np.zeros(1 << 24, dtype=bool)
                self.map[(self.frequent >> np.uint64(40)).astype(np.int64)] = True
            maybe = np.flatnonzero(self.map[(tokens >> np.uint64(40)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.frequent, tokens[maybe]), len(self.frequent) - 1)
            out[maybe] = np.where(self.frequent[at] == tokens[maybe], self.counts[at], 0)
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "map"}

    def prefixes(self, tokens: np.ndarray, size: int) -> list[np.ndarray]:
        """The first tokens under each order, in that order."""
        weights = self.weights(tokens)
        rare = tokens[weights == 0]
        often = tokens[weights > 0] if len(rare) < size else None
        out = []
        for k in range(self.orders):
            key = mix(rare, 100 + k)
            if often is None:
                first = np.argpartition(key, size - 1)[:size] if size < len(key) else np.arange(len(key))
                out.append(rare[first[np.argsort(key[first])]])
            else:
                last = np.lexsort((mix(often, 100 + k), weights[weights > 0]))[: size - len(rare)]
                out.append(np.concatenate((rare[np.argsort(key)], often[last])))
        return out


class TokenWindow:
    """The tokens of some documents, one after the other in one buffer."""

    def __init__(self):
        # Beyond 32 MB, so that the memory goes back to the system with the buffer.
        self.held, self.size = np.empty(WINDOW_TOKENS + (1 << 18), dtype=np.uint64), 0

    def add(self, tokens: np.ndarray) -> None:
        end = self.size + len(tokens)
        if end > len(self.held):
            self.held = np.concatenate((self.held[: self.size], np.empty(len(tokens), dtype=np.uint64)))
        self.held[self.size : end] = tokens
        self.size = end

    def report(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens that are in it REPORT times or more, with their counts; it is empty after that.
        It is sorted in place and only marked, as it is the most that a task holds."""
        x, self.size = self.held[: self.size], 0
        x.sort()
        first = np.ones(len(x), dtype=bool)
        np.not_equal(x[1:], x[:-1], out=first[1:])
        last = max(0, len(x) - REPORT + 1)
        starts = np.flatnonzero(first[:last] & (x[len(x) - last :] == x[:last]))
        tokens = x[starts]
        return tokens, np.searchsorted(x, tokens, side="right") - starts


def _scan(docs: DataFrame, n: int) -> DataFrame:
    """A row for each document with its set's digest, and rows of reported tokens."""
    schema = arrow_schema(_SCANNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, window = Shingles(n), TokenWindow()

        def report() -> Iterator[pa.RecordBatch]:
            tokens, counts = window.report()
            for a in range(0, len(tokens), SENT):
                t, c = pa.array(tokens[a : a + SENT].view(np.int64)), pa.array(counts[a : a + SENT])
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(t), f.type) for f in schema)][:-2] + [t, c], schema=schema)

        for batch in batches:
            rows = []
            for doc_id, key, tokens in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), shingles.batch(batch.column(1)), strict=True):
                d1, d2 = digest(tokens)
                rows.append((doc_id, key, len(tokens), d1, d2, *sketch(tokens), None, None))
                window.add(tokens)
                if window.size >= WINDOW_TOKENS:
                    yield from report()
            yield columns_batch(rows, schema)
        yield from report()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("key")).mapInArrow(run, _SCANNED)


def _frequent(scanned: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent tokens, sorted, and their estimated counts: as many of the most frequent
    reported ones as MOST_FREQUENT allows, which bounds what the driver and tasks hold."""
    counted = written(scanned.where("token IS NOT NULL").groupBy("token").agg(F.sum("reported").alias("n")))
    sizes = sorted((r["s"], r["count"]) for r in counted.groupBy(F.floor(F.log2("n")).alias("s")).count().collect())
    total, least = sum(n for _, n in sizes), 0
    for s, n in sizes:
        if total <= MOST_FREQUENT:
            break
        total, least = total - n, 2 ** (s + 1)
    rows = counted.where(F.col("n") >= least).toArrow()
    tokens = rows.column("token").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], rows.column("n").to_numpy().astype(np.int64)[order]


def _prefixes(docs: DataFrame, n: int, percent: int, orders: Orders) -> DataFrame:
    """(token, d1 of the class, place) for each prefix token of the first order of each
    class, and a row of each class with 32 bits of its prefix tokens under the others.
    Half a digest tells classes apart here; two that share it are each other's candidates
    where a third class shares a token."""
    schema = arrow_schema(_PREFIX)
    held = docs.sparkSession.sparkContext.broadcast(orders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, orders, seen = Shingles(n), held.value, set()
        parts: list[list[np.ndarray]] = [[], [], []]
        rows: list[tuple] = []
        held_back = 0

        def sent() -> Iterator[pa.RecordBatch]:
            columns = [pa.array(np.concatenate(x)) for x in parts]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(columns[0]), schema.field(k).type) for k in (3, 4))], schema=schema)
            yield columns_batch(rows, schema)
            for x in (rows, *parts):
                x.clear()

        for batch in batches:
            for tokens in shingles.batch(batch.column(0)):
                if not len(tokens) or (d := digest(tokens)) in seen:
                    continue
                if len(seen) < 1 << 18:
                    seen.add(d)
                prefix, *others = orders.prefixes(tokens, size := prefix_size(len(tokens), percent))
                for part, x in zip(parts, (prefix.view(np.int64), np.full(size, d[0]), np.arange(size)), strict=True):
                    part.append(x)
                rows.append((None, d[0], None, d[1], [(x >> np.uint64(32)).astype(np.uint32).view(np.int32) for x in others]))
                held_back += size
                if held_back >= SENT:
                    yield from sent()
                    held_back = 0
        if rows:
            yield from sent()

    return docs.select("text").mapInArrow(run, _PREFIX)


def _sets(texts: DataFrame, n: int) -> DataFrame:
    """(id, sorted tokens) of each row (id, text)."""
    schema = arrow_schema(_SETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(n)
        for batch in batches:
            rows, size = [], 0
            for i, tokens in zip(batch.column(0).to_pylist(), shingles.batch(batch.column(1)), strict=True):
                rows.append((i, tokens.view(np.int64)))
                size += len(tokens)
                if size > 2_000_000:
                    yield columns_batch(rows, schema)
                    rows, size = [], 0
            yield columns_batch(rows, schema)

    return texts.select("id", "text").mapInArrow(run, _SETS)


def _members(emitted: DataFrame, classes: DataFrame) -> DataFrame:
    """(token, id, n, pos, s1, s2) of each class in each bucket of two classes or more."""
    # Dealt by token once, for the counts and for the join with them: the exchange is used
    # again only if both read the same rows and columns, so the counts read the place as
    # well, and d1 is said to be known, as the join with the classes asks of one of them.
    tokens = emitted.where("token IS NOT NULL AND d1 IS NOT NULL").select("token", "d1", F.col("place").cast("int").alias("place")).repartition("token")
    shared = tokens.groupBy("token").agg(F.min("d1").alias("low"), F.max("d1").alias("high"), F.min("place").alias("least")).where("low <> high AND least >= 0").select("token")
    # A class has a row for each task that met it; they lie together still, and go before the next shuffle.
    each = tokens.join(shared, "token").groupBy("token", "d1").agg(F.min("place").alias("pos"))
    return each.join(classes.select("d1", "id", "n", "s1", "s2"), "d1").select("token", *_MEMBER)


def _filtered(pairs: DataFrame, classes: DataFrame, emitted: DataFrame, orders: int) -> DataFrame:
    """The pairs (a, b) that share a prefix token under every further order."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    wanted = written(classes.join(ids, "id").select("d1", "d2", "id"))
    wanted = F.broadcast(wanted) if wanted.count() <= MOST_SENT else wanted
    # A class has a row for each task that met it.
    prefixes = written(emitted.where("token IS NULL").join(wanted, ["d1", "d2"]).select("id", "others").dropDuplicates(["id"]))
    left = prefixes.select(F.col("id").alias("a"), F.col("others").alias("oa"))
    right = prefixes.select(F.col("id").alias("b"), F.col("others").alias("ob"))
    both = pairs.join(left, "a").join(right, "b")
    for k in range(orders - 1):
        both = both.where(F.arrays_overlap(F.col("oa")[k], F.col("ob")[k]))
    return both.select("a", "b").distinct()


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link, exactly."""
    left = sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("ta", "tb")))
    return both.where(100 * F.col("shared") >= percent * (F.size("ta") + F.size("tb") - F.col("shared"))).select("a", "b")


def _may_link(percent: int) -> Column:
    """Whether two members of a bucket (n, pos, s1, s2) and (other_n, ...) can link if its
    token is the first that they share: by their places, and by the counts of their sketches."""
    both = F.col("n") + F.col("other_n")
    room = (100 + percent) * F.least(F.col("n") - F.col("pos"), F.col("other_n") - F.col("other_pos")) >= percent * both
    apart = F.lit(0)
    for c in ("s1", "s2"):
        for shift in range(0, 64, 8):
            byte = lambda name: F.shiftrightunsigned(F.col(name), shift).bitwiseAND(255)  # noqa: B023, E731
            gap = F.abs(byte(c) - byte(f"other_{c}"))
            apart = apart + F.least(gap, 256 - gap)
    return (F.col("id") != F.col("other")) & room & ((100 + percent) * apart <= (100 - percent) * both)


_MEMBER = ["id", "n", "pos", "s1", "s2"]


def _other(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{c}").alias("other" if c == "id" else f"other_{c}") for c in _MEMBER]


def _pair() -> list[Column]:
    return [F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")]


def _led(members: DataFrame, percent: int) -> DataFrame:
    """The members, with the ``other`` that leads their bucket if they may link with it, and
    whether the bucket is ``wide``, so that its leader's pairs aren't all. Dealt by token once."""
    bucket = Window.partitionBy("token")
    lead = F.min(F.struct("pos", F.xxhash64("id").alias("draw"), "id", "n", "s1", "s2")).over(bucket)
    led = members.select("token", *_MEMBER, lead.alias("lead"), (F.count("*").over(bucket) > 2).alias("wide"))
    led = led.select("token", *_MEMBER, "wide", *_other("lead."))
    return led.select("token", *_MEMBER, "wide", F.when(_may_link(percent), F.col("other")).alias("other"))


def _cross_component(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of a bucket's members in different components, for members of wide buckets. Those
    of the largest component of a bucket stand on one side only, so a pair needs an outsider."""
    # Windows by token come first, so that the one by component too needs no further exchange.
    bucket = Window.partitionBy("token")
    mixed = members.select("token", *_MEMBER, "component", (F.min("component").over(bucket) < F.max("component").over(bucket)).alias("mixed")).where("mixed")
    mixed = mixed.withColumn("size", F.count("*").over(Window.partitionBy("token", "component")))
    main = F.max(F.struct("size", "component")).over(bucket)
    members = written(mixed.select("token", *_MEMBER, "component", (F.col("component") != main["component"]).alias("outside")))
    outside = members.where("outside").select("token", *_MEMBER, "component")
    other = members.select("token", *_other(), F.col("component").alias("other_component"))
    return outside.join(other, (outside["token"] == other["token"]) & (F.col("component") != F.col("other_component")) & _may_link(percent)).select(*_pair()).distinct()


def _verified(docs: DataFrame, classes: DataFrame, emitted: DataFrame, pairs: DataFrame, n: int, percent: int, orders: int) -> DataFrame:
    with scratch(docs.sparkSession) as keep:
        pairs = written(_filtered(pairs, classes, emitted, orders))
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        wanted = written(classes.join(ids, "id").select(F.col("class_id").alias("_id"), F.col("key").alias("_key"), "id"))
        sets = written(_sets(matching(docs.select("doc_id", "text"), wanted, "inner").select("id", "text"), n))
        return keep(_linked(pairs, sets, percent))


def similar(docs: DataFrame, n: int = N, percent: int = PERCENT, orders: int = ORDERS) -> DataFrame:
    """doc_id, text_hash, n_shingles, class_id, component_id and first of every row of ``docs``.

    ``class_id`` is the smallest doc_id with the same set, ``component_id`` the smallest
    one reachable by links, ``first`` marks the document with that id; rows without an id count for neither, and are null there if
    no document with an id is reached. A null, empty or blank text has no set: its
    class and component are its own id. Repeated rows are in the same class, so they
    change nothing. Texts of any length are read whole; an empty table gives no rows;
    further columns are not read."""
    with scratch(docs.sparkSession) as keep:
        scanned = written(_scan(docs, n))
        rows = scanned.where("token IS NULL").drop("token", "reported")
        # A class is named by its first row's id, for joins; ids are counted from 0, null ids included.
        classes = written(rows.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("class_id"), F.min_by("key", F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("key"), F.min("s1").alias("s1"), F.min("s2").alias("s2")))
        classes = written(classes.repartitionByRange("d1").withColumn("id", F.monotonically_increasing_id()))
        order = Orders(*_frequent(scanned), orders)

        emitted = written(_prefixes(docs, n, percent, order))
        members = written(_led(_members(emitted, classes), percent))
        first = written(members.where("other IS NOT NULL").select(*_pair()).distinct())
        links = _verified(docs, classes, emitted, first, n, percent, orders)
        placed = members.where("wide").join(components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))
        rest = written(_cross_component(placed, percent).join(first, ["a", "b"], "left_anti"))
        if not rest.isEmpty():
            links = links.unionByName(_verified(docs, classes, emitted, rest, n, percent, orders))
        reached = classes.join(components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))
        least = reached.groupBy("component").agg(F.min("class_id").alias("component_id"), F.min(F.struct(F.col("class_id").isNull().alias("none"), "class_id", "key")).alias("first"))
        of_class = reached.join(least, "component").select("d1", "d2", "class_id", "component_id", "first")
        out = rows.where("n > 0").join(of_class, ["d1", "d2"])
        chosen = F.col("doc_id").eqNullSafe(F.col("first.class_id")) & (F.col("key") == F.col("first.key"))
        out = out.select("doc_id", F.col("key").alias("text_hash"), F.col("n").alias("n_shingles"), "class_id", "component_id", chosen.alias("first"))
        bare = rows.where("n = 0").select("doc_id", F.col("key").alias("text_hash"), F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
        return keep(out.unionByName(bare))


def one_of_each(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """``docs`` less all but the first document of each component, with all columns.
    Rows that repeat the first one's id and text are the same document and stay too."""
    found = similar(docs, n, percent)
    gone = found.where("NOT first").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_key")).distinct()
    return matching(docs, written(gone), "left_anti")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each doc_id and text; null ids, and null texts, are equal.
    Only rows that are repeated are shuffled with their texts."""
    keys = docs.select(F.col("doc_id").cast("long").alias("_id"), text_key(F.col("text")).alias("_key"))
    repeated = written(keys.groupBy("_id", "_key").count().where("count > 1").select("_id", "_key"))
    again = matching(docs, repeated, "left_semi").dropDuplicates(["doc_id", "text"])
    return matching(docs, repeated, "left_anti").unionByName(again)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


OP3_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + {N - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {N - 1}, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS digest FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)
), r AS (
  SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(c) FROM r WHERE r.id = d.doc_id) AS component_id,
  CASE WHEN n.n IS NULL THEN d.doc_id ELSE min(d.doc_id) OVER (PARTITION BY n.digest, n.n) END AS class_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""
