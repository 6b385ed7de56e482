"""Approximate nearest neighbours with a forest of random-projection trees.

Each tree halves the vectors by hyperplanes between two random ones, at the median,
down to leaves of about ``LEAF`` vectors, so their number grows with the table. The
trees are fitted on a bounded sample, and every vector is in one leaf of each. A query
walks all trees with one shared priority queue: the next leaf is always the one behind
the smallest margin that was not taken, in whichever tree, until it has visited a number
of leaves. The vectors of those leaves are candidates, and they are ranked by their
exact cosine in double precision.

How many leaves to visit is a property of the vectors: a bounded number of queries is
compared with all vectors, and as many leaves are visited as give these the wanted
recall. Vectors with structure need few, whatever the size of the table.

Leaves are split into blocks of bounded size, so a leaf that a common vector fills is
the work of many tasks; a query goes to all blocks of its leaves. Tasks read blocks as
a sorted stream: the vectors of a block, then its queries in batches. Each task sends
on the best few of a query among its blocks, so the last step sees few rows of each.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlquilt.llm.common import arrow_schema, scratch, table, written

TREES = 20
#: Vectors in a leaf, about.
LEAF = 64
#: Bytes of the trees' planes, at most: they go to every task. 4,096 leaves of 64
#: dimensions have 21 MB; larger tables than this allows for have larger leaves.
MOST_PLANES = 64 << 20
#: Vectors that the trees are fitted on, about, for each leaf and at least; all vectors are in the leaves.
SAMPLE = (16, 20_000)
#: Queries whose true neighbours tell how many leaves to visit, and the share of them to find.
JUDGED, RECALL = 200, 0.96
#: Vectors in a block of a leaf, about.
BLOCK = 4096
NEAREST = 5
SEED = 11


class Forest:
    """Trees in arrays: node 1 is a root, node ``k`` has the children ``2k`` and ``2k + 1``."""

    def __init__(self, sample: np.ndarray, trees: int, leaves: int, seed: int):
        rng = np.random.default_rng(seed)
        dims = sample.shape[1]
        self.leaves, self.depth, self.visits = leaves, leaves.bit_length() - 1, trees * leaves
        self.planes, self.medians = np.zeros((trees, leaves, dims), dtype=np.float32), np.zeros((trees, leaves))
        for t in range(trees):
            parts = {1: np.arange(len(sample))}
            for k in range(1, leaves):
                here = parts.pop(k)
                plane = np.zeros(dims)
                for _ in range(5):  # two equal vectors have no plane between them
                    if len(here) > 1 and not plane.any():
                        a, b = rng.choice(here, 2, replace=False)
                        plane = sample[a] - sample[b]
                if not plane.any():
                    plane = rng.normal(size=dims)
                self.planes[t, k] = plane / np.sqrt((plane**2).sum())
                side = sample[here] @ self.planes[t, k]
                self.medians[t, k] = np.median(side) if len(here) else 0.0
                right = side > self.medians[t, k]
                parts[2 * k], parts[2 * k + 1] = here[~right], here[right]

    def margins(self, unit: np.ndarray, tree: int) -> np.ndarray:
        return unit @ self.planes[tree].T - self.medians[tree]

    def route(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.empty((len(unit), len(self.planes)), dtype=np.int32)
        for t in range(len(self.planes)):
            margin, node = self.margins(unit, t), np.ones(len(unit), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + (margin[np.arange(len(unit)), node] > 0)
            out[:, t] = node - self.leaves
        return out

    def search(self, margins: list[list[list[float]]]) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of one queue over all trees; ``margins`` by tree and node."""
        queue = [(0.0, t, 1) for t in range(len(margins))]
        out = []
        while queue and len(out) < self.visits:
            far, t, k = heapq.heappop(queue)
            here = margins[t]
            while k < self.leaves:
                m = here[k]
                k = 2 * k + (m > 0)
                heapq.heappush(queue, (max(far, abs(m)), t, k ^ 1))
            out.append((t, k - self.leaves))
        return out


    def places(self, margins: np.ndarray) -> np.ndarray:
        """The place of every leaf (by tree) in a query's queue, from 1, equal ones all at the
        last place; ``margins`` by tree and node."""
        far = np.zeros((len(margins), 1))
        for level in range(self.depth):
            here = margins[:, 1 << level : 2 << level]
            both = np.repeat(far, 2, axis=1)
            both[:, 0::2] = np.where(here > 0, np.maximum(far, np.abs(here)), far)
            both[:, 1::2] = np.where(here > 0, far, np.maximum(far, np.abs(here)))
            far = both
        return np.searchsorted(np.sort(far.ravel()), far, side="right")


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that brings its largest component under 1: no
    rounding, and no square that is too large or too small for a double."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None]) if x.size else x


def _units(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x**2).sum(1))[:, None]


def _valid(vectors: DataFrame, column: str) -> DataFrame:
    """id and vec (an array of doubles) of the vectors that are not null, with all
    components finite, not zero, and with an id."""
    v = F.col("vec")
    whole = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col(column).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull())
    return rows.where(whole & F.exists(v, lambda x: x != 0))


def dimensions(vectors: DataFrame, column: str) -> int:
    """The most frequent length of the valid vectors (the longer one if two are as
    frequent); 0 if there are none."""
    top = _valid(vectors, column).groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return top["n"] if top else 0


def usable(vectors: DataFrame, column: str, dims: int) -> DataFrame:
    """id and vec of the valid vectors with ``dims`` components: those that take part."""
    return _valid(vectors, column).where(F.size("vec") == dims)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _fit(rows: DataFrame, count: int, dims: int, trees: int, leaf: int, sample: tuple[int, int], seed: int) -> Forest:
    n = 1
    while 2 * n * leaf <= count and 8 * n * trees * dims <= MOST_PLANES:
        n *= 2
    want = max(sample[0] * n, sample[1])
    draw = 1 << 30
    share = min(draw, -(-draw * want // max(count, 1)))
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(draw)) < share).limit(2 * want).select("id", "vec").toArrow().sort_by("id")
    return Forest(_units(_matrix(chosen.column("vec").combine_chunks())), trees, n, seed)


def true_nearest(rows: DataFrame, ids: np.ndarray, x: np.ndarray, nearest: int) -> list[tuple[int, int, list[float]]]:
    """(query, neighbour, its vector) of the exact nearest of a few queries, by one pass
    over all rows; each task sends on ``nearest`` rows of each query."""
    held = rows.sparkSession.sparkContext.broadcast((ids, x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(nearest)
        for batch in batches:
            if batch.num_rows:
                order = np.argsort(found := batch.column(0).to_numpy(), kind="stable")
                best.add(_best(*held.value, found[order], _matrix(batch.column(1))[order], nearest))
        yield from best.batches(arrow_schema("query_id long, vec_id long, score double"))

    top = _ranked(rows.mapInArrow(run, "query_id long, vec_id long, score double"), nearest).select("query_id", F.col("vec_id").alias("id"))
    return [(r["query_id"], r["id"], r["vec"]) for r in rows.join(F.broadcast(top), "id").collect()]


def visits_for(recall: float, forest: Forest, rows: DataFrame, asked: DataFrame, nearest: int, judged: int = JUDGED) -> int:
    """How many leaves queries must visit for this recall, as ``judged`` of them tell."""
    some = asked.dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(judged).toArrow()
    if not some.num_rows:
        return 1
    ids, x = some.column("id").to_numpy(), _matrix(some.column("vec").combine_chunks())
    margins = np.stack([forest.margins(_units(x), t) for t in range(len(forest.planes))], 1)
    found = sorted(true_nearest(rows, ids, x, nearest))
    if not found:
        return 1
    leaves = forest.route(_units(np.array([v for *_, v in found], dtype=np.float64)))
    place = {int(q): forest.places(m) for q, m in zip(ids, margins, strict=True)}
    trees = np.arange(len(forest.planes))
    first = np.sort([place[q][trees, leaf].min() for (q, *_), leaf in zip(found, leaves, strict=True)])
    return int(first[min(len(first), -(-int(recall * 1000) * len(first) // 1000)) - 1])


def _ranked(found: DataFrame, nearest: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, column: str = "embedding", nearest: int = NEAREST, trees: int = TREES, leaf: int = LEAF, recall: float = RECALL, sample: tuple[int, int] = SAMPLE, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the nearest vectors found.

    Vectors that ``usable`` leaves out are neither queries nor candidates; those of another
    length than most of ``vectors`` are among them, in both tables. A vec_id
    names one vector: rows that repeat it are one candidate, with the best score among
    them, and never the neighbour of a query with their id. Equal scores go by the
    smaller vec_id. An empty table, or one without queries, gives no rows; further
    columns are not read."""
    spark = vectors.sparkSession
    with scratch(spark) as keep:
        dims = dimensions(vectors, column)
        rows = written(usable(vectors, column, dims).dropDuplicates(["id", "vec"]))
        count = rows.count()
        schema = "query_id long, rank int, vec_id long, score double"
        if not count:
            return spark.createDataFrame([], schema)
        asked = usable(queries, column, dims).select("id", "vec")
        fitted = _fit(rows, count, dims, trees, leaf, sample, seed)
        fitted.visits = visits_for(recall, fitted, rows, asked, nearest)
        forest = spark.sparkContext.broadcast(fitted)
        routed = written(rows.mapInArrow(lambda batches: _route(batches, forest.value, nearest), "id long, vec array<double>, leaves array<int>"))
        placed = routed.select("id", "vec", F.posexplode("leaves").alias("tree", "leaf"))
        # One row for each leaf: trees * leaves at most.
        parts = F.broadcast(placed.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")))
        key = ["tree", "leaf", "part"]
        members = placed.join(parts, ["tree", "leaf"]).select(*key[:2], F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("side"), "id", "vec")
        probes = asked.mapInArrow(lambda batches: _probe(batches, forest.value), "id long, vec array<double>, tree int, leaf int")
        probes = probes.join(parts, ["tree", "leaf"]).select(*key[:2], F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"), "id", "vec")
        blocks = members.unionByName(probes).repartition(*key).sortWithinPartitions(*key, "side", "id")
        found = blocks.mapInArrow(lambda batches: _rank(batches, nearest), "query_id long, vec_id long, score double")
        return keep(_ranked(found, nearest))


def _route(batches: Iterator[pa.RecordBatch], forest: Forest, nearest: int) -> Iterator[pa.RecordBatch]:
    """The leaves of each vector. Of equal vectors in a batch those with the smallest
    ids stay, one more than a query returns: the others are never among its nearest.
    Rows that repeat an id and its vector must be gone, so that ids are counted."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
        order = np.argsort(ids, kind="stable")
        _, group = np.unique(x[order], axis=0, return_inverse=True)
        by_group = np.argsort(group.ravel(), kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(group.ravel()[by_group]) != 0])
        place = np.arange(len(ids)) - np.repeat(starts, np.diff(np.r_[starts, len(ids)]))
        kept = np.sort(order[by_group[place <= nearest]])
        leaves = forest.route(_units(x[kept]))
        n = leaves.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(ids[kept]), batch.column(1).take(pa.array(kept)), pa.ListArray.from_arrays(pa.array(np.arange(0, leaves.size + 1, n), pa.int32()), pa.array(leaves.ravel()))], names=["id", "vec", "leaves"])


def _probe(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema("id long, vec array<double>, tree int, leaf int")
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            unit = _units(_matrix(batch.column(1)))
            margins = np.stack([forest.margins(unit, t) for t in range(len(forest.planes))], 1)
            found = [forest.search(m.tolist()) for m in margins]
            rows = np.repeat(np.arange(batch.num_rows), [len(f) for f in found])
            where = np.array([x for f in found for x in f], dtype=np.int32)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(where[:, 0]), pa.array(where[:, 1])], schema=schema)


#: Rows of results that a task gathers before it keeps only the best of each query.
GATHERED = 500_000


class _Best:
    """The best few of each query that a task has met."""

    def __init__(self, nearest: int):
        self.nearest, self.rows, self.held, self.kept = nearest, 0, [], 0

    def add(self, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        self.held.append(found)
        self.rows += len(found[0])
        if self.rows > 2 * self.kept + GATHERED:
            self.reduce()

    def reduce(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, found, score = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((-score, found, query))
        query, found, score = query[order], found[order], score[order]
        new = np.r_[True, (np.diff(query) != 0) | (np.diff(found) != 0)][: len(query)]
        query, found, score = query[new], found[new], score[new]
        order = np.lexsort((found, -score, query))
        query, found, score = query[order], found[order], score[order]
        starts = np.flatnonzero(np.r_[True, np.diff(query) != 0][: len(query)])
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
        out = tuple(x[place < self.nearest] for x in (query, found, score))
        self.held, self.kept = [out], len(out[0])
        self.rows = self.kept
        return out

    def batches(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if self.held:
            out = [pa.array(x) for x in self.reduce()]
            for a in range(0, self.kept, 65_536):
                yield pa.RecordBatch.from_arrays([x.slice(a, 65_536) for x in out], schema=schema)


def _rank(batches: Iterator[pa.RecordBatch], nearest: int) -> Iterator[pa.RecordBatch]:
    """From a stream sorted by block and side, the best few of each query in a task's
    blocks. A task holds those of its queries, three numbers each."""
    schema = arrow_schema("query_id long, vec_id long, score double")
    best = _Best(nearest)
    current, ids, parts, members = None, [], [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(4)], 1)
        starts = np.flatnonzero(np.r_[True, (np.diff(keys, axis=0) != 0).any(1)])
        for a, b in zip(starts, np.r_[starts[1:], len(keys)], strict=True):
            block, side = tuple(keys[a, :3]), keys[a, 3]
            if block != current:
                current, ids, parts, members = block, [], [], None
            part_ids, x = batch.column(4).slice(a, b - a).to_numpy(), _matrix(batch.column(5).slice(a, b - a))
            if side == 0:
                ids.append(part_ids)
                parts.append(x)
                continue
            if not ids:
                continue
            if members is None:
                members = (np.concatenate(ids), np.concatenate(parts))
            for k in range(0, len(part_ids), 512):
                best.add(_best(part_ids[k : k + 512], x[k : k + 512], *members, nearest))
    yield from best.batches(schema)


def _best(queries: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, nearest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score): the ``nearest`` best ids of each query, each by its best row. The ids are sorted."""
    rough = _units(q) @ _units(x).T
    rough[queries[:, None] == ids[None, :]] = -9.0
    firsts = np.flatnonzero(np.r_[True, np.diff(ids) != 0])
    of_id = np.maximum.reduceat(rough, firsts, axis=1) if len(firsts) < len(ids) else rough
    top = min(nearest, len(firsts))
    least = np.partition(of_id, len(firsts) - top, axis=1)[:, len(firsts) - top]
    near = rough >= np.maximum(least, -2.0)[:, None] - 1e-9
    if len(firsts) < len(ids):
        near &= rough >= np.repeat(of_id, np.diff(np.r_[firsts, len(ids)]), axis=1) - 1e-9
    rows, columns = np.nonzero(near)
    # The exact score of what is left: its rounding doesn't depend on the block.
    a, b = _scaled(q[rows]), _scaled(x[columns])
    score = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
    some = _Best(nearest)
    some.add((queries[rows], ids[columns], score))
    return some.reduce()


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))
