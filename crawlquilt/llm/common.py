"""What the operators share: scratch tables in the folder that the cluster shares,
scans by Arrow batch, and word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where the
    session names none, a temporary one serves a local master; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="crawlquilt-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Paths of the scratch tables of each pass that is under way, the innermost last.
_passes: list[list[str]] = []


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    The lineage ends there, so a lost executor costs no earlier stage. The table goes
    with the pass that it was written in; outside of one it stays until
    ``clear_scratch``, as a lazy result may still read it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/crawlquilt-scratch/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _passes:
        _passes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A pass: its scratch tables are deleted at its end. What it yields writes a result
    that outlives it, as a table of the pass around it, if any."""
    _passes.append([])

    def keep(df: DataFrame) -> DataFrame:
        own = _passes.pop()
        try:
            return written(df)
        finally:
            _passes.append(own)

    try:
        yield keep
    finally:
        for path in _passes.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables of this application; results that read them end."""
    _delete(spark, f"{shared_dir(spark)}/crawlquilt-scratch/{spark.sparkContext.applicationId}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> Column:
    """A stable key of a text, for telling apart rows that share a doc_id."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of ``name type, ...``; types as above or arrays of them."""

    def kind(t: str) -> pa.DataType:
        return pa.list_(kind(t[6:-1])) if t.startswith("array<") else _ARROW[t]

    return pa.schema([(name, kind(t)) for name, t in (x.split() for x in ddl.split(","))])


def columns_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """A batch of row tuples."""
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def unused(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores before those that a table already has."""
    have, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        out.append(name)
        have.add(name.lower())
    return out


#: Rows of two longs that may be broadcast; more are joined by a shuffle.
MOST_SENT = 500_000


def matching(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``docs`` joined (``inner``, ``left_semi`` or ``left_anti``) with a written table of ``_id`` and
    ``_key``, a doc_id and a text key. The keys are counted: few are broadcast, so that
    the texts aren't shuffled, many are not."""
    side = F.broadcast(keys) if keys.count() <= MOST_SENT else keys
    return docs.join(side, docs["doc_id"].cast("long").eqNullSafe(side["_id"]) & (text_key(docs["text"]) == side["_key"]), how)


def per_row(df: DataFrame, rows: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """``rows`` maps an iterator of row dicts of a partition to result dicts, by
    Arrow batches of bounded size on the way in and out."""
    arrow = arrow_schema(schema)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:

        def read():
            for batch in source:
                names = batch.schema.names
                yield from (dict(zip(names, values, strict=True)) for values in zip(*(c.to_pylist() for c in batch.columns), strict=True))

        held: list[dict] = []
        for row in rows(read()):
            held.append(row)
            if len(held) >= 4096:
                yield pa.RecordBatch.from_pylist(held, schema=arrow)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return df.mapInArrow(batches, schema)


class WordHashes:
    """64-bit hashes of words, kept for words seen lately."""

    def __init__(self, most: int = 1 << 18):
        self.most = most
        self.seen: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        seen = self.seen
        if len(seen) > self.most:
            seen.clear()
        out = []
        for w in words:
            h = seen.get(w)
            if h is None:
                h = seen[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return np.array(out, dtype=np.uint64)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them; another one for each seed."""
    with np.errstate(over="ignore"):
        h = h + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


_SPACES = np.zeros(256, dtype=bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
#: The value of each byte in a word's polynomial: A-Z as a-z, nothing for white space.
_VALUES = np.where(_SPACES, 0, np.arange(256) + 1).astype(np.uint64)
_VALUES[65:91] += np.uint64(32)
_FACTOR = 0x9E3779B97F4A7C15
#: Bytes of text that are hashed at once; arrays of eight times the size are needed.
SEGMENT = 1 << 18


class FoldedWords:
    """64-bit hashes of the words of texts (A-Z lower-cased, set apart by ASCII white
    space): the polynomial of a word's bytes modulo 2^64, mixed. Whole segments are
    hashed at once by running sums, and only longer words need more memory."""

    def __init__(self):
        self._grow(SEGMENT + 4096)

    def _grow(self, size: int) -> None:
        with np.errstate(over="ignore"):
            ones = np.ones(1, dtype=np.uint64)
            self.powers = np.cumprod(np.concatenate((ones, np.full(size, _FACTOR, dtype=np.uint64))))
            self.inverses = np.cumprod(np.concatenate((ones, np.full(size, pow(_FACTOR, -1, 1 << 64), dtype=np.uint64))))

    def _hash(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first byte) of each word of a piece of text that cuts no word."""
        if len(data) > len(self.powers):
            self._grow(len(data))
        edges = np.flatnonzero(np.diff(_SPACES[data].view(np.int8), prepend=1, append=1))
        starts, ends = edges[::2], edges[1::2]
        with np.errstate(over="ignore"):
            sums = np.cumsum(_VALUES[data] * self.powers[: len(data)])
            before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
            out = (sums[ends - 1] - before) * self.inverses[starts]
            return mix(out ^ (ends - starts).astype(np.uint64) * np.uint64(_FACTOR)), starts

    def of(self, data: np.ndarray) -> np.ndarray:
        """The word hashes of one text."""
        out, a = [], 0
        while a < len(data):
            b = min(len(data), a + SEGMENT)
            if b < len(data):
                cut = np.flatnonzero(_SPACES[data[a:b]])
                if len(cut):
                    b = a + int(cut[-1]) + 1
                else:
                    rest = np.flatnonzero(_SPACES[data[b:]])
                    b = b + int(rest[0]) if len(rest) else len(data)
            out.append(self._hash(data[a:b])[0])
            a = b
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)

    def batch(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The word hashes of each text of a column; a null has none."""
        if column.null_count:
            column = column.fill_null("")
        if pa.types.is_large_string(column.type):
            column = column.cast(pa.string())
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, dtype=np.int32, count=column.offset + len(column) + 1)[column.offset :]
        data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
        i = 0
        while i < len(column):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + SEGMENT, side="right")) - 1)
            if j == i + 1:
                yield self.of(data[ends[i] : ends[j]])
            else:
                yield from self._many(data, ends[i : j + 1])
            i = j

    def _many(self, data: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
        """Several short texts at once, with a space put between them."""
        n = len(ends) - 1
        sizes = np.diff(ends)
        spaced = np.full(int(ends[-1] - ends[0]) + n, 32, dtype=np.uint8)
        begins = ends[:-1] - ends[0] + np.arange(n)
        keep = np.ones(len(spaced), dtype=bool)
        keep[begins + sizes] = False
        spaced[keep] = data[ends[0] : ends[-1]]
        hashes, starts = self._hash(spaced)
        cuts = np.searchsorted(starts, np.concatenate((begins, [len(spaced)])))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield hashes[a:b]
