"""Packing of tokenised documents into windows of a fixed length.

Order-preserving dynamic programming: the documents of an input partition, in
their order, make one stream of ids; windows are consecutive stretches of it.
Cuts may stand at the end of a document (free), at the end of a sentence (a small
penalty) or on a grid inside sentences (a larger truncation penalty). With
``f(j)`` the least cost of a packing that ends at cut ``j``,

    f(j) = penalty(j) + W - p(j) + min { f(i) + p(i) : p(j) - p(i) <= W }

and as the bound on ``i`` only moves forward, a monotone queue of candidates gives
each minimum in constant amortised time.

No shuffle: the stream of a partition is cut in the task that reads it, in blocks
of bounded size whose last open window moves on to the next block. One window per
partition is not full.
"""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlquilt.llm.common import arrow_schema, columns_batch, table

WINDOW = 2048
END_ID = 1
SENTENCE_PENALTY = 2
TRUNCATION_PENALTY = 16
GRID = 16
#: Ids in a block of the stream.
BLOCK = 1 << 18

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of texts by a byte-level BPE; the rank file holds the same vocabulary as
    the JSON file, and its library is the faster one. A text that contains the
    string of a special token goes by the JSON file, which gives it its own id."""

    def __init__(self, json_path: str | None = None, rank_path: str | None = None):
        import public_tokenizers
        import tiktoken

        self.json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
        with open(rank_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(max(ranks.values()) + 2, dtype=bool)
        for token, i in ranks.items():
            self.ends[i] = token.rstrip(b"\"') ")[-1:] in (b".", b"!", b"?") or b"\n" in token
        self.full = None

    def __call__(self, text: str) -> list[int]:
        if "<|endoftext|>" in text:
            if self.full is None:
                from tokenizers import Tokenizer

                self.full = Tokenizer.from_file(self.json_path)
            return self.full.encode(text, add_special_tokens=False).ids
        return self.plain.encode_ordinary(text)


def cuts(points: list[int], penalties: list[int], window: int) -> list[int]:
    """Positions of the cuts of least total padding plus penalties, the last at
    ``points[-1]``. ``points``: increasing, from 0, with steps of at most ``window``."""
    n = len(points)
    cost, back = [0] * n, [0] * n
    queue = deque(((0, 0, 0),))  # value f(i) + p(i), p(i), i: values increase
    for j in range(1, n):
        p = points[j]
        while p - queue[0][1] > window:
            queue.popleft()
        value, _, back[j] = queue[0]
        cost[j] = c = value + penalties[j] + window - p
        value = c + p
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, p, j))
    out, j = [], n - 1
    while j:
        out.append(points[j])
        j = back[j]
    return out[::-1]


def boundaries(length: int, doc_ends: np.ndarray, sentence_ends: np.ndarray, window: int, grid: int, sentence: int, truncation: int) -> tuple[list[int], list[int]]:
    """The places where cuts may stand, and the penalty of each."""
    price = np.full(length + 1, -1, dtype=np.int32)
    price[:: min(grid, window)] = truncation
    price[sentence_ends] = sentence
    price[doc_ends] = 0
    price[0] = 0
    price[length] = max(0, price[length])
    points = np.flatnonzero(price >= 0)
    return points.tolist(), price[points].tolist()


class _Stream:
    """Documents come in, pieces of full windows come out; what is open is bounded."""

    def __init__(self, first_sequence: int, window: int, block: int, penalties: tuple[int, int], grid: int):
        self.sequence, self.window, self.block, self.penalties, self.grid = first_sequence, window, max(block, 4 * window), penalties, grid
        self.docs: deque = deque()  # [doc_id, all its ids, place from where they are not packed yet]
        self.size = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append([doc_id, ids, 0])
        self.size += len(ids)

    def pieces(self, ends: np.ndarray, last: bool) -> Iterator[tuple]:
        while self.size >= self.block or (last and self.size):
            take, parts, doc_ends, at = min(self.size, self.block), [], [], 0
            for _, ids, start in self.docs:
                parts.append(part := ids[start : start + take - at])
                at += len(part)
                if start + len(part) == len(ids):
                    doc_ends.append(at)
                if at == take:
                    break
            stream = np.concatenate(parts)
            closing = last and take == self.size
            points, price = boundaries(take, np.array(doc_ends, dtype=np.int64), np.flatnonzero(ends[np.minimum(stream, len(ends) - 1)]) + 1, self.window, self.grid, *self.penalties)
            places = cuts(points, price, self.window)
            if not closing:  # the last two windows stay open: what follows may end them better
                places = places[:-2]
            done = 0
            for place in places:
                yield from self._window(place - done)
                done = place

    def _window(self, room: int) -> Iterator[tuple]:
        offset, self.size = 0, self.size - room
        while room:
            doc_id, ids, start = doc = self.docs[0]
            n = min(room, len(ids) - start)
            yield doc_id, start, n, zlib.crc32(ids[start : start + n].astype("<u4").tobytes()), len(ids), self.sequence, offset
            doc[2], offset, room = start + n, offset + n, room - n
            if doc[2] == len(ids):
                self.docs.popleft()
        self.sequence += 1


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, sentence_penalty: int = SENTENCE_PENALTY, truncation_penalty: int = TRUNCATION_PENALTY, grid: int = GRID, block: int = BLOCK, json_path: str | None = None, rank_path: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Pieces of documents by window: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    Every row of ``docs`` is a document of its own, repeated ids and a null id
    included; a null text counts as empty and gives the end id alone. Texts of any
    length are cut, never shortened. An empty table gives no rows; further columns
    of ``docs`` are not read. The order is that of the rows in each input partition;
    ``sequence_id`` is unique, its upper bits are the partition."""

    arrow = arrow_schema(SCHEMA)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(json_path, rank_path)
        stream = _Stream(TaskContext.get().partitionId() << 40, window, block, (sentence_penalty, truncation_penalty), grid)
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            out = columns_batch(held, arrow)
            held.clear()
            return out

        for rows in source:
            for i in range(rows.num_rows):
                ids = encode(rows.column(1)[i].as_py() or "")
                ids.append(end_id)
                stream.add(rows.column(0)[i].as_py(), np.array(ids, dtype=np.uint32))
                if stream.size >= stream.block:
                    held += stream.pieces(encode.ends, last=False)
                if len(held) > 20_000:
                    yield batch()
        held += stream.pieces(encode.ends, last=True)
        if held:
            yield batch()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
