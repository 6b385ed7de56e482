"""Quality classifier by importance resampling.

Texts are bags of hashed n-grams (words and pairs of words). Two generative models
are fitted, one on target documents (labelled good and not toxic), one on all raw
documents, whose counts are scaled to the target's size, so that the same smoothing
makes rare n-grams say little in both. A document's importance weight is the logarithm
of the ratio of its probabilities under both, tempered by its length: that of
``LENGTH`` of its n-grams. Documents are drawn without replacement in proportion to
their weights by the Gumbel top-k trick: those with the k largest sums of log weight
and Gumbel noise are the sample, the others are rejected. ``k`` is the number of
documents that weigh no less than all but a small share of the target documents, and
a target document is weighed by the model without it: it is judged as one that the
model hasn't seen. As good and bad weights lie tens apart and the noise has a deviation
of 1.3, the draw decides only between documents near the cut.

The raw model counts every document, as do the weights and the selection; only the
target model rests on a bounded sample of labelled rows. The driver gets one row for
each bucket of the models, and counts by digit of the key for the selection.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlquilt.llm.common import WordHashes, arrow_schema, columns_batch, matching, mix, table, text_key, written

#: log2 of the number of n-gram buckets.
BITS = 16
#: Added to the count of each bucket, in target and scaled raw text alike.
SMOOTHING = 5.0
#: N-grams whose log weight a document's is, and those that are added to its own as neutral ones.
LENGTH, NEUTRAL = 1000, 20
#: At most so many labelled target documents are learned from, chosen by a hash of the id.
MOST_LABELLED = 100_000
#: Share of the target documents that may weigh less than the least weight counted in k.
TARGET_LOSS = 0.002
SEED = 7

_SCORED = "doc_id long, text_hash long, weight double, gumbel_key double, sort_key long, target boolean"
#: Letters and digits (and all that isn't ASCII), or other signs.
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+")


class Features:
    def __init__(self, bits: int):
        self.shift, self.hashes = np.uint64(64 - bits), WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        """Buckets of the words and word pairs of a text."""
        found = _WORD.findall((text or "").encode("utf-8", "replace"))
        if not found:
            return np.zeros(0, dtype=np.int64)
        h = self.hashes(found)
        with np.errstate(over="ignore"):
            pairs = mix(h[:-1] * np.uint64(3) + h[1:], 2)
        return (np.concatenate((mix(h, 1), pairs)) >> self.shift).astype(np.int64)


def noise(hashes: np.ndarray, seed: int) -> np.ndarray:
    """Gumbel noise that depends on the hashes and the seed alone."""
    u = ((mix(hashes.astype(np.uint64), seed) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    return -np.log(-np.log(u))


def ordered(x: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles."""
    bits = x.view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def target_ids(labels: DataFrame, most: int = MOST_LABELLED) -> list[int]:
    """Ids of labelled good documents, at most ``most``. An id counts only if all its
    labels agree; null ids and null qualities are no labels, a null toxic is not toxic."""
    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")).where("quality = 1 AND toxic = 0")
    return [r[0] for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id").collect()]


@dataclass(frozen=True)
class Model:
    """By bucket, counts in target text and those that raw text of its size would have."""

    target: np.ndarray
    expected: np.ndarray
    smoothing: float

    def ratio(self) -> np.ndarray:
        """By bucket, the log of the ratio of its probabilities in target and raw text."""
        return np.log((self.target + self.smoothing) / (self.expected + self.smoothing))

    def without(self, buckets: np.ndarray) -> float:
        """The log ratio of a target document's n-grams under the model without it."""
        own, n = np.unique(buckets, return_counts=True)
        left = 1 - len(buckets) / max(self.target.sum(), 1)
        return float((n * np.log((self.target[own] - n + self.smoothing) / (self.expected[own] * left + self.smoothing))).sum())


def fit(docs: DataFrame, ids: list[int], bits: int = BITS, smoothing: float = SMOOTHING) -> Model:
    """Both models. N-grams are counted batch by batch."""
    schema = arrow_schema("bucket int, raw long, target long")
    target = docs.sparkSession.sparkContext.broadcast(frozenset(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, good = Features(bits), target.value
        n = np.zeros((2, 1 << bits), dtype=np.int64)
        held: tuple[list, list] = ([], [])

        def count() -> None:
            for k, found in enumerate(held):
                if found:
                    n[k] += np.bincount(np.concatenate(found), minlength=1 << bits)
                    found.clear()

        size = 0
        for batch in batches:
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                found = features(batch.column(1)[i].as_py())
                held[0].append(found)
                if doc_id in good:
                    held[1].append(found)
                size += len(found)
                if size > 1 << 18:
                    count()
                    size = 0
        count()
        there = np.flatnonzero(n[0])
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(n[0][there]), pa.array(n[1][there])], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    n = np.zeros((2, 1 << bits))
    for k, name in enumerate(("raw", "target")):
        n[k, rows.column("bucket").to_numpy()] = rows.column(name).to_numpy()
    return Model(n[1], n[0] * (n[1].sum() / max(n[0].sum(), 1)), smoothing)


def weigh(docs: DataFrame, ids: list[int], model: Model, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """doc_id, text_hash, weight, gumbel_key, sort_key, target of every row."""
    schema = arrow_schema(_SCORED)
    held = docs.sparkSession.sparkContext.broadcast((frozenset(ids), model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, (good, model) = Features(bits), held.value
        ratio = model.ratio()

        def weight(text: str | None, own: bool) -> float:
            found = features(text)
            return LENGTH * (model.without(found) if own else float(ratio[found].sum())) / (len(found) + NEUTRAL)

        for batch in batches:
            if not batch.num_rows:
                continue
            target = [x in good for x in batch.column(0).to_pylist()]
            weights = np.array([weight(batch.column(1)[i].as_py(), own) for i, own in enumerate(target)])
            keys = weights + noise(batch.column(3).to_numpy(zero_copy_only=False), seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(weights), pa.array(keys), pa.array(ordered(keys)), pa.array(target)], schema=schema)

    key = text_key(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key.alias("key"), F.xxhash64("doc_id", key).alias("draw")).mapInArrow(run, _SCORED)


def kth_largest(rows: DataFrame, k: int, column: str = "sort_key", digit: int = 16) -> int:
    """The k-th largest of a column of 64-bit integers, exactly: from the highest digit
    down, counts by digit tell which one the k-th has. A pass sends 2^16 counts at most."""
    prefix, shift = None, 64 - digit
    while True:
        part = rows if prefix is None else rows.where(F.shiftright(column, shift + digit) == prefix)
        counts = part.groupBy(F.shiftright(column, shift).alias("d")).count().collect()
        for d, n in sorted(((r["d"], r["count"]) for r in counts), reverse=True):
            if k <= n:
                prefix = d
                break
            k -= n
        if not shift:
            return prefix
        shift -= digit


def select(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, target_loss: float = TARGET_LOSS, seed: int = SEED) -> DataFrame:
    """doc_id, text_hash, weight, gumbel_key and kept of every row of ``docs``.

    A null or empty text has no n-grams and the weight 0; a text of any length counts
    whole. Rows that share a doc_id are drawn each for itself; rows that share
    id and text have the same key, so they are kept or rejected together (k then grows
    by those that tie). Without labelled target documents nothing can be judged: all
    weights are 0 and all rows are kept. An empty table gives no rows; further columns
    are not read."""
    ids = target_ids(labels, most_labelled)
    model = fit(docs, ids) if ids else Model(np.zeros(1 << BITS), np.zeros(1 << BITS), SMOOTHING)
    scored = written(weigh(docs, ids, model, seed=seed))
    least = scored.where("target").agg(F.percentile("weight", F.lit(target_loss))).first()[0]
    k = scored.where(F.col("weight") >= least).count() if least is not None else 0
    kept = F.col("sort_key") >= kth_largest(scored, k) if k else F.lit(True)
    return scored.select("doc_id", "text_hash", "weight", "gumbel_key", kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with all their columns."""
    bad = select(docs, labels).where("NOT kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_key")).distinct()
    return matching(docs, written(bad), "left_anti")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are kept."""
    return select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).where("kept").select("doc_id", "weight", "gumbel_key")
