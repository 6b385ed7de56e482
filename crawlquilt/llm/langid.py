"""Language identification as a mixture of languages.

Each language has a model of hashed byte trigrams, smoothed by the trigrams of all.
A document is a mixture: expectation-maximisation estimates the proportions of the
languages that best explain its trigrams. How many languages it has is chosen by
penalised likelihood: the set grows from the likeliest single language, in the order
of the full mixture's proportions, as long as a further language gains more than its
share of the penalty. The predicted language is that with the largest proportion.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlquilt.llm.common import arrow_schema, columns_batch, table, text_key

#: log2 of the number of trigram buckets.
BITS = 16
SMOOTHING = 0.5
ROUNDS = 30
#: Letters stand in three trigrams each, so a trigram counts a third in likelihoods.
SHARE = 1 / 3
#: Factor of the penalty, half the logarithm of the evidence for each further language.
PENALTY = 2.0
#: Languages whose counts a task holds at once; it sends them on when there are more.
HELD_LANGUAGES = 64
UNKNOWN = "und"

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, languages string, text_hash long"

_MAYBE_LETTER = re.compile(r"[^\W\d_]")
_CLASS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def has_letter(text: str) -> bool:
    """Whether a text has a letter; signs such as a half or a raised two are none."""
    return any(m.group().isalpha() for m in _MAYBE_LETTER.finditer(text))


def grams(text: str) -> np.ndarray:
    """Buckets of the trigrams of a text's letters, words set apart by one space."""
    data = b" " + b" ".join(text.encode("utf-8", "replace").translate(_CLASS).split()) + b" "
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, dtype=np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def learn(docs: DataFrame, held_languages: int = HELD_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """The languages, and the log probability of each bucket by language, from all
    rows of ``docs`` (text, lang) that have both. The driver gets the sums alone: at
    most a row for each language and bucket. A language takes 256 kB of the model, on the
    driver and in each task."""
    schema = arrow_schema("lang string, bucket int, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, n in sums.items():
                there = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(there), pa.string()), pa.array(there, pa.int32()), pa.array(n[there], pa.int64())], schema=schema)
            sums.clear()

        for batch in batches:
            for i, lang in enumerate(batch.column(1).to_pylist()):
                if lang not in sums:
                    if len(sums) >= held_languages:
                        yield from sent()
                    sums[lang] = np.zeros(1 << BITS, dtype=np.int64)
                buckets, n = np.unique(grams(batch.column(0)[i].as_py()), return_counts=True)
                sums[lang][buckets] += n
        yield from sent()

    known = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    sums = known.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(sums.column("lang").to_pylist()))
    n = np.zeros((len(langs), 1 << BITS), dtype=np.float32)
    at = {x: i for i, x in enumerate(langs)}
    n[[at[x] for x in sums.column("lang").to_pylist()], sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    if not langs:
        return [], n
    whole = n.sum(0, dtype=np.float64)
    prior = SMOOTHING * 200 * len(langs) * (whole + SMOOTHING) / (whole.sum() + SMOOTHING * len(whole))
    for row in n:  # in place, a language at a time
        smooth = row + prior
        row[:] = np.log(smooth / smooth.sum())
    return langs, n


def mixture(p: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Proportions of the columns of ``p`` (probabilities of the observations, up to a
    factor by row) that make observations with weights ``n`` likeliest; log likelihood."""
    pi = np.full(p.shape[1], 1 / p.shape[1])
    total = n.sum()
    for _ in range(rounds):
        new = pi * (p.T @ (n / (p @ pi))) / total
        done = np.abs(new - pi).max() < 1e-4
        pi = new
        if done:
            break
    return pi, float(n @ np.log(p @ pi))


def proportions(text: str, log_p: np.ndarray) -> list[tuple[int, float]]:
    """(language, proportion) of a text, the largest first."""
    found = grams(text)
    if not len(found):
        return []
    buckets, n = np.unique(found, return_counts=True)
    rows = log_p[buckets].astype(np.float64)
    top = rows.max(1)
    n = n * SHARE
    p = np.exp(rows - top[:, None])
    single = n @ np.log(p)
    best = int(single.argmax())
    cost = PENALTY * 0.5 * np.log(1 + n.sum())
    out, value = [(best, 1.0)], single[best]
    if p.shape[1] == 1 or -value <= cost:  # no mixture is likelier than the best language for each trigram
        return out
    pi, whole = mixture(p, n)
    if whole - value <= cost:
        return out
    order = np.argsort(-pi, kind="stable")
    for size in range(2, len(order) + 1):
        part, likely = mixture(p[:, order[:size]], n)
        if likely - cost * (size - 1) <= value:
            break
        value = likely - cost * (size - 1)
        out = sorted(zip(order[:size].tolist(), part.tolist(), strict=True), key=lambda x: -x[1])
    return out


def predict(docs: DataFrame, langs: list[str], log_p: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages, text_hash of every row of ``docs``.

    ``languages`` lists the chosen set with its proportions, ``score`` is the largest.
    A text that is null or has no letter gets ``und`` and 0, as does every text if no
    language was learned. Repeated ids and null ids (never held out) are judged row by
    row, whole texts at any length; an empty table gives no rows. Only the text is
    read for a prediction; further columns are not read."""
    schema = arrow_schema(SCHEMA)
    model = docs.sparkSession.sparkContext.broadcast((langs, log_p.T.copy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, log_p = model.value
        for batch in batches:
            rows = []
            for i, (doc_id, out, key) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True)):
                text = batch.column(1)[i].as_py()
                found = proportions(text, log_p) if names and text and has_letter(text) else []
                if found:
                    rows.append((doc_id, out, names[found[0][0]], min(1.0, found[0][1]), ",".join(f"{names[k]}:{x:.3f}" for k, x in found), key))
                else:
                    rows.append((doc_id, out, UNKNOWN, 0.0, "", key))
            yield columns_batch(rows, schema)

    doc_id = F.col("doc_id")
    return docs.select(doc_id.cast("long").alias("doc_id"), "text", F.coalesce(held_out(doc_id), F.lit(False)).alias("out"), text_key(F.col("text")).alias("key")).mapInArrow(run, SCHEMA)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, *learn(docs.where(~held_out(F.col("doc_id"))))).drop("text_hash")
