"""Structured Streaming over crawl events (ts, host, status, error_type, ...)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from crawlquilt.sources.store import KEYS, upsert

# Fixed values of the politeness rule, in seconds.
STEP, MOST, CLEAR_AFTER = 0.5, 10.0, 3


def crawl_rate(events: DataFrame, seconds: int = 10, slide: int = 1, late: str = "30 seconds") -> DataFrame:
    """Events a second in sliding windows; on a stream, windows end with the watermark."""
    windows = F.window("ts", f"{seconds} seconds", f"{slide} seconds")
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(windows.alias("w")).agg((F.count("*") / seconds).alias("rate"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "rate")


def eta(queued: int, rate: float) -> float | None:
    return queued / rate if rate > 0 else None


def penalty_after(penalty: float, clean: int, status: int, error: str) -> tuple[float, int]:
    """A host's penalty and count of clean answers after one more answer."""
    if status in (429, 503) or error in ("timeout", "connection-refused"):
        return (STEP if penalty == 0 else min(MOST, penalty * 2)), 0
    if 200 <= status < 400 and penalty > 0:
        clean += 1
        return (0.0, 0) if clean >= CLEAR_AFTER else (penalty, clean)
    return penalty, clean


class HostPenalty(StatefulProcessor):
    """The penalty of each host after each of its answers; its state is two numbers."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("penalty", "penalty double, clean int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        penalty, clean = tuple(self.state.get()) if self.state.exists() else (0.0, 0)
        for df in rows:
            out = []
            for r in df.sort_values(["ts", "event_id"]).itertuples():
                penalty, clean = penalty_after(penalty, clean, int(r.status), r.error_type or "")
                out.append((key[0], r.event_id, penalty))
            yield pd.DataFrame(out, columns=["host", "event_id", "penalty"])
        self.state.update((penalty, clean))

    def close(self) -> None:
        pass


def host_penalties(events: DataFrame) -> DataFrame:
    """host, event_id, penalty of a stream of answers (host, event_id, ts, status, error_type)."""
    return events.groupBy("host").transformWithStateInPandas(statefulProcessor=HostPenalty(), outputStructType="host string, event_id long, penalty double", outputMode="Append", timeMode="None")


def host_penalties_batch(events: DataFrame) -> DataFrame:
    """The same of a table: a host's answers are sorted within its partition and read as a
    stream, so no host has to fit in memory."""
    ordered = events.select("host", "event_id", "ts", "status", "error_type").repartition("host").sortWithinPartitions("host", "ts", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, penalty, clean = None, 0.0, 0
        for df in batches:
            out = []
            for r in df.itertuples():
                if r.host != host:
                    host, penalty, clean = r.host, 0.0, 0
                penalty, clean = penalty_after(penalty, clean, int(r.status), r.error_type or "")
                out.append((host, r.event_id, penalty))
            yield pd.DataFrame(out, columns=["host", "event_id", "penalty"])

    return ordered.mapInPandas(run, "host string, event_id long, penalty double")


def last_attempts(attempts: DataFrame, key: tuple[str, ...] = ("run_id", "url")) -> DataFrame:
    """The last attempt at each url, as a deferred retry replaces the first one."""
    return attempts.groupBy(*key).agg(F.max_by(F.struct(*attempts.columns), "attempt").alias("x")).select("x.*")


def flush_to(root: str, table: str, stream: DataFrame, checkpoint: str) -> DataStreamWriter:
    """Write micro-batches as upserts of a store table; the batch id is the revision. A
    batch that runs again writes the same rows."""

    def flush(batch: DataFrame, revision: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("batch", F.lit(revision))
        path = f"{root}/{table}"
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(hadoop):
            runs = [r[0] for r in new.select("run_id").distinct().collect()]
            old = spark.read.parquet(path).where(F.col("run_id").isin(runs))
            new = upsert(old, new, KEYS[table]).checkpoint()
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)

    return stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).outputMode("update")
