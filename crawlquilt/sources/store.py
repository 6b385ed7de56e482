"""The crawl store: Parquet tables, a folder for each run, and exports."""

from __future__ import annotations

import hashlib
import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlquilt.functions.text import csv_guard, xml_name
from crawlquilt.schema import Crawl

TABLES = ["pages", "urls", "links", "issues", "dupes", "psi", "psi_opps", "sitemaps", "sitemap_entries", "runs", "frontier"]
#: The key of each table that is upserted.
KEYS = {"pages": ["run_id", "url_id"], "urls": ["run_id", "id"], "issues": ["run_id", "url_id", "code"], "dupes": ["run_id", "url_id", "kind"], "psi": ["run_id", "url", "strategy"], "frontier": ["run_id", "url"], "runs": ["id"]}


def with_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder that the session names. Where it names none, a
    temporary one serves a local master; a cluster must name one."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="crawlquilt-"))


def read(spark: SparkSession, root: str, run_id: str | None = None) -> Crawl:
    """The tables under ``root``; with a run, only its partitions are read. Tables that
    aren't there are None."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {}
    for name in TABLES:
        if there.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")):
            df = spark.read.parquet(f"{root}/{name}")
            found[name] = df if run_id is None else df.where(F.col("id" if name == "runs" else "run_id") == run_id)
    return Crawl(**found)


def write(table: DataFrame, root: str, name: str) -> None:
    """Replace the runs that ``table`` holds, and no others."""
    writer = table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer if name == "runs" else writer.partitionBy("run_id")).parquet(f"{root}/{name}")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], batch: str = "batch") -> DataFrame:
    """The last row of each key, by batch; rows of ``new`` win within one. Both have the
    batch column. Keys meet once, in one shuffle."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(batch), F.desc("_new")))
    return both.withColumn("_n", last).where("_n = 1").drop("_n", "_new")


def append_urls(old: DataFrame, new: DataFrame) -> DataFrame:
    """Urls are only ever added: a known id keeps its url."""
    return old.unionByName(new.join(old.select("run_id", "id"), ["run_id", "id"], "left_anti").dropDuplicates(["run_id", "id"]))


def replace_issues(old: DataFrame, new: DataFrame, codes: list[str]) -> DataFrame:
    """Issues with those codes are cleared in the runs of ``new``, and the new ones put in."""
    runs = new.select("run_id").distinct()
    kept = old.join(F.broadcast(runs.withColumn("_hit", F.lit(True))), "run_id", "left").where(F.col("_hit").isNull() | ~F.col("code").isin(codes)).drop("_hit")
    return kept.unionByName(new)


def delete_run(crawl: Crawl, run_id: str) -> Crawl:
    """The tables less one run: where they are partitioned by run, its folder is all that goes."""
    gone = {name: df.where(F.col("id" if name == "runs" else "run_id") != run_id) for name in TABLES if (df := getattr(crawl, name)) is not None}
    return Crawl(**gone)


def schema_digest(crawl: Crawl) -> str:
    text = "\n".join(f"{name} {df.schema.json()}" for name in TABLES if (df := getattr(crawl, name)) is not None)
    return hashlib.sha256(text.encode()).hexdigest()


def from_blobs(blobs: DataFrame, schema: str) -> DataFrame:
    """Pages from a stored JSON column ``data``; a broken one gives nulls."""
    return blobs.withColumn("page", F.from_json("data", schema, {"mode": "PERMISSIVE"})).select("*", "page.*").drop("page", "data")


def _texts(df: DataFrame) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]


def export_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """Text cells with a header and CRLF line ends, guarded against formulas. One file
    only if asked for, as one task then writes all."""
    out = df.select(*(csv_guard(c).alias(n) for c, n in zip(_texts(df), df.columns, strict=True)))
    (out.coalesce(1) if single else out).write.mode("overwrite").csv(path, header=True, lineSep="\r\n", escape='"', encoding="UTF-8", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="")


def export_json(df: DataFrame, path: str) -> None:
    """One object of text values a line; the columns are those of the first."""
    df.select(*_texts(df)).write.mode("overwrite").json(path, ignoreNullFields=False)


def export_xml(df: DataFrame, path: str) -> None:
    out = df.select(*(c.alias(xml_name(n)) for c, n in zip(_texts(df), df.columns, strict=True)))
    out.write.mode("overwrite").format("xml").option("rootTag", "crawl").option("rowTag", "row").save(path)


def json_envelope(df: DataFrame) -> DataFrame:
    """One row for small results: {"columns": [...], "rows": [...]} as text."""
    rows = df.select(F.to_json(F.struct(*_texts(df)), {"ignoreNullFields": "false"}).alias("r")).agg(F.array_join(F.collect_list("r"), ",").alias("rows"))
    names = ",".join(f'"{c}"' for c in df.columns)
    return rows.select(F.concat(F.lit(f'{{"columns":[{names}],"rows":['), F.col("rows"), F.lit("]}")).alias("json"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
