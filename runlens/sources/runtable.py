"""The run table: append-only ingest log, last-write-wins reads, compaction, restore, stats.

There is no lakehouse format in the environment, so the upsert of the reference
(``INSERT … ON CONFLICT (run_id) DO UPDATE``) is expressed as
* an append-only log partitioned by ``ingest_batch`` (each batch is one atomic Spark write), and
* a read-side resolution ``latest(log)``: per run_id the row of the highest ``ingest_seq``, with
  ``created_at`` of the first insertion (Q6). This is an aggregation (``max_by`` over a struct),
  partial-aggregable, so one run id repeated a billion times is combined map-side;
* compaction writes the resolved rows into a *new* directory partitioned by (project, run_date),
  sorted by trace_id inside each partition (min/max stats make trace/run point lookups cheap).
  Readers switch to the new directory; a run that moved project/day leaves no stale copy behind
  (which dynamic partition overwrite would).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

KEY_COLS = ["run_id", "trace_id", "project", "run_date"]


def append_batch(records: DataFrame, log_path: str, batch: int, ingest_ts=None) -> dict:
    """S7 write half: append one ingest batch to the log; returns {stored, skipped} counts measured
    by an ``Observation`` (no extra pass). Rows without a run_id are skipped (counted)."""
    from pyspark.sql import Observation
    obs = Observation(f"batch_{batch}")
    ts = F.lit(ingest_ts).cast("timestamp") if ingest_ts is not None else F.current_timestamp()
    ok = F.col("run_id").isNotNull() & F.col("project").isNotNull() & F.col("run_date").isNotNull()
    out = (records.withColumn("_ok", ok)
           .observe(obs, F.count_if("_ok").alias("stored"), F.count_if(~F.col("_ok")).alias("skipped"))
           .where("_ok").drop("_ok")
           .withColumns({"ingest_batch": F.lit(batch), "created_at": F.coalesce(
               F.col("created_at") if "created_at" in records.columns else F.lit(None).cast("timestamp"), ts)}))
    if "ingest_seq" not in out.columns:
        out = out.withColumn("ingest_seq", ingest_order(out))
    if "doc" in out.columns:
        out = out.withColumn("doc", F.to_json("doc"))
    # a batch has a folder of its own, which a replay of the batch replaces
    out.drop("ingest_batch").write.mode("overwrite").parquet(f"{log_path}/ingest_batch={batch}")
    return dict(obs.get)


#: digits of an ingest order: batch (milliseconds fit), start in microseconds, hash of the run
ORDER_DIGITS = (14, 16, 8)


def ingest_order(rows: DataFrame) -> Column:
    """Place of a row in the order of ingestion as decimal(38,0): batch, then start time, then run.

    It follows from the row alone, so a task that runs again gives the same order, whatever the number of rows.
    A batch holds a run once; numbers that have no room are an error, never cut.
    """
    started = F.unix_micros("start_time") if "start_time" in rows.columns else F.lit(0)
    parts = (F.col("ingest_batch"), F.greatest(F.coalesce(started, F.lit(0)), F.lit(0)),
             F.pmod(F.xxhash64("run_id"), F.lit(10 ** ORDER_DIGITS[2])))
    fits = [F.when(c.between(0, 10 ** n - 1), F.lpad(c.cast("string"), n, "0"))
            .otherwise(F.raise_error(F.concat(F.lit("no room in an ingest order for "), c.cast("string"))))
            for c, n in zip(parts, ORDER_DIGITS)]
    return F.concat(*fits).cast("decimal(38,0)")


def read_log(spark: SparkSession, log_path: str) -> DataFrame:
    df = spark.read.parquet(log_path)
    if "doc" in df.columns:
        df = df.withColumn("doc", F.try_parse_json("doc"))
    return df


def latest(log: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """S7 read half: last write wins per run_id; created_at = first insertion."""
    cols = [c for c in log.columns if c != "created_at"]
    payload = [c for c in cols if c != "run_id"]
    doc_is_variant = "doc" in log.columns and log.schema["doc"].dataType.typeName() == "variant"
    src = log.withColumn("doc", F.to_json("doc")) if doc_is_variant else log
    g = src.groupBy("run_id").agg(
        F.max_by(F.struct(*[F.col(c) for c in payload]), F.col(seq)).alias("_l"),
        F.min("created_at").alias("created_at"))
    out = g.select("run_id", *[F.col("_l." + c).alias(c) for c in payload], "created_at")
    return out.withColumn("doc", F.try_parse_json("doc")) if doc_is_variant else out


def compact(runs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a run table version partitioned by (project, run_date), zstd Parquet, rows of a
    partition clustered by trace_id; a busy project and day is split into several files by trace.
    Fails on an empty input (V4), counted while it is written. A version has a folder of its own: overwriting is
    refused, since an empty input would be found only after the old version had gone."""
    from pyspark.sql import Observation
    if mode == "overwrite":
        raise ValueError("a new version goes to a new folder")
    rows = Observation()
    out = runs.withColumn("doc", F.to_json("doc")) if "doc" in runs.columns and \
        runs.schema["doc"].dataType.typeName() == "variant" else runs
    (out.repartitionByRange("project", "run_date", "trace_id")
        .sortWithinPartitions("project", "run_date", "trace_id", "run_id")
        .observe(rows, F.count(F.lit(1)).alias("n"))
        .write.mode(mode).option("compression", "zstd")
        .partitionBy("project", "run_date").parquet(path))
    if not rows.get["n"]:
        raise ValueError("nothing to compact: no runs")


def read_partitioned(spark: SparkSession, path: str) -> DataFrame:
    """The table with its partition columns as written: project names such as 007 stay strings."""
    kinds = {"project": StringType(), "run_date": DateType()}
    found = spark.read.parquet(path).schema
    return spark.read.schema(StructType([StructField(f.name, kinds.get(f.name, f.dataType), f.nullable)
                                         for f in found])).parquet(path)


def read_table(spark: SparkSession, path: str, project: str | None = None, start=None, end=None) -> DataFrame:
    """S3 over a compacted table: partition filters prune directories before any file is opened."""
    return as_runs(of_places(read_partitioned(spark, path), project, start, end))


def of_places(df: DataFrame, project: str | None = None, start=None, end=None) -> DataFrame:
    """Rows of a project and of the days ``start`` to ``end`` (of that day alone without ``end``)."""
    if project is not None:
        df = df.where(F.col("project") == project)
    if start is not None:
        df = df.where(F.col("run_date") >= F.lit(str(start)).cast("date"))
        df = df.where(F.col("run_date") <= F.lit(str(end or start)).cast("date"))
    return df


def as_runs(df: DataFrame) -> DataFrame:
    """Rows of a stored table as the operators take them: documents parsed, merge order ``ord``."""
    if "doc" in df.columns:
        df = df.withColumn("doc", F.try_parse_json("doc"))
    if "ord" not in df.columns and "ingest_seq" in df.columns:
        # merge order of runs = ingest order (stands for the reference's created_at order)
        df = df.withColumn("ord", F.col("ingest_seq"))
    return df


def restore_partition(spark: SparkSession, archive_path: str, table_path: str, project: str, day: str,
                      force: bool = False) -> int:
    """Copy one archived (project, day) partition back into a table; refuses to overwrite an
    existing partition unless ``force``."""
    src = read_partitioned(spark, archive_path).where(
        (F.col("project") == project) & (F.col("run_date") == F.lit(day).cast("date")))
    target = os.path.join(table_path, f"project={project}", f"run_date={day}")
    n = src.count()
    if n == 0:
        raise ValueError(f"no archived runs for {project} {day}")
    (src.drop("project", "run_date").write.mode("overwrite" if force else "errorifexists")
        .option("compression", "zstd").parquet(target))
    return n


def partition_stats(spark: SparkSession, root: str) -> DataFrame:
    """Per (project, day) folder of the landing area: run files, their bytes and MB, summary files.

    Run files are listed by the ``binaryFile`` source without reading their content. Summaries (``_*.json``) are hidden
    from Spark's file index, so their paths come from one listing of the file system on the driver, which
    has an entry for each folder, as Spark's own listing of partitions does. They count, their bytes do not. A folder
    of summaries alone has no run files and 0 bytes.
    """
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
          .option("pathGlobFilter", "*.json").load(root).select("path", "length"))
    hidden = spark.createDataFrame([(p,) for p in _summary_paths(spark, root)], "path string")
    path = F.col("path")
    parts = df.withColumn("hidden", F.lit(0)).union(hidden.select("path", F.lit(0).cast("long"), F.lit(1))).select(
        F.regexp_extract(path, r"/([^/]+)/(\d{4}-\d{2}-\d{2})/[^/]+$", 1).alias("project"),
        F.regexp_extract(path, r"/([^/]+)/(\d{4}-\d{2}-\d{2})/[^/]+$", 2).alias("date"), "length", "hidden")
    return (parts.groupBy("project", "date")
            .agg(F.count_if(F.col("hidden") == 0).alias("run_files"), F.sum("hidden").alias("summary_files"),
                 F.sum("length").alias("total_bytes"))
            .withColumn("total_mb", F.round(F.col("total_bytes") / (1024 * 1024), 2)))


def _summary_paths(spark: SparkSession, root: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(root, "*", "*", "_*.json"))
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [status.getPath().toString() for status in found or []]
