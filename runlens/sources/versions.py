"""Versioned run table: ingest batches merged incrementally into partitions of a table.

Layout below the table's folder:

* ``data/v<n>/project=<p>/run_date=<d>/`` holds the partitions that version n wrote; they are never changed.
* ``nested/v<n>/project=<p>/run_date=<d>/`` holds the runs nested in the documents of those rows, typed (N1), so reports
  read no documents for them. They are found once, when their partition is written, and go with it.
* ``versions/version=<n>/`` lists the table of version n: a row for each partition, with the version that wrote it,
  and the last ingest batch that the version contains. The list is written last, so it is what makes a version; a merge that
  fails before leaves data that no list names.

A merge reads the batches after the last merged one, resolves them to one row per run (last write wins), finds the
partitions that hold older rows of these runs, and rewrites just those and the ones that the rows go to. A run
that moved to another project or day leaves its old partition. All other partitions go on in the new list under
the version that wrote them: their files are neither read nor renamed. Merging a batch again changes nothing.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.operators.errors import KEYS, nested_runs
from runlens.session import staged
from runlens.sources import runtable as RT

PLACE = ["project", "run_date"]
LIST = "project string, run_date date, written long, batch long, version long, nested boolean"
#: columns of the stored nested runs; a version may have none, so no file need be there to tell them
NESTED = ("trace_id string, stored_run_id string, ord decimal(38,0), depth int, place array<int>, id string, name string, "
          "status string, error string, start_time string, target_url string, symbol string, project string, run_date date")


def version_list(spark: SparkSession, root: str) -> DataFrame | None:
    """``(project, run_date, written, batch, nested)`` of the newest version, or None before the first one; ``nested``
    says whether the nested runs of the partition are stored."""
    try:
        lists = spark.read.schema(LIST).parquet(f"{root}/versions")
        newest = lists.agg(F.max("version")).first()[0]
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    return None if newest is None else lists.where(F.col("version") == newest)


def read_version(spark: SparkSession, root: str, places: DataFrame | None = None) -> DataFrame | None:
    """The rows of the newest version, of ``places(project, run_date)`` only if given; None if there are none.

    The driver gets the numbers of the versions that wrote what is read, not the partitions: each version's folder
    is read with its partitions pruned by a join with the list.
    """
    listed = version_list(spark, root)
    if listed is None:
        return None
    if places is not None:
        listed = listed.join(places, PLACE, "left_semi")
    return _listed_rows(listed, lambda n: RT.read_partitioned(spark, f"{root}/data/v{n}"))


def _listed_rows(listed: DataFrame, of_version) -> DataFrame | None:
    """The rows of the partitions listed, each from the version that wrote it."""
    parts = []
    for row in listed.select("written").distinct().orderBy("written").collect():
        own = listed.where(F.col("written") == row["written"]).select(*PLACE)
        parts.append(of_version(row["written"]).join(own, PLACE, "left_semi"))
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


def read_runs(spark: SparkSession, root: str, project: str | None = None, start=None,
              end=None) -> tuple[DataFrame, DataFrame | None] | None:
    """S3 over the newest version: the runs of a project and of the days ``start`` to ``end``, with parsed documents,
    and the runs nested in them. The second is None if a partition asked for was written without its nested runs (no
    documents, or an older list), the whole None if the table has no version. Folders of versions and partitions that
    are not asked for are not opened."""
    listed = version_list(spark, root)
    if listed is None:
        return None
    listed = staged(RT.of_places(listed, project, start, end), "listed")
    any_version = version_list(spark, root) if listed.isEmpty() else listed  # gives the columns of an empty answer
    runs = RT.of_places(_listed_rows(any_version, lambda n: RT.read_partitioned(spark, f"{root}/data/v{n}")), project, start, end)
    runs = RT.as_runs(runs)
    if not any_version.where(~F.coalesce("nested", F.lit(False))).isEmpty():
        return runs, None
    nested = _listed_rows(any_version, lambda n: spark.read.schema(NESTED).parquet(f"{root}/nested/v{n}"))
    return runs, RT.of_places(nested, project, start, end)


def _write(rows: DataFrame, last_key: str, target: str) -> None:
    """Files by place; a busy place is split by trace, whose rows stay together."""
    (rows.repartitionByRange(*PLACE, "trace_id").sortWithinPartitions(*PLACE, "trace_id", last_key)
     .write.mode("overwrite").option("compression", "zstd").partitionBy(*PLACE).parquet(target))


def merge_batches(spark: SparkSession, log_path: str, root: str) -> dict:
    """Merge the batches of the ingest log that the table does not have yet.

    Returns ``{version, batch, partitions, runs}``: the version that is current then, the last batch it contains,
    and how many partitions were written with how many runs (0 if there was nothing to merge).
    """
    listed = version_list(spark, root)
    state = listed.agg(F.max("batch").alias("batch"), F.max("version").alias("version")).first() if listed is not None else None
    done, version = (state["batch"], state["version"]) if state is not None else (None, 0)
    log = spark.read.parquet(log_path)
    fresh = log.where(F.col("ingest_batch") > done) if done is not None else log
    last = fresh.agg(F.max("ingest_batch")).first()[0]
    if last is None:
        return {"version": version, "batch": done, "partitions": 0, "runs": 0}
    changed = staged(RT.latest(fresh), "changed")
    touched = changed.select(*PLACE)
    old = read_version(spark, root)
    if old is not None:
        # where older rows of the changed runs are: two short columns of the table and the ids
        places = old.select("run_id", *PLACE).join(changed.select("run_id"), "run_id", "left_semi").select(*PLACE)
        touched = touched.union(places)
    touched = staged(touched.distinct(), "touched")
    kept = read_version(spark, root, touched) if old is not None else None  # None: the batch is of new partitions alone
    rows = changed if kept is None else kept.unionByName(changed, allowMissingColumns=True)
    target = f"{root}/data/v{version + 1}"
    # RT.latest keeps the row of the highest order and the time of the first insertion
    merged = staged(RT.latest(rows), "merged")
    merged_runs = merged.count()
    _write(merged, "run_id", target)
    has_documents = "doc" in merged.columns
    if has_documents:
        runs = RT.as_runs(merged).withColumn("ord", F.col("ingest_seq").cast("decimal(38,0)"))
        _write(nested_runs(runs, keep=[*KEYS, "run_id", "ord"]), "stored_run_id", f"{root}/nested/v{version + 1}")
    own = merged.select(*PLACE).distinct().select(
        *PLACE, F.lit(version + 1).cast("long").alias("written"), F.lit(has_documents).alias("nested"))
    if listed is not None:
        own = own.union(listed.join(touched, PLACE, "left_anti").select(*PLACE, "written", "nested"))
    new = own.select(*PLACE, "written", F.lit(last).cast("long").alias("batch"), "nested")
    new.coalesce(1).write.mode("overwrite").parquet(f"{root}/versions/version={version + 1}")
    return {"version": version + 1, "batch": last, "partitions": merged.select(*PLACE).distinct().count(),
            "runs": merged_runs}
