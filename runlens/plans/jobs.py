"""End-to-end jobs (the reference's commands) composed from operators.

E1 error report · E2 error detail report · E3 evaluation dataset · E4 ingest of landed files.
Each job reads the run table with partition filters (project / day range), so only the partitions
of the request are listed and opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from runlens.operators import curation as C
from runlens.operators import errors as E
from runlens.operators import evaluation as EV
from runlens.operators import quality as Q
from runlens.session import staged
from runlens.sources import landing as L
from runlens.sources import reports as R
from runlens.sources import runtable as RT
from runlens.sources import sinks as SK
from runlens.sources import versions as VT


def _runs(spark: SparkSession, table: str, project: str | None = None, start=None,
          end=None) -> tuple[DataFrame, DataFrame | None]:
    """The runs asked for, and the runs nested in them where the table stores these: a versioned table does, a
    compacted one leaves them in the documents."""
    return VT.read_runs(spark, table, project, start, end) or (RT.read_table(spark, table, project, start, end), None)


def error_report(spark: SparkSession, table: str, day: str, project: str | None = None) -> str:
    """E1 ``report zenrows-errors --date D [--project P]``: CSV text (header even when empty)."""
    Q.validate_params(date=day)
    runs, nested = _runs(spark, table, project, day)
    if project is not None:
        rep = E.daily_error_report(runs, project=project, run_date=day, nested=nested)
    else:
        rep = E.merge_projects(E.daily_error_report(runs, run_date=day, nested=nested))
    return SK.csv_report(rep)


def error_detail_report(spark: SparkSession, table: str, day: str, out: str, project: str | None = None,
                        fmt: str = "text", nested: DataFrame | None = None) -> None:
    """E2 ``report zenrows-detail``: hierarchy symbol -> root trace -> errors, written to ``out`` as text or JSON.

    Nested runs come from ``nested``, if given, or else from where the versioned table stores them. Every error is a row up to the files; the driver gets none.
    """
    Q.validate_params(date=day)
    runs, stored = _runs(spark, table, project, day)
    facts = E.error_facts(runs, project=project, run_date=day, nested=stored if nested is None else nested)
    if project is None:
        facts = E.merge_project_facts(facts)
    facts = staged(facts, "facts")
    if fmt == "json":
        R.write_json(facts, out, day, project)
    else:
        R.write_text(facts, out)


def create_dataset(spark: SparkSession, table: str, project: str, eval_type: str, start: str,
                   end: str | None = None, best_100: bool = False, out: str | None = None) -> DataFrame:
    """E3 ``eval create-dataset``: one scan, one trace-level aggregation, optional curation; written
    as JSONL when ``out`` is given. Name: ``<project>_<type>_<start>_<end>[_best100]``."""
    start, end = Q.validate_params(start=start, end=end, eval_type=eval_type, best_100=best_100)
    runs, _ = _runs(spark, table, project, start, end)
    ds = EV.build_dataset(runs, eval_type)
    if best_100:
        # dataset order of the reference = (run_date, trace_id); curation only compares positions,
        # so the ordering key itself serves as position (no global window / row numbering)
        ds = staged(ds, "dataset")  # curation reads it several times
        ex = ds.withColumn("pos", F.struct("run_date", "trace_id"))
        cur = staged(C.curate(ex.select("pos", "website_url", "is_available", "notes"), 100), "curated")
        C.validate(cur)
        # the whole examples at the positions picked
        ds = ds.join(cur.select("pos.*"), ["run_date", "trace_id"], "left_semi").select(*ds.columns)
    if out:
        name = f"{project}_{eval_type}_{start}_{end}" + ("_best100" if best_100 else "")
        SK.write_dataset_jsonl(ds, f"{out}/{name}", eval_type)
    return ds


def ingest(spark: SparkSession, landing_root: str, log_path: str, batch: int, project: str | None = None,
           day: str | None = None, date_mode: str = "utc", ingest_ts=None, feedback: DataFrame | None = None) -> dict:
    """E4 ``archive to-db`` from landed files: parse, reconcile, validate, map to records, enrich the documents with
    ``feedback(run_id, ...)`` (J1) if given, append one ingest batch to the run log. The files are read once.
    Returns {stored, skipped, rejected}."""
    seen = Observation()
    landed = L.landed_records(L.scan_files(spark, landing_root, project, day), date_mode,
                              str(ingest_ts)[:10] if ingest_ts else None)
    landed = landed.observe(seen, F.count_if(F.col("reason") == "invalid legacy run").alias("rejected"))
    recs = L.latest_file_per_run(landed.where("reason IS NULL").drop("reason"))
    if feedback is not None:
        recs = EV.feedback_in_documents(recs, feedback)
    counts = RT.append_batch(recs, log_path, batch, ingest_ts)
    return counts | dict(seen.get)


def merge_log(spark: SparkSession, log_path: str, table: str) -> dict:
    """E4, second half: bring the versioned table up to the last ingest batch (only touched partitions are written)."""
    return VT.merge_batches(spark, log_path, table)
