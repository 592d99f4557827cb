"""Landing-folder ingest: JSON run files -> typed run rows.

Layout: ``<root>/<project>/<YYYY-MM-DD>/<run_id>_<HHMMSS>.json``; ``_summary.json`` manifests are
hidden files to Spark's file index (leading underscore), as the reference skips them.

The scan is one ``read.text(wholetext)`` over a path glob (directory pruning by project/date comes
from the glob), JSON is parsed with ``try_parse_json`` into VARIANT (malformed files -> NULL ->
``bad_records``), and every later step is a projection: no driver loop over files.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions import text as T
from runlens.functions import variant as V

UUID_RE = r"^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"


def scan_files(spark: SparkSession, root: str, project: str | None = None, day: str | None = None) -> DataFrame:
    """One row per landed file: project and day from the path, raw text, parsed VARIANT."""
    glob = os.path.join(root, project or "*", day or "*", "*.json")
    df = spark.read.option("wholetext", True).text(glob)
    path = F.col("_metadata.file_path")
    return df.select(
        path.alias("file_path"),
        F.regexp_extract(path, r"/([^/]+)/(\d{4}-\d{2}-\d{2})/[^/]+$", 1).alias("path_project"),
        F.regexp_extract(path, r"/([^/]+)/(\d{4}-\d{2}-\d{2})/[^/]+$", 2).alias("path_date"),
        F.regexp_extract(path, r"_(\d{6})\.json$", 1).alias("extracted_hhmmss"),
        F.col("_metadata.file_modification_time").alias("file_mtime"),
        F.try_parse_json("value").alias("v"),
    )


def bad_records(files: DataFrame) -> DataFrame:
    """Files that are not valid JSON (the reference logs and skips them)."""
    return files.where(F.col("v").isNull()).select("file_path")


def reconcile(files: DataFrame) -> DataFrame:
    """Pick the run object of each file and label its format.

    wrapped: ``{"metadata":…, "trace": run}`` (enhanced when metadata.enhanced_feedback is truthy);
    metadata-only (``metadata`` without ``id``): skipped; anything else: a bare (legacy) run.
    File-mode analyses require a truthy ``trace`` (analysis S1 rule), exposed as ``has_trace``.
    """
    return _formats(files.where("v IS NOT NULL")).where(F.col("format") != "metadata_only")


def _formats(files: DataFrame) -> DataFrame:
    v = F.col("v")
    wrapped = V.present(v, "$.trace")
    meta_only = ~wrapped & V.present(v, "$.metadata") & ~V.present(v, "$.id")
    fmt = (F.when(wrapped & V.truthy_at(V.obj_or_empty(v, "$.metadata"), "$.enhanced_feedback"), F.lit("enhanced"))
           .when(wrapped, F.lit("wrapped")).when(meta_only, F.lit("metadata_only")).otherwise(F.lit("bare")))
    return _once(files, {"format": fmt, "has_trace": V.truthy_at(v, "$.trace"),
                         "run": F.when(wrapped, V.sub(v, "$.trace")).otherwise(v)})


def _once(df: DataFrame, found: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once a row. A filter on a plain column is pushed below it with the column's whole
    expression, so a path of a document would be read again for every use; one over a generated row stays above."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in found.items()]))))


def _id_str(run: Column, key: str) -> Column:
    return V.text_at(run, "$." + key)


def valid_legacy(runs: DataFrame) -> Column:
    """Legacy (bare/wrapped) runs need UUID-shaped id fields and ISO timestamps."""
    r = F.col("run")
    ids = F.array(*[V.as_string(r, "$." + k) for k in
                    ("id", "trace_id", "parent_run_id", "session_id", "reference_example_id", "manifest_id")])
    times = F.array(*[V.as_string(r, "$." + k) for k in ("start_time", "end_time", "first_token_time")])
    return (F.forall(F.array_compact(ids), lambda s: s.rlike(UUID_RE))
            & F.forall(F.array_compact(times), lambda s: F.regexp_replace(s, "Z$", "+00:00").try_cast("timestamp").isNotNull()))


def to_records(runs: DataFrame, project: Column | str | None = None, date_mode: str = "utc",
               ingest_date: str | None = None) -> DataFrame:
    """Run object -> run table record.

    run_id = id; trace_id falls back to id (also when the run has trace_id null, Q10);
    project = the given project, else the path project; run_date = start_time's date (``utc``: after
    conversion to UTC; ``offset_local``: the date written in the timestamp, Q8); a missing start_time
    takes ``ingest_date`` (stand-in for "today", Q9) or else the day on which its file was written."""
    r = F.col("run")
    st_raw = V.as_string(r, "$.start_time")
    st = F.regexp_replace(st_raw, "Z$", "+00:00").try_cast("timestamp")
    if date_mode == "utc":
        day = F.to_date(st)
    elif date_mode == "offset_local":
        day = F.substring(st_raw, 1, 10).try_cast("date")
    else:
        raise ValueError("date_mode must be 'utc' or 'offset_local'")
    if ingest_date is not None:
        day = F.coalesce(day, F.lit(ingest_date).cast("date"))
    elif "file_mtime" in runs.columns:
        day = F.coalesce(day, F.to_date("file_mtime"))
    proj = (F.col(project) if isinstance(project, str) and project in runs.columns
            else F.lit(project) if isinstance(project, str) else project if project is not None
            else F.col("path_project"))
    rid = _id_str(r, "id")
    return runs.select(
        rid.alias("run_id"),
        F.coalesce(_id_str(r, "trace_id"), rid).alias("trace_id"),
        _id_str(r, "parent_run_id").alias("parent_run_id"),
        proj.alias("project"),
        day.alias("run_date"),
        st.alias("start_time"),
        st_raw.alias("start_time_raw"),
        V.as_string(r, "$.name").alias("name"),
        V.as_string(r, "$.status").alias("status"),
        V.text_at(r, "$.error").alias("error"),
        r.alias("doc"),
        *[c for c in ("file_path", "format", "extracted_hhmmss", "file_mtime", "reason") if c in runs.columns],
    )


def latest_file_per_run(records: DataFrame) -> DataFrame:
    """A re-fetched run lands twice (``_HHMMSS`` suffix); keep the newest file per run_id.
    A file without an id is a run of its own.
    Aggregation (max over struct), not a window: a hot run id is reduced map-side."""
    cols = records.columns
    # VARIANT is not orderable: order by a struct of the file keys, carry the row as the value
    alone = F.when(F.col("run_id").isNull(), F.col("file_path"))
    best = records.groupBy("run_id", alone.alias("_alone")).agg(
        F.max_by(F.struct(*[F.col(c).alias("_" + c) for c in cols]),
                 F.struct(F.col("file_mtime"), F.col("extracted_hhmmss"), F.col("file_path"))).alias("_b"))
    return best.select(*[F.col("_b._" + c).alias(c) for c in cols])


def file_mode_runs(spark: SparkSession, root: str, project: str | None = None, day: str | None = None) -> DataFrame:
    """Landed runs for the file-mode analyses: parsed, unwrapped, one file per run, ``date_key``
    from the start_time text and ``ord`` from the file path order."""
    files = reconcile(scan_files(spark, root, project, day)).where("has_trace")
    recs = to_records(files)
    recs = latest_file_per_run(recs)
    return recs.withColumns({
        "date_key": T.date_key(F.col("start_time_raw")),
        "ord": F.xxhash64("file_path"),
    })


def landed_records(files: DataFrame, date_mode: str = "utc", ingest_date: str | None = None) -> DataFrame:
    """Every landed file that should hold a run as a record, with the ``reason`` for which it cannot be stored (null:
    it can). Files of metadata alone hold no run. Enhanced files are taken as they are; legacy runs must pass S16."""
    found = _formats(files).where(F.col("format") != "metadata_only")
    no_json = F.col("v").isNull()
    reason = (F.when(no_json, "not JSON")
              .when((F.col("format") != "enhanced") & ~valid_legacy(found), "invalid legacy run")
              .when(_id_str(F.col("run"), "id").isNull(), "no run id"))
    return to_records(_once(found, {"reason": reason}), date_mode=date_mode, ingest_date=ingest_date)


def ingest_records(spark: SparkSession, root: str, project: str | None = None, day: str | None = None,
                   date_mode: str = "utc", ingest_date: str | None = None) -> tuple[DataFrame, DataFrame]:
    """E4 from landed files: (good records, rejected rows with a reason)."""
    recs = landed_records(scan_files(spark, root, project, day), date_mode, ingest_date)
    good = latest_file_per_run(recs.where("reason IS NULL").drop("reason"))
    return good, recs.where("reason = 'invalid legacy run'").select("file_path", "reason")
