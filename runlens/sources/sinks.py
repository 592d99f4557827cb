"""Daily report and dataset sinks (S5, S6, S10, S11, S12); detail reports are in ``reports``.

The daily report has one row per day: it is produced as a DataFrame, and only its text is put together on the driver.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from runlens.functions import text as T

CSV_HEADER = "Date,Total Traces,Zenrows Errors,Error Rate"


def write_runs_json(records: DataFrame, out: str) -> dict:
    """Runs that can be written and those that cannot, by one pass and one commit: the folders are
    ``outcome=<written|failed>/project=<p>/run_date=<d>``. Returns {written, failed}, counted on the way.

    A row fails with its ``reason``, if it brings one, or for want of an id, a document or a day; the others are written.
    Rows without a project go to ``unknown-project`` (F10), rows without a day to Spark's folder for null.
    """
    brought = F.col("reason") if "reason" in records.columns else F.lit(None).cast("string")
    reason = F.coalesce(brought, F.when(F.col("run_id").isNull(), "no run id").when(F.col("doc").isNull(), "no document")
                        .when(F.col("run_date").isNull(), "no day"))
    counts = Observation(f"written-{uuid.uuid4().hex}")
    rows = (records.withColumn("reason", reason)
            .withColumns({"outcome": F.when(F.col("reason").isNull(), "written").otherwise("failed"),
                          "project": T.sanitize_project(F.col("project"))})
            .observe(counts, F.count_if(F.col("reason").isNull()).alias("written"),
                     F.count_if(F.col("reason").isNotNull()).alias("failed")))
    rows.write.mode("append").partitionBy("outcome", "project", "run_date").json(out)
    return dict(counts.get)


def read_runs_json(spark: SparkSession, out: str, outcome: str) -> DataFrame:
    """The ``written`` or ``failed`` rows of ``write_runs_json``: keys, reason and document."""
    schema = "run_id string, trace_id string, reason string, doc variant, outcome string, project string, run_date date"
    return spark.read.schema(schema).json(out).where(F.col("outcome") == outcome).drop("outcome")


def manifest(records: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Per (project, run_date): total, successful and failed counts, combined map-side."""
    ok = records.select("project", "run_date", F.lit(1).alias("ok"))
    rows = ok if failed is None else ok.union(failed.select("project", "run_date", F.lit(0)))
    return rows.groupBy("project", "run_date").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("ok") == 1).alias("successful"),
        F.count_if(F.col("ok") == 0).alias("failed"))


def manifest_entries(records: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """S6 lists: a row for each run that was written (``reason`` null) or not; never gathered into one row."""
    none = F.lit(None).cast("string")
    ok = records.select("project", "run_date", "run_id", none.alias("reason"))
    if failed is None:
        return ok
    return ok.union(failed.select("project", "run_date", "run_id", F.col("reason") if "reason" in failed.columns else none))


def csv_lines(report: DataFrame, date_col: str = "run_date") -> DataFrame:
    """S10 rows: ``date,total,errors,rate%`` with one decimal; order by date at the sink."""
    return report.select(F.col(date_col).cast("string").alias("date"), F.concat_ws(
        ",", F.col(date_col).cast("string"), F.col("total_traces").cast("string"),
        F.col("zenrows_errors").cast("string"),
        F.concat(F.call_function("format_number", F.col("error_rate"), F.lit("0.0")), F.lit("%"))).alias("line"))


def csv_report(report: DataFrame, date_col: str = "run_date") -> str:
    """S10 text (header even when empty); the report has one row per day, so this is tiny."""
    rows = csv_lines(report, date_col).orderBy("date").collect()
    return "\n".join([CSV_HEADER] + [r["line"] for r in rows]) + "\n"


def write_csv(report: DataFrame, path: str, date_col: str = "run_date") -> None:
    (report.orderBy(date_col).select(
        F.col(date_col).cast("string").alias("Date"), F.col("total_traces").alias("Total Traces"),
        F.col("zenrows_errors").alias("Zenrows Errors"),
        F.concat(F.call_function("format_number", F.col("error_rate"), F.lit("0.0")), F.lit("%")).alias("Error Rate"))
     .coalesce(1).write.mode("overwrite").option("header", True).csv(path))


def summary_text(stats_row, report: DataFrame, date_col: str = "run_date") -> str:
    """A6 text rendering of ``errors.summary_stats`` (one row)."""
    if not stats_row or stats_row["total_days"] == 0:
        return "No data available for the specified date range.\n"
    rates = {str(r[date_col]): r["error_rate"] for r in report.select(date_col, "error_rate").collect()}
    lines = ["=== Zenrows Error Rate Summary ===",
             f"Analysis period: {stats_row['total_days']} day(s)",
             f"Total traces analyzed: {stats_row['total_traces']}",
             f"Total zenrows errors: {stats_row['total_zenrows_errors']}",
             f"Overall error rate: {stats_row['overall_error_rate']:.1f}%"]
    if stats_row["worst_day"] and stats_row["best_day"]:
        lines.append(f"Worst day: {stats_row['worst_day']} ({rates[stats_row['worst_day']]:.1f}%)")
        lines.append(f"Best day: {stats_row['best_day']} ({rates[stats_row['best_day']]:.1f}%)")
    return "\n".join(lines) + "\n"


def dataset_lines(examples: DataFrame, eval_type: str) -> DataFrame:
    """S11 rows: the keys and ``line``, one compact JSON object: inputs, outputs, metadata (reference not written).

    Inputs are JSON values as the runs gave them (``inputs_json`` of the formats): lists stay lists, null stays null.
    """
    from runlens.operators.evaluation import FORMAT_COLUMNS
    ins, outs = FORMAT_COLUMNS[eval_type]
    compact = {"ignoreNullFields": "false"}
    inputs = F.col("inputs_json") if "inputs_json" in examples.columns else \
        F.to_json(F.struct(*[F.parse_json(c).alias(c) if c == "social_profiles" else F.col(c) for c in ins]), compact)
    outputs = F.to_json(F.struct(*[F.col(c) for c in outs]), compact)
    meta = F.to_json(F.struct("trace_id", "project", F.col("run_date").cast("string").alias("date"),
                              F.lit(eval_type).alias("eval_type")), compact)
    return examples.select("trace_id", "project", "run_date", F.concat(
        F.lit('{"inputs":'), inputs, F.lit(',"outputs":'), outputs, F.lit(',"metadata":'), meta, F.lit("}")).alias("line"))


def write_dataset_jsonl(examples: DataFrame, path: str, eval_type: str) -> None:
    """The lines as text files."""
    dataset_lines(examples, eval_type).select("line").write.mode("overwrite").text(path)


def read_dataset(spark: SparkSession, path: str, fmt: str = "auto") -> DataFrame:
    """JSONL, a JSON list, or a JSON object with ``examples``; detected by content for 'auto'."""
    if fmt == "auto":
        head = spark.read.text(path).where(F.length(F.trim("value")) > 0).first()
        first = head["value"].lstrip()[:1] if head else ""
        fmt = "list" if first == "[" else "jsonl"
        if first == "{":
            try:
                obj = json.loads(head["value"])
                fmt = "object" if "examples" in obj and "inputs" not in obj else "jsonl"
            except ValueError:
                fmt = "object"
    if fmt == "jsonl":
        return spark.read.json(path)
    whole = spark.read.option("multiLine", True).json(path)
    if fmt == "object":
        return whole.select(F.explode("examples").alias("e")).select("e.*")
    return whole
