"""Detail reports as distributed output: lines of text, and JSON documents with totals beside them.

Every error is a row of its own from the facts to the files. Rows are dealt by range of (symbol, root, place in the
trace) and sorted within their files, so a symbol or root that holds a third of all errors is spread over files, and
the files in order are the report. Nothing but totals by symbol is aggregated, and nothing reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions import text as T
from runlens.operators import errors as E

# Fixed texts of the report.
TITLE = ["Zenrows Error Detail Report", "=" * 40, ""]
NO_ERRORS = "No zenrows errors found for the specified date."
REPORT_TYPE = "zenrows_detail"

#: the order of lines: title, then symbols; a symbol's roots, then the blank line that ends it
LINE_ORDER = ["body", "symbol", "tail", "root_id", "level", "place", "line_no"]
_NO_PLACE = "struct<not_root:boolean,ord:decimal(38,0),place:array<int>>"


def shown_time(start_time: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS UTC`` of the stored text as it stands, without conversion; other texts as they are."""
    stored = F.regexp_replace(start_time, "Z$", "+00:00")
    shown = F.date_format(F.try_to_timestamp(F.regexp_replace(F.substring(stored, 1, 19), "T", " "),
                                             F.lit("yyyy-MM-dd HH:mm:ss")), "yyyy-MM-dd HH:mm:ss")
    return F.when(F.length(start_time) > 0, F.coalesce(F.concat(shown, F.lit(" UTC")), start_time)).otherwise(F.lit(""))


def hierarchy_lines(facts: DataFrame) -> DataFrame:
    """The report's lines with the columns of ``LINE_ORDER`` that put them in order.

    Roots are sorted by id within their symbol, errors stand in the order in which the trace has them.
    """
    none = F.lit(None).cast(_NO_PLACE)
    place = F.struct(F.col("not_root"), F.col("ord").cast("decimal(38,0)").alias("ord"), F.col("place").alias("place"))

    def line(df: DataFrame, tail: int, root: Column, level: int, at: Column, no: Column, text: Column) -> DataFrame:
        return df.select(F.lit(1).alias("body"), "symbol", F.lit(tail).alias("tail"), root.alias("root_id"),
                         F.lit(level).alias("level"), at.cast(_NO_PLACE).alias("place"), no.alias("line_no"), text.alias("line"))

    texts = F.array(F.concat(F.lit("    Error: "), T.clean_error(F.coalesce("error_message", F.lit("Unknown error")))),
                    F.concat(F.lit("      Time: "), shown_time(F.col("start_time"))),
                    F.concat(F.lit("      URL: "), F.coalesce("target_url", F.lit(""))))
    rows = facts.select("symbol", "root_id", place.alias("p"), F.posexplode(texts).alias("no", "text"))
    errors = line(rows, 0, F.col("root_id"), 2, F.col("p"), F.col("no"), F.col("text"))
    roots = facts.select("symbol", "root_id").distinct()
    roots = line(roots, 0, F.col("root_id"), 1, none, F.lit(0), F.concat(F.lit("  "), F.col("root_id"), F.lit(":")))
    symbols = facts.select("symbol").distinct()
    heads = line(symbols, 0, F.lit(""), 0, none, F.lit(0), F.concat("symbol", F.lit(":")))
    ends = line(symbols, 1, F.lit(""), 0, none, F.lit(0), F.lit(""))
    return heads.union(roots).union(errors).union(ends)


def title_lines(lines: DataFrame) -> DataFrame:
    """The lines above the body, or the one line of a report without errors."""
    spark = lines.sparkSession
    some = lines.limit(1).select(F.lit(True).alias("some"))
    title = spark.createDataFrame([(i, t, True) for i, t in enumerate(TITLE)] + [(0, NO_ERRORS, False)],
                                  "line_no int, line string, wanted boolean")
    flag = some.agg(F.count("*").alias("n")).select((F.col("n") > 0).alias("some"))
    title = title.join(flag, title["wanted"] == flag["some"])
    return title.select(F.lit(0).alias("body"), F.lit("").alias("symbol"), F.lit(0).alias("tail"), F.lit("").alias("root_id"),
                        F.lit(0).alias("level"), F.lit(None).cast(_NO_PLACE).alias("place"), "line_no", "line")


def write_text(facts: DataFrame, path: str) -> None:
    """The text report as files of lines, in the order of their names."""
    lines = hierarchy_lines(facts)
    every = title_lines(lines).unionByName(lines)
    (every.repartitionByRange(*LINE_ORDER).sortWithinPartitions(*LINE_ORDER).select("line").write.mode("overwrite").text(path))


def error_documents(facts: DataFrame) -> DataFrame:
    """S13 details: a row for each error with its symbol, its root and its document as JSON; null fields stay."""
    document = F.struct(F.col("error_id").alias("trace_id"), F.col("root_id").alias("root_trace_id"),
                        F.col("error_symbol").alias("crypto_symbol"), "error_message", "start_time", "target_url", "name")
    return facts.select("symbol", "root_id", "not_root", "ord", "place", "error_id",
                        F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))


def report_totals(facts: DataFrame, report_date: str, project: str | None = None) -> DataFrame:
    """S13 head and summary as one row; errors of each symbol are a table of their own (``symbol_totals``)."""
    totals = symbol_totals(facts).agg(
        F.coalesce(F.sum("total_errors"), F.lit(0)).alias("total_errors"),
        F.coalesce(F.sum("total_traces"), F.lit(0)).alias("total_traces"), F.count("*").alias("crypto_symbols"))
    return totals.select(F.lit(REPORT_TYPE).alias("report_type"), F.lit(report_date).alias("report_date"),
                         F.lit(project or "all").alias("project"), "*")


def symbol_totals(facts: DataFrame) -> DataFrame:
    return E.detail_summary(facts, by=[]).select("symbol", "total_errors", "total_traces")


def write_json(facts: DataFrame, path: str, report_date: str, project: str | None = None) -> None:
    """The JSON report: ``errors/`` in order (a document a line), ``symbols/`` and ``report/``."""
    order = ["symbol", "root_id", "not_root", "ord", "place"]
    rows = error_documents(facts).repartitionByRange(*order).sortWithinPartitions(*order)
    line = F.concat(F.lit('{"symbol":'), _quoted("symbol"), F.lit(',"root_trace_id":'), _quoted("root_id"),
                    F.lit(',"error":'), F.col("document"), F.lit("}"))
    rows.select(line.alias("value")).write.mode("overwrite").text(f"{path}/errors")
    symbol_totals(facts).orderBy("symbol").write.mode("overwrite").json(f"{path}/symbols")
    report_totals(facts, report_date, project).write.mode("overwrite").json(f"{path}/report")


def _quoted(name: str) -> Column:
    return F.regexp_extract(F.to_json(F.array(name)), r"(?s)^\[(.*)\]$", 1)
