"""Helpers shared by the operators: shared scratch folder, staged tables, table access."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
PACKAGE = __name__.partition(".")[0]


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only where the session names none (tests on one machine) a temporary folder is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="runlens-shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers (once), wherever the driver has it from."""
    top = Path(__file__).resolve().parents[2]
    if f"{PACKAGE}.zip" in spark.sparkContext._python_includes:
        return
    path = Path(tempfile.mkdtemp(prefix="runlens-ship-")).resolve() / f"{PACKAGE}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted((top / PACKAGE).rglob("*.py")):
            out.write(source, source.relative_to(top))
    spark.sparkContext.addPyFile(str(path))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    ship(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))
