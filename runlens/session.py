"""Session construction and the few session-level settings the jobs rely on."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job assumes: UTC session time zone (dates are UTC days), AQE on so that
# joins switch to broadcast only when the *measured* build side is small, skew splitting for
# hot trace / request keys, and partition coalescing for tiny shuffles.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.ui.enabled": "false",
    "spark.driver.memory": "8g",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "runlens") -> SparkSession:
    """Create (or reuse) a session with the defaults above.

    On a cluster pass ``master=None`` and let spark-submit decide; shuffle partitions should then be
    sized so that one partition holds ~128-256 MB of shuffled data (AQE coalesces the rest).
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    for k in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled"):
        spark.conf.set(k, _DEFAULTS[k])
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must be a shared (distributed) folder configured by the cluster; without one only
    a local master, as in tests, gets a scratch folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="runlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


@contextlib.contextmanager
def _method_limit(spark: SparkSession):
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "8000")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def staged(df: DataFrame, name: str, many_rules: bool = False) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back: lineage ends here.

    ``many_rules``: code of very many expressions is split into methods that the JVM compiles (up to 8000 bytes of
    code); fused into one larger method it would be interpreted, row by row. Rows do not depend on it.
    """
    path = os.path.join(checkpoint_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    with _method_limit(df.sparkSession) if many_rules else contextlib.nullcontext():
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
