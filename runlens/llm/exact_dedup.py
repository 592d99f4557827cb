"""Exact dedup [native]: a persistent digest index, bucketed and sorted by digest.

The index is a Parquet table ``(digest, keep_id, group_size)`` with one row per distinct text,
``CLUSTERED BY (digest) SORTED BY (digest)``. A batch is reduced to one row per digest (combined map-side,
so a text with a third of all rows costs one row per task), sort-merge anti-joined with the index on the
digest, and what is new is appended. The index side of that join is read by bucket, without a shuffle.

Texts are equal when they are identical after lower-casing A-Z only (SHA-256 of the UTF-8 bytes).
Null text counts as empty. Of the rows of a batch with a new text the one with the largest id stays; a text
that an earlier batch has brought keeps that batch's row. Rows that repeat an id with the same text are the
same document: all of them get the same decision. A null id never beats another id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm.common import ascii_lower, scratch_path, staged, text_or_empty


def with_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, digest)`` of every row; nothing but 32 bytes of a text goes further."""
    normal = ascii_lower(text_or_empty(F.col(text_col)))
    return docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(normal, 256)).alias("digest"))


class DigestIndex:
    """Persistent index of the texts seen so far.

    ``location`` names its folder (a new one in the shared folder if omitted). A session that is given the
    folder of an existing index goes on with it; ``buckets`` must then be the number it was made with.
    """

    def __init__(self, spark: SparkSession, id_type: str, location: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.location = location or scratch_path(spark, "digests")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.table} (digest BINARY, keep_id {id_type}, group_size BIGINT) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.location}'")

    def known(self, digests: DataFrame) -> DataFrame:
        """``(digest, keep_id, group_size)`` of the batch's digests that the index has, as it stands now.

        The index is read by bucket, without a shuffle; only the batch's distinct digests are dealt to the buckets.
        """
        batch = digests.select("digest").distinct()
        return staged(self.spark.table(self.table).hint("merge").join(batch, "digest", "left_semi")
                      .select("digest", "keep_id", "group_size"), "known")

    def fresh(self, digests: DataFrame) -> DataFrame:
        """One row for each digest of the batch that the index lacks (sort-merge anti-join)."""
        groups = digests.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        return groups.join(self.spark.table(self.table).hint("merge").select("digest"), "digest", "left_anti")

    def append(self, fresh: DataFrame) -> None:
        """Append to the index: one file for each bucket and batch, sorted by digest."""
        (fresh.select("digest", "keep_id", "group_size").repartition(self.buckets, "digest").write
         .mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table))

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Index a batch and return its decisions: ``id, digest, keep_id, group_size, kept`` for each row.

        Adding a batch a second time changes nothing and returns the same decisions.
        """
        digests = staged(with_digest(docs, id_col, text_col), "digests")
        known = self.known(digests)
        fresh = staged(self.fresh(digests), "fresh")
        self.append(fresh)
        # both sides are plain shuffles of the batch, whose large partitions Spark splits when one text is hot
        decided = staged(fresh.select(*known.columns).union(known), "decided")
        return digests.join(decided, "digest").withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Decisions over one table: a new index that gets the whole table as its first batch."""
    index = DigestIndex(docs.sparkSession, docs.schema[id_col].dataType.simpleString())
    return index.add(docs, id_col, text_col)
