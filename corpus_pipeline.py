"""A corpus for training: five stages over ``documents``, each by one operator of ``runlens.llm``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; stages are written as
Parquet in the shared folder and read again, so a lost executor costs one stage's tasks at most. All but the
last return the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import line_dedup, ngram_join, packing, suffix_dedup, toxicity
from runlens.llm.common import staged, table
from runlens.llm.queries import WORD_TOKENIZER


def with_n_chars(docs: DataFrame, columns: list[str], changed: str) -> DataFrame:
    n_chars = F.when(F.expr(changed), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return docs.withColumn("n_chars", n_chars).select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the model learns from the labelled documents among the input."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("score") < toxicity.THRESHOLD).select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in too large a share of their source's distinct texts go; every document stays."""
    cleaned = line_dedup.drop_boilerplate_lines(docs, F.col("source"), copies_once=True)
    return with_n_chars(cleaned, docs.columns, "n_dropped > 0")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles with a similarity of 0.8 or more the smallest id stays.

    Documents without words link with nothing and stay, as do rows without an id. Rows that repeat an id are
    one document, of which one row stays.
    """
    found = staged(ngram_join.linked_components(docs, n=5, least=Fraction(4, 5)), "components")
    late = found.where("id <> root").select(F.col("id").alias("doc_id")).distinct()
    kept = docs.join(late, "doc_id", "left_anti").select(*docs.columns)
    again = found.where("id IS NOT NULL").groupBy("id").count().where("count > 1").select(F.col("id").alias("doc_id"))
    if again.isEmpty():
        return kept
    once = kept.join(again, "doc_id").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).union(once.select("row.*"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that stand earlier in the corpus go, by whole characters; every document stays."""
    cut = suffix_dedup.remove_repeats(docs, whole_chars=True).withColumn("text", F.col("kept").cast("string"))
    return with_n_chars(cut, docs.columns, "n_removed > 0")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of what is left."""
    return packing.pack(docs, WORD_TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", drop_repeats),
    ("packing", pack),
]

#: SQL cannot state the classifier, the components or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
