"""Availability-dataset curation: URL de-duplication and a domain-diverse top-k.

Input: examples with ``pos`` (dataset order), ``website_url``, ``is_available``, ``notes``.

Plan shape (no global window, nothing collected):
* One ``groupBy`` on the normalized URL reads the examples, once: its first negative (W2), its best positive (W3)
  and its first position. A URL with a negative has no positive (J4), so there is no anti join. Partial aggregation
  shrinks a URL that holds a third of all examples map-side. The sketch is written once to the shared folder.
* W4 is ``groupBy`` + ``min(struct)`` over the sketch, a row for each domain.
* L2 is ``orderBy(...).limit(target)`` = TakeOrderedAndProject: each task keeps its top-k, the driver merges k rows
  per task. The count of negatives is a scalar subquery over the sketch; it cuts the ranked rows to the capacity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions import text as T
from runlens.session import staged

COLS = ["pos", "website_url", "is_available", "notes"]


def annotate(examples: DataFrame) -> DataFrame:
    """Add norm_url (F1), domain (F2) and the quality score in tenths."""
    return examples.withColumns({
        "norm_url": T.normalize_url(F.col("website_url")),
        "domain": T.url_domain(F.col("website_url")),
        "score": T.quality_tenths(F.col("website_url"), F.col("is_available"), F.col("notes")),
    })


def url_sketch(examples: DataFrame) -> DataFrame:
    """W2, W3 and J4 in one aggregate: a row for each normalized URL.

    ``negative``: its first example that is unavailable or has no flag; ``positive``: its available example with the
    highest score, ties to the first; null where there is none. ``url_pos``: the first available example's position.
    """
    a = annotate(examples)
    row = F.struct(*a.columns)
    available = F.coalesce(F.col("is_available"), F.lit(False))
    # the order stands before the row, so that rows of equal order are settled by their own values
    return a.groupBy("norm_url").agg(
        F.min(F.when(~available, F.struct(F.col("pos").alias("p"), row.alias("row")))).alias("negative"),
        F.min(F.when(available, F.struct((-F.col("score")).alias("s"), F.col("pos").alias("p"), row.alias("row")))).alias("positive"),
        F.min(F.when(available, F.col("pos"))).alias("url_pos"))


def negatives_of(sketch: DataFrame) -> DataFrame:
    """The URLs' first negatives."""
    return sketch.where("negative IS NOT NULL").select("negative.row.*")


def positives_of(sketch: DataFrame) -> DataFrame:
    """J4 + W3: the best available example of each URL that has no negative, and its ``url_pos``."""
    return sketch.where("negative IS NULL").select("positive.row.*", "url_pos")


def negatives(examples: DataFrame) -> DataFrame:
    """Examples with is_available false/null, one per normalized URL (the first one)."""
    return negatives_of(url_sketch(examples))


def rank_positives(pos_dedup: DataFrame) -> DataFrame:
    """Per domain its best example (max score, ties -> earlier URL group) and the domain's first
    appearance ``domain_pos``; ``is_winner`` marks the domain's pick."""
    w = pos_dedup.groupBy("domain").agg(
        F.min(F.struct((-F.col("score")).alias("_s"), F.col("url_pos").alias("_u"))).alias("_w"),
        F.min("url_pos").alias("domain_pos"))
    w = w.select("domain", "domain_pos", F.col("_w._u").alias("winner_pos"))
    # one row per domain: a plain equi-join (AQE picks broadcast when the domain table is small)
    return (pos_dedup.join(w, "domain", "inner")
            .withColumn("is_winner", F.col("url_pos") == F.col("winner_pos")).drop("winner_pos"))


def select_positives(ranked: DataFrame, target_size: int, n_negatives: Column) -> DataFrame:
    """L2: domain winners in order of first appearance, then the rest by score (desc) and URL order, up to
    ``target_size - n_negatives`` rows. The window numbers at most ``target_size`` rows."""
    order = [F.col("is_winner").desc(),
             F.when(F.col("is_winner"), F.col("domain_pos")).asc_nulls_last(),
             F.col("score").desc(), F.col("url_pos").asc()]
    top = ranked.orderBy(*order).limit(max(0, target_size))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    return top.withColumn("_k", place).where(F.col("_k") <= F.lit(target_size) - n_negatives).drop("_k")


def curate(examples: DataFrame, target_size: int = 100) -> DataFrame:
    """L2 flagship: all de-duplicated negatives (never truncated) + up to target - #negatives
    representative positives. Output columns: COLS + norm_url, domain, score, kind.

    The examples are read once, to write the sketch of URLs; nothing else runs before the result is asked for."""
    sketch = staged(url_sketch(examples), "url-sketch")
    negs = negatives_of(sketch)
    n_neg = sketch.agg(F.count("negative")).scalar()
    pos = select_positives(rank_positives(positives_of(sketch)), target_size, n_neg)
    keep = COLS + ["norm_url", "domain", "score"]
    return (negs.select(*keep, F.lit("negative").alias("kind"))
            .unionByName(pos.select(*keep, F.lit("positive").alias("kind"))))


def problems(curated: DataFrame) -> DataFrame:
    """V1 counts, one row: examples, those that repeat another's normalized URL, those without a URL, without a flag."""
    return curated.agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count_distinct("norm_url")).alias("repeated"),
                       F.count_if(F.length(F.coalesce("website_url", F.lit(""))) == 0).alias("no_url"),
                       F.count_if(F.col("is_available").isNull()).alias("no_flag"))


def validate(curated: DataFrame) -> None:
    """V1: raise on an empty result, duplicate normalized URLs, a missing URL or a missing flag
    (checked in that order) using one aggregation."""
    r = problems(curated).first()
    if r["n"] == 0:
        raise ValueError("Curated dataset is empty")
    if r["repeated"]:
        raise ValueError("Curated dataset contains duplicate URLs")
    if r["no_url"]:
        raise ValueError("Curated example missing website_url")
    if r["no_flag"]:
        raise ValueError("Curated example missing is_available field")


def curation_stats(curated: DataFrame) -> DataFrame:
    """Total, negatives, positives, distinct positive domains, diversity ratio (2 decimals)."""
    pos = F.coalesce(F.col("is_available"), F.lit(False))
    g = curated.agg(F.count(F.lit(1)).alias("total_examples"),
                    F.count_if(~pos).alias("negative_examples"),
                    F.count_if(pos).alias("positive_examples"),
                    F.count_distinct(F.when(pos, T.url_domain(F.col("website_url")))).alias("unique_domains"))
    return g.withColumn("diversity_ratio", F.when(F.col("positive_examples") > 0,
                        F.col("unique_domains") / F.col("positive_examples")))
