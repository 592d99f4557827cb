"""Line dedup: lines are boilerplate where they stand on too large a share of their site's pages.

Pages are grouped by host. The number of a host's pages that contain a line, over the number of that host's
pages, is the line's site-relative frequency; lines above ``ratio`` are dropped from every page of the host.

Only 16-byte digests of lines are shuffled, one for each page and distinct line, counted map-side first, so a
host or a line with a third of all rows is no hot key. A host has at most (mean lines a page) / ratio
boilerplate lines. Their table is staged and counted: below ``BROADCAST_ROWS`` it is broadcast, beyond that
pages are joined by (host, salt).

Defined cases: null text has no lines and stays null; pages without a host belong to no site and stay as they
are; blank lines are never dropped; a line on fewer than ``least_pages`` pages is no boilerplate, whatever the host's size;
repeated rows count as pages of their own, or with ``copies_once`` a host's rows of the same text as one page, in
counts and totals; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import staged

RATIO = 0.1
LEAST_PAGES = 3
#: 16 bytes of digest a row and some for the host: a few MB
BROADCAST_ROWS = 50_000
SALTS = 64


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    return F.unhex(F.md5(line))


def boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float = RATIO,
                least_pages: int = LEAST_PAGES, copies_once: bool = False) -> DataFrame:
    """``(host, bad)``: for each host the digests of the lines that stand on more than ``ratio`` of its pages."""
    keys = F.array_distinct(F.transform(F.filter(lines_of(text), lambda x: F.trim(x) != ""), line_key))
    rows = pages.select(host.alias("host"), F.unhex(F.md5(text)).alias("page"), keys.alias("keys")).where("host IS NOT NULL")
    if copies_once:
        rows = rows.groupBy("host", "page").agg(F.first("keys").alias("keys"))
    totals = rows.groupBy("host").agg(F.count("*").alias("pages"))
    counts = (rows.select("host", F.explode("keys").alias("key")).groupBy("host", "key")
              .agg(F.count("*").alias("n")).where(F.col("n") >= least_pages))
    return (counts.join(totals, "host").where(F.col("n") > ratio * F.col("pages"))
            .groupBy("host").agg(F.collect_set("key").alias("bad"), F.count("*").alias("n_bad")))


def drop_boilerplate_lines(pages: DataFrame, host: Column, text_col: str = "text", ratio: float = RATIO,
                           least_pages: int = LEAST_PAGES, copies_once: bool = False) -> DataFrame:
    """``pages`` with ``text_col`` cleaned, and ``n_lines`` and ``n_dropped`` at the end (in place of such columns)."""
    bad = staged(boilerplate(pages, host, F.col(text_col), ratio, least_pages, copies_once), "boilerplate")
    size = bad.agg(F.coalesce(F.sum("n_bad"), F.lit(0)) + F.count("*")).first()[0]
    own = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    packed = pages.select(F.struct(*own).alias("_page"), host.alias("_host"))
    if size <= BROADCAST_ROWS:
        joined = packed.join(F.broadcast(bad.select(F.col("host").alias("_host"), "bad")), "_host", "left")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
        joined = (packed.withColumn("_salt", F.pmod(F.xxhash64("_page"), F.lit(SALTS)).cast("int"))
                  .join(bad.select(F.col("host").alias("_host"), "bad", salts), ["_host", "_salt"], "left"))
    lines = lines_of(F.col("_page")[text_col])
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("bad"), line_key(x)))
    cleaned = joined.select("_page", lines.alias("_lines"),
                            F.when(F.col("bad").isNull(), lines).otherwise(kept).alias("_kept"))
    n_lines = F.coalesce(F.size("_lines"), F.lit(0))
    kept_text = F.when(F.col("_page")[text_col].isNotNull(), F.array_join("_kept", "\n"))
    return cleaned.select(*[kept_text.alias(c) if c == text_col else F.col("_page")[c].alias(c) for c in own],
                          F.greatest(n_lines, F.lit(0)).cast("long").alias("n_lines"),
                          F.greatest(n_lines - F.size("_kept"), F.lit(0)).cast("long").alias("n_dropped"))
