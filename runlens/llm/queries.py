"""The registered queries of the training-data operators, and their DuckDB SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import (byte_bpe, conversation_trie, exact_dedup, html_extract, license_scan, line_dedup,
                         minhash_dedup, ngram_join, oracles, packing, suffix_dedup, toxicity, vector_codes,
                         vector_search)
from runlens.llm.common import LOWER, UPPER, staged, table

#: Where the tokenizers' files are; a deployment may set others.
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_bpe.encode_column(table(spark, sf_dir, "documents"), BYTE_RANKS, PATTERN)
    return byte_bpe.digests(encoded).withColumnRenamed("id", "doc_id")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.linked_components(table(spark, sf_dir, "documents"), n=4, least=Fraction(85, 100))
    return found.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"),
                        F.col("root").alias("component_id"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
                       F.lower(F.hex("digest")).alias("text_sha256"))


OP5_SQL = f"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(normal) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS normal FROM documents)
WINDOW same AS (PARTITION BY normal)"""


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages, html_extract.fit(pages))


def op7_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vector_search.nearest(rows, rows.where("vec_id % 50 = 0"), k=5)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate_lines(docs, F.col("source")).select(
        "doc_id", "source", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def line_dedup_sql(ratio: float, least_pages: int, source: str = "documents") -> str:
    """Common table expressions up to ``cleaned(doc_id, n_lines, n_dropped, text)``."""
    return f"""
WITH pages AS (SELECT row_number() OVER () AS page, doc_id, source, text FROM {source}),
lines AS (SELECT page, source, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM pages WHERE text IS NOT NULL),
totals AS (SELECT source, count(*) AS n_pages FROM pages WHERE source IS NOT NULL GROUP BY source),
bad AS (SELECT l.source, l.line FROM lines l JOIN totals t ON l.source = t.source WHERE trim(l.line, ' ') <> ''
        GROUP BY l.source, l.line HAVING count(DISTINCT l.page) > {ratio!r}::DOUBLE * max(t.n_pages) AND count(DISTINCT l.page) >= {least_pages}),
marked AS (SELECT l.*, b.line IS NULL AS keep FROM lines l LEFT JOIN bad b ON l.source = b.source AND l.line = b.line),
cleaned AS (SELECT p.doc_id, p.source, count(m.pos) AS n_lines, count(m.pos) FILTER (NOT m.keep) AS n_dropped,
   CASE WHEN max(p.text) IS NOT NULL
        THEN coalesce(string_agg(m.line, chr(10) ORDER BY m.pos) FILTER (m.keep), '') END AS text
 FROM pages p LEFT JOIN marked m ON p.page = m.page GROUP BY p.page, p.doc_id, p.source)"""


OP8_SQL = line_dedup_sql(line_dedup.RATIO, line_dedup.LEAST_PAGES) + """
SELECT doc_id, source, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM cleaned"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan_licenses(docs).drop("text")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    rows = vector_codes.with_label_errors(staged(coded, "codes"))
    digits = F.transform("indexes", lambda i: F.lpad(F.lower(F.hex(i)), 2, "0"))
    return rows.select(F.col("id").alias("vec_id"), F.array_join(digits, "").alias("code"), "error", "label_error",
                       F.lit(vector_codes.digest(codebooks)).alias("codebooks_sha256"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"),
                                         lambda conv_id: F.crc32(conv_id.cast("string")) % 6)


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), n=4, least=Fraction(80, 100))
    return found.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"),
                        F.col("root").alias("component_id"), F.col("id").eqNullSafe(F.col("root")).alias("kept"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_ngram_join": op4_ngram_join,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_html_extract": op6_html_extract,
    "op7_vector_search": op7_vector_search,
    "op8_line_dedup": op8_line_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_license_scan": op10_license_scan,
    "op11_vector_codes": op11_vector_codes,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_minhash_dedup": op13_minhash_dedup,
}

ORACLE: dict[str, str] = {
    "op5_exact_dedup": OP5_SQL,
    "op8_line_dedup": OP8_SQL,
    "op10_license_scan": license_scan.oracle(),
    "op11_vector_codes": oracles.vector_codes_sql(),
    "op12_conversation_trie": oracles.CONVERSATION_TRIE_SQL,
}
