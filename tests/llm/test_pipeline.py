from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from runlens.llm import line_dedup, queries, suffix_dedup, toxicity

from . import brute
from .conftest import DOCS


@pytest.fixture
def sf_dir(spark, docs, made_up_docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    marks = [(d, int("utter scum" in (t or ""))) for d, t, *_ in made_up_docs]
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages_match_brute_force(spark, docs, made_up_docs, sf_dir):
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)

    clean = stage["toxicity"](spark, docs, sf_dir)
    assert clean.columns == columns
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = sorted(map(tuple, clean.collect()))
    assert rows == sorted(r for r in made_up_docs if model.score(r[1] or "") < toxicity.THRESHOLD)

    again = spark.createDataFrame(rows, DOCS)
    lined = stage["line_dedup"](spark, again, sf_dir)
    assert lined.columns == columns
    texts = brute.drop_lines([(r[3], r[1]) for r in rows], line_dedup.RATIO, line_dedup.LEAST_PAGES)
    wanted = [(r[0], t, r[2], r[3], r[4] if t == r[1] else len(t)) for r, t in zip(rows, texts)]
    rows = sorted(map(tuple, lined.collect()))
    assert rows == sorted(wanted)

    again = spark.createDataFrame(rows, DOCS)
    unique = stage["ngram_jaccard_join"](spark, again, sf_dir)
    assert unique.columns == columns
    groups = brute.components([(r[0], r[1]) for r in rows], 5, 4, 5)
    wanted = [r for r in rows if groups[r[0]][1] == r[0]]
    assert len(wanted) < len(rows)
    rows = sorted(map(tuple, unique.collect()))
    assert rows == sorted(wanted)

    again = spark.createDataFrame(rows, DOCS)
    cut = stage["suffix_array_dedup"](spark, again, sf_dir)
    assert cut.columns == columns
    gone = brute.removed_bytes([(r[0], r[1]) for r in rows], suffix_dedup.LENGTH)
    assert any(m.any() for m in gone.values())
    got = {r["doc_id"]: r for r in cut.collect()}
    assert set(got) == set(gone)
    for doc, text, *_ in rows:
        out, at = "", 0
        for c in text or "":
            n = len(c.encode())
            out += "" if gone[doc][at:at + n].all() else c
            at += n
        assert got[doc]["text"] == out and got[doc]["n_chars"] == (len(out) if gone[doc].any() else len(text or ""))

    packed = stage["packing"](spark, cut, sf_dir).toPandas()
    encoder = Tokenizer.from_file(queries.WORD_TOKENIZER)
    for r in packed.itertuples():
        ids = encoder.encode(got[r.doc_id]["text"], add_special_tokens=False).ids + [1]
        assert zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32

    whole = corpus_pipeline.run(spark, sf_dir).toPandas()
    same = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(whole[same].itertuples(index=False)) == sorted(packed[same].itertuples(index=False))


def test_repeated_ids_are_one_document(spark):
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "a b c d e f", "en", "s", 11),
            (None, "q", "en", "s", 1), (3, None, "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    kept = corpus_pipeline.drop_near_copies(spark, df, "")
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3]


def test_a_group_of_copies_keeps_its_text(spark):
    copy = "first line of a copy\nsecond line of the same copy\nfooter of all pages"
    rows = [(i, copy if i % 3 == 0 else f"a page {i} of its own {i * i}\nwith line {i + 7} {i * 3}\nfooter of all pages",
             "en", "s", 0) for i in range(90)]
    lined = corpus_pipeline.drop_boilerplate(spark, spark.createDataFrame(rows, DOCS), "")
    got = {r["doc_id"]: r["text"] for r in lined.collect()}
    assert got == {i: text.removesuffix("\nfooter of all pages") for i, text, *_ in rows}
    unique = corpus_pipeline.drop_near_copies(spark, lined, "")
    kept = [r for r in unique.collect() if r["doc_id"] % 3 == 0]
    assert [(r["doc_id"], r["text"]) for r in kept] == [(0, "first line of a copy\nsecond line of the same copy")]


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0


def test_registration():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_held_out_is_a_crc(spark):
    got = spark.range(50).select("id", toxicity.held_out(F.col("id")).alias("out")).collect()
    assert all(r["out"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in got)
