from __future__ import annotations

import base64
import hashlib
import random
import textwrap
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from runlens.llm import (byte_bpe, exact_dedup, group_links, html_extract, license_scan, line_dedup, ngram_join, packing, queries,
                         suffix_array, suffix_dedup, toxicity, vector_search)

from . import brute
from .conftest import DOCS


def clashing(df):
    """Extra columns with names that operators use themselves."""
    for name in ("id", "row", "digest", "size", "root", "score", "kept", "_doc", "shard", "n"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("x"))
    return df


# packing

def test_packing_matches_the_tokenizer_and_wastes_little(docs, made_up_docs):
    packed = packing.pack(clashing(docs), queries.WORD_TOKENIZER).toPandas()
    model = Tokenizer.from_file(queries.WORD_TOKENIZER)
    ids = {d: model.encode(t or "", add_special_tokens=False).ids + [1] for d, t, *_ in made_up_docs}
    for doc, rows in packed.groupby("doc_id"):
        rows = rows.sort_values("start")
        assert rows["start"].tolist() == (rows["length"].cumsum() - rows["length"]).tolist()
        assert rows["length"].sum() == len(ids[doc]) == rows["doc_tokens"].iloc[0]
        for r in rows.itertuples():
            data = np.array(ids[doc][r.start:r.start + r.length], "<u4").tobytes()
            assert zlib.crc32(data) == r.ids_crc32
    assert set(packed["doc_id"]) == set(ids)
    for _, rows in packed.sort_values("offset").groupby("sequence_id"):
        assert rows["offset"].tolist() == (rows["length"].cumsum() - rows["length"]).tolist()
        assert rows["length"].sum() <= 2048
    used = packed.groupby("sequence_id")["length"].sum()
    assert used.sum() > 0.97 * 2048 * len(used)


def test_words_of_letters_go_to_the_model_as_the_tokenizer_would_send_them():
    model = Tokenizer.from_file(queries.WORD_TOKENIZER)
    table = packing.spelling(model)
    assert {ord(c) for c in "azAZ\u00df\u00e9\u00c9\u0142"} <= set(table) and ord("\u0130") not in table
    draw = random.Random(3)
    words = ["".join(draw.choices([*map(chr, table)], k=draw.randint(1, 12))) for _ in range(3000)]
    words += ["\u0130x", "e\u0301", "a1b", "don't", "\u6f22\u5b57", "x" * 400, ""]
    memo, fold, part = packing.word_ids(queries.WORD_TOKENIZER)
    assert fold and part
    assert [np.frombuffer(ids, "<u4").tolist() for ids in memo.compute(words)] == [
        model.encode(w, add_special_tokens=False).ids for w in words]
    model.add_tokens(["lantern"])  # found anywhere in a text, before the model
    assert packing.spelling(model) == {}
    model = Tokenizer.from_file(queries.WORD_TOKENIZER)
    model.pre_tokenizer = pre_tokenizers.Split(Regex("oo"), "isolated")  # parts words of letters
    assert packing.spelling(model) == {}


def test_punctuation_is_parted_only_where_the_tokenizer_parts_it():
    texts = ["ab!! cd.%%% ab ab$$$ ef", "\u0130. x A\u0130!? y", "\u0958. z \u09dc, \ufb1d. q", "it's' 's. don't! o", "a.\nb, c. ", "", None]
    model = Tokenizer.from_file(queries.WORD_TOKENIZER)
    ids, ends = packing.token_ids(pa.array(texts), *packing.word_ids(queries.WORD_TOKENIZER))
    assert [part.tolist() for part in np.split(ids, ends[:-1])] == [
        model.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert packing.words_of(pa.array(texts[:1]), True, True).to_pylist() == [
        ["ab", "!!", "cd", ".%%%", "ab", "ab", "$$$", "ef"]]  # three words and their stops, not five words


def test_fullest_is_the_best_subset_sum():
    draw = random.Random(1)
    for _ in range(200):
        lengths = [draw.randint(1, 30) for _ in range(draw.randint(0, 9))]
        room = draw.randint(0, 60)
        counts = {x: lengths.count(x) for x in lengths}
        chosen = packing.fullest(counts, sorted(counts, reverse=True), room)
        sums = {0}
        for x in lengths:
            sums |= {s + x for s in sums if s + x <= room}
        assert sum(chosen) == max(sums)
        assert all(chosen.count(x) <= counts[x] for x in chosen)


# byte-level BPE

@pytest.fixture(scope="module")
def codec():
    return byte_bpe.codec(queries.BYTE_RANKS, queries.PATTERN)


@pytest.fixture(scope="module")
def reference():
    with open(queries.BYTE_RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    draw = random.Random(2)
    alphabet = "abcxyz'sSt  \n\n\t\x1c\x85\xa0 　äöüßéñ漢字😀0123,.!?-_\x00\r"
    yield from ("", " ", "\n", "a b\nc", "a  b", "don't we'll", " lead", "trail ", "x" * 3000, "ab" * 999, "a\x00b c")
    for _ in range(300):
        yield "".join(draw.choice(alphabet) for _ in range(draw.randint(1, 60)))


def test_byte_bpe_is_what_the_library_gives(codec, reference):
    for text in odd_texts():
        ids = np.frombuffer(codec.encode(text), "<u4").tolist()
        assert ids == reference.encode_ordinary(text), repr(text)
        assert codec.decode(codec.encode(text)) == text.encode()


def test_words_share_the_tables_of_their_pieces(codec, reference, monkeypatch):
    built = []

    class Counted(byte_bpe.PrefixTable):
        def __init__(self, vocabulary, data=b""):
            built.append(data)
            super().__init__(vocabulary, data)

    monkeypatch.setattr(byte_bpe, "PrefixTable", Counted)
    text = "a zqxjkv, zqxjkv. zqxjkv! zqxjkv\nzqxjkv"
    own = byte_bpe.TextCodec(codec.vocabulary, queries.PATTERN)
    assert np.frombuffer(own.encode(text), "<u4").tolist() == reference.encode_ordinary(text)
    assert sorted(x for x in built if b"zqx" in x) == [b" zqxjkv", b"zqxjkv"]


def test_other_white_space_is_never_printable():
    assert not [c for c in map(chr, range(0x110000)) if byte_bpe.OTHER_SPACE.search(c) and c.isprintable()]


def test_prefix_table_appends_and_edits_exactly(codec):
    vocabulary, draw = codec.vocabulary, random.Random(3)
    for _ in range(60):
        data = bytes(draw.choice(b"etaoin shrdlu,.") for _ in range(draw.randint(1, 400)))
        table = byte_bpe.PrefixTable(vocabulary, data)
        more = bytes(draw.choice(b"etaoin ") for _ in range(draw.randint(0, 20)))
        table.append(more)
        data += more
        assert table.last == byte_bpe.PrefixTable(vocabulary, data).last
        start = draw.randint(0, len(data))
        end, new = draw.randint(start, min(len(data), start + 5)), draw.choice((b"", b"qu", b"the end"))
        table.replace(start, end, new)
        data = data[:start] + new + data[end:]
        assert table.data == data and table.last == byte_bpe.PrefixTable(vocabulary, data).last
    long = b"the cat sat on the mat and " * 400
    assert byte_bpe.PrefixTable(vocabulary, long).replace(50, 51, b"z") < len(long) / 4


def test_byte_bpe_query_columns(docs, made_up_docs, reference):
    found = byte_bpe.digests(byte_bpe.encode_column(clashing(docs), queries.BYTE_RANKS, queries.PATTERN))
    got = {r["id"]: r for r in found.collect()}
    for doc, text, *_ in made_up_docs:
        ids = np.array(reference.encode_ordinary(text or ""), "<u4")
        assert got[doc]["n_tokens"] == len(ids)
        assert got[doc]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[doc]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


# suffix arrays

def test_suffix_array_sorts_and_measures():
    draw = random.Random(5)
    for _ in range(120):
        data = bytes(draw.randrange(draw.choice((2, 3, 256))) for _ in range(draw.randint(1, 250)))
        data = data * draw.choice((1, 1, 4))
        array = np.frombuffer(data, np.uint8)
        order = suffix_array.suffix_array(array, len(data))
        assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        words = suffix_array.words_at(array)
        for a, b, n in zip(order, order[1:], suffix_array.common_prefixes(words, order[:-1], order[1:], 30)):
            assert data[a:a + n] == data[b:b + n]
            assert n == 30 or data[a + n:a + n + 1] != data[b + n:b + n + 1]


def suffix_rows(df):
    found = df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha")).collect()
    return {r["doc_id"]: tuple(r)[1:] for r in found}


def test_suffix_dedup_matches_brute_force(docs, made_up_docs):
    rows = [(d, t) for d, t, *_ in made_up_docs]
    assert suffix_rows(suffix_dedup.remove_repeats(clashing(docs))) == brute.repeats(rows, 100)


def test_suffix_dedup_splits_anchors_with_many_stretches(docs, made_up_docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SPLIT", 3)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 16)
    rows = [(d, t) for d, t, *_ in made_up_docs]
    assert suffix_rows(suffix_dedup.remove_repeats(docs)) == brute.repeats(rows, 100)


def test_suffix_dedup_gives_no_rows_for_unequal_strings_of_a_common_anchor(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SPLIT", 3)
    tables, staged = {}, suffix_dedup.staged
    monkeypatch.setattr(suffix_dedup, "staged", lambda df, name: tables.setdefault(name, []).append(staged(df, name)) or tables[name][-1])
    draw = random.Random(6)
    prose = lambda n: "".join(draw.choices("abcdefgh ", k=n))
    line, longer = prose(60), prose(90)
    middles = [line] * 20 + [longer] * 20 + ["%s" % (prose(30) + line + prose(30))] * 3 + [longer + prose(5)] * 6 + ["z" * 150] * 5
    rows = [(i, prose(draw.randint(60, 120)) + m + prose(draw.randint(60, 120))) for i, m in enumerate(middles)]
    found = suffix_rows(suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found == brute.repeats(rows, 100)
    assert len(tables["halves"]) > 1
    repeats = tables["repeats"][-1]
    assert repeats.count() < len(rows)  # one for each string start of such anchors before


def test_suffix_dedup_of_long_texts_in_chunks(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 500)
    data = np.frombuffer(random.Random(1).randbytes(3000), np.uint8)
    _, _, first, count = suffix_dedup.stretches(data, 100)
    assert first[0] == 0 and (first[1:] == (first + count)[:-1]).all() and first[-1] + count[-1] == 2901


def test_suffix_dedup_odd_rows(spark):
    text = "".join(random.Random(9).choices("abcdefgh ", k=240))
    rows = [(1, text), (1, text), (2, text + "z"), (None, text), (3, None), (4, text[:50]), (5, "y" + text), (5, "other")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = suffix_dedup.remove_repeats(df).collect()
    by = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in got)
    assert by == [(0, 240, 0), (1, 240, 0), (1, 240, 0), (2, 241, 240), (3, 0, 0), (4, 50, 0), (5, 5, 0), (5, 241, 240)]
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(df, length=8)


def test_suffix_dedup_keeps_whole_characters(spark):
    text = "é" * 80
    df = spark.createDataFrame([(1, "xx" + text), (2, "y" + text + "ü")], "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(df, whole_chars=True).collect()}
    assert got[2].decode() == "yü" and set(got[1].decode()) == {"x", "é"}


# n-gram join

@pytest.mark.parametrize("n, p, q", [(4, 85, 100), (5, 4, 5), (2, 3, 5)])
def test_ngram_join_matches_brute_force(docs, made_up_docs, n, p, q):
    found = ngram_join.linked_components(clashing(docs), n=n, least=Fraction(p, q)).collect()
    rows = [(d, t) for d, t, *_ in made_up_docs]
    assert {r["id"]: (r["size"], r["root"]) for r in found} == brute.components(rows, n, p, q)


def test_ngram_join_in_small_blocks(docs, made_up_docs, monkeypatch):
    monkeypatch.setattr(group_links, "CENTRES", 1)
    monkeypatch.setattr(group_links, "LIST_ROWS", 2)
    monkeypatch.setattr(group_links, "BLOCK_SETS", 2)
    found = ngram_join.linked_components(docs, n=4, least=Fraction(85, 100)).collect()
    rows = [(d, t) for d, t, *_ in made_up_docs]
    assert {r["id"]: (r["size"], r["root"]) for r in found} == brute.components(rows, 4, 85, 100)


def test_ngram_join_odd_rows(spark):
    rows = [(1, "a b c d e"), (2, "A B c d E"), (3, "a b"), (4, "a\tb"), (5, None), (6, " "), (7, "x y z w v"),
            (7, "a b c d e"), (None, "a b c d e"), (3, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["id"] or 0), r["size"], r["root"] or 0) for r in ngram_join.linked_components(df, n=4).collect())
    assert got == [(0, 2, 0), (1, 2, 1), (2, 2, 1), (3, 1, 3), (3, 1, 3), (4, 1, 3), (5, 0, 5), (6, 0, 6), (7, 2, 1),
                   (7, 2, 1)]
    assert ngram_join.linked_components(df.limit(0)).count() == 0


def test_bounds_of_sizes_and_subsets():
    bounds = ngram_join.Threshold(Fraction(85, 100))
    for s in range(1, 40):
        for u in range(s, 40):
            least = next((x for x in range(s + 1) if bounds.linked(x, s, u)), None)
            assert (least is None) == (bounds.need(s, u) > s)
            if least is not None:
                assert bounds.need(s, u) == least and u in bounds.partners(s, 99) and s in bounds.partners(u, 99)
    assert 0 <= bounds.boundary({8: 10, 12: 5, 30: 7}) <= ngram_join.LARGEST_LIGHT


# exact dedup

def test_exact_dedup_matches_sql(docs, made_up_docs):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(made_up_docs, columns=["doc_id", "text", "lang", "source", "n_chars"]))
    rows = exact_dedup.exact_dedup(clashing(docs).drop("id").withColumn("keep_id", F.lit("x")))
    got = sorted((r["id"], r["keep_id"], r["group_size"], r["kept"], r["digest"].hex()) for r in rows.collect())
    wanted = sorted(con.execute(
        f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({queries.OP5_SQL})").fetchall())
    assert got == wanted


def test_digest_index_goes_on_across_batches(spark):
    index = exact_dedup.DigestIndex(spark, "bigint", buckets=3)
    first = spark.createDataFrame([(1, "A"), (2, "a"), (3, None), (None, "n")], "doc_id long, text string")
    again = spark.createDataFrame([(9, "a"), (8, "b"), (7, "B"), (6, "")], "doc_id long, text string")

    def decide(batch):
        return sorted(((r["id"] or 0), r["keep_id"] or 0, r["group_size"], r["kept"]) for r in index.add(batch).collect())
    wanted = [(0, 0, 1, True), (1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)]
    assert decide(first) == wanted
    assert decide(again) == [(6, 3, 1, False), (7, 8, 2, False), (8, 8, 2, True), (9, 2, 2, False)]
    assert decide(first) == wanted
    assert spark.table(index.table).count() == 4
    plan = index.fresh(exact_dedup.with_digest(again))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan


# line dedup

def test_line_dedup_matches_brute_force(docs, made_up_docs, monkeypatch):
    rows = [(r[3], r[1]) for r in made_up_docs]
    wanted = {r[0]: t for r, t in zip(made_up_docs, brute.drop_lines(rows, 0.05, 10))}
    for limit in (line_dedup.BROADCAST_ROWS, -1):  # broadcast, and joined by salted host
        monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", limit)
        got = line_dedup.drop_boilerplate_lines(clashing(docs), F.col("source"), ratio=0.05, least_pages=10)
        got = got.collect()
        assert {r["doc_id"]: r["text"] for r in got} == wanted
        assert sum(r["n_dropped"] for r in got) >= 20
        assert all(r["n_lines"] == (0 if t is None else t.count("\n") + 1)
                   for r, t in ((r, dict((d[0], d[1]) for d in made_up_docs)[r["doc_id"]]) for r in got))


def test_line_dedup_odd_rows(spark):
    rows = [(i, "same\n\nown %d" % i, None, "h" if i < 30 else None, 0) for i in range(40)] + [(99, None, None, "h", 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in line_dedup.drop_boilerplate_lines(df, F.col("source")).collect()}
    assert got[0]["text"] == "\nown 0" and got[0]["n_dropped"] == 1
    assert got[35]["text"] == "same\n\nown 35" and got[99]["text"] is None
    assert line_dedup.drop_boilerplate_lines(df.limit(0), F.col("source")).count() == 0


# licence scans

def test_license_scan(spark):
    rows = [(1, "prose of no kind\nReleased under the MIT License.\nmore"), (2, "licensed under cc-by-nc 4.0!"),
            (3, "Released under the license."), (4, None), (5, ""), (6, "MIT"),
            (7, "text\n\n  This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy "
                "of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit(1))
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(df).collect()}
    assert [got[i]["license"] for i in range(1, 8)] == ["MIT", "CC-BY-NC-4.0", None, None, None, None, "MPL-2.0"]
    assert got[1]["score"] == 1.0 and got[4]["score"] == 0.0 and got[7]["n_matches"] == 1
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    wanted = con.execute(f"SELECT doc_id, license, score, n_matches FROM ({license_scan.oracle()})").fetchall()
    assert sorted(wanted) == sorted((i, r["license"], r["score"], r["n_matches"]) for i, r in got.items())
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


def test_license_scan_of_runs_beyond_blocks(spark):
    templates = dict(enumerate(license_scan.TEMPLATES))
    mit, apache, gpl = templates[3][1], templates[5][1], templates[8][1]
    words = "sun moon of the to the under a copy file rain".split()
    draw = random.Random(3)

    def prose(n: int) -> str:
        return " ".join(draw.choice(words) for _ in range(n))

    def wrapped(text: str) -> str:
        return "\n".join(textwrap.wrap(text, 40))

    changed = mit.replace("copy", "duplicate").replace("sell", "vend")
    texts = [wrapped(mit), f"{prose(30)}\n{wrapped(mit)}\n{prose(30)}", wrapped(prose(20) + " " + changed + " " + prose(9)),
             "Copyright 2021 Example Authors. Licensed under the MIT License. All rights are reserved to them.",
             f"{prose(40)}. {apache} {prose(25)} {gpl} {prose(12)}", prose(80),
             f"{prose(9)}\n\n{prose(12)} Released under the\nBSD 3-Clause License. {prose(15)}\n\n{prose(5)}",
             f"{prose(9)} Licensed under the MIT License. Licensed under the MIT License. {prose(9)}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["score"], r["license"], r["n_matches"]) for r in license_scan.scan_licenses(df).collect()}
    rows = license_scan.template_rows(license_scan.TEMPLATES)
    assert got == {i: brute.license_runs(t, rows, license_scan.THRESHOLD) for i, t in enumerate(texts)}
    assert [got[i][1] for i in range(8)] == ["MIT", "MIT", "MIT", "MIT", "Apache-2.0", None, "BSD-3-Clause", "MIT"]
    assert got[0] == (1.0, "MIT", 1) and got[4][2] == got[7][2] == 2
    # beside a line that matches
    text = f"Released under the ISC license.\n{templates[0][1]}\n{prose(20)} {templates[17][1]} {prose(20)}"
    beside = license_scan.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (beside["license"], beside["score"], beside["n_matches"]) == ("MIT", 1.0, 2)


# toxicity

def test_toxicity_learns_from_its_part_alone(spark):
    draw = random.Random(8)
    words = ["".join(draw.choice("abcdefg") for _ in range(5)) for _ in range(200)]
    rows, marks = [], []
    for i in range(300):
        toxic = i % 4 == 0
        rows.append((i, " ".join(draw.choice(words) for _ in range(30)) + (" you scum idiot" if toxic else " fine day")))
        marks.append((i, int(toxic)))
    docs = spark.createDataFrame(rows + [(1000, None), (1001, "")], "doc_id long, text string").withColumn("score", F.lit(7))
    labels = spark.createDataFrame(marks + [(5000, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, fit_rows=150)
    got = {r["doc_id"]: r for r in toxicity.score(docs.drop("score"), model).withColumn(
        "out", toxicity.held_out(F.col("doc_id"))).collect()}
    assert all(got[i]["out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(300))
    held = [i for i in range(300) if got[i]["out"]]
    assert np.mean([(got[i]["score"] >= 0.7) == (i % 4 == 0) for i in held]) > 0.95
    assert 0 <= got[1000]["score"] == got[1001]["score"] <= 1
    # labels of held-out rows are never read
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(docs, other, fit_rows=150)
    assert np.allclose(again.weights, model.weights)
    none = toxicity.fit(docs, labels.where("toxic = 0"))
    assert 0 < none.score("you scum") == none.score("") < 0.1
    assert toxicity.score(docs.drop("score").limit(0), model).count() == 0


# vector search

def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_vector_search_is_exact_at_factor_one(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(12, 16))
    x = (centres[draw.integers(0, 12, 700)] + 0.2 * draw.normal(size=(700, 16))).astype("float32")
    x[100:160] = x[100]  # a very common vector
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [], 0), (904, [1.0, 2.0], 0),
           (950, [None] * 16, 0), (7, x[7].tolist(), 1)]
    df = vectors(spark, rows + odd).withColumn("shard", F.lit("x"))
    got = vector_search.nearest(df, df.where("vec_id % 50 = 0"), k=5, factor=1.0, shard_rows=128).collect()
    y = x.astype(float)
    unit = y / np.linalg.norm(y, axis=1, keepdims=True)
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 700, 50))
    for q, hits in found.items():
        score = np.round(unit @ unit[q], 12)
        order = [i for i in np.lexsort((np.arange(700), -score)) if i != q][:5]
        assert [h[1] for h in sorted(hits)] == order
        assert np.allclose([h[2] for h in sorted(hits)], score[order])
    few = vectors(spark, rows[:3])
    assert vector_search.nearest(few, few, k=5).count() == 6
    assert vector_search.nearest(few.limit(0), few.limit(0)).count() == 0


def test_vector_search_recall_of_the_relaxed_factor():
    draw = np.random.default_rng(4)
    unit = draw.normal(size=(3000, 32))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    tree = vector_search.VantageTree(unit)
    wanted = np.argsort(-(unit[:60] @ unit.T), axis=1)[:, :6]
    for factor, least in ((1.0, 1.0), (vector_search.FACTOR, 0.9)):
        place, _ = vector_search.search(tree.points, tree.nodes, unit[:60], 6, factor)
        got = tree.order[place]
        assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(got, wanted)]) >= least


# HTML extraction

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=#>Home</a><li><a>News</a></ul></nav>
<div class="ad">Buy now</div><article><h1>Big &amp; title</h1><p>First <b>part</b>
  of &lt;it&gt; &eacute; a<br>b<p>Second part, which goes on for a while.</article><form><label>Mail</label></form>
<footer>&copy; 2020</footer><script>if (a < b) {}</script><!-- end"""


def test_blocks_and_extraction(spark):
    texts = [t for _, t in html_extract.blocks_of(PAGE)]
    assert texts == ["Home", "News", "Buy now", "Big & title", "First part of <it> é a b",
                     "Second part, which goes on for a while.", "Mail", "© 2020"]
    body = "Some words of a story that goes on. " * 3
    pages = [(i, f"u{i}", f"<body><nav><a>home {i}</a></nav><div class=ad>buy</div><article><h1>t{i}</h1><p>{body}{i}</p>"
                          f"</article><footer>foot {i}</footer></body>") for i in range(40)]
    odd = [(100, "p", PAGE), (101, "e", ""), (102, "n", None), (103, "b", "<<<>&am <p"), (100, "p", PAGE)]
    df = spark.createDataFrame(pages + odd, "page_id long, url string, html string").withColumn("text", F.lit(1))
    model = html_extract.fit(df)
    got = html_extract.extract(df, model).collect()
    by = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 45 and by[101] == by[102] == ""
    assert by[100] == "Big & title\n\nFirst part of <it> é a b\n\nSecond part, which goes on for a while."
    assert all(by[i] == f"t{i}\n\n{body}{i}" for i in range(40))
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract(df.limit(0), model).count() == 0


def test_gradients_of_the_labeller():
    draw = np.random.default_rng(0)
    cell = html_extract.Lstm(draw, 3, 4)
    x, aim = draw.normal(size=(5, 2, 3)), draw.normal(size=(5, 2, 4))
    cell.forward(x, keep=True)
    slopes = cell.backward(x, aim)
    for weight, slope in zip((cell.w, cell.u, cell.b), slopes):
        at = tuple(int(draw.integers(0, n)) for n in weight.shape)
        kept, ends = weight[at], []
        for step in (1e-5, -1e-5):
            weight[at] = kept + step
            ends.append((cell.forward(x) * aim).sum())
        weight[at] = kept
        assert np.isclose((ends[0] - ends[1]) / 2e-5, slope[at], rtol=1e-4)
