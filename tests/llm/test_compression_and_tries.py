from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
import pytest
from fractions import Fraction
from pyspark.sql import functions as F

from runlens.llm import (conversation_trie, exact_dedup, group_links, line_dedup, minhash_dedup, ngram_join, suffix_dedup,
                         toxicity, vector_codes, vector_search)

from . import brute
from .conftest import DOCS

CONVERSATIONS = "conv_id long, turn long, role string, text string"


def shared(conv_id):
    return F.crc32(conv_id.cast("string")) % 6


# vector codes

def made_up_vectors(n: int) -> list[tuple]:
    draw = random.Random(11)
    rows = [(3 * i, [draw.choice((-0.5, 0.0, 0.25, draw.uniform(-1, 1))) for _ in range(8)], i % 3 or None)
            for i in range(n)]
    rows += [(1, None, 1), (4, [], 1), (7, [None] * 8, 2), (10, [float("nan")] + [0.0] * 7, 2),
             (13, [float("inf")] + [0.0] * 7, 2), (None, [0.1] * 8, 0), (0, rows[0][1], 5), (0, [-0.9] * 8, 5)]
    return rows


@pytest.mark.parametrize("entries", [4, 256])
def test_vector_codes_are_those_of_plain_rounds(spark, entries):
    rows = made_up_vectors(90)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    table = table.withColumn("ints", F.lit("x")).withColumn("error", F.lit("x"))
    coded, _ = vector_codes.compress(table, entries=entries)
    got = vector_codes.with_label_errors(coded).collect()
    want = brute.vector_codes(rows, 4, entries, 4)
    key = str
    assert sorted(((r["id"], r["label"], list(r["indexes"]), r["error"]) for r in got), key=key) == sorted(want, key=key)
    for label in {r["label"] for r in got}:
        assert {r["label_error"] for r in got if r["label"] == label} == {sum(w[3] for w in want if w[1] == label)}


def test_vector_codes_of_nothing_and_of_what_cannot_be_cut(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1)], schema))[0].count() == 0
    for vectors in ([[0.1] * 6], [[0.1] * 8, [0.1] * 4], [[3e5] * 4]):
        with pytest.raises(ValueError):
            vector_codes.compress(spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], schema))


def test_large_integers_keep_their_exact_distances():
    part = np.array([[2 ** 28, -2 ** 28], [5, 5]])
    index, far = vector_codes.nearest(part, np.array([[0, 0], [2 ** 28, 0]]))
    assert index.tolist() == [1, 0] and far.tolist() == [2 ** 56, 50]


# conversation trie

def made_up_conversations() -> list[tuple]:
    draw = random.Random(12)
    said = ["", "hi", "what?", "né", "so long"]
    rows = [(100 * (i % 3) + draw.randint(0, 9), draw.choice((None, 0, 1, 2, 3, 4, 5)), draw.choice(("user", None, "bot")),
             draw.choice(said + [None])) for i in range(220)]
    rows += [(300, t, "user", "again and again") for t in range(40)] + [(301, t, "user", "again and again") for t in range(40)]
    rows += [(310 + i, 0, "user", "alone") for i in range(30)] + [(-105, 1, "user", "x"), (-100, 1, "user", "y")]
    return rows + [(None, 1, "user", "nobody"), rows[0], rows[0]]


@pytest.mark.parametrize("segment, shard_turns", [(512, 100_000), (3, 7), (1, 1)])
def test_trie_nodes_are_all_prefixes(spark, segment, shard_turns):
    rows = made_up_conversations()
    table = spark.createDataFrame(rows, CONVERSATIONS).repartition(7).withColumn("depth", F.lit("x"))
    found = conversation_trie.prefix_trie(table, shared, shard_turns=shard_turns, segment=segment)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute.prefix_nodes(rows, 100)


def test_trie_of_nothing(spark):
    assert conversation_trie.prefix_trie(spark.createDataFrame([], CONVERSATIONS), shared).count() == 0


def test_turns_are_numbered_across_tasks(spark):
    rows = [(7, t, "user", str(t)) for t in range(500)] + [(8, t, "user", "x") for t in range(3)]
    turns = conversation_trie.turns_of(spark.createDataFrame(rows, CONVERSATIONS).repartition(5), "conv_id", "turn", "role", "text")
    numbers = conversation_trie.numbered(turns, 6).groupBy("conv_id").agg(F.sort_array(F.collect_list("at")).alias("at"))
    assert {r["conv_id"]: list(r["at"]) for r in numbers.collect()} == {7: list(range(1, 501)), 8: [1, 2, 3]}


def test_double_array_finds_its_paths_and_no_other():
    draw = random.Random(13)
    paths = sorted({tuple(draw.randint(0, 30) for _ in range(draw.randint(1, 6))) for _ in range(300)})
    lengths = np.array([len(p) for p in paths])
    table = np.zeros((len(paths), 6), np.int64)
    for i, path in enumerate(paths):
        table[i, :len(path)] = path
    trie, prefixes = conversation_trie.packed(table, lengths), {p[:n] for p in paths for n in range(len(p) + 1)}
    states = {(): 0}
    for path in sorted(prefixes, key=len):
        if path:
            states[path] = int(trie.step(np.array([states[path[:-1]]]), np.array([path[-1]]))[0])
    assert min(states.values()) == 0 and len(set(states.values())) == len(prefixes)
    for path, state in states.items():
        for last in range(31):
            assert (trie.step(np.array([state]), np.array([last]))[0] > 0) == (path + (last,) in prefixes)


def test_ends_of_a_node_are_hashed_as_one_text(spark):
    import hashlib
    ids = [5, -3, 12, 100, 7]
    rows = [(1, 2, 3, i) for i in ids] + [(1, 2, 4, 9), (1, 2, 4, 8)]
    found = conversation_trie.ends_hash(spark.createDataFrame(rows, "depth long, x long, y long, conv_id long"), 10 ** 6)
    want = {3: ",".join(map(str, sorted(ids))), 4: "8,9"}
    assert {r["y"]: r["ends_sha256"] for r in found.collect()} == \
        {y: hashlib.sha256(t.encode()).hexdigest() for y, t in want.items()}


# MinHash near-duplicates, and the links of candidate groups

def test_minhash_components_are_those_of_all_pairs(docs, made_up_docs):
    extra = docs.withColumn("id", F.lit("x")).withColumn("node", F.lit("x")).withColumn("keys", F.lit("x"))
    for n, least in ((4, Fraction(4, 5)), (5, Fraction(1, 2))):
        found = minhash_dedup.near_duplicates(extra, n=n, least=least, matches=28 if least > Fraction(3, 5) else 12)
        want = brute.components([r[:2] for r in made_up_docs], n, least.numerator, least.denominator)
        assert {r["id"]: (r["size"], r["root"]) for r in found.collect()} == want


def test_minhash_values_take_four_bytes_and_stay_apart_by_coordinate(spark):
    texts = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e")], "id long, text string")
    found = minhash_dedup.read_signatures(texts, 4, 64)
    assert found.schema["keys"].dataType.simpleString() == "array<int>"
    assert found.select("keys").distinct().count() == 1
    for other, nodes in (([8, -7], set()), ([-7, 9], {1, 2})):
        classes = spark.createDataFrame([(1, [-7, 8]), (2, other)], "node long, keys array<int>")
        assert {r["node"] for r in minhash_dedup.posted(classes, 1).collect()} == nodes


def test_minhash_defined_cases(spark):
    same = "a b c d e f g h"
    rows = [(5, same, "", "", 0), (5, same, "", "", 0), (2, same.upper(), "", "", 0), (5, "p q r s t u v", "", "", 0),
            (9, "p q r s t u v", "", "", 0), (None, same, "", "", 0), (1, None, "", "", 0), (0, "", "", "", 0)]
    found = minhash_dedup.near_duplicates(spark.createDataFrame(rows, DOCS), n=4)
    assert sorted({(r["id"], r["root"]) for r in found.collect()}, key=str) == sorted(
        {(5, 2), (2, 2), (9, 2), (None, None), (1, 1), (0, 0)}, key=str)
    assert found.count() == len(rows)
    assert minhash_dedup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_intersections_and_blocks_match_plain_sets(monkeypatch):
    draw = random.Random(14)
    monkeypatch.setattr(group_links, "COLUMNS", 16)
    sets = [np.unique(np.array(draw.sample(range(90), draw.randint(1, 60)), np.uint64)) for _ in range(40)]
    plain = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    assert group_links.intersections(sets, None).tolist() == plain
    assert group_links.intersections(sets[:15], sets[15:]).tolist() == [r[15:] for r in plain[:15]]
    assert group_links.intersections(sets[:3], []).shape == (3, 0)


def test_groups_of_many_blocks_give_the_links_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(group_links, "BLOCK_SETS", 6)
    draw, base = random.Random(15), list(range(40))
    sets = []
    for i in range(60):
        own = set(base)
        for _ in range(draw.randint(0, 9)):
            own.discard(draw.choice(base))
            own.add(100 + draw.randint(0, 30))
        sets.append(sorted(own))
    least = Fraction(4, 5)
    groups = spark.createDataFrame([(i, len(s), 0) for i, s in enumerate(sets)], "node long, size long, group long")
    rows = spark.createDataFrame([(i, bytearray(np.array(s, np.uint64).tobytes())) for i, s in enumerate(sets)],
                                 "node long, grams binary")
    from runlens.llm.components import components
    found = {r["node"]: r["root"] for r in components(group_links.verified_links(groups, rows, least)).collect()}
    want = brute.components([(i, " ".join(map(str, s))) for i, s in enumerate(sets)], 1, 4, 5)
    assert {i: found.get(i, i) for i in range(60)} == {i: root for i, (_, root) in want.items()}


def test_longer_sketches_keep_all_links_and_part_large_sets(spark, monkeypatch):
    monkeypatch.setattr(group_links, "BLOCK_SETS", 4)
    draw = np.random.default_rng(16)
    bases = [np.unique(draw.integers(0, 2 ** 63, 1500).astype(np.uint64)) for _ in range(6)]
    sets = [np.sort(np.append(b[:len(b) - 20 * j], draw.integers(0, 2 ** 63, 10 * j).astype(np.uint64)))
            for b in bases for j in range(3)]
    groups = spark.createDataFrame([(i, len(s), 0) for i, s in enumerate(sets)], "node long, size long, group long")
    bits = spark.createDataFrame([(i, ngram_join.sketch(s, ngram_join.wide_bits(len(s))).tolist())
                                  for i, s in enumerate(sets)], "node long, bits array<long>")
    found = group_links.refined_groups(groups, bits, Fraction(4, 5), 512).toPandas()
    assert sorted(map(sorted, found.groupby("group")["node"].apply(list))) == [[3 * i, 3 * i + 1, 3 * i + 2] for i in range(6)]


# what the other operators do at the edges

def test_a_small_site_has_boilerplate_too(spark):
    rows = [(i, f"own {i}\nfooter", "", "small" if i < 19 else "large", 0) for i in range(60)]
    found = line_dedup.drop_boilerplate_lines(spark.createDataFrame(rows, DOCS), F.col("source"))
    assert {r["text"] for r in found.collect()} == {f"own {i}" for i in range(60)}
    two = spark.createDataFrame(rows[:2], DOCS)
    assert line_dedup.drop_boilerplate_lines(two, F.col("source")).where("n_dropped > 0").isEmpty()


@pytest.mark.parametrize("factor", [1.0, 4.0])
def test_equal_directions_go_to_the_smaller_ids(spark, factor):
    rows = [(100 - i, [2.0 ** i, 2.0 ** (i + 1)]) for i in range(40)] + [(500 + i, [1.0, -float(i)]) for i in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = vector_search.nearest(table, table.where("vec_id = 100"), factor=factor).orderBy("rank").toPandas()
    assert found["vec_id"].tolist() == [61, 62, 63, 64, 65]


def test_labels_without_documents_teach_nothing(spark):
    texts = [(i, f"{'you utter scum' if i % 2 else 'a calm day'} number {i}", "", "", 0) for i in range(60)]
    docs = spark.createDataFrame(texts, DOCS)
    labels = spark.range(40_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    scored = toxicity.score(docs, toxicity.fit(docs, labels, fit_rows=50)).select("doc_id", "score").toPandas()
    assert (scored["score"][scored["doc_id"] % 2 == 1].min()) > scored["score"][scored["doc_id"] % 2 == 0].max()


def test_an_id_repeated_many_times_is_one_document(spark):
    draw = random.Random(17)
    text = "".join(draw.choice("abcdefgh ") for _ in range(600))
    rows = [(1, text, "", "", 0)] + [(2, text[:400], "", "", 0)] * 300
    found = suffix_dedup.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(4)).groupBy("doc_id", "n_removed").count()
    assert sorted(map(tuple, found.collect())) == [(1, 0, 1), (2, 400, 300)]


def test_index_keeps_what_earlier_batches_decided(spark):
    index = exact_dedup.DigestIndex(spark, "bigint", buckets=3)
    first = spark.createDataFrame([(1, "A", "", "", 0), (2, "a", "", "", 0), (3, None, "", "", 0)], DOCS)
    assert {(r["id"], r["keep_id"], r["group_size"]) for r in index.add(first).collect()} == {(1, 2, 2), (2, 2, 2), (3, 3, 1)}
    second = spark.createDataFrame([(9, "a", "", "", 0), (8, "new", "", "", 0), (7, "", "", "", 0)], DOCS)
    assert {(r["id"], r["keep_id"], r["kept"]) for r in index.add(second).collect()} == {(9, 2, False), (8, 8, True), (7, 3, False)}
    assert {r["keep_id"] for r in index.add(first).collect()} == {2, 3}
