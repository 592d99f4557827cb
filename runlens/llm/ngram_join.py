"""N-gram Jaccard join: size-aware heavy-light set similarity self-join, and the components of its links.

A document's set holds the hashes of its distinct word n-grams. Two sets can only reach the Jaccard similarity
t if their sizes are within t of each other and they share at least need(s, u) = ceil(t (s + u) / (1 + t))
elements. Documents with the same set are one class; the join runs over classes.

* Light sets (up to a boundary): every subset of need(s, u) elements is enumerated for each partner size u up to
  the boundary; partners share one of these fixed-size subsets.
* Heavy sets: the inverted lists of their rarest elements are scanned. Of the first s - ceil(t s) + 1 elements of
  a set in a fixed order, one is among the first elements of every partner, so the lists of that many elements
  find them all. Any fixed order is exact; this one puts rare elements first: by weight, an estimate of the number
  of documents that is kept for frequent elements, then n-grams of long words before those of short ones.
* The boundary is the one with the least cost: subsets written against list entries written and scanned, from
  the histogram of small sizes. Pairs across it are found by the lists, so light sets that are within t of a
  heavy size are entered there, too.

A list of m entries is never expanded into m * m pairs, nor does a task give out the pairs that it meets: lists tie
their entries to candidate groups and give spanning forests, of pairs whose sizes and 512-bit parity sketches (whose
difference never exceeds that of the sets) allow a link; whole sets then meet within their groups, where a task gives
a spanning forest of the verified links (``group_links``). No link is lost.
Lists, classes and groups may hold a third of all rows: counts, centres and roots are combined map-side, joins
back are plain shuffled joins whose large partitions Spark splits, and blocks are of bounded size.

Defined cases: null, empty or wordless text has the empty set, links with nothing and is its own component;
with fewer than n words the whole sequence is the one element; rows that repeat an id are one document, linked
through any of its texts; a null id takes no part (component null). Ids are integers.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import staged
from runlens.llm.components import components
from runlens.llm.group_links import candidate_groups, refined_groups, verified_links
from runlens.llm.worker import sliced, tidy

WEIGHT_BITS = 22
WEIGHT_MASK = np.uint64((1 << WEIGHT_BITS) - 1)
LEAST_WEIGHT = 32
LENGTH_BITS, MOST_BYTES = 6, 63
LARGEST_LIGHT = 20
#: cost of a list entry against that of an enumerated subset: it is scanned and verified, too
SCAN_COST = 4.0
SKETCH_BITS = 512

_draw = np.random.default_rng(2024)
BYTE_VALUES = _draw.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
BYTE_VALUES[[32, 9, 10, 11, 12, 13]] = 0
IS_SPACE = BYTE_VALUES == 0
ODD = np.uint64(0x9E3779B97F4A7C15)
_powers = {"table": np.ones(1, np.uint64)}


def powers(n: int) -> np.ndarray:
    if len(_powers["table"]) < n:
        _powers["table"] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 4096) - 1, ODD)]))
    return _powers["table"]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of words; A-Z lower-cased, words parted by ASCII white space.

    The highest bits hold how short the words are, so the longest n-grams come first: those are the rarest.
    """
    data = np.frombuffer(text.encode("utf-8", "replace").lower(), np.uint8)
    space = IS_SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(data) else np.empty(0, int)
    if not len(starts):
        return np.empty(0, np.uint64)
    spans = np.diff(np.append(starts, len(data)))
    data, space = data[starts[0]:], space[starts[0]:]
    lengths = np.concatenate([[0], np.cumsum(np.add.reduceat(~space, starts - starts[0], dtype=np.int64))])
    within = np.arange(len(data)) - np.repeat(starts - starts[0], spans)
    words = mixed(np.add.reduceat(BYTE_VALUES[data] * powers(int(spans.max()))[within], starts - starts[0]))
    grams = min(n, len(words))
    found = np.full(len(words) - grams + 1, grams, np.uint64)
    for j in range(grams):
        found = mixed(found * ODD + words[j:j + len(found)])
    short = MOST_BYTES - np.minimum(lengths[grams:] - lengths[:-grams], MOST_BYTES)
    return np.unique(short.astype(np.uint64) << np.uint64(64 - LENGTH_BITS) | found >> np.uint64(LENGTH_BITS))


class Threshold:
    """Exact bounds of a Jaccard threshold given as a fraction."""

    def __init__(self, least: Fraction):
        self.least = least

    def linked(self, shared: int, s: int, u: int) -> bool:
        return shared * self.least.denominator >= self.least.numerator * (s + u - shared)

    def need(self, s: int, u: int) -> int:
        return math.ceil(self.least * (s + u) / (1 + self.least))

    def prefix(self, s: int) -> int:
        """Of so many rarest elements, one at least is among those of every partner, its own or larger."""
        return s - math.ceil(self.least * s) + 1

    def partners(self, s: int, upto: int) -> range:
        return range(math.ceil(self.least * s), min(upto, math.floor(s / self.least)) + 1)

    def subset_sizes(self, s: int, boundary: int) -> list[int]:
        """Sizes of the subsets that a set of s elements shares with its light partners."""
        return sorted({self.need(s, u) for u in self.partners(s, boundary)} & set(range(s + 1)))

    def first_listed(self, boundary: int) -> int:
        """Smallest size that has a partner above the boundary."""
        return math.ceil(self.least * (boundary + 1))

    def boundary(self, sizes: dict[int, int]) -> int:
        """The boundary of least cost for a histogram of the sets' sizes (larger sets cost the same anyway)."""
        def cost(boundary: int) -> float:
            total = 0.0
            for s, count in sizes.items():
                if s <= boundary:
                    total += count * sum(math.comb(s, c) for c in self.subset_sizes(s, boundary))
                if s >= self.first_listed(boundary):
                    total += count * SCAN_COST * self.prefix(s)
            return total
        return min(range(LARGEST_LIGHT + 1), key=cost)


def keys_of(grams: np.ndarray, bounds: Threshold, boundary: int, weights: np.ndarray) -> np.ndarray:
    """The lists that a set is entered in: its light subsets and its rarest elements."""
    s, found = len(grams), []
    if s <= boundary:
        whole = grams.sum(dtype=np.uint64)
        for size in bounds.subset_sizes(s, boundary):
            out = np.array(list(itertools.combinations(range(s), s - size)), dtype=int).reshape(math.comb(s, size), s - size)
            found.append(mixed((whole - grams[out].sum(axis=1, dtype=np.uint64)) ^ mixed(np.full(1, size, np.uint64))))
    if s >= bounds.first_listed(boundary):
        weight, count = weights[(grams & WEIGHT_MASK).astype(np.int64)], bounds.prefix(s)
        rare = grams[weight == 0][:count]
        if len(rare) < count:
            rare = grams[np.lexsort((grams, weight))[:count]]
        found.append(rare)
    return np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)


def read_sets(docs: DataFrame, n: int) -> DataFrame:
    """Rows ``(id, size, digest, bits, wide)`` of documents, and ``(bucket, weight)`` of buckets frequent in a task's rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << WEIGHT_BITS, np.int32)
        nothing, names = [None], ["id", "size", "digest", "bits", "wide", "bucket", "weight"]
        for batch in sliced(batches):
            sets = [shingles(t or "", n) for t in batch.column(1).to_pylist()]
            for grams in sets:
                np.add.at(counts, (grams & WEIGHT_MASK).astype(np.int64), 1)
            digests = [digest_of(g) for g in sets]
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(digests, pa.binary()),
                 pa.array([sketch(g) for g in sets], pa.list_(pa.int64())),
                 pa.array([sketch(g, wide_bits(len(g))) if len(g) > SKETCH_BITS else None for g in sets],
                          pa.list_(pa.int64())),
                 pa.array(nothing * rows, pa.int32()), pa.array(nothing * rows, pa.int64())], names=names)
        often = np.flatnonzero(counts > 4 + 4 * counts.mean()).astype(np.int32)
        rows = len(often)
        yield pa.RecordBatch.from_arrays(
            [pa.array(nothing * rows, pa.int64()), pa.array(nothing * rows, pa.int64()),
             pa.array(nothing * rows, pa.binary()), *[pa.array(nothing * rows, pa.list_(pa.int64()))] * 2, pa.array(often),
             pa.array(counts[often].astype(np.int64))], names=names)

    return docs.mapInArrow(tidy(run), "id long, size long, digest binary, bits array<long>, wide array<long>, "
                                      "bucket int, weight long")


def lists_of(texts: DataFrame, classes: DataFrame, n: int, bounds: Threshold, boundary: int,
             weights: np.ndarray) -> DataFrame:
    """``(key, node)``: the entries of all lists with two entries or more, over the classes' first documents."""
    shared = texts.sparkSession.sparkContext.broadcast(weights)  # 2 ** WEIGHT_BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingles(t or "", n) for t in batch.column(1).to_pylist()]
            keys = [keys_of(grams, bounds, boundary, shared.value) for grams in sets]
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(map(digest_of, sets), pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["root", "digest", "keys"])

    made = texts.mapInArrow(tidy(run), "root long, digest binary, keys array<long>")
    arrays = staged(made.join(classes.select("root", "digest", "node"), ["root", "digest"])
                    .dropDuplicates(["root", "digest"]).select("node", "keys"), "keys")
    entries = arrays.select(F.explode("keys").alias("key"), "node")
    # staged, so that both sides of the join are plain shuffles, whose large partitions Spark splits
    several = staged(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "several")
    return entries.join(several, "key")


def digest_of(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def wide_bits(size: int) -> int:
    """Bits of the longer sketch of a set: at least as many as it has elements, by powers of two."""
    return max(SKETCH_BITS, 1 << max(size - 1, 0).bit_length())


def sketch(grams: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity of the number of elements in each of ``bits`` buckets, as 64-bit words.

    Every bucket whose parity differs holds an element of only one of two sets, so the number of differing bits
    never exceeds the size of the symmetric difference.
    """
    counts = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def may_link(bounds: Threshold):
    """Condition on two struct columns of size and bits: sizes and sketches allow a link.

    Linked sets differ in at most (s + u) (1 - t) / (1 + t) elements.
    """
    p, q = bounds.least.numerator, bounds.least.denominator

    def near(one: str, other: str) -> Column:
        s, u = F.col(f"{one}.size"), F.col(f"{other}.size")
        differ = F.aggregate(F.zip_with(f"{one}.bits", f"{other}.bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))),
                             F.lit(0), lambda total, x: total + x)
        return (s * q >= u * p) & (u * q >= s * p) & (differ * (p + q) <= (s + u) * (q - p))
    return near


def may_link_rows(bounds: Threshold):
    """The same of arrays: sizes and rows of bits of two selections."""
    p, q = bounds.least.numerator, bounds.least.denominator

    def near(s: np.ndarray, bits: np.ndarray, u: np.ndarray, other: np.ndarray) -> np.ndarray:
        passed = (s * q >= u * p) & (u * q >= s * p)
        at = np.flatnonzero(passed)
        differ = np.bitwise_count((bits[at] ^ other[at]).view(np.uint64)).sum(axis=1, dtype=np.int64)
        passed[at] = differ * (p + q) <= (s[at] + u[at]) * (q - p)
        return passed
    return near


def linked_components(docs: DataFrame, n: int = 5, least: Fraction = Fraction(4, 5), id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """``(id, size, root)`` for each row: the size of its set, and the smallest id reachable by links."""
    bounds = Threshold(least)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    read = staged(read_sets(texts, n), "sets-read")
    rows = read.where("bucket IS NULL").select("id", "size", "digest", "bits", "wide")
    weights = np.zeros(1 << WEIGHT_BITS, np.uint8)  # by powers of two
    often = (read.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("weight").alias("weight"))
             .where(F.col("weight") >= LEAST_WEIGHT).select("bucket", F.floor(F.log2("weight")).alias("weight")))
    often = often.toPandas()
    weights[often["bucket"].to_numpy(dtype=int)] = often["weight"]
    known = rows.where("size > 0 AND id IS NOT NULL")
    classes = staged(known.groupBy("digest", "size").agg(F.min("id").alias("root"), F.first("bits").alias("bits"),
                                                         F.first("wide").alias("wide"))
                     .withColumn("node", F.monotonically_increasing_id()), "classes")
    small = classes.where(F.col("size") <= 2 * LARGEST_LIGHT).groupBy("size").count()  # a row for each small size
    boundary = bounds.boundary({r["size"]: r["count"] for r in small.collect()})

    lists = staged(lists_of(texts.where("id IS NOT NULL"), classes, n, bounds, boundary, weights), "lists")
    nodes = staged(lists.select("node").distinct(), "nodes")
    labels = staged(classes.join(nodes, "node").select("node", "size", "bits", F.col("node").alias("root")), "labels")
    groups = candidate_groups(lists, labels, may_link(bounds), may_link_rows(bounds))
    groups = refined_groups(groups, classes.select("node", F.coalesce("wide", "bits").alias("bits")), least, SKETCH_BITS)
    wanted = staged(classes.select("node", "root", "digest").join(groups.select("node"), "node"), "wanted")
    return with_roots(rows, classes, components(verified_links(groups, class_sets(texts, wanted, n), least)))


def class_sets(texts: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """``(node, grams)``: whole sets of ``classes(node, root, digest)``, as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingles(t or "", n) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(digest_of, sets), pa.binary()),
                 pa.array([g.tobytes() for g in sets], pa.binary())], names=["root", "digest", "grams"])

    firsts = classes.select(F.col("root").alias("id")).distinct()
    read = texts.join(firsts, "id").select("id", "text").mapInArrow(tidy(run), "root long, digest binary, grams binary")
    return read.join(classes, ["root", "digest"]).select("node", "grams")


def with_roots(rows: DataFrame, classes: DataFrame, joined: DataFrame) -> DataFrame:
    """``(id, size, root)`` for each of ``rows(id, size, digest)``, from the components ``joined(node, root)`` of
    ``classes(node, root, digest)``. Rows that repeat an id tie the classes of its texts together."""
    tops = staged(classes.select("node", "digest", F.col("root").alias("first")).join(joined, "node", "left")
                  .select("digest", "first", F.coalesce("root", "node").alias("top")), "tops")
    ends = tops.groupBy("top").agg(F.min("first").alias("end"))
    ends = staged(tops.join(ends, "top").select("digest", "end"), "ends")
    placed = rows.where("size > 0 AND id IS NOT NULL").select("id", "digest").distinct().join(ends, "digest")
    again = placed.groupBy("id").agg(F.min("end").alias("a"), F.max("end").alias("b"))
    ties = staged(placed.join(again.where("a <> b"), "id").select("a", F.col("end").alias("b")).where("a <> b"), "ties")
    if not ties.isEmpty():
        onward = components(ties).select(F.col("node").alias("end"), F.col("root").alias("next"))
        ends = staged(ends.join(onward, "end", "left").select("digest", F.coalesce("next", "end").alias("end")), "ends")
    return rows.select("id", "size", "digest").join(ends, "digest", "left").select(
        "id", "size", F.when(F.col("id").isNotNull(), F.coalesce("end", "id")).alias("root"))
