"""MinHash near-duplicates: an inverted join of signature coordinates, and the components of its links.

1. A document's set holds the hashes of its distinct word n-grams; its signature is the smallest value of the set
   under each of COORDINATES hash functions. Two sets agree in a coordinate with the probability of their Jaccard
   similarity. Documents with the same set are one class; the join runs over classes.
2. A class is posted under its (coordinate, value) pairs. Pairs of classes that collide in at least MATCHES
   coordinates are candidates. Counting merges short lists only (prefix): values that no other class has are
   skipped, a class with fewer than MATCHES others takes no part, and of k others the k - MATCHES + 1 rarest are
   posted: two classes that agree in MATCHES coordinates must share one of these. Where two meet in a list, the
   lists not merged are skipped to their agreement by the signatures, which give the whole count.
3. Candidates that pass the match threshold tie classes to groups, and links are confirmed on whole sets within the
   groups (``group_links``): tasks give spanning forests, never all pairs.

A similarity at the threshold of 0.8 collides in 28 of 64 coordinates but for a probability of 1e-9, so that few links
are missed at any size; a missed link matters only where no other path connects its ends. More coordinates or fewer
matches lower it further.

Defined cases: null, empty or wordless text has the empty set, links with nothing and is its own component; with
fewer than n words the whole sequence is the one element; rows that repeat an id are one document, linked through
any of its texts; a null id takes no part (component null). Ids are integers. An empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import staged
from runlens.llm.components import components
from runlens.llm.group_links import candidate_groups, verified_links
from runlens.llm.ngram_join import class_sets, digest_of, shingles, with_roots
from runlens.llm.worker import sliced, tidy

COORDINATES, MATCHES = 64, 28
#: elements hashed at a time
CHUNK = 2048


def seeds(coordinates: int) -> np.ndarray:
    return np.random.default_rng(13).integers(1, 2**64, coordinates, dtype=np.uint64, endpoint=False)


def signature(grams: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """Smallest value under each hash function; of an empty set all are 2 ** 64 - 1."""
    least = np.full(len(salts), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), CHUNK):
        x = grams[at:at + CHUNK, None] ^ salts[None, :]
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        np.minimum(least, x.min(axis=0), out=least)
    return least


def posting_keys(least: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """32 bits of each coordinate's value, an odd value by chance alike; the low 16 serve to compare signatures."""
    x = (least + salts) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))).astype(np.uint32).view(np.int32)


def read_signatures(texts: DataFrame, n: int, coordinates: int) -> DataFrame:
    """``(id, size, digest, keys)`` for each row of ``texts(id, text)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = seeds(coordinates)
        for batch in sliced(batches):
            sets = [shingles(t or "", n) for t in batch.column(1).to_pylist()]
            keys = np.concatenate([posting_keys(signature(g, salts), salts) for g in sets])
            ends = np.arange(0, len(keys) + 1, coordinates, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, sets), pa.int64()),
                 pa.array([digest_of(g) for g in sets], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))], names=["id", "size", "digest", "keys"])

    return texts.mapInArrow(tidy(run), "id long, size long, digest binary, keys array<int>")


def posted(classes: DataFrame, matches: int) -> DataFrame:
    """``(key, node)``: the prefix of every class that can reach ``matches`` collisions."""
    # the coordinate stands above its 32 bits; alike by chance, values only make candidates that are not confirmed
    entries = classes.select("node", F.posexplode("keys").alias("at", "value")).select(
        "node", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("value")).alias("key"))
    # staged, so that both sides of the join are plain shuffles, whose large partitions Spark splits
    several = staged(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "several")
    own = (entries.join(several, "key").groupBy("node")
           .agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("rare"))  # a coordinate each
           .where(F.size("rare") >= matches))
    return own.select("node", F.explode(F.slice("rare", F.lit(1), F.size("rare") - (matches - 1))).alias("r")) \
        .select(F.col("r.key").alias("key"), "node")


def sizes_allow(s, u, least: Fraction):
    return (s * least.denominator >= u * least.numerator) & (u * least.denominator >= s * least.numerator)


def collide(matches: int, least: Fraction):
    """Condition on two struct columns of size and bits: enough collisions, and sizes that allow a link."""
    def near(one: str, other: str) -> Column:
        same = F.aggregate(F.zip_with(f"{one}.bits", f"{other}.bits", lambda x, y: (x == y).cast("int")), F.lit(0),
                           lambda total, x: total + x)
        return sizes_allow(F.col(f"{one}.size"), F.col(f"{other}.size"), least) & (same >= matches)
    return near


def collide_rows(matches: int, least: Fraction):
    """The same of arrays: sizes and rows of bits of two selections."""
    def near(s: np.ndarray, bits: np.ndarray, u: np.ndarray, other: np.ndarray) -> np.ndarray:
        passed = sizes_allow(s, u, least)
        at = np.flatnonzero(passed)
        passed[at] = (bits[at] == other[at]).sum(axis=1) >= matches
        return passed
    return near


def near_duplicates(docs: DataFrame, n: int = 5, least: Fraction = Fraction(4, 5), id_col: str = "doc_id",
                    text_col: str = "text", coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """``(id, size, root)`` for each row: the size of its set, and the smallest id reachable by links."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = staged(read_signatures(texts, n, coordinates), "signatures")
    known = rows.where("size > 0 AND id IS NOT NULL")
    classes = staged(known.groupBy("digest", "size").agg(F.min("id").alias("root"), F.first("keys").alias("keys"))
                     .withColumn("node", F.monotonically_increasing_id()), "classes")
    lists = staged(posted(classes, matches), "posted")
    nodes = staged(lists.select("node").distinct(), "nodes")
    low = lambda k: F.shiftright(F.shiftleft(k, 16), 16).cast("short")
    labels = staged(classes.join(nodes, "node").select("node", "size", F.col("node").alias("root"),
                                                       F.transform("keys", low).alias("bits")),
                    "labels")
    groups = candidate_groups(lists, labels, collide(matches, least), collide_rows(matches, least))
    wanted = staged(classes.select("node", "root", "digest").join(groups.select("node"), "node"), "wanted")
    return with_roots(rows, classes, components(verified_links(groups, class_sets(texts, wanted, n), least)))
