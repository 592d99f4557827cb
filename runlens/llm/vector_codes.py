"""Vector code compression: product codes from codebooks of integers, by dictionaries of each dimension's values.

1. Components become integers, floor(1024 x). Vectors are cut into equal parts; each part has a codebook.
2. In a task, every dimension of a block of rows is dictionary-encoded: its distinct integers and a code for each
   row. The squared differences of the distinct integers to all entries are tabulated once, so the distances of a
   part to its codebook are one gather and one addition for each dimension.
3. A round assigns every part to its nearest entry (ties to the lower index) and sends, from each task, one row
   for each entry in use: a count and sums. Sums over all tasks give the next entries, by floored division. The
   codebooks (entries x dimensions) are all that reaches the driver.

Defined cases: rows whose vector is null, empty or holds null or non-finite components are dropped; an empty table
has no rows. Starting entries are taken by distinct id, the smallest first, rows without an id last of all and not
among them; of rows that repeat an id the one with the smallest integers starts, and each of them is coded. With
fewer ids than entries the codebooks are that much shorter; with vectors but no id at all, that is an error, as
are vectors of different lengths, a length that the parts do not divide, and components beyond 2 ** 18, whose
squared distances would not fit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import staged
from runlens.llm.worker import sliced, tidy

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
LARGEST = 1 << 28
#: rows whose values make one dictionary: bounds the tables and the distances held at once
BLOCK = 4096


def usable(vector: Column) -> Column:
    """No null, no empty vector, every component there and finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


def integers(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``(id, label, ints)`` of the rows that are kept."""
    vector = F.col(vector_col).cast("array<double>")
    scaled = F.transform(vector, lambda x: F.floor(x * F.lit(float(SCALE))))
    return rows.where(usable(vector)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"),
                                             scaled.alias("ints"))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry for each row of ``part`` (the lowest at ties), and its squared distance."""
    spread = int(max(part.max(), entries.max())) - int(min(part.min(), entries.min()))
    kind = np.int32 if part.shape[1] * spread * spread < 2**31 else np.int64
    total = np.zeros((len(part), len(entries)), kind)
    for values, rows in zip(entries.T, part.T):
        distinct, codes = np.unique(rows, return_inverse=True)
        total += ((distinct[:, None] - values[None, :]) ** 2).astype(kind)[codes]
    index = total.argmin(axis=1)
    return index, total[np.arange(len(part)), index].astype(np.int64)


def assigned(batches: Iterator[pa.RecordBatch], at: int, codebooks: np.ndarray) -> Iterator[tuple]:
    """For blocks of rows: the batch, its parts as (parts, rows, width), and for each part indexes and distances."""
    parts, _, width = codebooks.shape
    for batch in sliced(batches, BLOCK):
        if batch.num_rows:
            cut = matrix(batch.column(at)).reshape(batch.num_rows, parts, width).transpose(1, 0, 2)
            found = [nearest(cut[p], codebooks[p]) for p in range(parts)]
            yield batch, cut, found


def entry_sums(codebooks: np.ndarray) -> Callable:
    """A task's counts and sums for the entries that its rows are nearest to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(codebooks.shape[:2], np.int64), np.zeros(codebooks.shape, np.int64)
        for _, cut, found in assigned(batches, 0, codebooks):
            for p, (index, _) in enumerate(found):
                counts[p] += np.bincount(index, minlength=len(counts[p]))
                np.add.at(sums[p], index, cut[p])
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]),
             pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])
    return tidy(run)


def refined(kept: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after one round; entries that no part is nearest to stay."""
    sums = kept.select("ints").mapInArrow(entry_sums(codebooks), "part int, entry int, n long, sums array<long>")
    width = codebooks.shape[2]
    total = sums.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    found = codebooks.copy()
    for row in total.collect():  # an entry of the codebooks each
        found[row["part"], row["entry"]] = np.array(row["sums"], np.int64) // row["n"]
    return found


def starting(kept: DataFrame, length: int, parts: int, entries: int) -> np.ndarray:
    """Codebooks cut from the vectors of the smallest ids."""
    ids = [r["id"] for r in kept.where("id IS NOT NULL").select("id").distinct().orderBy("id").limit(entries).collect()]
    if not ids:
        raise ValueError("no vector has an id, so no codebook can start")
    first = kept.where(F.col("id").isin(ids)).groupBy("id").agg(F.min("ints").alias("ints"))
    vectors = np.array([r["ints"] for r in sorted(first.collect(), key=lambda r: r["id"])], np.int64)
    return np.ascontiguousarray(vectors.reshape(len(ids), parts, length // parts).transpose(1, 0, 2))


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def coded(kept: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """``(id, label, indexes, error)`` by the given codebooks."""
    types = {f.name: f.dataType.simpleString() for f in kept.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, found in assigned(batches, 2, codebooks):
            indexes = np.stack([index for index, _ in found], axis=1).astype(np.int32)
            ends = np.arange(0, indexes.size + 1, indexes.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(indexes.ravel())),
                 pa.array(sum(far for _, far in found))], names=["id", "label", "indexes", "error"])

    return kept.select("id", "label", "ints").mapInArrow(
        tidy(run), f"id {types['id']}, label {types['label']}, indexes array<int>, error long")


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """``(id, label, indexes, error)`` for every kept row, and the final codebooks as (parts, entries, width)."""
    kept = staged(integers(rows, id_col, vector_col, label_col), "integers")
    about = kept.agg(F.min(F.size("ints")).alias("least"), F.max(F.size("ints")).alias("most"),
                     F.max(F.greatest(F.array_max("ints"), -F.array_min("ints"))).alias("largest")).first()
    if about["most"] is None:
        return coded(kept, np.zeros((parts, 1, 1), np.int64)), np.zeros((parts, 0, 0), np.int64)
    if about["least"] != about["most"] or about["most"] % parts:
        raise ValueError(f"vectors of {about['least']} to {about['most']} components cannot be cut into {parts} parts")
    if about["largest"] > LARGEST:
        raise ValueError(f"a component exceeds {LARGEST // SCALE}: squared distances would not fit")
    codebooks = starting(kept, about["most"], parts, entries)
    for _ in range(rounds):
        codebooks = refined(kept, codebooks)
    return coded(kept, codebooks), codebooks


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``: errors summed over equal labels, rows without a label together.

    Sums are combined map-side; the join back is a plain one, which Spark broadcasts when the sums are few and
    splits where a label is hot.
    """
    sums = staged(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    sums = sums.withColumnRenamed("label", "of")
    return codes.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
