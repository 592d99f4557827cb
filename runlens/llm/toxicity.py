"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct character n-grams (2 to 5 bytes of the lower-cased UTF-8 text) hashed to 2**18 places.
The log-count ratio of a feature, log P(feature | toxic) - log P(feature | other), is counted over *all*
labelled training rows: tasks emit counts of their rows, which are summed by feature. A logistic regression is
then fitted to the vectors of ratios of the features present, scaled to unit length, on a sample of at most
``fit_rows`` labelled documents (those with the smallest hash of their id; the bound is a parameter). Scoring reads
each whole text once and shuffles nothing; the model has a fixed size, whatever the corpus.

Defined cases: null text scores as empty text; an empty text has no feature but the word border and scores like
any other; labels that are null or have no document do not count, a document with several labels is toxic if
one says so; without both classes in training the score is the smoothed share of toxic rows for all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.worker import sliced, tidy, tidy_group

BITS = 18
LONGEST = 5
FIT_ROWS = 3000
#: rows whose features are handled at once in fitting
FIT_PART = 250
THRESHOLD = 0.7
#: Length of a document's vector, weight of the squared norm, steps of the optimiser.
SCALE, RIDGE, STEPS = 5.0, 3e-5, 60


def features(text: str) -> np.ndarray:
    """Sorted places of the distinct n-grams of a whole text."""
    data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    seen, rolling = np.zeros(1 << BITS, bool), data
    for n in range(2, LONGEST + 1):
        if len(data) < n:
            break
        rolling = rolling[:-1] * np.uint32(0x01000193) + data[n - 1:] + np.uint32(n)
        seen[(rolling * np.uint32(2654435761)) >> np.uint32(32 - BITS)] = True
    return np.flatnonzero(seen).astype(np.int32)


@dataclass
class Model:
    """Weights already multiplied by the ratios; ``ratios`` give a document's length."""
    weights: np.ndarray
    ratios: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        places = features(text)
        length = float(np.sqrt(np.square(self.ratios[places]).sum())) + 1e-9
        z = SCALE * float(self.weights[places].sum()) / length + self.bias
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -60.0, 60.0))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_weights(rows: list[np.ndarray], toxic: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam over the whole sample in every step."""
    n, share, parts = len(rows), toxic.mean(), []
    for at in range(0, n, FIT_PART):  # arrays of a part of the rows at a time bound the memory
        place, sizes = np.concatenate(rows[at:at + FIT_PART]), [len(r) for r in rows[at:at + FIT_PART]]
        row, value = np.repeat(np.arange(len(sizes)), sizes), ratios[place]
        value = SCALE * value / (np.sqrt(np.bincount(row, value * value, len(sizes))) + 1e-9)[row]
        parts.append((place, sizes, value.astype(np.float32), toxic[at:at + FIT_PART]))
    theta = np.append(np.zeros(1 << BITS), np.log(share / (1 - share)))
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        slope = np.append(RIDGE * theta[:-1], 0.0)
        for place, sizes, value, marks in parts:
            row = np.repeat(np.arange(len(sizes)), sizes)
            z = np.bincount(row, theta[place] * value, len(sizes)) + theta[-1]
            error = (1.0 / (1.0 + np.exp(-np.clip(z, -60.0, 60.0))) - marks) / n
            slope[:-1] += np.bincount(place, value * error[row], 1 << BITS)
            slope[-1] += error.sum()
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope * slope
        theta -= 0.1 * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    return theta[:-1] * ratios, float(theta[-1])


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple:
    """``(docs, marks)`` of the training part: ids and texts, and one mark for each labelled id."""
    marks = (labels.where(F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
             .groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic")))
    texts = docs.where(~held_out(F.col(id_col))).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts, marks


def count_ratios(texts: DataFrame, marks: DataFrame) -> tuple[np.ndarray, int, int]:
    """Log-count ratios over all labelled rows, and the numbers of toxic and other rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, (1 << BITS) + 1), np.int64)
        for batch in sliced(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[toxic, features(text or "")] += 1
                found[toxic, -1] += 1
        places = np.flatnonzero(found.any(axis=0)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(found[1, places]), pa.array(found[0, places])],
                                         names=["place", "toxic", "other"])

    joined = texts.join(marks, "id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    sums = (joined.mapInArrow(tidy(count), "place int, toxic long, other long").groupBy("place")
            .agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).toPandas())
    counts = np.zeros((2, (1 << BITS) + 1))
    counts[1, sums["place"]], counts[0, sums["place"]] = sums["toxic"], sums["other"]
    (other, toxic), counts = counts[:, -1], counts[:, :-1]
    ratios = np.log((counts[1] + 1) / (toxic + 2)) - np.log((counts[0] + 1) / (other + 2))
    return ratios, int(toxic), int(other)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    texts, marks = labelled(docs, labels, id_col, text_col, label_col)
    ratios, toxic, other = count_ratios(texts, marks)
    if not toxic or not other:
        return Model(np.zeros(1 << BITS), ratios, float(np.log((toxic + 1) / (other + 1))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            places = [features(t or "").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.binary()), batch.column(2)],
                                             names=["id", "places", "toxic"])

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", ignore_index=True)
        mark = (group["toxic"] > 0).to_numpy().astype(float)
        if mark.min() == mark.max():
            weights, bias = np.zeros(1 << BITS), float(np.log((toxic + 1) / (other + 1)))
        else:
            weights, bias = fit_weights([np.frombuffer(x, np.int32) for x in group["places"]], mark, ratios)
        return pd.DataFrame({"weights": [weights.tobytes()], "bias": [bias]})

    known = marks.join(texts.select("id"), "id", "left_semi")
    sample = known.orderBy(F.xxhash64("id"), "id").limit(fit_rows)  # proven size: fit_rows rows of an id and a mark
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = (texts.join(F.broadcast(sample), "id").select("id", "text", "toxic")
            .mapInArrow(tidy(read), f"id {id_type}, places binary, toxic int")
            .groupBy("id").agg(F.min("places").alias("places"), F.max("toxic").alias("toxic")))
    found = rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(
        tidy_group(train), "weights binary, bias double").first()
    return Model(np.frombuffer(found["weights"], float), ratios, found["bias"])


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``score`` between 0 and 1 at the end (in place of one of that name)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = [c for c in docs.columns if c != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            scores = [shared.value.score(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())],
                                             names=["_doc", "score"])

    packed = docs.select(F.struct(*own).alias("_doc"), F.col(text_col).alias("_text"))
    schema = f"_doc {packed.schema['_doc'].dataType.simpleString()}, score double"
    return packed.mapInArrow(tidy(run), schema).select(*[F.col("_doc")[c].alias(c) for c in own], "score")
