"""Suffix-array dedup: remove every byte covered by a string of ``length`` bytes that starts earlier elsewhere.

"Earlier" means in a document with a smaller id, or in the same document further left. Strings are judged on
the input, overlaps count, and no match crosses documents.

Every string of ``length`` bytes contains one chosen gram: of its grams of ``GRAM`` bytes the one with the
smallest hash, leftmost among equals. Equal strings choose equal grams, so only strings with the same gram (the
anchor) need to be compared. The strings of a document that choose the same occurrence of a gram are
consecutive; together they cover a *stretch* of at most 2 * length - GRAM bytes. Stretches go through:

1. anchors that occur once are dropped: counts are combined map-side, the join back is a plain shuffled join;
2. equal stretches of an anchor are one class (128 bits of hash): all but its first occurrence are removed whole,
   and only the first goes on;
3. anchors with very many classes become longer (``narrowed``): a class's strings are halved by the place that the
   anchor has in them, and the strings of a half have more bytes about it in common, up to the whole string. Step 2
   follows for the halves, until no anchor has very many classes;
4. anchors with several classes: the classes' bytes meet in blocks of bounded size. Each block's suffix array is
   made by two-stage sorting; adjacent suffixes with a common prefix of ``length`` bytes are equal strings, and
   all but the earliest are removed.

Texts are shuffled once, with the stretches found in them; those with classes to compare are staged until the
blocks are done. Memory is bounded by the longest document and by the block size.

Defined cases: null text is empty text; texts shorter than ``length`` lose nothing; rows that repeat an id with
the same text are one document and get the same result; rows that repeat an id with different texts count as
documents of their own, ordered by a hash of the text; rows with a null id take no part and stay whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import staged, text_or_empty
from runlens.llm.suffix_array import common_prefixes, suffix_array, words_at
from runlens.llm.worker import tidy, tidy_group

LENGTH = 100
GRAM = 24
#: string starts handled at once in a document: bounds memory and keeps places below the bits of a hash
CHUNK = 1 << 18
#: classes from which on an anchor is made longer, and stretches of a block altogether (about 140 bytes each)
SPLIT, BLOCK = 2048, 8192
LENGTH_BITS = 10

_draw = np.random.default_rng(77)
VALUES = _draw.integers(1, 2**64, (2, 256), dtype=np.uint64, endpoint=False)
BASE = np.uint64(0xD1342543DE82EF95)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        n = max(n, 65_536)
        for name, base in (("up", BASE), ("down", INVERSE)):
            _powers[name] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base)]))
    return _powers["up"], _powers["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RangeHash:
    """64-bit hashes of any ranges of a byte string, from sums of its bytes' values times powers."""

    def __init__(self, data: np.ndarray, table: int = 0):
        self.up, down = powers(len(data) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(VALUES[table][data] * down[:len(data)],
                                                                      dtype=np.uint64)])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.up[start] + (stop - start).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.up[:n] + np.uint64(size))


def ranked(grams: np.ndarray) -> np.ndarray:
    """Numbers that order a document's grams by hash, equal ones from left to right; the low bits are the place."""
    return (grams & np.uint64(~0xFFFFFF & (2**64 - 1))) | np.arange(len(grams), dtype=np.uint64)


def stretches(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """``(anchor, content hash, first start, number of starts)`` of a document's stretches."""
    found = []
    starts_left, at = len(data) - length + 1, 0
    while starts_left > 0:
        starts = min(starts_left, CHUNK)
        part = data[at:at + starts + length - 1]
        hashes = RangeHash(part)
        grams = hashes.grams(GRAM)
        window = length - GRAM + 1
        smallest = ranked(grams)
        reach = 1
        while 2 * reach <= window:
            smallest = np.minimum(smallest[:-reach], smallest[reach:])
            reach *= 2
        if window > reach:
            smallest = np.minimum(smallest[:len(smallest) - (window - reach)], smallest[window - reach:])
        place = (smallest & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        count = np.diff(np.append(first, starts))
        found.append((grams[place[first]], hashes(first, first + count + (length - 1)), first + at, count))
        at += starts
        starts_left -= starts
    if not found:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found))


def as_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)


def occurrences(texts: DataFrame, keys: list[str], length: int) -> DataFrame:
    """``(keys, anchor, content, at)`` of every stretch; ``at`` packs its first start and number of starts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                found = [stretches(as_bytes(t), length) for t in part.column(len(keys)).to_pylist()]
                row = pa.array(np.repeat(np.arange(len(found)), [len(x[0]) for x in found]))
                anchor, content, first, count = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [part.column(k).take(row) for k in range(len(keys))]
                    + [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)),
                       pa.array((first << LENGTH_BITS) | count)], names=[*keys, "anchor", "content", "at"])

    return texts.select(*keys, "text").mapInArrow(
        tidy(run), f"{types(texts, keys)}, anchor long, content long, at long")


def types(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def places(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, start, starts, place, data)`` of stretches; ``place`` is where their anchor begins."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [int(ranked(RangeHash(np.frombuffer(d, np.uint8)).grams(GRAM)).argmin())
                     for d in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], names=[*batch.schema.names, "place"])

    own = pieces.select(*keys, "start", "starts", "data")
    return own.mapInArrow(tidy(run), f"{types(own, own.columns)}, place int")


def halved(pieces: DataFrame, keys: list[str], length: int) -> DataFrame:
    """``pieces`` cut in two by the place of the anchor in their strings, from ``low`` to ``high``; ``anchor`` is hashed anew.

    All strings of a half have the bytes from ``low`` before the place to ``length - high`` after it.
    """
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    spans = F.when(F.col("low") < F.col("high"), F.array(
        F.struct(F.col("low").alias("low"), middle.alias("high")),
        F.struct((middle + 1).alias("low"), F.col("high").alias("high")))).otherwise(F.array(F.struct("low", "high")))
    cut = pieces.select(*keys, "start", "starts", "place", "data", F.explode(spans).alias("s")).select(
        *keys, "start", "place", "data", "s.*",
        F.greatest(F.lit(0), F.col("place") - F.col("s.high")).alias("first"),
        F.least(F.col("starts") - 1, F.col("place") - F.col("s.low")).alias("last")).where("first <= last")
    half = cut.select(*keys, (F.col("start") + F.col("first")).alias("start"), (F.col("last") - F.col("first") + 1).alias("starts"),
                      (F.col("place") - F.col("first")).alias("place"), "low", "high",
                      F.expr(f"substring(data, first + 1, cast(last - first + {length} AS int))").alias("data"))
    return half.withColumn("anchor", F.expr(
        f"xxhash64(low, high, substring(data, place - low + 1, {length} - (high - low)))"))


def narrowed(hot: DataFrame, keys: list[str], length: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """``hot(keys, start, starts, data)``, classes of anchors that have very many, by longer anchors.

    Gives ``(keys, start, data, anchor)`` of those to compare, and ``(keys, start, starts)`` of removed starts.
    """
    compared, lost = [], []
    width = length - GRAM + 1  # places of an anchor in a string
    hot = places(hot, keys).withColumns({"low": F.lit(0), "high": F.lit(width - 1)})
    while width > 1:
        width = -(-width // 2)
        halves = staged(halved(hot, keys, length), "halves")
        here = F.struct(*keys, "start")
        rest = F.struct(*keys, "start", "starts", "place", "low", "high")
        classes = staged(halves.groupBy("anchor", "data").agg(F.min(rest).alias("first"), F.count("*").alias("n")), "classes")
        first = classes.where("n > 1").select("anchor", "data", F.struct(*[f"first.{c}" for c in [*keys, "start"]]).alias("first"))
        lost.append(halves.join(first, ["anchor", "data"]).where(here != F.col("first")).select(*keys, "start", "starts"))
        many = classes.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
        left = staged(classes.select("anchor", "data", "first.*").join(many, "anchor"), "narrowed")
        few = F.col("n") <= SPLIT if width > 1 else F.lit(True)
        compared.append(left.where(few).select(*keys, "start", "data", "anchor"))
        hot = left.where(~few)
        if hot.isEmpty():
            break
    return compared, lost


def block_repeats(group: pd.DataFrame, keys: list[str], length: int) -> pd.DataFrame:
    """Removed starts of one block's stretches."""
    group = group.sort_values([*keys, "start"], ignore_index=True)  # rows in the order of "earlier"
    sizes = group["data"].map(len).to_numpy()
    data = np.frombuffer(b"".join(group["data"]), np.uint8)
    offset = np.cumsum(sizes) - sizes
    words = words_at(data)
    order = suffix_array(data, length, words)
    row = np.repeat(np.arange(len(group)), sizes)
    inside = np.arange(len(data)) - offset[row]
    order = order[inside[order] + length <= sizes[row[order]]]  # suffixes with a whole string in their stretch
    same = common_prefixes(words, order[:-1], order[1:], length) >= length
    run = np.concatenate([[0], np.cumsum(~same)])
    start = group["start"].to_numpy()[row] + inside
    # of equal strings the earliest: by document, then by start (rows of a document may overlap)
    document = group.groupby(keys, sort=False).ngroup().to_numpy()[row]
    by = np.lexsort((start[order], document[order], run))
    order, run = order[by], run[by]
    earliest = np.concatenate([[True], run[1:] != run[:-1]])
    # the same string of the same document may be in two rows of a block; it is no copy of itself
    lead = order[np.maximum.accumulate(np.where(earliest, np.arange(len(order)), 0))]
    earliest |= (document[order] == document[lead]) & (start[order] == start[lead])
    lost = np.sort(order[~earliest])
    cut = np.concatenate([[True], (lost[1:] != lost[:-1] + 1) | (row[lost[1:]] != row[lost[:-1]])]) \
        if len(lost) else np.empty(0, bool)
    first = lost[cut]
    count = np.diff(np.append(np.flatnonzero(cut), len(lost)))
    out = {k: group[k].to_numpy()[row[first]] for k in keys}
    return pd.DataFrame(out | {"start": start[first], "starts": count})


def spans_of(starts: list[int], counts: list[int], length: int) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes for runs of removed string starts."""
    spans: list[list[int]] = []
    for start, count in sorted(zip(starts, counts)):
        stop = start + count - 1 + length
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], stop)
        else:
            spans.append([start, stop])
    return [tuple(s) for s in spans]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   whole_chars: bool = False) -> DataFrame:
    """``docs`` without its text, with ``n_bytes, n_removed, n_spans, kept`` at the end (in place of such columns).

    ``kept`` is binary, the bytes that stay. With ``whole_chars`` a character of which a byte stays, stays whole,
    so that ``kept`` is UTF-8.
    """
    if not GRAM < length <= 1 << (LENGTH_BITS - 1):
        raise ValueError(f"length must be above {GRAM} and at most {1 << (LENGTH_BITS - 1)}")
    own = [c for c in docs.columns if c not in (text_col, "n_bytes", "n_removed", "n_spans", "kept")]
    carried = F.struct(*own).alias("row")
    text = text_or_empty(F.col(text_col)).alias("text")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text, carried)
    repeated = rows.where("id IS NOT NULL").groupBy("id").agg(F.min("h").alias("a"), F.max("h").alias("b"),
                                                             F.count("*").alias("n"))
    keys = ["id"] if repeated.where("a <> b").isEmpty() else ["id", "h"]
    # rows that repeat a document are read once
    texts = rows.where(F.col("id").isNotNull() & (F.octet_length("text") >= length)).select(*keys, "text")
    again = staged(repeated.where("n > 1").select("id"), "repeated")
    if not again.isEmpty():
        once = texts.join(again, "id").groupBy(*keys).agg(F.first("text").alias("text"))
        texts = texts.join(again, "id", "left_anti").select(*keys, "text").union(once)
    found = occurrences(texts, keys, length)

    # staged, so that both sides of the join are plain shuffles, whose large partitions Spark splits
    several = staged(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "several")
    shared = staged(found.join(several, "anchor"), "stretches")
    here = F.struct(*keys, "at")
    classes = staged(shared.groupBy("anchor", "content").agg(F.min(here).alias("first"), F.count("*").alias("n")),
                     "classes")
    copies = (shared.join(classes.where("n > 1").select("anchor", "content", "first"), ["anchor", "content"])
              .where(here != F.col("first")).select(*keys, "at", F.lit(None).cast("long").alias("anchor"),
                                                    F.lit(None).cast("long").alias("n")))
    many = classes.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    compared = classes.select("anchor", "first.*").join(many, "anchor").select(*keys, "at", "anchor", "n")
    marks = copies.union(compared).groupBy(*keys).agg(F.collect_list(F.struct("at", "anchor", "n")).alias("marks"))
    joined = rows.join(marks, keys, "left")

    half = staged(cut_rows(joined, keys, length, whole_chars), "texts")
    low = F.lit((1 << LENGTH_BITS) - 1)
    pieces = half.select(*keys, F.explode("pieces").alias("p")).select(
        *keys, F.shiftright("p.at", LENGTH_BITS).alias("start"), F.col("p.at").bitwiseAND(low).alias("starts"), "p.anchor", "p.n", "p.data")
    once = [*keys, "start"]
    total, very = half.select(F.sum(F.size("pieces")), F.sum(F.size(F.filter("pieces", lambda p: p["n"] > SPLIT)))).first()
    plain = pieces.where(F.col("n") <= SPLIT).dropDuplicates(once).select(*keys, "start", "data", "anchor")
    lost = []
    if very:
        longer, lost = narrowed(pieces.where(F.col("n") > SPLIT).dropDuplicates(once), keys, length)
        total += sum(x.count() for x in longer) - very
        for x in longer:
            plain = plain.union(x)
    blocks = max(1, -(-(total or 0) // BLOCK))
    dealt = plain.select(*keys, "start", "data", F.pmod(F.xxhash64("anchor"), F.lit(blocks)).alias("block"))
    result = staged(dealt.groupBy("block").applyInPandas(
        tidy_group(lambda group: block_repeats(group, keys, length)), f"{types(rows, keys)}, start long, starts long"), "repeats")
    for x in lost:
        result = result.union(x)
    removed = result.groupBy(*keys).agg(F.collect_list(F.struct("start", "starts")).alias("more"))

    done = half.where("size(pieces) = 0").select("row", "n_bytes", "n_removed", "n_spans", "kept")
    open_ = half.where("size(pieces) > 0").select(*keys, "row", "text", "gone").join(removed, keys, "left")
    rest = cut_again(open_, length, whole_chars)
    return done.union(rest).select(*[F.col("row")[c].alias(c) for c in own], "n_bytes", "n_removed", "n_spans", "kept")


RESULT = "n_bytes long, n_removed long, n_spans long, kept binary"
RUNS = "array<struct<start:long,starts:long>>"


def outcome(data: bytes, spans: list[tuple[int, int]], whole_chars: bool) -> tuple[int, int, int, bytes]:
    kept, at = [], 0
    if whole_chars:  # bytes 10xxxxxx go on with a character
        inner = []
        for start, stop in spans:
            while start < stop and data[start] & 0xC0 == 0x80:
                start += 1
            while start < stop < len(data) and data[stop] & 0xC0 == 0x80:
                stop -= 1
            if start < stop:
                inner.append((start, stop))
        spans = inner
    for start, stop in spans:
        kept.append(data[at:start])
        at = stop
    kept.append(data[at:])
    return len(data), sum(b - a for a, b in spans), len(spans), b"".join(kept)


def carried_type(df: DataFrame) -> str:
    return f"row {df.schema['row'].dataType.simpleString()}"


def cut_rows(joined: DataFrame, keys: list[str], length: int, whole_chars: bool) -> DataFrame:
    """Results of texts without stretches to compare; of the others, text, removed runs and stretches' bytes."""
    piece = "struct<at:long,anchor:long,n:long,data:binary>"
    schema = (f"{types(joined, keys)}, {carried_type(joined)}, {RESULT}, text binary, gone {RUNS}, "
              f"pieces array<{piece}>")
    low = (1 << LENGTH_BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns: list[list] = [[] for _ in range(7)]
                for text, marks in zip(part.column("text").to_pylist(), part.column("marks").to_pylist()):
                    data = text.encode("utf-8", "replace")
                    marks = marks or []
                    gone = [(m["at"] >> LENGTH_BITS, m["at"] & low) for m in marks if m["anchor"] is None]
                    pieces = [{**m, "data": data[(s := m["at"] >> LENGTH_BITS):s + (m["at"] & low) + length - 1]}
                              for m in marks if m["anchor"] is not None]
                    spans = spans_of([g[0] for g in gone], [g[1] for g in gone], length)
                    row = outcome(data, spans, whole_chars) if not pieces else (None,) * 4
                    gone = [{"start": a, "starts": b - a - length + 1} for a, b in spans]
                    for column, value in zip(columns, (*row, data if pieces else None, gone, pieces)):
                        column.append(value)
                kinds = [pa.int64()] * 3 + [pa.binary()] * 2 + [
                    pa.list_(pa.struct([("start", pa.int64()), ("starts", pa.int64())])),
                    pa.list_(pa.struct([("at", pa.int64()), ("anchor", pa.int64()), ("n", pa.int64()),
                                        ("data", pa.binary())]))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(k) for k in keys] + [part.column("row")]
                    + [pa.array(c, t) for c, t in zip(columns, kinds)],
                    names=[*keys, "row", "n_bytes", "n_removed", "n_spans", "kept", "text", "gone", "pieces"])

    return joined.select(*keys, "row", "text", "marks").mapInArrow(tidy(run), schema)


def cut_again(open_: DataFrame, length: int, whole_chars: bool) -> DataFrame:
    """Results of the texts whose stretches were compared."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, gone, more in zip(*(batch.column(c).to_pylist() for c in ("text", "gone", "more"))):
                runs = gone + (more or [])
                spans = spans_of([r["start"] for r in runs], [r["starts"] for r in runs], length)
                rows.append(outcome(data, spans, whole_chars))
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("row")] + [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.binary()])],
                names=["row", "n_bytes", "n_removed", "n_spans", "kept"])

    return open_.select("row", "text", "gone", "more").mapInArrow(
        tidy(run), f"{carried_type(open_)}, {RESULT}")


__all__ = ["block_repeats", "remove_repeats", "spans_of", "stretches"]
