"""Conversation prefix trie: double-array tries over sorted shards, whose shared upper nodes are merged globally.

1. Turns become digests; texts never leave the scan. Rows are numbered within their conversation over a range
   partitioning by (conversation, turn), so that a conversation of very many turns lies in many tasks.
2. Turn sequences are cut into segments of at most SEGMENT turns. A prefix is named by its depth and 128 bits that
   combine the digests of its turns by position, so a segment knows the node below which it hangs.
3. Segments are range-partitioned in the lexicographic order of (depth, node, turns) and read in shards of bounded
   size. In a shard, turns get dense ids and a double-array trie is packed (BASE and CHECK: the child of s by id c
   is t = BASE[s] + c if CHECK[t] = s), traversed with all paths at once for its nodes, and summed up from its leaves.
4. In that order a node is shared with other shards only if it lies on the first or the last path of a shard; such
   upper nodes, and those that a later segment continues, are merged globally. Sums over their subtrees are made
   by pointer doubling, in as many passes as the logarithm of the depth. All other nodes are whole where they are.
5. Ids of the conversations that end at a node are sorted by range partitioning, joined to texts of bounded length,
   and hashed as a stream by one task for each node; a node with a single end needs none of this.

Defined cases: rows with a null conversation id take no part; turns of the same number come in the order of role, then
of the MD5 of their text; a row that repeats is a turn of its own; null role or text is empty; an empty table has no nodes.
``%`` is the remainder with the sign of the dividend.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import staged
from runlens.llm.worker import tidy

#: turns of a segment; turns of a shard; shards' turns of a task; ends in one text
SEGMENT, SHARD_TURNS, TASK_TURNS, ENDS = 512, 100_000, 1_000_000, 4096
EMPTY = hashlib.sha256(b"").hexdigest()
KEY = ["depth", "x", "y"]


def turns_of(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``(conv_id, turn, role, tie, x, y, chars)``: a row for each turn, without its text."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    return (rows.where(F.col(conv_col).isNotNull())
            .select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"),
                    F.md5(text).alias("tie"), F.char_length(text).cast("long").alias("chars"))
            .select("*", F.xxhash64("role", "tie").alias("x"), F.xxhash64("tie", F.lit(7), "role").alias("y")))


def numbered(turns: DataFrame, tasks: int) -> DataFrame:
    """``(conv_id, at, x, y, chars)``: ``at`` counts a conversation's turns from 1.

    A task numbers the rows that it has; the first run of a task goes on from what the tasks before it had of the
    same conversation, a table of two rows for each task at most.
    """
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "tie"]
    dealt = turns.repartitionByRange(tasks, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for batch in batches:
            conv = batch.column(0).to_numpy()
            if not len(conv):
                continue
            starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            at = np.arange(len(conv)) - np.repeat(starts, np.diff(np.append(starts, len(conv)))) + 1
            if conv[0] == last:
                at[:starts[1] if len(starts) > 1 else len(at)] += count
            last, count = conv[-1], int(at[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(at)],
                                             names=["conv_id", "x", "y", "chars", "at"])

    rows = staged(dealt.select("conv_id", "x", "y", "chars").mapInArrow(
        tidy(run), "conv_id long, x long, y long, chars long, at long").withColumn("task", F.spark_partition_id()),
        "numbered")
    runs = rows.groupBy("conv_id", "task").agg(F.max("at").alias("n"))
    split = staged(runs.groupBy("conv_id").agg(F.count("*").alias("tasks")).where("tasks > 1").select("conv_id"), "split")
    if split.isEmpty():
        return rows.drop("task")
    before = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged(runs.join(split, "conv_id").select("conv_id", "task", F.coalesce(F.sum("n").over(before), F.lit(0))
                                                         .alias("offset")), "offsets")
    return staged(rows.join(offsets, ["conv_id", "task"], "left")
                  .select("conv_id", "x", "y", "chars", (F.col("at") + F.coalesce("offset", F.lit(0))).alias("at")),
                  "turns-numbered")


def rebuilt(turns: DataFrame, shared_turns: Column, block: int) -> tuple[DataFrame, DataFrame]:
    """Conversations ``(conv_id, own, head)`` and their rebuilt turns ``(conv_id, at, x, y, chars)``.

    ``shared_turns`` says, of ``conv_id``, how many turns come from the first conversation of its block.
    """
    convs = staged(turns.groupBy("conv_id").agg(F.max("at").alias("n"))
                   .withColumn("h", shared_turns.cast("long")), "conversations")
    most = convs.agg(F.coalesce(F.max("h"), F.lit(0))).first()[0]
    heads = (turns.where((F.col("conv_id") % block == 0) & (F.col("at") <= most)).groupBy("conv_id")
             .agg(F.sort_array(F.collect_list(F.struct("at", "x", "y", "chars"))).alias("turns"))
             .select(F.col("conv_id").alias("base"), "turns"))
    none = F.array().cast("array<struct<at:bigint,x:bigint,y:bigint,chars:bigint>>")
    known = staged(convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % block).join(heads, "base", "left")
                   .select("conv_id", "n", "h", F.slice(F.coalesce("turns", none), F.lit(1), F.col("h").cast("int"))
                           .alias("head")), "heads")
    own = (turns.join(known.select("conv_id", "h", F.size("head").alias("n_head")), "conv_id").where("at > h")
           .select("conv_id", (F.col("at") - F.col("h") + F.col("n_head")).alias("at"), "x", "y", "chars"))
    return known, known.select("conv_id", F.inline("head")).select("conv_id", "at", "x", "y", "chars").union(own)


def segments(turns: DataFrame, segment: int) -> DataFrame:
    """``(conv_id, segment, x, y, path, chars, more)``: the node above a segment, and its turns.

    ``path`` alternates the two numbers of each turn's digest; ``more`` says that a segment follows.
    """
    cut = (turns.groupBy("conv_id", F.floor((F.col("at") - 1) / segment).alias("segment"))
           .agg(F.sort_array(F.collect_list(F.struct("at", "x", "y", "chars"))).alias("t"),
                F.bit_xor(F.xxhash64("at", "x", "y")).alias("x"), F.bit_xor(F.xxhash64("y", "at", "x")).alias("y")))
    # a conversation's segments meet here, a row for as many turns as a segment has
    by_conv = Window.partitionBy("conv_id").orderBy("segment")
    above = by_conv.rowsBetween(Window.unboundedPreceding, -1)
    flat = F.flatten(F.transform("t", lambda t: F.array(t["x"], t["y"])))
    return cut.select("conv_id", "segment", F.coalesce(F.bit_xor("x").over(above), F.lit(0)).alias("x"),
                      F.coalesce(F.bit_xor("y").over(above), F.lit(0)).alias("y"), flat.alias("path"),
                      F.transform("t", lambda t: t["chars"]).alias("chars"),
                      F.lead(F.lit(True), 1, False).over(by_conv).alias("more"),
                      F.transform("t", lambda t: F.xxhash64(t["at"], t["x"], t["y"])).alias("xs"),
                      F.transform("t", lambda t: F.xxhash64(t["y"], t["at"], t["x"])).alias("ys"))


class DoubleArray:
    """A trie over paths of dense ids, packed into BASE and CHECK; state 0 is the root."""

    def __init__(self):
        self.base, self.check = np.zeros(64, np.int64), np.full(64, -1, np.int64)
        self.check[0], self.low, self.end = 0, 1, 1  # all states below low are taken, all from end on are free

    def _room(self, upto: int) -> None:
        if upto >= len(self.check):
            more = max(len(self.check), upto + 1 - len(self.check))
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def add_level(self, parents: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """States of the new children; both arrays are distinct pairs, sorted by parent, then id."""
        states = np.empty(len(ids), np.int64)
        starts = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
        counts = np.diff(np.append(starts, len(parents)))
        for start, count in zip(starts[counts > 1].tolist(), counts[counts > 1].tolist()):
            offsets = ids[start:start + count] - ids[start]
            states[start:start + count] = self._fit(offsets) + offsets
            self._take(states[start:start + count], parents[start:start + count])
        single = starts[counts == 1]
        if len(single):
            self._room(self.end + len(single))
            free = np.flatnonzero(self.check[self.low:self.end + len(single)] < 0)[:len(single)] + self.low
            states[single] = free
            self._take(free, parents[single])
        self.base[parents] = states - ids
        return states

    def _fit(self, offsets: np.ndarray) -> int:
        """The first place among the free ones at which all offsets are free, or the end."""
        for place in (np.flatnonzero(self.check[self.low:self.end] < 0)[:64] + self.low).tolist():
            self._room(place + int(offsets[-1]))
            if (self.check[place + offsets] < 0).all():
                return place
        self._room(self.end + int(offsets[-1]))
        return self.end

    def _take(self, states: np.ndarray, parents: np.ndarray) -> None:
        self.check[states] = parents
        self.end = max(self.end, int(states.max()) + 1)
        taken = self.check[self.low:self.end + 1] >= 0
        self.low += int(np.argmin(taken)) if not taken.all() else len(taken)

    def step(self, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Where ``ids`` lead from ``states``; -1 where no such path was packed."""
        found = self.base[states] + ids
        inside = (found >= 0) & (found < len(self.check))
        found[~inside] = 0
        return np.where(inside & (self.check[found] == states) & (found > 0), found, -1)


def packed(paths: np.ndarray, lengths: np.ndarray) -> DoubleArray:
    """The trie of ``paths`` (a row each, of dense ids, as long as ``lengths`` says)."""
    trie, at = DoubleArray(), np.zeros(len(paths), np.int64)
    for level in range(paths.shape[1]):
        going = np.flatnonzero(lengths > level)
        span = int(paths[going, level].max()) + 1
        pairs, inverse = np.unique(at[going] * span + paths[going, level], return_inverse=True)
        at[going] = trie.add_level(pairs // span, pairs % span)[inverse]
    return trie


NODE = ("depth long, x long, y long, px long, py long, conv_id long, parent_conv_id long, n_convs long, chars long, "
        "n_ends long, first_end long, children long, leaves long, saved long, upper boolean, under_upper boolean")
NAMES = [part.split()[0] for part in NODE.split(", ")]


def shard_nodes(rows: pd.DataFrame, segment: int) -> pd.DataFrame:
    """The nodes of a shard's trie; ``rows`` are segments in order.

    ``upper`` nodes are parts, to be merged: what other upper nodes have below them is not in their sums.
    """
    lengths = rows["chars"].map(len).to_numpy() + 1
    conv, more = rows["conv_id"].to_numpy(), rows["more"].to_numpy()
    row = np.repeat(np.arange(len(rows)), lengths)
    level = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)

    def laid(tops: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """A value for each state of the paths: the segment's own first, then its turns'."""
        out = np.empty(len(row), np.int64)
        out[level == 0], out[level > 0] = tops, turns
        return out

    tops_x, tops_y = rows["x"].to_numpy(), rows["y"].to_numpy()
    path, chars, xs, ys = (np.concatenate(rows[c].to_list()) for c in ("path", "chars", "xs", "ys"))
    first, second, chars = laid(tops_x, path[0::2]), laid(tops_y, path[1::2]), laid(np.zeros(len(rows)), chars)
    # names of the prefixes: the one above the segment, combined with each turn's
    x, y = laid(tops_x, xs), laid(tops_y, ys)
    for name in (x, y):
        np.bitwise_xor.accumulate(name, out=name)
        starts = np.cumsum(lengths) - lengths
        name ^= np.repeat(np.concatenate([[0], name[starts[1:] - 1]]), lengths)
    # dense ids: the nodes above segments and the turns, in the order of the levels
    symbol = np.zeros(len(row), [("top", bool), ("segment", np.int64), ("a", np.int64), ("b", np.int64)])
    symbol["top"], symbol["a"], symbol["b"] = level == 0, first, second
    symbol["segment"] = np.where(level == 0, rows["segment"].to_numpy()[row], -1)
    _, seen, dense = np.unique(symbol, return_index=True, return_inverse=True)
    by_level = np.empty(len(seen), np.int64)
    by_level[np.lexsort((seen, level[seen]))] = np.arange(len(seen))
    paths = np.zeros((len(rows), int(lengths.max())), np.int64)
    paths[row, level] = by_level[dense]
    trie = packed(paths, lengths)

    # traverse: all paths go down together
    state = np.zeros((len(rows), paths.shape[1] + 1), np.int64)
    for at in range(paths.shape[1]):
        going = np.flatnonzero(lengths > at)
        state[going, at + 1] = trie.step(state[going, at], paths[going, at])
    if (state[row, level + 1] < 1).any():
        raise AssertionError("a packed path is not found again")
    nodes, where, node = np.unique(state[row, level + 1], return_index=True, return_inverse=True)
    parent = np.searchsorted(nodes, state[row, level][where])  # not used at the top
    depth = level[where]
    n = np.bincount(node, minlength=len(nodes))
    least = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(least, node, conv[row])
    last = np.cumsum(lengths) - 1
    ended = node[last[~more]]
    n_ends = np.bincount(ended, minlength=len(nodes))
    first_end = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(first_end, ended, conv[~more])
    upper = depth == 0
    on = np.concatenate([np.flatnonzero((row == 0) | (row == len(rows) - 1)), np.flatnonzero(more[row])])
    upper[node[on]] = True
    children, leaves, saved = (np.zeros(len(nodes), np.int64) for _ in range(3))
    for at in range(int(depth.max()), 0, -1):
        here = np.flatnonzero(depth == at)
        whole = here[~upper[here]]
        leaves[whole] += children[whole] == 0
        saved[whole] += (n[whole] - 1) * chars[where[whole]]
        np.add.at(children, parent[whole], 1)
        np.add.at(leaves, parent[whole], leaves[whole])
        np.add.at(saved, parent[whole], saved[whole])
    top = depth == 0
    deep = rows["segment"].to_numpy()[row[where]] * segment + depth
    under = ~top & upper[parent] & ~upper
    return pd.DataFrame({
        "depth": deep, "x": x[where], "y": y[where], "px": np.where(top, 0, x[where[parent % len(nodes)]]),
        "py": np.where(top, 0, y[where[parent % len(nodes)]]),
        "conv_id": nulled(least, top),
        "parent_conv_id": nulled(least[parent % len(nodes)], top | upper[parent % len(nodes)]),
        "n_convs": np.where(top, 0, n), "chars": chars[where], "n_ends": n_ends,
        "first_end": nulled(first_end, n_ends == 0), "children": children, "leaves": leaves, "saved": saved,
        "upper": upper, "under_upper": under})[NAMES]


def nulled(values: np.ndarray, absent: np.ndarray) -> pd.api.extensions.ExtensionArray:
    return pd.arrays.IntegerArray(values.astype(np.int64), absent.copy())


def trie_nodes(cut: DataFrame, turns: int, shard_turns: int, segment: int) -> DataFrame:
    """The nodes of all shards; those of ``upper`` are parts."""
    order = ["segment", "x", "y", "path", "conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_pandas(shard_nodes(pd.concat(waiting, ignore_index=True), segment),
                                              schema=SCHEMA, preserve_index=False)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256).to_pandas()
                waiting.append(rows)
                held += int(rows["chars"].map(len).sum())
                if held >= shard_turns:
                    yield made()
                    waiting, held = [], 0
        if waiting:
            yield made()

    tasks = 1 + turns // TASK_TURNS
    tasks = max(tasks, min(cut.sparkSession.sparkContext.defaultParallelism, 1 + turns // 2000))
    return cut.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(tidy(run), NODE)


SCHEMA = pa.schema([(part.split()[0], pa.bool_() if part.endswith("boolean") else pa.int64()) for part in NODE.split(", ")])


def below(nodes: DataFrame) -> DataFrame:
    """``(depth, x, y, leaves, saved)`` of whole subtrees, from every node's own share, by pointer doubling.

    After pass r a node has the sum of all nodes less than 2 ** r below it, and points 2 ** r up.
    """
    own = staged(nodes.select(*KEY, F.when(F.col("depth") > 0, F.struct((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"),
                                                    F.col("py").alias("y"))).alias("up"), "leaves", "saved"), "doubling")
    while not own.where("up IS NOT NULL").isEmpty():
        sent = (own.where("up IS NOT NULL").groupBy("up").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
                .select("up.*", "l", "s"))
        onward = own.select(*[F.col(c).alias(f"u{c}") for c in KEY], F.col("up").alias("next"))
        met = (F.col("up.depth") == F.col("udepth")) & (F.col("up.x") == F.col("ux")) & (F.col("up.y") == F.col("uy"))
        own = staged(own.join(onward, met, "left").join(sent, KEY, "left")
                     .select(*KEY, F.col("next").alias("up"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"),
                             (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "doubling")
    return own.drop("up")


def merged_upper(parts: DataFrame, convs: DataFrame) -> DataFrame:
    """Upper nodes with whole sums, the root among them: its members are all conversations."""
    ended = (F.col("n") <= F.col("h")) & (F.size("head") == 0)
    root = convs.groupBy().agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"),
                               F.count_if(ended).alias("n_ends"),
                               F.min(F.when(ended, F.col("conv_id"))).alias("first_end")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    filled = {"n_convs", "conv_id", "n_ends", "first_end"}
    root = root.select(*[F.col(c) if c in filled else zero.alias(c) for c in NAMES[:-2] if c != "parent_conv_id"])
    both = parts.select(*root.columns).union(root)
    sums = {c: F.sum(c) for c in ("n_convs", "n_ends", "children", "leaves", "saved")}
    sums |= {c: F.min(c) for c in ("conv_id", "first_end")} | {"chars": F.max("chars")}
    # the part that a segment hangs below has no parent of its own
    named = {c: F.max_by(c, F.col("n_convs")) for c in ("px", "py")}
    nodes = staged(both.groupBy(*KEY).agg(*[a.alias(c) for c, a in (sums | named).items()]), "upper")
    ups = (nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y"))
           .agg(F.count("*").alias("more")))
    nodes = staged(nodes.join(ups, KEY, "left").withColumn("children", F.col("children") + F.coalesce("more", F.lit(0)))
                   .drop("more"), "upper-children")
    # nodes of one conversation are a chain with one leaf: what lies above them needs no more than that
    alone = (F.col("n_convs") == 1) & (F.col("depth") > 0)
    chain = nodes.where(alone).withColumn("leaves", F.lit(1).cast("long")).withColumn("saved", zero)
    shared = nodes.where(~alone)
    hung = (chain.groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y"))
            .agg(F.count("*").alias("tails")))
    own = shared.join(hung, KEY, "left").withColumn(
        "leaves", F.col("leaves") + F.coalesce("tails", zero) + F.when(F.col("children") == 0, 1).otherwise(0)).withColumn(
        "saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("chars"))
    whole = shared.drop("leaves", "saved").join(below(own), KEY)
    nodes = staged(whole.unionByName(chain), "upper-whole")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"),
                         F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(above, ["depth", "px", "py"], "left")


def ends_hash(ends: DataFrame, total: int) -> DataFrame:
    """``(depth, x, y, ends_sha256)`` of the nodes of ``ends(depth, x, y, conv_id)``."""
    order = [*KEY, "conv_id"]

    def runs(keys: list[np.ndarray]) -> list[int]:
        """Where rows of another node begin, and the end."""
        new = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        return [0, *(np.flatnonzero(new) + 1).tolist(), len(keys[0])]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ENDS):
                part = batch.slice(at, ENDS)
                cuts = runs([c.to_numpy() for c in part.columns[:3]])
                ids = part.column(3).to_pylist()
                texts = [",".join(map(str, ids[a:b])) for a, b in zip(cuts, cuts[1:])]
                firsts = pa.array(cuts[:-1])
                yield pa.RecordBatch.from_arrays([*(c.take(firsts) for c in part.columns), pa.array(texts)],
                                                 names=[*order, "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []
        for batch in batches:
            for *own, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if own != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield out(done)
                done = []
        if key is not None:
            yield out([(*key, state.hexdigest())])

    def out(done: list[tuple]) -> pa.RecordBatch:
        *key, digests = zip(*done)
        return pa.RecordBatch.from_arrays([*(pa.array(k, pa.int64()) for k in key), pa.array(digests)],
                                          names=[*KEY, "ends_sha256"])

    dealt = ends.repartitionByRange(1 + total // (64 * ENDS), *order).sortWithinPartitions(*order).select(*order)
    texts = staged(dealt.mapInArrow(tidy(join), "depth long, x long, y long, conv_id long, ids string"), "ends")
    return texts.repartition(*KEY).sortWithinPartitions(*order).mapInArrow(
        tidy(hashed), "depth long, x long, y long, ends_sha256 string")


def prefix_trie(rows: DataFrame, shared_turns: Callable[[Column], Column], block: int = 100, conv_col: str = "conv_id",
                turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                shard_turns: int = SHARD_TURNS, segment: int = SEGMENT) -> DataFrame:
    """A row for each distinct prefix of the rebuilt conversations.

    A conversation is rebuilt from the first ``shared_turns(conv_id)`` turns of the first one of its ``block`` of
    ids and its own turns after as many. Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` (code points) and ``ends_sha256``.
    """
    turns = staged(turns_of(rows, conv_col, turn_col, role_col, text_col), "turns")
    total = turns.count()
    at_once = turns.sparkSession.sparkContext.defaultParallelism
    numbers = numbered(turns, max(1 + total // TASK_TURNS, min(at_once, 1 + total // 2000)))
    convs, rebuilt_turns = rebuilt(numbers, shared_turns(F.col("conv_id")), block)
    cut = staged(segments(rebuilt_turns, segment), "segments")
    total = cut.agg(F.coalesce(F.sum(F.size("chars")), F.lit(0))).first()[0]
    found = staged(trie_nodes(cut, total, shard_turns, segment), "nodes")
    upper = staged(merged_upper(found.where("upper"), convs), "upper-nodes")
    inner = found.where("NOT upper")
    names = upper.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"),
                         F.col("conv_id").alias("above"))
    whole = [c for c in NAMES if c not in ("upper", "under_upper")]
    under = (inner.where("under_upper").join(names, ["depth", "px", "py"]).withColumn("parent_conv_id", F.col("above"))
             .select(*whole))
    nodes = staged(inner.where("NOT under_upper").select(*whole).union(under).union(upper.select(*whole)), "all-nodes")
    # the turnless end at the root; all others where their last segment does
    lengths = F.size("chars").cast("long")
    last = cut.where("NOT more").select(
        (F.col("segment") * segment + lengths).alias("depth"),
        F.col("x").bitwiseXOR(F.aggregate("xs", F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))).alias("x"),
        F.col("y").bitwiseXOR(F.aggregate("ys", F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))).alias("y"), "conv_id")
    zero = F.lit(0).cast("long")
    none = convs.where("n <= h AND size(head) = 0").select(zero.alias("depth"), zero.alias("x"), zero.alias("y"), "conv_id")
    several = staged(nodes.where("n_ends > 1").select(*KEY), "several-ends")
    ends = staged(last.union(none).join(several, KEY), "ends")
    hashes = staged(ends_hash(ends, ends.count()), "hashes")
    single = nodes.where("n_ends < 2").withColumn(
        "ends_sha256", F.when(F.col("n_ends") == 0, F.lit(EMPTY)).otherwise(F.sha2(F.col("first_end").cast("string"), 256)))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"),
               F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256"]
    return single.select(*columns).union(nodes.where("n_ends > 1").join(hashes, KEY).select(*columns))
