"""From inverted lists to verified links, without a row for each pair.

1. Lists tie nodes to candidate groups. Every entry is tested against its list's centres (``centre_links``); lists
   that still span several groups are met in bounded blocks, and a block's task gives a spanning forest of the
   pairs that pass (``forest_links``): at most one row for each entry that it read.
2. True links lie within groups. A group's sets meet in tasks of bounded blocks, where all intersections of a pair
   of blocks come from products of 0/1 matrices over the elements that at least two sets have; a task gives a
   spanning forest of the links it verified (``verified_links``). Groups of several blocks first meet centres;
   blocks of what then is one component are not met with each other.

Every pair of nodes that could link either meets in a task or is known to be connected, so the components of the
links that come out are those of all links.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import staged
from runlens.llm.components import components
from runlens.llm.worker import tidy_group

#: centres of a list or group; entries of a list expanded in one task
CENTRES, LIST_ROWS = 2, 512
#: sets of a block and their elements together
BLOCK_SETS, BLOCK_GRAMS = 1024, 500_000
#: columns of a 0/1 matrix at a time
COLUMNS = 4096


def centre_links(lists: DataFrame, labels: DataFrame, near: Callable[[str, str], Column]) -> DataFrame:
    """``(a, b)``: each entry of ``lists(key, node)`` with those of its list's centres that pass ``near``.

    ``labels`` has ``node, root, size, bits``; ``near`` gets the names of two struct columns of size and bits.
    """
    marked = lists.join(labels, "node")
    centres = [F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("by"), F.col("node"), F.col("size"),
                              F.col("bits"))) for turn in range(CENTRES)]
    chosen = staged(marked.groupBy("key").agg(*[c.alias(f"c{i}") for i, c in enumerate(centres)])
                    .select("key", F.array_distinct(F.array(*[f"c{i}" for i in range(CENTRES)])).alias("centres")),
                    "chosen")
    return (marked.select("key", "node", F.struct("size", "bits").alias("own")).join(chosen, "key")
            .select("node", "own", F.explode("centres").alias("c"))
            .where((F.col("node") != F.col("c.node")) & near("own", "c"))
            .select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct())


def forest_links(lists: DataFrame, labels: DataFrame, near: Callable[..., np.ndarray]) -> DataFrame:
    """``(a, b)``: spanning forests of the pairs across groups that share a list and pass ``near``.

    ``near`` gets sizes and rows of bits of two equally long selections and tells which pairs pass.
    """
    marked = lists.join(labels, "node")
    open_lists = staged(marked.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"),
                                                  F.count("*").alias("n"))
                        .where("least <> most").select("key", F.ceil(F.col("n") / LIST_ROWS).alias("blocks"), "n"),
                        "open")
    total = open_lists.agg(F.coalesce(F.sum(F.col("n") * F.col("blocks")), F.lit(0))).first()[0]
    tasks = max(1, -(-total // (8 * LIST_ROWS)))
    # an entry meets every block of its list once: in the pair of blocks (own, other), own <= other
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).alias("own")
    met = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("with")
    dealt = (marked.join(open_lists, "key").select("key", "node", "root", "size", "bits", own, met)
             .select("key", "node", "root", "size", "bits", "own", F.least("own", "with").alias("i"),
                     F.greatest("own", "with").alias("j"))
             .withColumn("task", F.pmod(F.xxhash64("key", "i", "j"), F.lit(tasks))))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key", "i", "j", "node"], ignore_index=True)
        size, root, node, own = (group[c].to_numpy() for c in ("size", "root", "node", "own"))
        bits = np.stack(group["bits"].to_list())
        within = group["i"].to_numpy() == group["j"].to_numpy()
        starts = (group[["key", "i", "j"]].diff() != 0).any(axis=1).to_numpy()
        first = np.flatnonzero(starts)
        left_over = np.repeat(np.append(first[1:], len(group)), np.diff(np.append(first, len(group))))
        left_over -= np.arange(len(group))  # rows from each one to the end of its list
        roots, top = np.unique(root, return_inverse=True)
        up, links = np.arange(len(roots)), []
        for step in range(1, int(left_over.max(initial=0))):
            left = np.flatnonzero(left_over > step)
            right = left + step
            # pairs within a block are met in the pair of blocks (i, i)
            open_ = (top[left] != top[right]) & (within[left] | (own[left] != own[right]))
            left, right = left[open_], right[open_]
            passed = near(size[left], bits[left], size[right], bits[right])
            left, right = left[passed], right[passed]
            if not len(left):
                continue
            lower, upper = np.minimum(top[left], top[right]), np.maximum(top[left], top[right])
            _, once = np.unique(lower * len(roots) + upper, return_index=True)
            for a, b, x, y in zip(node[left[once]].tolist(), node[right[once]].tolist(), lower[once].tolist(),
                                  upper[once].tolist()):
                x, y = highest(up, x), highest(up, y)
                if x != y:
                    up[max(x, y)] = min(x, y)
                    links.append((a, b))
            while (up != up[up]).any():
                up = up[up]
            top = up[top]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("task").applyInPandas(tidy_group(run), "a long, b long")


def highest(up: np.ndarray, at: int) -> int:
    while up[at] != at:
        at = up[at]
    return at


def contracted(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels(node, root, ...)`` after joining the groups that ``links(a, b)`` of nodes connect."""
    at = labels.select(F.col("node"), F.col("root"))
    across = (links.join(at.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
              .join(at.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
              .select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    onward = components(across).select(F.col("node").alias("root"), F.col("root").alias("next"))
    rest = [c for c in labels.columns if c != "root"]
    return staged(labels.join(onward, "root", "left").select(*rest, F.coalesce("next", "root").alias("root")), "labels")


def candidate_groups(lists: DataFrame, labels: DataFrame, near_columns: Callable[[str, str], Column],
                     near_rows: Callable[..., np.ndarray]) -> DataFrame:
    """``(node, size, group)`` of the nodes that are candidates with any other."""
    for links in (lambda: centre_links(lists, labels, near_columns), lambda: forest_links(lists, labels, near_rows)):
        found = staged(links(), "candidates")
        if not found.isEmpty():
            labels = contracted(labels, found)
    several = staged(labels.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root"), "groups")
    return staged(labels.join(several, "root").groupBy("node").agg(F.max("size").alias("size"), F.min("root").alias("group")),
                  "grouped")


def intersections(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of all of ``left`` with all of ``right`` (None: with ``left`` itself)."""
    both = left + (right or [])
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    grams = np.concatenate(both) if both else np.empty(0, np.uint64)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    first = np.concatenate([[True], grams[1:] != grams[:-1]]) if len(grams) else np.empty(0, bool)
    column = np.cumsum(first) - 1
    times = np.bincount(column)
    if right is None:
        useful = times > 1
    else:
        on_left = np.bincount(column, weights=owner < len(left), minlength=len(times))
        useful = (on_left > 0) & (on_left < times)
    keep = useful[column] if len(column) else np.empty(0, bool)
    column, owner = (np.cumsum(useful) - 1)[column[keep]], owner[keep]
    found = np.zeros((len(left), len(left if right is None else right)), np.float32)
    cuts = np.searchsorted(column, np.arange(0, int(useful.sum()) + COLUMNS, COLUMNS))
    for at, (low, high) in enumerate(zip(cuts[:-1], cuts[1:])):
        table = np.zeros((len(both), COLUMNS), np.float32)
        table[owner[low:high], column[low:high] - at * COLUMNS] = 1
        found += table[:len(left)] @ (table[:len(left)] if right is None else table[len(left):]).T
    return found.astype(np.int64)


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, least: Fraction) -> np.ndarray:
    """Which of ``left`` have at least the similarity ``least`` to which of ``right``; empty sets to none."""
    shared = intersections(left, right)
    s = np.array([len(x) for x in left])[:, None]
    u = np.array([len(x) for x in (left if right is None else right)])[None, :]
    return (shared > 0) & (shared * least.denominator >= least.numerator * (s + u - shared))


def spanning(nodes: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the symmetric matrix ``near`` connects, breadth first."""
    waiting, links = np.ones(len(nodes), bool), []
    for start in range(len(nodes)):
        if not waiting[start]:
            continue
        waiting[start] = False
        edge = [start]
        while edge:
            at = edge.pop()
            new = np.flatnonzero(near[at] & waiting)
            waiting[new] = False
            links += [(nodes[at], nodes[i]) for i in new]
            edge += new.tolist()
    return links


def pair_links(group: pd.DataFrame, near: Callable[..., np.ndarray]) -> list[tuple[int, int]]:
    """Links of one pair of blocks: rows of block i against those of block j, or all rows where i = j."""
    nodes, first = group["node"].to_numpy(), (group["own"] == group["i"]).to_numpy()
    if (group["i"] == group["j"]).all():
        return spanning(nodes, near(group, None))
    a, b = np.flatnonzero(first), np.flatnonzero(~first)
    across = near(group[first], group[~first])
    both = np.zeros((len(nodes), len(nodes)), bool)
    both[np.ix_(a, b)] = across
    both[np.ix_(b, a)] = across.T
    return spanning(nodes, both)


def met(dealt: DataFrame, data: DataFrame, near: Callable[..., np.ndarray], tasks: int) -> DataFrame:
    """Links found by the pairs of blocks of ``dealt(group, i, j, own, node)``, whose nodes have ``data(node, ...)``.

    ``near`` gets the rows of two blocks (None: the first one itself) and gives a matrix. Tasks hold several pairs.
    """
    def run(task: pd.DataFrame) -> pd.DataFrame:
        links = []
        for _, part in task.groupby(["group", "i", "j"], sort=False):
            links += pair_links(part, near)
        return pd.DataFrame([(a, b) for a, b in links if a != b], columns=["a", "b"], dtype="int64")

    placed = dealt.withColumn("task", F.pmod(F.xxhash64("group", "i", "j"), F.lit(tasks)))
    return data.join(placed, "node").groupBy("task").applyInPandas(tidy_group(run), "a long, b long")


def near_sets(least: Fraction) -> Callable[..., np.ndarray]:
    def near(left: pd.DataFrame, right: pd.DataFrame | None) -> np.ndarray:
        both = [None if x is None else [np.frombuffer(g, np.uint64) for g in x["grams"]] for x in (left, right)]
        return linked(*both, least)
    return near


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A parity sketch as one of fewer words: halves are laid over each other."""
    while len(bits) > words:
        bits = bits[:len(bits) // 2] ^ bits[len(bits) // 2:]
    return bits


def near_sketches(least: Fraction) -> Callable[..., np.ndarray]:
    """Pairs whose sizes and parity sketches, folded to the least number of words, allow a link.

    Only pairs with a row of the lower size class (``low``) count.
    """
    p, q = least.numerator, least.denominator

    def near(left: pd.DataFrame, right: pd.DataFrame | None) -> np.ndarray:
        right = left if right is None else right
        words = min(int(x["bits"].map(len).min()) for x in (left, right))
        a, b = (np.stack([folded(np.asarray(v), words) for v in x["bits"]]).view(np.uint64) for x in (left, right))
        s, u = left["size"].to_numpy()[:, None], right["size"].to_numpy()[None, :]
        passed = (s * q >= u * p) & (u * q >= s * p)
        passed &= left["low"].to_numpy()[:, None] | right["low"].to_numpy()[None, :]
        for i in np.flatnonzero(passed.any(axis=1)):
            at = np.flatnonzero(passed[i])
            differ = np.bitwise_count(a[i] ^ b[at]).sum(axis=1, dtype=np.int64)
            passed[i, at] = differ * (p + q) <= (s[i, 0] + u[0, at]) * (q - p)
        return passed
    return near


def refined_groups(groups: DataFrame, sketches: DataFrame, least: Fraction, above: int) -> DataFrame:
    """``groups(node, size, group)`` cut anew by longer sketches, where a group has sets of more than ``above``.

    Sketches of a fixed length say little of large sets, so their groups grow by chance; ``sketches(node, bits)``
    have a length that follows the size. Sets that can link are in the same class of sizes or in neighbouring
    ones, so a group's nodes meet by pairs of classes, in blocks.
    """
    large = staged(groups.groupBy("group").agg(F.max("size").alias("most")).where(F.col("most") > above)
                   .select("group"), "large-sets")
    if large.isEmpty():
        return groups
    part = staged(groups.join(large, "group"), "to-refine")
    width = 1.0001 * float(np.log(float(1 / least)))
    own = F.floor(F.log("size") / width)
    cells = part.select("node", "size", "group", F.explode(F.array(
        F.struct(own.alias("c"), F.lit(True).alias("low")), F.struct((own - 1).alias("c"), F.lit(False).alias("low")))).alias("x"))
    cells = cells.select("node", "size", "group", "x.*")
    about = staged(cells.groupBy("group", "c").agg(F.count("*").alias("n"), F.bool_or("low").alias("any"))
                   .where("any AND n > 1").select("group", "c", F.ceil(F.col("n") / BLOCK_SETS).alias("blocks"), "n")
                   .withColumn("cell", F.monotonically_increasing_id()), "cells")
    zero = F.lit(0).cast("long")
    dealt = (cells.join(about, ["group", "c"])
             .select(F.col("cell").alias("group"), "node", "size", "low", F.pmod(F.xxhash64("node"), "blocks").alias("own"),
                     F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("with"))
             .select("group", "node", "size", "low", "own", F.least("own", "with").alias("i"),
                     F.greatest("own", "with").alias("j")))
    tasks = 1 + total(about, F.col("n") * F.col("blocks")) // (2 * BLOCK_SETS)
    links = staged(met(dealt, sketches, near_sketches(least), tasks), "refined")
    labels = contracted(part.select("node", "size", F.col("node").alias("root")), links)
    again = labels.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root")
    found = labels.join(again, "root").select("node", "size", F.col("root").alias("group"))
    return staged(groups.join(large, "group", "left_anti").select("node", "size", "group").union(found), "grouped")


def total(rows: DataFrame, what: Column) -> int:
    return rows.agg(F.coalesce(F.sum(what), F.lit(0)).cast("long")).first()[0]


def verified_links(groups: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """``(a, b)``: links that connect the nodes of ``groups(node, size, group)`` as all links between them would.

    ``sets(node, grams)`` has whole sets; rows that repeat a node are read once.
    """
    sets = staged(sets.dropDuplicates(["node"]), "sets")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("size") / BLOCK_GRAMS)).alias("blocks")
    about = staged(groups.groupBy("group").agg(blocks), "blocks")
    grouped = staged(groups.join(about, "group"), "dealt")
    single = grouped.where("blocks = 1")
    zero = F.lit(0).cast("long")
    whole = single.select("group", "node", zero.alias("own"), zero.alias("i"), zero.alias("j"))
    found = staged(met(whole, sets, near_sets(least), 1 + total(single, F.col("size")) // BLOCK_GRAMS), "links")
    large = grouped.where("blocks > 1")
    if large.isEmpty():
        return found
    # centres of large groups meet all members, in as many parts as the group has blocks
    centre = [F.min_by("node", F.xxhash64("node", F.lit(turn))) for turn in range(CENTRES)]
    chosen = staged(large.groupBy("group", "blocks").agg(F.array_distinct(F.array(*centre)).alias("centres")), "chosen")
    part = F.pmod(F.xxhash64("node"), F.col("blocks"))
    members = large.join(chosen.select("group", "centres"), "group").where(~F.array_contains("centres", F.col("node")))
    every = F.explode(F.sequence(zero, F.col("blocks") - 1))
    rows = members.select("group", "node", (part + 1).alias("own")).select("group", "node", "own", zero.alias("i"),
                                                                           F.col("own").alias("j"))
    middle = (chosen.select("group", "centres", every.alias("part"))
              .select("group", F.explode("centres").alias("node"), zero.alias("own"), zero.alias("i"),
                      (F.col("part") + 1).alias("j")))
    tasks = 1 + total(large, F.col("size")) // BLOCK_GRAMS
    first = staged(met(rows.union(middle), sets, near_sets(least), tasks), "links")
    labels = contracted(large.select("node", "size", "group", F.col("node").alias("root")), first)
    # the largest component of a group lies in blocks of its own, which are not met with each other
    parts = labels.groupBy("group", "root").agg(F.count("*").alias("n"), F.sum("size").alias("grams"))
    main = staged(parts.groupBy("group").agg(F.max(F.struct("n", "grams", "root")).alias("m"),
                                             F.sum("n").alias("n"), F.sum("grams").alias("grams"))
                  .select("group", F.col("m.root").alias("main"),
                          need(F.col("m.n"), F.col("m.grams")).alias("mains"),
                          need(F.col("n") - F.col("m.n"), F.col("grams") - F.col("m.grams")).alias("rests"))
                  .where("rests > 0"), "main")
    ranked = (labels.join(main, "group")
              .withColumn("own", F.when(F.col("root") == F.col("main"), F.pmod(F.xxhash64("node"), "mains"))
                          .otherwise(F.col("mains") + F.pmod(F.xxhash64("node"), "rests"))))
    partners = F.when(F.col("own") < F.col("mains"), F.sequence(F.col("mains"), F.col("mains") + F.col("rests") - 1)) \
        .otherwise(F.sequence(zero, F.col("mains") + F.col("rests") - 1))
    dealt = staged(ranked.select("group", "node", "size", "own", F.explode(partners).alias("with"))
                   .select("group", "node", "size", "own", F.least("own", "with").alias("i"),
                           F.greatest("own", "with").alias("j")), "pairs-of-blocks")
    tasks = 1 + total(dealt, F.col("size")) // (2 * BLOCK_GRAMS)
    second = staged(met(dealt.drop("size"), sets, near_sets(least), tasks), "links")
    return found.union(first).union(second)


def need(n: Column, grams: Column) -> Column:
    """Blocks for ``n`` sets of so many elements together."""
    return F.ceil(F.greatest(n / BLOCK_SETS, grams / BLOCK_GRAMS)).cast("long")
