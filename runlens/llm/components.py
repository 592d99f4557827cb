"""Connected components of a table of links, by repeated contraction towards the smallest id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every end of ``links(a, b)``; root is the component's smallest id.

    Each pass sends every node to the smallest of its neighbours and itself, follows these pointers once more,
    and contracts the links. Smallest neighbours are combined map-side, so a node with very many links is no
    hot key; nothing but a row count reaches the driver.
    """
    left, passes = staged(links.where("a <> b").distinct(), "links"), []
    while not left.isEmpty():
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p"))
        far = near.select(F.col("a").alias("p"), F.col("p").alias("q"))
        parent = staged(near.join(far, "p").select(F.col("a").alias("node"), F.col("q").alias("root")), "parents")
        passes.append(parent)
        a, b = (parent.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        left = staged(left.join(a, "a").join(b, "b").where("ra <> rb")
                      .select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
    if not passes:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = passes[0]
    for parent in passes[1:]:
        onward = parent.select(F.col("node").alias("root"), F.col("root").alias("next"))
        found = found.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return found
