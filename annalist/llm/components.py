"""Connected components of a graph given as links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from annalist.llm import common


def _linked_to_least(links: DataFrame) -> DataFrame:
    """Links with the least of ``a`` and its partners beside them."""
    least = links.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return links.join(least, "a")


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``node, root`` for every node of ``a, b`` links; ``root`` is the component's least node.

    Each round relinks larger partners, then smaller ones, to the least node in reach, and is
    stored in the shared folder. Rounds grow with the logarithm of the longest path. A node
    with very many links is reduced by partial minima; its join is split by adaptive execution.
    Null ends and loops are left out; an empty table has no components.
    """
    links = common.stage(links.where("a <> b").select("a", "b"), "links")
    before = None
    for _ in range(most_rounds):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _linked_to_least(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        small = _linked_to_least(large)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        read, links = links, common.stage(small.where("a <> b").distinct(), "components")
        common.unstage(read)
        digest = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("digest")
        now = tuple(links.agg(F.count("*"), digest).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    found = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found.union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
