"""Connected components of a table of links, on the cluster alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import packed


def components(links: DataFrame, folder: str, name: str = "links") -> DataFrame:
    """(node, component) for every node of links (a, b): the least node that can be reached. Null ends and loops don't count.

    Alternating stars: every node hands its larger neighbours to its least one, then its smaller ones, until nothing changes;
    each round is a join and two grouped minima over the links that are left, and is written to the shared folder.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = packed.table(edges, folder, f"{name}0")
    before = None
    for k in range(1, 100):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 2**40), F.sum("v")).first()
        if now == before or not now[0]:
            break
        before = now
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct()
        edges = packed.table(small, folder, f"{name}{k}")
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v")).groupBy("node").agg(F.min("component").alias("component"))
