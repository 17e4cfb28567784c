"""Connected components of a table of links, as a fixed number of small joins per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept


def _pairs(first: str, second: str):
    return F.struct(F.col(first).alias("u"), F.col(second).alias("v"))


def connected(links: DataFrame) -> DataFrame:
    """``(node, component)`` of every node in ``links(a, b)``: the least node reachable.

    Large-star and small-star steps in turn: every node hands its larger neighbours, then
    its smaller ones, to the least node it knows, until all hang on the least of their
    component. The number of rounds grows with the logarithm of the longest path, links
    never grow in number, and each round is a written table. Links to oneself and links
    with a null end say nothing. No node's neighbours are ever gathered in one row.
    """
    a, b = F.col("a"), F.col("b")
    edges = kept(
        links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "links",
    )
    mark = None
    while True:
        found = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("v").cast("long"))).first()
        if found == mark or not found[0]:
            break
        mark = found
        both = edges.select(F.inline(F.array(_pairs("u", "v"), _pairs("v", "u"))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = F.inline(F.array(_pairs("v", "m"), _pairs("u", "m")))
        edges = kept(large.join(least, "u").select(moved).where("u <> v").distinct(), "stars")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
