"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is a few joins and sums over the links, written to the shared folder, so neither a hub with a
third of all links nor a long chain meets in one task, and a lost executor costs a read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parleyspark.llm.common import keep


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (a, b) with a > b. Large: greater neighbours go to the least of a's neighbourhood; small: lesser ones do."""
    around = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = keep(around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")))
    joined = around.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    out = out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return keep(out.distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): the least node that it reaches. Nodes without links are absent."""
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links, before = keep(links.distinct()), None
    while True:
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        links = _star(_star(links, large=True), large=False)
    roots = links.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
