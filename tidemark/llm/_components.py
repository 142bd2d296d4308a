"""Connected components of a table of links, by alternating star operations."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import scratch


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for the nodes of links(a, b): root is the smallest node reachable.

    Each round first hangs a node's larger neighbours on its smallest neighbour, then its smaller
    neighbours (Kiveris et al., 2014), until nothing changes. A node's minimum is an aggregate joined
    back, so that no task ever holds the neighbours of one node. Each step is written, which cuts the
    lineage. No links give no rows.
    """
    spark = links.sparkSession
    edges = scratch(
        spark,
        links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "cc",
    )
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join reads both sides from shuffles and the links of a hub can be split
        low = scratch(spark, both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-low")
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = scratch(spark, large, "cc")
        low = scratch(spark, large.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        small = scratch(spark, small, "cc")
        # a forest of stars no longer changes: every larger end has one link, and no root is a larger end
        loose = small.groupBy("u").count().where("count > 1").select("u").unionByName(small.select("u").join(small.select(F.col("v").alias("u")), "u", "left_semi"))
        edges = small
        if loose.isEmpty():
            return small.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(small.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    raise RuntimeError("components did not settle")
