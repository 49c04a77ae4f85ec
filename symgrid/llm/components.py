"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgrid.llm.common import drop_dir, work_dir


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); root is the smallest node reachable.

    Large-star and small-star steps alternate until the edge set no longer changes: each
    shortens every path, so the number of rounds grows with the logarithm of the longest one.
    Rounds are tables in shared storage; nothing is gathered on the driver but two numbers a
    round. Loops and repeated edges don't matter; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    step = work_dir(spark, "components")
    least = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before, at = None, 0
    while True:
        path = f"{step}/{at}"
        least.write.parquet(path)
        now = spark.read.schema("u long, v long").parquet(path)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if at > 1:
            drop_dir(spark, f"{step}/{at - 2}")
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before, at = mark, at + 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        least = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).distinct()
