"""Connected components over an edge table by alternating large-star and small-star rounds.

Every round is a partial aggregation (smallest neighbour) and one join with a side that is unique on the key, so a
node with very many neighbours is split by adaptive skew handling and never gathered in one task. The edges of each
round are written to the shared folder; nothing is collected to the driver but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandspark.llm.common import forget, save


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows (node, root): each node that has an edge, with the smallest node of its component.

    Nulls and loops in `edges` are ignored; repeated edges count once; no edges give no rows.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = save(e.where("u > v").distinct(), "edges")
    seen = mark(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = save(large.where("u > v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = save(small.where("u > v").distinct(), "small")
        forget(large)
        forget(e)
        e, was = new, seen
        seen = mark(e)
        if seen == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
