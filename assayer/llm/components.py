"""Connected components of a graph whose edges are rows, for graphs of any size.

Large-star and small-star steps alternate until the edges no longer change; each
step is one minimum per node and one join, so nothing gathers a node's
neighbours.  The minima are written before they are joined: a join that reads an
aggregate couldn't be split where a node has very many edges.  Every round ends
lineage in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._run import cut


def _hung(edges: DataFrame) -> DataFrame:
    """Both steps: afterwards every node hangs on a smaller one, or on the same as before."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    large = cut(large, "large")
    least = cut(large.groupBy("a").agg(F.min("b").alias("m")), "least")
    small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id`` and ``root``, the smallest id that it reaches; ids without a link to another are left out."""
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    mark = None
    while True:
        edges = cut(_hung(edges), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
        mark = now
