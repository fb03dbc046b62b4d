"""Connected components of a link table, in a few rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(member, root) for every node of ``links`` (src, dst) that isn't its own root.

    Alternates two steps until nothing changes: every larger neighbour of a node is
    linked to the node's smallest neighbour, then every node and its smaller
    neighbours are linked to the smallest of them. A component ends as a star
    around its smallest node after about log n rounds. Each round is written to
    the shared folder, so lost executors cost one round. Minima are combinable
    and written before they are joined back, so the join sees plain shuffles
    and a node with very many links can be split.
    """
    star = cut_lineage(
        links.where("src <> dst")
        .select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).distinct()
    )
    last = None
    while True:
        now = star.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
        if now == last or not now["n"]:
            return star.select(F.col("hi").alias("member"), F.col("lo").alias("root"))
        last = now
        both = star.select(F.col("hi").alias("at"), F.col("lo").alias("to")).union(star.select("lo", "hi"))
        least = cut_lineage(both.groupBy("at").agg(F.min("to").alias("m")).select("at", F.least("at", "m").alias("m")))
        large = cut_lineage(both.join(least, "at").where("to > at").select(F.col("to").alias("hi"), F.col("m").alias("lo")).distinct())
        below = cut_lineage(large.groupBy("hi").agg(F.min("lo").alias("m")))
        moved = large.join(below, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        star = cut_lineage(moved.union(below.select("hi", F.col("m").alias("lo"))).distinct())
