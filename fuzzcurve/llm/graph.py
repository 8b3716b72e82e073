"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import drop_tables, write_table


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): for each node of ``links`` (a, b) the smallest node that it reaches.

    Alternating stars: first every node's larger neighbours are linked to its
    least one, then its smaller ones. Each half is one aggregate and one join
    by node; a round's links go to a table, so lineage stays short. A round
    never adds links, and their number of rounds is logarithmic in practice.
    Nodes without links are not in the result.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = write_table(links, "links")
    state = None
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        before, links = links, write_table(small, "links")
        drop_tables(before)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = links.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id"))
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
