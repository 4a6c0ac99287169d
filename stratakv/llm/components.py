"""Connected components of a table of links, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakv.llm.textio import discard, written

#: Rows in a file of the tables in between.
FILE_ROWS = 200_000


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of longs -> node, component: the smallest node that links lead to. Nodes without a link are left out.

    Every round, each root takes the smallest root it is linked to, chains of such choices are followed by doubling,
    and links are rewritten to roots; those within one component fall away. Links at least halve the roots a round.
    All of it stays in tables, deleted as soon as the next is there; nothing but counts reaches the driver.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = written(links, "cc-links")
    files = 1 + links.count() // FILE_ROWS
    label = None
    while True:
        both = links.union(links.select(F.col("b"), F.col("a")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up"))
        parent = written(parent.withColumn("moved", F.lit(True)), "cc-parents", files)
        while True:  # parents are never larger, so this ends in roots
            above = parent.select(F.col("node").alias("n2"), F.col("up").alias("top"))
            jumped = parent.join(above, F.col("up") == F.col("n2")).select("node", F.col("top").alias("up"), (F.col("up") != F.col("top")).alias("moved"))
            old, parent = parent, written(jumped, "cc-parents", files)
            discard(old)
            if parent.where("moved").isEmpty():
                break
        up = parent.select(F.col("node").alias("n2"), "up")
        if label is None:
            new = parent.select("node", F.col("up").alias("component"))
        else:
            new = label.join(up, F.col("component") == F.col("n2"), "left").select("node", F.coalesce("up", "component").alias("component"))
        half = links.join(up, F.col("a") == F.col("n2")).select(F.col("up").alias("a"), "b")
        rest = half.join(up, F.col("b") == F.col("n2")).select("a", F.col("up").alias("b")).where("a <> b").distinct()
        stale = [links, parent] + ([label] if label is not None else [])
        links, label = written(rest, "cc-links", files), written(new, "cc-labels", files)
        for df in stale:
            discard(df)
        if links.isEmpty():
            discard(links)
            return label
