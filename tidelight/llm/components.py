"""Connected components of an edge table, by alternating large and small stars.

Each round attaches every node's greater neighbours, then its smaller ones, to
the least node it knows, until nothing changes; that takes a number of rounds
logarithmic in the size of a component. Rounds are cut by written tables. Links
and labels stay distributed; a node with very many links is pre-aggregated for
its minimum and its rows are joined, never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelight.llm.common import drop_table, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of ``edges``; the component is its least node.

    Links from a node to itself and null ends are ignored; repeated links count
    once; an empty table gives no rows. Ends are integers (long).
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    links = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter(u.isNotNull() & v.isNotNull() & (F.col("u") > F.col("v")))
    e = materialize(links.distinct(), "links")
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        drop_table(e)
        e, before, state = after, state, _state(after)
        if state == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _state(e: DataFrame) -> tuple[int, int]:
    """Equal for equal edge sets: the count, and a sum of hashes kept exact as a decimal."""
    row = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)
