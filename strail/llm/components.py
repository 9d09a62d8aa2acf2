"""Connected components of an edge table, by alternating star contraction.

Each round replaces the edges of a node by edges to its smallest neighbour; both halves are one aggregation with
partial sums and one equi-join of two written tables, so a hub with a large share of all edges is split by AQE's skew
join and never gathered in one task. Nothing is collected: the driver sees one row of checksums a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strail.llm.common import discard, materialize


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return r[0], r[1]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b: long) -> (node, root): for each node of an edge, the smallest node it reaches.

    Null ends and loops are dropped; repeated edges count once; an empty table gives an empty one.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null and u <> v").dropDuplicates()
    e = materialize(e, "edges")
    state = _state(e)
    for _ in range(max_rounds):
        if not state[0]:
            break
        # Larger neighbours of each node move to its smallest neighbour (or to itself).
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = materialize(moved.dropDuplicates(), "large")
        # Smaller neighbours of each node, and the node itself, move to the smallest of them.
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        nodes = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        new = materialize(nodes.where("u <> v").dropDuplicates(), "edges")
        now = _state(new)
        for x in (e, least, large, low):
            discard(x)
        e = new
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v"))).dropDuplicates()
