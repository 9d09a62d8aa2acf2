"""Statistics of an index: areas, use of leaves, sizes of lists, overlap of children."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strail.functions.geometry import div0, unit_mbb, volume
from strail.functions.klee import union_measure
from strail.operators.index import BOX, Index


def entry_volume(units: DataFrame) -> DataFrame:
    return units.select(*unit_mbb()).select(volume().alias("v"))


def overlap_ratios(children: DataFrame, keys: list[str]) -> DataFrame:
    """Union volume of the children over the sum of their volumes, for each node; 1 where the sum is nearly 0.

    A node has at most its fan-out of children, so a group is small.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = pdf[BOX[:3]].to_numpy(np.float64), pdf[BOX[3:]].to_numpy(np.float64)
        total = float(np.prod(high - low, axis=1).sum())
        union = union_measure(low, high)
        return pd.DataFrame([[*key, union, total, 1.0 if total <= 2.220446049250313e-16 else union / total]], columns=[*keys, "union_volume", "sum_volume", "ratio"])

    kinds = ", ".join(f"{k} {children.schema[k].dataType.simpleString()}" for k in keys)
    return children.groupBy(*keys).applyInPandas(run, f"{kinds}, union_volume double, sum_volume double, ratio double")


def tree_stats(index: Index) -> DataFrame:
    """One row of statistics; per-level figures are maps by level."""
    nodes, posts = index.nodes, index.postings
    leaf = nodes.where("level = 0")
    root = nodes.where(F.col("level") == index.height - 1).select(volume().alias("root"), *[F.col(c).alias(f"root_{c}") for c in BOX])
    entries = entry_volume(index.units).agg(F.coalesce(F.avg("v"), F.lit(0.0)).alias("ev"), F.count(F.lit(1)).alias("entry_count"))
    leaf_stats = leaf.select(volume().alias("v")).agg(F.coalesce(F.avg("v"), F.lit(0.0)).alias("lv"), F.count(F.lit(1)).alias("leaf_nodes"))
    lists = posts.where("level > 0 and label_id is not null").groupBy("level", "node_id").agg(F.count(F.lit(1)).alias("n"))
    per_level = lists.groupBy("level").agg(F.avg("n").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", "n")))).alias("internal_index_size_level"))
    sizes = lists.agg(F.coalesce(F.avg("n"), F.lit(0.0)).alias("internal_index_size"))
    child = nodes.where("parent_id is not null").select((F.col("level") + 1).alias("level"), F.col("parent_id").alias("node_id"), *BOX)
    below = posts.where("label_id is not null").join(nodes.select("level", "node_id", "parent_id"), ["level", "node_id"]).where("parent_id is not null")
    list_size = below.groupBy("level", "parent_id", "label_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.avg("n"), F.lit(0.0)).alias("internal_list_size"))
    ratio = overlap_ratios(child, ["level", "node_id"]).groupBy("level").agg(F.avg("ratio").alias("r")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", "r")))).alias("internal_area_ratio_level"))
    one = entries
    for part in (leaf_stats, root, per_level, sizes, list_size, ratio, nodes.where("level > 0").agg(F.count(F.lit(1)).alias("internal_nodes"))):
        one = one.crossJoin(F.broadcast(part))  # one row each
    c = F.col
    return one.select(
        div0(div0(c("ev"), c("root")), c("entry_count").cast("double")).alias("entry_area"),
        div0(div0(c("lv"), c("root")), c("leaf_nodes").cast("double")).alias("leaf_area"),
        div0(c("entry_count").cast("double"), (c("leaf_nodes") * index.config.leaf_fanout).cast("double")).alias("leaf_utilization"),
        "internal_index_size", "internal_index_size_level", "internal_list_size", "internal_area_ratio_level", "entry_count", "leaf_nodes", "internal_nodes",
        F.lit(index.height).alias("height"), F.lit(index.config.lambda_).alias("lambda"), *[c(f"root_{b}").alias(b) for b in BOX],
    )
