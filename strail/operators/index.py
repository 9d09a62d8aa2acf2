"""Index tables over laid-out units: nodes with boxes, postings with counts and id sets, settings; and their upkeep.

Leaves are summarized by one aggregation; each higher level aggregates the level below, never the units again.
Level 0 are the leaves. label_id null in postings is the list of all labels.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strail.functions.geometry import extend_agg, unit_extend_agg
from strail.functions.idset import bloom_bits, ids_to_intervals, lists_to_blooms, lists_to_intervals
from strail.operators.stored import keep
from strail.schema import UNITS, IndexConfig

BOX = ["xmin", "ymin", "tmin", "xmax", "ymax", "tmax"]
SHIPPED = 500_000  # label counts of nodes that go to all tasks


@dataclass
class Index:
    units: DataFrame  # with leaf_id
    nodes: DataFrame  # level, node_id, parent_id, n_entries, box
    postings: DataFrame  # level, node_id, label_id, unit_count, ids
    labels: DataFrame | None
    config: IndexConfig
    height: int
    size: int
    kept: tuple = ()  # tables that the build keeps

    def close(self) -> None:
        """Let go of the tables that the build kept; the index can still be read, at the price of building it again."""
        for df in self.kept:
            df.unpersist()


def leaf_boxes(units: DataFrame) -> DataFrame:
    return units.groupBy(F.col("leaf_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_entries"), *unit_extend_agg())


def leaf_summary(units: DataFrame) -> DataFrame:
    """(node_id, label_id or null for all, unit_count, ids): count and distinct trajectories of each leaf, by label and in all."""
    ids = F.sort_array(F.collect_set("trajectory_id")).alias("ids")  # a leaf holds at most its fan-out of them
    by = units.groupBy(F.col("leaf_id").alias("node_id"), "label_id").agg(F.count(F.lit(1)).alias("unit_count"), ids)
    total = units.groupBy(F.col("leaf_id").alias("node_id")).agg(F.count(F.lit(1)).alias("unit_count"), ids)
    return by.unionByName(total.withColumn("label_id", F.lit(None).cast("long")))


def histogram(units: DataFrame) -> DataFrame:
    return units.groupBy(F.col("leaf_id").alias("node_id"), "label_id").count()


def parent_of(node: Column, fanout: int) -> Column:
    return F.floor(node / F.lit(fanout)).cast("long")


def number_nodes(nodes: DataFrame) -> DataFrame:
    """node_id -> seq, dense in node order. Node tables are smaller than units by the fan-out; layouts give dense ids where they can."""
    from strail.operators.layout import global_rank

    n = nodes.count()
    parts = 1 if n < 500_000 else int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return global_rank(nodes.select("node_id"), ["node_id"], "seq", parts)


def internal_boxes(nodes: DataFrame, fanout: int) -> DataFrame:
    return nodes.groupBy(parent_of(F.col("node_id"), fanout).alias("node_id")).agg(F.count(F.lit(1)).alias("n_entries"), *extend_agg())


def internal_summary(postings: DataFrame, fanout: int, lambda_: int | None = None) -> DataFrame:
    """Counts add up and ids unite, list by list; with lambda_ the ids become at most so many intervals, over a shuffle of ids."""
    up = postings.withColumn("node_id", parent_of(F.col("node_id"), fanout))
    if lambda_ is None:
        return up.groupBy("node_id", "label_id").agg(F.sum("unit_count").alias("unit_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    counts = up.groupBy("node_id", "label_id").agg(F.sum("unit_count").alias("unit_count"))
    spans = ids_to_intervals(up.select("node_id", "label_id", F.explode("ids").alias("id")), ["node_id", "label_id"], lambda_)
    ids = spans.groupBy("node_id", "label_id").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("ids"))
    same = F.col("c.label_id").eqNullSafe(F.col("i.label_id")) & (F.col("c.node_id") == F.col("i.node_id"))
    return counts.alias("c").join(ids.alias("i"), same).select("c.node_id", "c.label_id", "unit_count", "ids")


def to_interval_postings(postings: DataFrame, lambda_: int) -> DataFrame:
    """Postings with exact id arrays -> with at most lambda_ closed intervals; each list by itself, without a shuffle of ids."""
    return lists_to_intervals(postings.select("level", "node_id", "label_id", "unit_count", "ids"), "ids", lambda_)


def to_bloom_postings(postings: DataFrame, lambda_: int) -> DataFrame:
    """Postings with exact id arrays -> with a Bloom filter (words of bits) as large as lambda_ intervals; without a shuffle as well."""
    return lists_to_blooms(postings.select("level", "node_id", "label_id", "unit_count", "ids"), "ids", bloom_bits(lambda_))


def build(units: DataFrame, config: IndexConfig, labels: DataFrame | None = None) -> Index:
    """Lay out, number leaves densely, and summarize level by level up to one root."""
    from strail.operators.layout import apply_layout

    laid = keep(apply_layout(units, config.layout, config.leaf_fanout, config.beta, config.internal_fanout, config.beta_mode))
    index = _numbered(laid, config, labels)
    laid.unpersist()  # the numbered units are kept by now
    return index


def _numbered(laid: DataFrame, config: IndexConfig, labels: DataFrame | None) -> Index:
    """The index of laid-out units whose leaf ids, in their order, become dense."""
    seq = number_nodes(leaf_boxes(laid))
    laid = keep(laid.join(seq.withColumnRenamed("node_id", "leaf_id"), "leaf_id").drop("leaf_id").withColumnRenamed("seq", "leaf_id"))
    return summarize(laid, config, labels)


def summarize(laid: DataFrame, config: IndexConfig, labels: DataFrame | None = None, least_height: int = 1) -> Index:
    """Nodes and postings of units with leaf_id, level by level up to one root; node n of a level is under node n DIV fan-out of the next."""
    level, nodes, posts = 0, keep(leaf_boxes(laid)), keep(leaf_summary(laid))
    kept = [laid, nodes, posts]
    all_nodes, all_posts = [nodes.withColumn("level", F.lit(0))], [posts.withColumn("level", F.lit(0))]
    while nodes.count() > 1 or level + 1 < least_height:
        level, nodes, posts = level + 1, keep(internal_boxes(nodes, config.internal_fanout)), keep(internal_summary(posts, config.internal_fanout))
        kept += [nodes, posts]
        all_nodes.append(nodes.withColumn("level", F.lit(level)))
        all_posts.append(posts.withColumn("level", F.lit(level)))
    tree = reduce(DataFrame.unionByName, all_nodes).withColumn("parent_id", F.when(F.col("level") < level, parent_of(F.col("node_id"), config.internal_fanout)))
    postings = reduce(DataFrame.unionByName, all_posts).select("level", "node_id", "label_id", "unit_count", "ids")
    if config.id_set == "interval":
        postings = keep(to_interval_postings(postings, config.lambda_))
        kept.append(postings)
    elif config.id_set == "bloom":
        postings = keep(to_bloom_postings(postings, config.lambda_))
        kept.append(postings)
    elif config.id_set == "null":
        postings = postings.drop("ids")
    return Index(laid, tree.select("level", "node_id", "parent_id", "n_entries", *BOX), postings, labels, config, level + 1, laid.count(), tuple(kept))


def naive_summary(units: DataFrame, fanout: int, level: int) -> DataFrame:
    """internal_summary() of a level straight from the units, label by label, as a check of the level-wise one."""
    node = F.floor(F.col("leaf_id") / F.lit(fanout**level)).cast("long").alias("node_id")
    ids = F.sort_array(F.collect_set("trajectory_id")).alias("ids")
    by = units.groupBy(node, "label_id").agg(F.count(F.lit(1)).alias("unit_count"), ids)
    return by.unionByName(units.groupBy(node).agg(F.count(F.lit(1)).alias("unit_count"), ids).withColumn("label_id", F.lit(None).cast("long")))


def save(index: Index, path: str) -> None:
    """Units are clustered by leaf within files, so the scan's minima and maxima are narrow."""
    from strail.operators.layout import parts_for

    parts = parts_for(index.size)
    index.units.repartitionByRange(parts, "leaf_id").sortWithinPartitions("leaf_id", "trajectory_id", "unit_index").write.mode("overwrite").parquet(f"{path}/units")
    index.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    index.postings.write.mode("overwrite").parquet(f"{path}/postings")
    if index.labels is not None:
        index.labels.write.mode("overwrite").parquet(f"{path}/labels")
    meta = {**index.config.row(), "height": index.height, "size": index.size}
    index.units.sparkSession.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").parquet(f"{path}/meta")


def open_index(spark: SparkSession, path: str, expected: IndexConfig | None = None) -> Index:
    """Refuses an index built with another version, fan-out, lambda or kind of id set than expected."""
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
    height, size = meta.pop("height"), meta.pop("size")
    config = IndexConfig(**meta)
    if expected is not None:
        for name in ("version", "leaf_fanout", "internal_fanout", "lambda_", "id_set"):
            if getattr(config, name) != getattr(expected, name):
                raise ValueError(f"index has {name} {getattr(config, name)}, expected {getattr(expected, name)}")
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/labels")
    labels = spark.read.parquet(f"{path}/labels") if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else None
    return Index(spark.read.parquet(f"{path}/units"), spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/postings"), labels, config, height, size)


def descend(index: Index, probe: DataFrame) -> DataFrame:
    """probe (units) with the leaf of least cost, found from the root down: each level joins a unit with the children of its node.

    A child costs beta_at(its parent's depth) * enlargement / largest enlargement + the rest * textual cost; ties go to the
    smaller, then to the first child. The upper levels, of SHIPPED label counts in all, go to all tasks as arrays and need no
    shuffle; below them units and nodes meet by sort-merge or broadcast as AQE sees fit.
    """
    from strail.functions import geometry as G

    posted = index.postings.where(F.col("label_id").isNotNull())
    lists = dict(posted.groupBy("level").count().collect())  # a row for each level
    level, room, upper = index.height - 2, SHIPPED, []
    while level >= 0 and lists.get(level, 0) <= room:
        room -= lists.get(level, 0)
        counts = posted.where(F.col("level") == level).select("node_id", "label_id", "unit_count").toPandas()  # of bounded size
        nodes = index.nodes.where(F.col("level") == level).select("node_id", "parent_id", *BOX).toPandas()
        nodes = nodes.merge(counts.groupby("node_id", as_index=False)["unit_count"].sum().rename(columns={"unit_count": "total"}), on="node_id")
        upper.append((nodes, counts, index.config.beta_at(index.height, index.height - 2 - level)))
        level -= 1
    at = _routed(probe, upper).select("*", *G.unit_mbb("__u_"))
    key = ["trajectory_id", "unit_index"]
    for level in range(level, -1, -1):  # noqa: B020  the levels that are left
        beta = index.config.beta_at(index.height, index.height - 2 - level)
        posts = posted.where(F.col("level") == level)
        total = posts.groupBy("node_id").agg(F.sum("unit_count").alias("__total"))
        nodes = index.nodes.where(F.col("level") == level).join(total, "node_id").select("node_id", "__total", F.col("parent_id").alias("__parent"), *[F.col(c).alias(f"__n_{c}") for c in BOX])
        hist = posts.select("node_id", "label_id", F.col("unit_count").alias("__count"))
        pair = at.join(nodes, "__parent").join(hist, ["node_id", "label_id"], "left")
        pair = pair.select("*", G.volume("__n_").alias("__size"), *G.union_box("__u_", "__n_", "__g_")).withColumn("__grown", G.volume("__g_") - F.col("__size"))
        textual = F.when(F.col("__count").isNull(), F.lit(1.0)).otherwise(1 - (F.lit(1) + F.col("__count")) / (F.lit(1) + F.col("__total")))
        pair = pair.withColumn("__textual", textual)
        # The largest enlargement comes from the same group as the choice: one aggregation over the children of a node.
        child = F.struct("__grown", "__textual", "__size", "node_id")
        rows = pair.groupBy(*key).agg(F.first(F.struct(*[c for c in at.columns if c not in (*key, "__parent")])).alias("__row"), F.max("__grown").alias("__top"), F.collect_list(child).alias("__children"))
        share = G.inverse(F.col("__top"))
        cost = lambda c: F.struct((F.lit(beta) * c["__grown"] * share + F.lit(1 - beta) * c["__textual"]).alias("cost"), c["__size"].alias("size"), c["node_id"].alias("node"))  # noqa: B023, E731
        best = F.array_min(F.transform("__children", cost))["node"]
        at = rows.select(*key, "__row.*", best.alias("__parent"))
    return at.select(*probe.columns, F.col("__parent").alias("leaf_id"))


def _routed(probe: DataFrame, upper: list[tuple]) -> DataFrame:
    """probe with the node of the lowest of the given levels that each unit comes to, as __parent; 0 without a level."""
    if not upper:
        return probe.withColumn("__parent", F.lit(0).cast("long"))
    import numpy as np
    import pyarrow as pa

    from strail.operators.insertion import Levels

    shared = probe.sparkSession.sparkContext.broadcast(Levels(upper))

    def run(batches):
        for batch in batches:
            own = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "t0", "x1", "y1", "t1")}
            box = {f"{a}{m}": f(own[f"{a}0"], own[f"{a}1"]) for a in "xyt" for m, f in (("min", np.fmin), ("max", np.fmax))}
            label = batch.column("label_id")
            node = shared.value.route(box, label.fill_null(0).to_numpy(zero_copy_only=False), label.is_valid().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node, pa.int64())], names=[*batch.schema.names, "__parent"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in probe.schema)
    return probe.mapInArrow(run, f"{schema}, __parent long")


def insert(index: Index, batch: DataFrame) -> Index:
    """The index with more units: each goes to the leaf of least cost, leaves that overflow are split, and their ancestors are summarized again.

    Leaves that don't overflow keep their units. Splits are those of inserting one by one; a leaf and what comes to it is one
    group, so a batch that puts more than `tile_rows` units into a leaf is cut into tiles there first.
    """
    import numpy as np
    import pandas as pd

    from strail.operators.insertion import Tree
    from strail.operators.layout import MAX_PARTITIONS, _corners, global_rank, parts_for

    config, tile_rows = index.config, 20_000
    fields = UNITS.fieldNames()
    old = index.units.select(*fields, "leaf_id")
    everything = keep(old.unionByName(descend(index, batch.select(*fields)).select(*fields, "leaf_id")))
    sizes = everything.groupBy("leaf_id").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > config.leaf_fanout)
    rest = everything.join(sizes, "leaf_id", "left_anti").select(*fields, F.col("leaf_id"), F.lit(0).cast("long").alias("__part"))
    tile = F.pmod(F.xxhash64("trajectory_id", F.expr("unit_index DIV 64")), F.ceil(F.col("__n") / tile_rows))
    over = everything.join(sizes, "leaf_id").withColumn("__tile", tile).drop("__n")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["trajectory_id", "unit_index"], ignore_index=True)
        tree = Tree(config.leaf_fanout, config.internal_fanout, config.beta, config.beta_mode)
        low, high = _corners(pdf)
        for i, label in enumerate(pdf["label_id"].to_numpy()):
            tree.insert(i, low[i], high[i], {int(label): 1})
        pdf["__part"] = pdf["__tile"].astype(np.int64) * (1 << 20) + tree.leaf_numbers(len(pdf))
        return pdf.drop(columns="__tile")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in UNITS) + ", leaf_id long, __part long"
    # Growing a tree takes long for its few bytes, so the number of tasks goes by units.
    tasks = min(MAX_PARTITIONS, -(-(sizes.agg(F.sum("__n")).first()[0] or 1) // tile_rows))
    split = over.select(*fields, "leaf_id", "__tile").repartition(tasks, "leaf_id", "__tile").groupBy("leaf_id", "__tile").applyInPandas(grow, schema)
    parts = keep(rest.unionByName(split))

    names = parts.select("leaf_id", "__part").distinct()
    ranked = global_rank(names, ["leaf_id", "__part"], "__leaf", parts_for(names.count()))
    laid = keep(parts.join(ranked, ["leaf_id", "__part"]).select(*fields, F.col("__leaf").alias("leaf_id")))
    return summarize(laid, config, index.labels)


def attach(index: Index, other: Index) -> Index:
    """Both trees under one root, their leaves as they are: the other's nodes are numbered behind the first's, level by level.

    The lower tree gets nodes of one child above its root, so that both roots are on one level. Summaries above the leaves
    come from one more pass over the postings. An empty tree leaves the other one as it is.
    """
    if (index.config.leaf_fanout, index.config.internal_fanout) != (other.config.leaf_fanout, other.config.internal_fanout):
        raise ValueError("fan-outs differ")
    if not other.size or not index.size:
        return index if not other.size else Index(other.units, other.nodes, other.postings, other.labels, index.config, other.height, other.size)
    height = max(index.height, other.height)
    shift = index.config.internal_fanout ** (height - 1)  # leaves under one node of the common level, at most
    moved = other.units.withColumn("leaf_id", F.col("leaf_id") + F.lit(shift).cast("long"))
    laid = keep(index.units.select(*UNITS.fieldNames(), "leaf_id").unionByName(moved.select(*UNITS.fieldNames(), "leaf_id")))
    return summarize(laid, index.config, index.labels)


def append(index: Index, batch: DataFrame) -> Index:
    """The index of old and new units together; leaves of old units may change."""
    return build(index.units.select(*UNITS.fieldNames()).unionByName(batch.select(*UNITS.fieldNames())), index.config, index.labels)


def matching_children(postings: DataFrame, nodes: DataFrame, level: int, labels: set[int] | frozenset[int]) -> DataFrame:
    """(node_id, parent_id, ids) of the nodes of a level with one of the labels (none: any); exact ids unite over the labels."""
    own = postings.where(F.col("level") == level)
    own = own.where(F.col("label_id").isin(sorted(labels))) if labels else own.where("label_id is null")
    ids = own.groupBy("node_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    return ids.join(nodes.where(F.col("level") == level).select("node_id", "parent_id"), "node_id")


def postings_total(postings: DataFrame) -> DataFrame:
    """(label_id, nodes, units) of each list of a level's postings; the list of all labels has a null label."""
    return postings.groupBy("level", "label_id").agg(F.count(F.lit(1)).alias("nodes"), F.sum("unit_count").alias("units"))


def replace_child(postings: DataFrame, level: int, node: int, summary: DataFrame) -> DataFrame:
    """Postings with a node's lists replaced by those of a new summary (label_id, unit_count, ids); labels that it lacks lose theirs."""
    gone = (F.col("level") == level) & (F.col("node_id") == node)
    new = summary.select(F.lit(level).alias("level"), F.lit(node).cast("long").alias("node_id"), "label_id", "unit_count", "ids")
    return postings.where(~gone).unionByName(new)


def lost_labels(before: DataFrame, after: DataFrame) -> DataFrame:
    """(node_id, label_id) of lists that were there before and aren't any more."""
    return before.where("label_id is not null").select("node_id", "label_id").join(after.select("node_id", "label_id"), ["node_id", "label_id"], "left_anti")


def merged_ids(postings: DataFrame, fanout: int) -> DataFrame:
    """(node_id, merged): the sorted id lists of a node's children merged in order, ids that several have repeated."""
    all_of = postings.where("label_id is null").groupBy(parent_of(F.col("node_id"), fanout).alias("node_id"))
    return all_of.agg(F.array_sort(F.flatten(F.collect_list("ids"))).alias("merged"))


def dump_lists(index: Index) -> DataFrame:
    """Lines of the postings of each node in the order of dump_text(): label and count, the list of all labels first."""
    one = F.format_string("%s: %d", F.coalesce(F.col("label_id").cast("string"), F.lit("all")), "unit_count")
    listed = F.array_sort(F.collect_list(F.struct(F.coalesce("label_id", F.lit(-1).cast("long")).alias("label"), one.alias("one"))))
    rows = index.postings.groupBy("level", "node_id").agg(F.array_join(F.transform(listed, lambda x: x["one"]), ", ").alias("lists"))
    return rows.select("level", "node_id", F.concat(F.repeat(F.lit("  "), (F.lit(index.height) - F.col("level")).cast("int")), F.lit("index "), "lists").alias("line"))


def dump_text(index: Index) -> DataFrame:
    """Lines of the tree, from the root down, indented by depth."""
    depth = F.lit(index.height - 1) - F.col("level")
    box = F.format_string("(%.5f, %.5f, %d) - (%.5f, %.5f, %d)", *[F.col(c).cast("double") if c[0] != "t" else F.col(c) for c in BOX])
    return index.nodes.orderBy(F.col("level").desc(), "node_id").select(F.concat(F.repeat(F.lit("  "), depth.cast("int")), F.format_string("node %d: %d entries, %s", F.col("node_id"), F.col("n_entries"), box)).alias("line"))


def leaf_json(units: DataFrame) -> DataFrame:
    """A JSON object for each leaf: its box and points."""
    own = units.groupBy("leaf_id").agg(*unit_extend_agg(), F.array_sort(F.collect_list(F.struct("x0", "y0", "t0"))).alias("points"))
    return own.select("leaf_id", F.to_json(F.struct(F.struct(*BOX).alias("mbb"), "points")).alias("json"))


def dictionary_text(labels: DataFrame) -> DataFrame:
    return labels.orderBy("label_id").select("label_id", "name")


def dictionary_json(labels: DataFrame) -> DataFrame:
    """{name: id, ...} in the order of ids; a dictionary is small by nature."""
    entries = F.array_sort(F.collect_list(F.struct("label_id", "name")))
    return labels.agg(F.to_json(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["name"], e["label_id"])))).alias("json"))


def inspect_node(index: Index, path: list[int]) -> DataFrame:
    """The children of the node that the child numbers lead to, from the root."""
    level, node = index.height - 1, 0
    for child in path:
        level, node = level - 1, node * index.config.internal_fanout + child
        if level < 0:
            raise ValueError("the path leads below the leaves")
    return index.nodes.where((F.col("level") == level - 1) & (F.col("parent_id") == node))


def node_summary(index: Index, level: int, node: int) -> DataFrame:
    return index.postings.where((F.col("level") == level) & (F.col("node_id") == node)).select("label_id", "unit_count")
