"""Bounded expansion, shortest paths and reachability on edge tables."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.scalar import clamp, joined_key
from ..schema import MAX_DEPTH


def touching(edges: DataFrame | Callable[[DataFrame, str], DataFrame], nodes: DataFrame, end: str = "src") -> DataFrame:
    """Edges whose ``end`` is one of ``nodes`` (node). Edges may be a function of these two, where all of them are too many to be made."""
    nodes = nodes.select("node").distinct()
    return edges(nodes, end) if callable(edges) else edges.join(nodes.withColumnRenamed("node", end), end, "left_semi").select(*edges.columns)


def trails(edges: DataFrame | Callable[[DataFrame, str], DataFrame], start: str, depth: int = 1, kind: str | None = None) -> DataFrame:
    """All directed trails (no edge twice) of 1 to ``depth`` edges from a node: ``length``, ``nodes``, ``kinds``, ``edges``.

    Edges are filtered to the last nodes of the level before, and each level is
    written, as it is read for these, for the next level and for the result.
    """
    depth = clamp(depth, 0, MAX_DEPTH)
    spark = SparkSession.active()
    if depth == 0:
        return spark.createDataFrame([(0, [start], [], [])], "length int, nodes array<string>, kinds array<string>, edges array<string>")

    def near(nodes: DataFrame) -> DataFrame:
        own = touching(edges, nodes)
        return (own if kind is None else own.where(F.col("type") == kind)).select("src", "dst", "type", joined_key("src", "type", "dst").alias("edge"))

    level = near(spark.createDataFrame([(start,)], "node string")).select(F.lit(1).alias("length"), F.array("src", "dst").alias("nodes"), F.array("type").alias("kinds"), F.array("edge").alias("edges"), F.col("dst").alias("last"))
    levels = [level]
    for k in range(2, depth + 1):
        levels[-1] = level = checkpointed(level)  # it is read for its last nodes, the next level and the result
        own = near(level.select(F.col("last").alias("node")))
        level = level.join(own, (F.col("last") == F.col("src")) & ~F.array_contains("edges", F.col("edge"))).select(F.lit(k).alias("length"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("kinds", F.array("type")).alias("kinds"), F.concat("edges", F.array("edge")).alias("edges"), F.col("dst").alias("last"))
        levels.append(level)
    return reduce(DataFrame.unionByName, levels).drop("last")


def first_trails(edges: DataFrame, start: str, depth: int = 1, kind: str | None = None, limit: int = 100) -> DataFrame:
    """The first ``limit`` rows of ``trails`` by length, nodes and kinds, without the others being made.

    A level that fills what is left of the limit is the last one, so at most
    ``limit`` trails are ever expanded, each by its first edges only: as many
    as are still wanted, and those that it may have used already.  The first
    edges of a node with very many are cut in each task before they meet.
    """
    level = SparkSession.active().createDataFrame([([start], [], [], start)], "nodes array<string>, kinds array<string>, edges array<string>, last string")
    out, left = None, limit
    for k in range(1, clamp(depth, 0, MAX_DEPTH) + 1):
        near = touching(edges, F.broadcast(level.select(F.col("last").alias("node")).distinct()))  # ``limit`` rows at most
        near = near if kind is None else near.where(F.col("type") == kind)
        near = near.select("src", "dst", "type", joined_key("src", "type", "dst").alias("edge")).withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy("dst", "type"))).where(F.col("n") < left + k)
        step = near.join(F.broadcast(level), (F.col("last") == F.col("src")) & ~F.array_contains("edges", F.col("edge")))
        step = step.select(F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("kinds", F.array("type")).alias("kinds"), F.concat("edges", F.array("edge")).alias("edges"), F.col("dst").alias("last"))
        level = checkpointed(step.orderBy(F.array_join("nodes", "|"), F.array_join("kinds", "|")).limit(left))
        one = level.select(F.lit(k).alias("length"), "nodes", "kinds", "edges")
        out, left = one if out is None else out.unionByName(one), left - level.count()
        if left <= 0:
            break
    return out


def traverse(entities: DataFrame, edges: DataFrame, start: str, depth: int = 1, kind: str | None = None, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Entities and relations on the first ``limit`` trails (shortest first, then by nodes). Depth 0 is the start alone; a start without edges gives nothing."""
    depth = clamp(depth, 0, MAX_DEPTH)
    if depth == 0:
        none = SparkSession.active().createDataFrame([], "node string")
        return entities.where(F.col("id") == start), touching(edges, none)
    top = first_trails(edges, start, depth, kind, limit)
    nodes = top.select(F.explode("nodes").alias("id")).distinct()
    used = top.select(F.explode("edges").alias("edge")).distinct()
    first = top.select(F.explode(F.slice("nodes", F.lit(1), F.size("nodes") - 1)).alias("node")).distinct()  # first ends of the edges
    keyed = touching(edges, first).withColumn("edge", joined_key("src", "type", "dst"))
    return entities.join(nodes, "id", "left_semi"), keyed.join(used, "edge", "left_semi").drop("edge")


def shortest_path(edges: DataFrame, start: str, end: str, depth: int = MAX_DEPTH) -> DataFrame:
    """At most one row (length, path): the shortest directed path of at most ``depth`` edges; of several, the least by its text.

    Two frontiers, one from each end, of which the smaller is expanded, until
    they meet.  Each keeps one row per node, its least path, and drops nodes
    that it has met before, so neither has more rows than the graph has nodes.
    The last step looks only for nodes of the other frontier.
    """
    depth = clamp(depth, 1, MAX_DEPTH)
    spark = SparkSession.active()
    if start == end:
        node = spark.createDataFrame([(start,)], "node string")
        return touching(edges, node).select("src").union(touching(edges, node, "dst").select("src")).limit(1).select(F.lit(0).alias("length"), F.lit(start).alias("path"))
    sides = []
    for node, near, far in ((start, "src", "dst"), (end, "dst", "src")):
        first = spark.createDataFrame([(node, node)], "node string, path string")
        sides.append({"frontier": first, "seen": first.select("node"), "n": 1, "near": near, "far": far})
    for k in range(1, depth + 1):
        this, other = sorted(sides, key=lambda x: x["n"])
        step = touching(edges, this["frontier"], this["near"]).select(F.col(this["near"]).alias("node"), F.col(this["far"]).alias("far"))
        if k == depth:
            step = step.join(other["frontier"].select(F.col("node").alias("far")), "far", "left_semi")
        longer = F.concat_ws(">", "path", "far") if this["near"] == "src" else F.concat_ws(">", "far", "path")
        made = this["frontier"].join(step, "node").groupBy("far").agg(F.min(longer).alias("path")).select(F.col("far").alias("node"), "path")
        this["frontier"] = checkpointed(made.join(this["seen"], "node", "left_anti"))
        forward, back = (side["frontier"] for side in sides)
        behind = back.select("node", F.expr("substring(path, length(node) + 1)").alias("rest"))
        hit = forward.join(behind, "node").select(F.lit(k).alias("length"), F.concat("path", "rest").alias("path"))
        hit = checkpointed(hit.orderBy("path").limit(1))
        if k == depth or not hit.isEmpty():
            return hit
        this["seen"], this["n"] = this["seen"].union(this["frontier"].select("node")), this["frontier"].count()
        if not this["n"]:
            return hit


def reachable(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that can be reached from ``roots`` (node) over ``edges`` (src, dst), roots included, however far.

    One parent of each node makes a forest (or rings): there each node points
    to its parent, then to that one's pointer and so on, so chains of any
    length take a logarithm of rounds.  Edges from other parents are followed
    by a frontier, from which the pointers are doubled again.
    """
    pairs = checkpointed(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    parent = pairs.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("up"))
    others = pairs.join(parent, (F.col("dst") == F.col("node")) & (F.col("src") != F.col("up"))).select("src", "dst")
    pointers = checkpointed(parent.unionByName(pairs.select(F.col("src").alias("node")).distinct().join(parent, "node", "left_anti").select("node", F.lit(None).cast("string").alias("up"))))
    most = pointers.count().bit_length() + 1
    seen = checkpointed(roots.select("node").distinct())
    new = seen
    while True:
        state = pointers.join(seen.select("node", F.lit(True).alias("met")), "node", "left").select("node", "up", F.coalesce("met", F.lit(False)).alias("met"))
        for _ in range(most):  # rings have no end
            state = checkpointed(state)
            if state.where("up IS NOT NULL AND NOT met").isEmpty():
                break
            above = state.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("met").alias("met_above"))
            state = state.join(above, "up", "left").select("node", F.when(~F.col("met"), F.col("next")).alias("up"), (F.col("met") | F.coalesce("met_above", F.lit(False))).alias("met"))
        before, seen = seen, checkpointed(seen.union(state.where("met").select("node")).distinct())
        new = seen.join(before, "node", "left_anti").union(new)
        new = checkpointed(others.join(new.distinct(), others["src"] == F.col("node"), "left_semi").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
        if new.isEmpty():
            return seen
        seen = seen.union(new)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark is one process."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="graphloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree) over both directions."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def isolated(entities: DataFrame, edges: DataFrame) -> DataFrame:
    return entities.join(edges.select(F.explode(F.array("src", "dst")).alias("id")), "id", "left_anti")
