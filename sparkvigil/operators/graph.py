"""Connected components and bounded paths over edge tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_own: list[str] = []


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the folder of spark.checkpoint.dir and read again: lineage ends, and lost executors lose nothing."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.conf.get("spark.master", "local").split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="sparkvigil-"))
        root = _own[0]
    path = f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node of its component.

    Each round every node takes the least root among its own and its neighbours', then the root of that root, so
    that distances halve; it ends when a round changes nothing. Links to itself count as nodes, null ends not at all.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null").distinct()
    both = written(both, "edges")
    now = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "roots")
    for _ in range(rounds):
        # merged: tables of nodes are shuffled and never sent to the driver, at any size
        near = both.join(now.hint("merge"), both["b"] == now["node"]).groupBy("a").agg(F.min("root").alias("near"))
        step = now.join(near.hint("merge"), now["node"] == near["a"]).select("node", F.least("root", "near").alias("root"))
        up = now.select(F.col("node").alias("of"), F.col("root").alias("up"))
        after = written(step.join(up.hint("merge"), step["root"] == up["of"]).select("node", F.least("root", "up").alias("root")), "roots")
        changed = after.join(now.withColumnRenamed("root", "was").hint("merge"), "node").where("root <> was").isEmpty()
        now = after
        if changed:
            return now
    raise RuntimeError(f"components didn't settle in {rounds} rounds")


def dependency_paths(edges: DataFrame, max_hops: int = 4) -> DataFrame:
    """(src, dst, hops, path): for each pair within ``max_hops``, the shortest path, the least among equals.

    ``edges`` holds (src, dst). A node's path to itself is [node], of 0 hops; no path repeats a node. Each hop's
    front is written, so that a hop's plan holds none of the hops before.
    """
    links = edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct()
    nodes = links.select("src").unionByName(links.select(F.col("dst").alias("src"))).distinct()
    links = written(links, "links")
    found = front = written(nodes.select("src", F.col("src").alias("dst"), F.lit(0).alias("hops"), F.array("src").alias("path")), "front")
    for hop in range(1, max_hops + 1):
        step = front.join(links.select(F.col("src").alias("dst"), F.col("dst").alias("to")), "dst").where(~F.array_contains("path", F.col("to")))
        step = step.select("src", F.col("to").alias("dst"), F.concat("path", F.array("to")).alias("path")).groupBy("src", "dst").agg(F.min("path").alias("path"))
        front = written(step.join(found.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", F.lit(hop).alias("hops"), "path"), "front")
        found = found.unionByName(front)
    return found
