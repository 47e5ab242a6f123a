"""Graph operators on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.session import written


def undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Both directions of every edge once, without loops."""
    one = edges.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src != dst").distinct()


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, component), the component being its least node. Large-star and small-star steps in turn: the number of
    rounds grows with the logarithm of the longest path, every step is a shuffle-and-aggregate of at most the edges, and
    its result is a written table, so a lost executor repeats one step only. Nodes without a partner aren't listed."""
    edge = written(undirected(edges, a, b).where("src > dst"), "cc")
    nodes = edge.select(F.col("src").alias("node")).unionByName(edge.select(F.col("dst").alias("node"))).distinct()
    before = None
    for _ in range(rounds):
        # large star: neighbours above a node are linked to its least neighbour (or itself)
        both = edge.unionByName(edge.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src > dst").distinct()
        # small star: neighbours below a node, and the node, are linked to the least of them
        low = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(low, "src").where("dst != m").select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(low.select("src", F.col("m").alias("dst"))).where("src > dst").distinct()
        edge = written(small, "cc")
        state = edge.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("src", "dst")).alias("h")).head()
        if before == tuple(state):
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return nodes.join(edge.select(F.col("src").alias("node"), "dst"), "node", "left").select("node", F.coalesce("dst", "node").alias("component"))


def degrees(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, degree, centrality): centrality is the degree over the other nodes."""
    deg = undirected(edges, a, b).groupBy("src").agg(F.count("*").alias("degree"))
    total = deg.agg(F.count("*").alias("n"))
    return deg.join(F.broadcast(total)).select(F.col("src").alias("node"), "degree", F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(F.lit(0.0)).alias("centrality"))


def reach(edges: DataFrame, a: str, b: str, start: DataFrame, hops: int) -> DataFrame:
    """(node, hop): nodes that can be reached along the edges from ``start`` (column node), with the least hop; the start
    nodes have hop 0. Frontiers are written after each hop."""
    step = edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct()
    seen = start.select("node", F.lit(0).alias("hop")).distinct()
    front = seen
    for hop in range(1, hops + 1):
        new = front.join(step, "node").select(F.col("next").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        front = written(new.withColumn("hop", F.lit(hop)), "reach")
        seen = seen.unionByName(front)
    return seen


def propagated(edges: DataFrame, a: str, b: str, weight: str, start: DataFrame, hops: int, decay: float) -> DataFrame:
    """(node, strength): strength 1 at the start nodes, passed along edges times weight and ``decay`` for a bounded number
    of hops, summed where paths meet."""
    step = edges.groupBy(F.col(a).alias("node"), F.col(b).alias("next")).agg(F.max(weight).alias("w"))
    front = start.select("node", F.lit(1.0).alias("s")).distinct()
    parts = [front]
    for _ in range(hops):
        front = written(front.join(step, "node").groupBy("next").agg(F.sum(F.col("s") * F.col("w") * decay).alias("s")).withColumnRenamed("next", "node"), "wave")
        parts.append(front)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("node").agg(F.sum("s").alias("strength"))


def clusters(members: DataFrame, facts: DataFrame, key: str, value: str) -> DataFrame:
    """Summary per component (column component, member node): size, least and mean of a fact joined by node."""
    rows = members.join(facts.select(F.col(key).alias("node"), F.col(value).alias("v")), "node", "left")
    return rows.groupBy("component").agg(F.count("*").alias("size"), F.min("node").alias("hub"), F.avg("v").alias("mean"))


def profiles(df: DataFrame, who: str, features: list[tuple[str, object]]) -> DataFrame:
    """One row per ``who`` with named aggregates (name, Column)."""
    return df.groupBy(who).agg(*[c.alias(n) for n, c in features])
