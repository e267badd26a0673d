"""Column lineage as two tables, walked level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "node_id string, step int, action string, column string"
EDGES = "source string, target string, action string, step int"


def record_lineage(spark: SparkSession, steps: list[dict], root_columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a list of steps ``{action, before, after, mapping}``.

    ``mapping`` names the sources of new columns; a column that exists before
    and after a step continues.  Sizes follow the number of steps and columns.
    """
    nodes = [(f"0:{c}", 0, "source", c) for c in root_columns]
    edges = []
    current = {c: f"0:{c}" for c in root_columns}
    for number, step in enumerate(steps, start=1):
        after = {}
        for c in step["after"]:
            node = f"{number}:{c}"
            nodes.append((node, number, step["action"], c))
            sources = step.get("mapping", {}).get(c) or ([c] if c in current else [])
            edges += [(current[s], node, step["action"], number) for s in sources if s in current]
            after[c] = node
        current = after
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def _walk(edges: DataFrame, start: str, forward: bool) -> DataFrame:
    if not forward:
        edges = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    begin = edges.sparkSession.createDataFrame([(start,)], "node string")
    return reachable(edges, begin).select("node", "depth")


def column_lineage(edges: DataFrame, node: str) -> DataFrame:
    """``(node, depth)`` of everything the node comes from."""
    return _walk(edges, node, forward=False)


def impact_analysis(edges: DataFrame, node: str) -> DataFrame:
    """``(node, depth)`` of everything that depends on the node."""
    return _walk(edges, node, forward=True)


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``(start, node, depth)`` for many starts at once; the edges may form cycles.

    Level by level: each step joins only the newest nodes, drops those already
    seen, and is cut so the plan stays short.
    """
    from ..plans.cut import cut

    seen = cut(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth")))
    newest = seen
    level = 0
    while not newest.isEmpty():
        level += 1
        step = newest.join(edges, newest.node == edges.source).select("start", F.col("target").alias("node")).distinct()
        newest = cut(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(level)))
        seen = seen.unionByName(newest)
    return seen
