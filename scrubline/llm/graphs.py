"""Connected components of a table of links, in rounds of joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import cut


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    return row[0], row[1]


#: edges that one task of a round takes; a round over fewer has as many tasks as the cluster has cores
TASK_EDGES = 200_000


def _tasks(links: DataFrame, edges: int) -> int:
    return max(links.sparkSession.sparkContext.defaultParallelism, 2, edges // TASK_EDGES)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of (a, b) links; the component is its smallest node.

    Large-star and small-star steps take turns: a node's larger neighbours, then
    its smaller ones, are tied to its smallest.  Each step is a minimum by node
    and a join, so a node with many links is pre-aggregated or split; the number
    of rounds grows with the logarithm of the graph.  The number of tasks follows
    the number of edges, which no round raises, so that the rounds over a small
    graph don't leave hundreds of nearly empty files each.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    tasks = _tasks(links, state[0])
    while state[0]:
        edges = edges.coalesce(tasks)
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").coalesce(tasks).distinct().coalesce(tasks)
        smallest = large.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks)
        small = large.join(smallest, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = cut(small.select("e.a", "e.b").where("a <> b").coalesce(tasks).distinct().coalesce(tasks))
        before, state = state, _state(edges)
        if before == state:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct().coalesce(tasks))


def joined_by(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components of all links so far: those found before, and (a, b) links that came since.

    Only the new links go through the rounds, as links between the components that
    their ends have by now.
    """
    if found is None:
        return cut(components(links))
    of = found.select(F.col("node").alias("n"), F.col("component").alias("c"))
    ends = links.join(of, F.col("a") == F.col("n"), "left").select(F.coalesce("c", "a").alias("a"), "b")
    ends = ends.join(of, F.col("b") == F.col("n"), "left").select("a", F.coalesce("c", "b").alias("b"))
    new = cut(components(ends)).select(F.col("node").alias("n"), F.col("component").alias("c"))
    kept = found.join(new, F.col("component") == F.col("n"), "left").select("node", F.coalesce("c", "component").alias("component"))
    added = new.join(found, F.col("n") == F.col("node"), "left_anti").select(F.col("n").alias("node"), F.col("c").alias("component"))
    tasks = _tasks(links, found.count() + new.count())
    return cut(kept.coalesce(tasks).unionByName(added.coalesce(tasks)))
