"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import delete, written


def _state(df: DataFrame) -> tuple:
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of BIGINT nodes to rows (node, root).

    ``root`` is the smallest node of the component, in signed order; it has a
    row of its own. Nodes without an edge to another node don't appear: null
    ends, loops and repeated edges add nothing, and no edges give no rows.

    Every round links each node's larger neighbours to its smallest one, then
    its smaller neighbours likewise, until nothing changes; the rounds grow
    with the logarithm of a component's diameter. A hub's edges are only ever
    pre-aggregated (``min``) or joined from a written table, which adaptive
    execution splits when skewed; nothing is gathered per node.
    """
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now, path = written(ordered.distinct(), "edges")
    state, old = _state(now), []
    while state[0]:
        both = now.union(now.select("v", "u").toDF("u", "v"))
        least, p1 = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large, p2 = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        down, p3 = written(large.groupBy("u").agg(F.min("v").alias("m")), "down")
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        then, p4 = written(small.union(down.toDF("u", "v")).distinct(), "edges")
        new = _state(then)
        for p in (path, p1, p2, p3):
            delete(edges.sparkSession, p)
        now, path = then, p4
        if new == state:
            break
        state = new
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.toDF("node", "root").union(roots.select("node", F.col("node").alias("root")))
