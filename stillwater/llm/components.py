"""Connected components of a graph whose vertices have few edges each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_ROWS, cut, small


def smallest_reachable(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Give every vertex the smallest label that it can reach: ``v, label``.

    ``vertices`` has ``v, label`` with distinct labels, ``edges`` has ``a, b``
    (any direction, no loops needed).  Labels are passed to the neighbours
    and then followed (the label of the label's vertex), so a path of n edges
    takes about log n rounds.  Only vertices with edges take part in the
    rounds; each round ends in a checkpoint.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter(F.col("a") != F.col("b")).distinct()
    both = cut(both)
    linked = cut(both.select(F.col("a").alias("v")).distinct())
    start = vertices.join(small(linked), "v").select("v", F.col("label").alias("own"), "label")
    now = cut(start)
    # vertices, labels heard and labels ahead are no more than these
    near_by = F.broadcast if now.count() <= SMALL_ROWS else lambda df: df
    while True:
        heard = both.join(near_by(now.select(F.col("v").alias("b"), "label")), "b").groupBy("a").agg(F.min("label").alias("heard"))
        near = cut(now.join(near_by(heard), now["v"] == heard["a"]).select("v", "own", F.least("label", "heard").alias("label"), F.col("label").alias("before")))
        if near.filter(F.col("label") < F.col("before")).isEmpty():
            break
        # follow: only the labels whose own vertex has a smaller one by now
        ahead = near.filter(F.col("label") < F.col("own")).select(F.col("own").alias("label"), F.col("label").alias("next"))
        now = cut(near.select("v", "own", "label").join(near_by(ahead), "label", "left").select("v", "own", F.coalesce("next", "label").alias("label")))
    found = near.select("v", F.col("label").alias("reached"))
    return vertices.join(near_by(found), "v", "left").select("v", F.coalesce("reached", "label").alias("label"))
