"""Connected components by contraction, all in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drop, save


def components(edges: DataFrame, n: int | None = None) -> DataFrame:
    """edges: a, b (long). Rows (id, comp) for every id of an edge; comp is the component's smallest id.

    Each round links every node to the smallest of itself and its neighbours and contracts
    the graph along these links; labels follow. A star or chain of any size contracts in a few
    rounds, and no row ever holds a node's neighbours. n: tasks that the edges are worth.
    """
    e = save(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), n)
    labels = None
    while not e.isEmpty():
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = save(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("p")), n)
        if labels is None:
            new = up.select("id", F.col("p").alias("comp"))
        else:
            # a label that took part in this round moves on; ids always stay
            new = labels.join(up.withColumnRenamed("id", "comp"), "comp", "left").select("id", F.coalesce("p", "comp").alias("comp"))
        old, labels = labels, save(new, n)
        moved = e.join(up.select(F.col("id").alias("a"), F.col("p").alias("pa")), "a").join(up.select(F.col("id").alias("b"), F.col("p").alias("pb")), "b")
        last, e = e, save(moved.filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), n)
        drop(last, up, *([old] if old is not None else []))
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("comp")).limit(0)
    return labels
