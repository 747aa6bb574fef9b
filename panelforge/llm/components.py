"""Connected components over edge tables of any size, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import discard, joined, stage


def _star(edges: DataFrame, n: int, small: bool) -> DataFrame:
    """Link neighbours of ``u`` to the smallest of ``u`` and its neighbours.

    Small: the neighbours below ``u``, and ``u`` itself. Large: the neighbours above ``u``. The minimum is taken with partial
    aggregation. Nodes with more than a thousandth of all edges are sent to the edges, so a hub's neighbours never meet in a task.
    """
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    links = joined(both, least, ["u"], "n", n if small else 2 * n)
    if small:
        links = links.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
    else:
        links = links.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return links.distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id, component_id`` for every id in ``edges`` (columns ``a``, ``b``): the smallest id that links reach.

    Self links and null ids are left out; ids without a link are not returned. Each step is written to the shared folder; the
    steps end when one leaves every edge as it is.
    """
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    n = now.count()
    while n:
        large = stage(_star(now, n, small=False), "links")
        after = stage(_star(large, large.count(), small=True), "links")
        discard(large)
        m = after.count()
        same = m == n and after.join(now, ["u", "v"], "left_anti").isEmpty()
        discard(now)
        now, n = after, m
        if same:
            break
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(roots)
