"""Connected components of a link table, by alternating large-star and small-star rounds.

Each round rewrites links so that they point at smaller nodes, and ends when
every node points straight at the smallest node of its component.  A round is
two grouped minima (combined before their shuffles) and two equi-joins; nothing
is gathered in one task or on the driver.  A node with very many links makes a
skewed join partition, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.staging import remove, staged


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = links.select("hi", "lo").unionByName(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = both.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("least"))
    least = least.select("node", F.least("least", "node").alias("least"))
    larger = links.select(F.col("lo").alias("node"), F.col("hi").alias("larger"))
    return larger.join(least, "node").select(F.col("larger").alias("hi"), F.col("least").alias("lo")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("hi").agg(F.min("lo").alias("least"))
    others = links.join(least, "hi").filter("lo <> least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
    return least.select("hi", F.col("least").alias("lo")).unionByName(others).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node that has a link. ``links``: two columns of longs, in either order.

    Links of a node to itself and repeated links do no harm; links with a null
    end are left out; no links give no rows.
    """
    a, b = (F.col(name) for name in links.columns)
    now = links.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    now = staged(now, "links")
    before, state = None, _state(now)
    while state != before:
        after = staged(_small_star(_large_star(now)), "links")
        remove(now)
        now, before, state = after, state, _state(after)
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
