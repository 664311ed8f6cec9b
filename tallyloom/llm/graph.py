"""Connected components of a table of links by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import staged


#: Links that a task writes in a round.
LINKS = 200_000


def components(links: DataFrame) -> DataFrame:
    """(v, label): for every vertex of links (a long, b long) the smallest vertex that it is connected to.

    A round links the larger neighbours of every vertex to the least around it, then every vertex with its smaller
    neighbours to the least of these. Neither adds links or changes what is connected. Rounds go on until the links stay
    the same, which are then stars around the smallest vertices; stars end at once, and paths in about as many rounds as
    the logarithm of their length, whatever the order of their ids. An empty table gives an empty table; links to itself
    and repeated links do no harm.
    """
    ends = staged(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    parts = max(8, -(-ends.count() // LINKS))  # no round adds links, so each is written by as many tasks as these need
    stars = ends.where("hi > lo")
    digest = [F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))]
    was = (0, None)
    while was != (now := tuple(stars.agg(*digest).first())):
        was = now
        both = stars.select(F.col("hi").alias("v"), F.col("lo").alias("w")).union(stars.select("lo", "hi"))
        least = both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("least"))
        large = staged(both.where("w > v").join(least, "v").select(F.col("w").alias("hi"), F.col("least").alias("lo")).distinct().coalesce(parts))
        least = large.groupBy("hi").agg(F.min("lo").alias("least"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct("hi", "least"), F.struct(F.col("lo").alias("hi"), "least"))).alias("x"))
        stars = staged(small.select("x.hi", F.col("x.least").alias("lo")).where("hi > lo").distinct().coalesce(parts))
    every = stars.union(ends.select("lo", "lo")).union(ends.select("hi", "hi"))
    return every.groupBy(F.col("hi").alias("v")).agg(F.min("lo").alias("label"))
