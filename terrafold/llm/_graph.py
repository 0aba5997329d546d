"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations and two joins over the edge list, each written to a table
in the shared scratch folder. Joins therefore read both sides from tables, and adaptive
execution can split a hub's edges among tasks. Nothing is gathered on the driver but a row
count and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import drop, stored


#: Edges to a task: small graphs take few tasks, whatever the session's number of shuffle partitions.
_EDGES, _LEAST_TASKS = 100_000, 8


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of about ``rows`` rows in as few tasks as hold them, eight at least."""
    return df.coalesce(max(_LEAST_TASKS, rows // _EDGES))


def _checksum(df: DataFrame) -> tuple:
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame, tag: str = "cc", rows: int | None = None) -> DataFrame:
    """``edges(a, b)`` of longs, about ``rows`` of them if that is known -> ``(node, component)``: the smallest node reachable.

    Loops and repeated edges are allowed. Nodes without an edge to another node are
    not in the result. An empty input gives an empty result.
    """
    spark = edges.sparkSession
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path = stored(pairs if rows is None else few(pairs, rows), tag)
    seen = _checksum(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least, path_1 = stored(few(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), seen[0]), tag)
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # every node below its neighbours also points to its own least neighbour
        large, path_2 = stored(large.unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).distinct().transform(few, seen[0]), tag)
        down, path_3 = stored(few(large.groupBy("a").agg(F.min("b").alias("m")), seen[0]), tag)
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        after, new_path = stored(few(small.unionByName(down.select("a", F.col("m").alias("b"))).distinct(), seen[0]), tag)
        for used in (path_1, path_2, path_3):
            drop(spark, used)
        check = _checksum(after)
        drop(spark, path)
        now, path = after, new_path
        if check == seen:
            break
        seen = check
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return few(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots), 2 * seen[0])
