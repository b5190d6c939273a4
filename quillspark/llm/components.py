"""Connected components by alternating large-star and small-star rounds.

Each round is a grouped minimum and a join on the same key; edges are written between
rounds, so a lost executor repeats tasks, not rounds.  Edges never reach the driver.  A node
with very many neighbours is reduced by partial aggregation, and its edges do not meet in one task
of the join either: such hubs are few, and their minima are sent to where the edges are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import discard, small_enough, stored

#: Neighbours that make a node a hub, and the hubs that are sent to every task; were there more (that
#: is over HUB * HUBS edges at hubs), they would take part in the join like other nodes.
HUB, HUBS = 500, 200_000


def join_each(rows: DataFrame, each: DataFrame, key: str) -> DataFrame:
    """``rows`` inner-joined to ``each``, which has a row a key: keys of very many rows do not meet
    in one task, their few rows of ``each`` are sent to where theirs are."""
    hot = stored(rows.groupBy(key).agg(F.count(F.lit(1)).alias("d")).filter(F.col("d") > HUB).select(key), "hot")
    if not hot.limit(1).count() or not small_enough(hot, HUBS):
        return rows.join(each, key)
    few = F.broadcast(each.join(F.broadcast(hot), key, "left_semi"))
    rest = lambda t: t.join(F.broadcast(hot), key, "left_anti")
    return rows.join(few, key).unionByName(rest(rows).join(rest(each), key))


def with_least(rows: DataFrame, every: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows(a, b)`` with ``m``, the smallest of ``a`` and its neighbours in ``every(a, b)``; and
    the scratch table of hubs, to be discarded once the rows are written."""
    least = lambda t: t.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    hubs = every.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("d")).filter(F.col("d") > HUB).select("a", "m")
    hubs = stored(hubs, "hubs")
    if not hubs.limit(1).count() or not small_enough(hubs, HUBS):
        return rows.join(least(every), "a"), hubs
    rest = lambda t: t.join(F.broadcast(hubs.select("a")), "a", "left_anti")
    return rows.join(F.broadcast(hubs), "a").unionByName(rest(rows).join(least(rest(every)), "a")), hubs


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` to ``(node, component)`` for every node of an edge that is not its
    component's smallest node.  Loops and repeated or reversed edges do no harm."""
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    now = stored(now, "edges")
    state = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rows, hubs = with_least(both.filter("b > a"), both)
        large = stored(rows.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        discard(hubs)
        rows, hubs = with_least(large, large)
        small = rows.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        small = stored(small, "edges")
        for done in (now, large, hubs):
            discard(done)
        now = small
        # every node has one edge, to a node that has none: stars, which no round changes
        seen = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(seen) == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = tuple(seen)
    raise RuntimeError("components did not settle")
