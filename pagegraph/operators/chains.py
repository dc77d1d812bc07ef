"""Ends of chains in which every node has one follower, by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegraph.session import checkpointed


def single_steps(steps: DataFrame, key: str, node: str, follower: str) -> DataFrame:
    """``key, node, next``: the greatest follower of each node, steps to itself left out."""
    rows = steps.select(F.col(key).alias("key"), F.col(node).alias("node"), F.col(follower).alias("next"))
    rows = rows.where("key is not null and node is not null and next is not null and next <> node")
    return rows.groupBy("key", "node").agg(F.max("next").alias("next"))


def _doubled(steps: DataFrame, enough: int | None) -> tuple[DataFrame, DataFrame]:
    """Rows ``key, node, cur`` that have come to an end, and those that go on.

    In round r every row learns its 2**r-th follower from the row of its 2**(r-1)-th. Rows at a node
    without follower rest, and are kept as what others read. A finite chain loses a row in every round,
    so when no row comes to its end any more all that go on are on rings or lead to one. With ``enough``
    rounds go on until that many steps are made.
    """
    now = checkpointed(steps.select("key", "node", F.col("next").alias("cur"), F.lit(True).alias("moving")))
    made, before = 1, None
    while True:
        moving = now.where("moving")
        ahead = now.select("key", F.col("node").alias("cur"), F.col("cur").alias("then"))
        hop = moving.select("key", "node", "cur").join(ahead, ["key", "cur"], "left")
        hop = hop.select("key", "node", F.coalesce("then", "cur").alias("cur"), F.col("then").isNotNull().alias("moving"))
        now = checkpointed(now.where("not moving").unionByName(hop))
        made *= 2
        left = now.where("moving").count()
        if left == 0 or (made >= enough if enough is not None else left == before):
            return now.where("not moving").drop("moving"), now.where("moving").drop("moving")
        before = left


def chain_ends(steps: DataFrame) -> DataFrame:
    """``key, node, end, last``: where the chain of each node leads, and the node before it comes back.

    ``steps`` has one row ``key, node, next`` per node, see :func:`single_steps`. A chain that ends gives
    its end twice. One that runs into a ring gives, as ``end``, the first node of the ring it meets (a
    node of the ring: itself) and, as ``last``, the node of the ring before that one. Rounds are as many
    as the doublings of the longest chain, and as many again for rings; each round joins the rows that
    still move once.
    """
    ended, moving = _doubled(steps, None)
    ended = ended.select("key", "node", F.col("cur").alias("end"), F.col("cur").alias("last"))
    count = moving.count()
    if not count:
        return ended
    # followers of these rows are among these rows; after as many steps as there are rows all are on rings
    own = checkpointed(steps.join(moving.select("key", "node"), ["key", "node"], "left_semi"))
    _, around = _doubled(own, count)
    ring = checkpointed(around.select("key", F.col("cur").alias("node")).distinct())
    before = own.join(ring, ["key", "node"]).select("key", F.col("next").alias("end"), F.col("node").alias("last"))
    on_ring = ring.select("key", "node", F.col("node").alias("end"))
    # without the steps of its ring a tail ends where it meets it
    tails = own.join(ring, ["key", "node"], "left_anti")
    to_ring = on_ring if tails.isEmpty() else on_ring.union(_doubled(tails, None)[0])
    return checkpointed(ended.unionByName(to_ring.join(before, ["key", "end"]).select("key", "node", "end", "last")))
