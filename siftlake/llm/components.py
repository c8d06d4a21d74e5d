"""Connected components by contraction, over edge tables of any size.

Defined results: edges may repeat, in either direction, and lead from a node to itself, which adds nothing; nodes are whole
numbers, and rows with a null end are no edges; a table without edges gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm import common


def roots(edges: DataFrame) -> DataFrame:
    """node and root for every node of edges (a, b): nodes are connected if their roots are equal.

    In each round every node joins the neighbour that comes first in an order drawn anew for the
    round, edges are carried over to what their ends joined, and edges within one node go; so the
    graph shrinks by a fixed share a round, whatever its shape, until no edge is left. Tables are written and read again
    each round. Minima are pre-aggregated before the shuffle; joins on a hub are left
    to adaptive execution, which splits them.
    """
    spark = edges.sparkSession
    folder = f"{common.checkpoint_dir(spark)}/roots-{uuid.uuid4()}"
    edges, left = common.written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{folder}/edges")
    found, turn = None, 0
    while left:
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        order = lambda name: F.struct(F.xxhash64(F.col(name), F.lit(turn)).alias("o"), F.col(name).alias("n"))  # noqa: B023, E731
        joined = both.groupBy("node").agg(F.min(order("other")).alias("best")).select("node", F.least(order("node"), "best")["n"].alias("to"))
        joined, _ = common.written(joined, f"{folder}/joined-{turn}")
        if found is None:
            found = joined.select("node", F.col("to").alias("root"))
        else:
            moved = joined.select(F.col("node").alias("root"), "to")
            found = found.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        found, _ = common.written(found, f"{folder}/found-{turn}")
        ends = lambda name: joined.select(F.col("node").alias(name), F.col("to").alias(f"{name}_to"))  # noqa: B023, E731
        carried = edges.join(ends("a"), "a").join(ends("b"), "b").where("a_to <> b_to")
        edges, left = common.written(carried.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), f"{folder}/edges-{turn}")
        for before in [f"joined-{turn}", *([f"found-{turn - 1}", f"edges-{turn - 1}"] if turn else ["edges"])]:
            common.removed(spark, f"{folder}/{before}")
        turn += 1
    kept = common.checkpointed(found if found is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root")))
    common.removed(spark, folder)
    return kept
