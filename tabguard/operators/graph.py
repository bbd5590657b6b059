"""Connected components in DataFrames, and cutting lineage in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints: spark.checkpoint.dir; only where that is unset (local tests) one of this machine."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tabguard-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Nodes (16 bytes each) up to which where they go is broadcast, and parts into which, beyond that, nodes with the same goal are split.
BROADCAST_NODES, SALTS = 500_000, 8


def _looked_up(df: DataFrame, key: str, spread: str, table: DataFrame, value: str, few: bool) -> DataFrame:
    """df with the value that table has for each key; a frequent key fills no task."""
    table = table.toDF(key, value)
    if few:
        return df.join(F.broadcast(table), key, "left")
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    copies = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("salt", salt).join(copies, [key, "salt"], "left").drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """node and label, the least node of its component, for the nodes of edges (a, b).

    In each round every node goes to its least neighbour, and on to that one's, and the
    graph is contracted: edges inside a contracted node are dropped, so the rounds get
    smaller. The links between nodes and where they went stay as edges until they agree.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    labels = None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("node", "to")
        near = cut(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("up")))
        few = near.count() <= BROADCAST_NODES
        hint = F.broadcast if few else lambda x: x
        goals = near if few else near.join(near.select("up").distinct().withColumnRenamed("up", "node"), "node", "left_semi")
        moved = cut(_looked_up(near, "up", "node", goals, "next", few).select("node", F.col("next").alias("up")))
        if labels is None:
            labels = moved.select("node", F.col("up").alias("label"))
        else:
            labels = cut(_looked_up(labels, "label", "node", moved, "up", few).select("node", F.coalesce("up", "label").alias("label")))
        ends = edges.join(hint(moved.toDF("a", "x")), "a").join(hint(moved.toDF("b", "y")), "b").select("x", "y")
        # where a node went may itself have gone on
        heads = moved.select("up").distinct().join(hint(moved.toDF("up", "next")), "up").select(F.col("up").alias("x"), F.col("next").alias("y"))
        rest = ends.union(heads).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        edges = cut(rest.distinct())
        if not edges.limit(1).count():
            return labels
