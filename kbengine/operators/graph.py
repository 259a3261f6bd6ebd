"""Connected components by shrinking labels, for groups of names and drafts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for intermediate tables; a session with a local master gets one of its own once."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="kbengine-"))
    return shared_dir(spark)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the cluster's shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table, written once to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/kbengine/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, root: the least node of each component. ``edges`` has a, b; ``nodes`` has node and adds lone ones."""
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        step = checkpointed(step.join(jump, "root", "left").select("node", F.least("root", F.coalesce("further", "root")).alias("root"), "old"))
        labels = step.select("node", "root")
        if step.where("root != old").isEmpty():
            break
    if nodes is None:
        return labels
    return nodes.select("node").distinct().join(labels, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
