"""Session plumbing shared by the graph and vector operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []
#: Rows up to which a side may be broadcast after its rows were counted.
BROADCAST_ROWS = 50_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster shares. One is made only where none is set and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _made:
        _made.append("file://" + tempfile.mkdtemp(prefix="graphvec-"))
    return _made[0]


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` stored in the checkpoint folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
