"""Reading the document tables, and where checkpoints go."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Short rows for a part of a checkpoint.
PART_ROWS = 50_000


def checkpointed(df: DataFrame, rows: int | None = None, each: int = PART_ROWS) -> DataFrame:
    """df with its lineage cut, in the folder named by spark.checkpoint.dir.

    Where that setting is missing a local session uses a temporary folder; on a cluster it is an error.
    Every part is a file, and to write one to a local folder Hadoop begins several processes. Where `rows` says how
    many rows df has or is made from at most, it gets no more parts than one for `each` of them, or one for each core.
    """
    context = df.sparkSession.sparkContext
    if rows is not None:
        df = df.coalesce(max(context.defaultParallelism, -(-rows // each)))
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="logloom-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
