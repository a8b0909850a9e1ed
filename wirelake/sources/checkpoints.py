"""The shared folder for checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """A local session without spark.checkpoint.dir gets a temporary folder; a cluster must name a shared one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="wirelake-checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder: its plan ends there, and lost executors cost nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def cut_plain(df: DataFrame) -> DataFrame:
    """cut() that carries no inferred constraints along, for loops over unions.

    A checkpoint keeps its plan's constraints, and a union joins its sides' constraints by OR: in a loop they double each round.
    """
    conf, key = df.sparkSession.conf, "spark.sql.constraintPropagation.enabled"
    before = conf.get(key)
    conf.set(key, "false")
    try:
        return cut(df)
    finally:
        conf.set(key, before)
