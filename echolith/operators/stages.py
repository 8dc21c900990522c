"""Tables that a query uses more than once, kept where every machine can read them again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a session of one machine gets a folder of its own where it is unset, any other one fails."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", sc.master) is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="echolith-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared folder, without a scheme where it is a plain file system."""
    return f"{shared_folder(spark).removeprefix('file:')}/{uuid.uuid4().hex}"


def once(df: DataFrame) -> DataFrame:
    """The rows, worked out once and read back from the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
