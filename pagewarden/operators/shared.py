"""Lineage cut by files in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """A DataFrame written to spark.checkpoint.dir and read from there; where that is unset, to a folder in the warehouse, or in local mode a temporary one."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        alone = re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master)
        spark.sparkContext.setCheckpointDir(named or (tempfile.mkdtemp(prefix="pagewarden-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/pagewarden-work"))
    return df.checkpoint()


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that is shuffled as the other one is, never broadcast: Spark judges it by the compressed files it comes from."""
    return df.hint("merge")
