"""Cutting points for iterative plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that a lost executor costs no earlier round.

    The folder is the session's ``spark.checkpoint.dir``.  Only a local session
    without one gets a temporary folder.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="scrubline-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
