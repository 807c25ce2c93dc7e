"""Cutting the lineage of what is worked on in rounds, or read by many branches of a plan."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df from a checkpoint in the shared folder that the cluster names (spark.checkpoint.dir) or that the session has set, so a lost
    executor costs no recomputation. Only on a local master with neither, a temporary folder is made."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="stranda-"))
    return df.checkpoint(eager=True)
