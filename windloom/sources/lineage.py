"""Tables that iterative operators read again: written to the folder that the cluster shares, so plans stay short and a lost executor costs nothing."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(rows: DataFrame) -> DataFrame:
    """The rows as a checkpoint in ``spark.checkpoint.dir``; a folder of its own only where that is unset and Spark is one process (tests)."""
    sc = rows.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="windloom-"))
    return rows.checkpoint()
