"""Lineage cuts for iterative operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder of spark.checkpoint.dir.

    Where none is named, a session in this one process (local, as in tests) gets a folder of its own;
    on a cluster that is an error, for executors would write to their own disks.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="quillmesh-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return df.checkpoint()
