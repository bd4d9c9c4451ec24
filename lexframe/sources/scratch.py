"""Folders for written intermediates."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: Used only on a single machine whose session names no shared folder, as in tests.
LOCAL_SCRATCH = "file:///tmp/checkpoints"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared spark.checkpoint.dir.

    Without that setting a local session takes a folder of its machine; on a cluster, whose executors would each write
    to their own disk, it is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.conf.get("spark.master", None) or ""
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = LOCAL_SCRATCH
    return f"{top.rstrip('/')}/lexframe/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
