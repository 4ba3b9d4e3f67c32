"""Folders for what a query writes and reads again."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession


@functools.lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="sketchmill-")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the cluster shares (spark.checkpoint.dir). Where that is unset, a temporary folder if everything
    runs in one process, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        root = _own_folder()
    return f"{root.rstrip('/')}/sketchmill/{name}-{uuid.uuid4().hex}"
