"""Where intermediate files go: the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A path not used before, in spark.checkpoint.dir; in a temporary folder only where that is unset and Spark is one process."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "")
    if not folder:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = tempfile.mkdtemp(prefix="lastro-files-")
            atexit.register(shutil.rmtree, _own[context.applicationId], ignore_errors=True)
        folder = _own[context.applicationId]
    return f"{folder}/lastro-files/{name}-{uuid.uuid4().hex}"
