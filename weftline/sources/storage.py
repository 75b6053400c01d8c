"""A folder that all executors share, for files that a query writes and reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where that is unset and Spark runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="weftline-"))
    return sc.getCheckpointDir()


def work_dir(spark: SparkSession) -> str:
    """A new folder in the shared one, as a path of the file system that is mounted; removed when the driver ends.

    Formats of a single ordered file are written by the driver, so the folder must be one that it can open.
    """
    parts = urlsplit(shared_dir(spark))
    if parts.scheme not in ("", "file"):
        raise ValueError(f"single files cannot be written to {parts.scheme}: mount the folder of spark.checkpoint.dir")
    folder = Path(parts.path, f"files-{uuid.uuid4().hex}")
    folder.mkdir(parents=True)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return str(folder)
