"""Files in the folder that driver and executors share, as tasks open them."""

from __future__ import annotations

import atexit
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

from quern.llm.common import gone, shared_dir


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; pyarrow knows local paths, hdfs, s3, gs and abfs."""
    return fs.FileSystem.from_uri(uri)


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path of its own in the shared folder (spark.checkpoint.dir, or the warehouse's where it is unset); it goes when the
    driver ends."""
    if not shared_dir(spark):
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    path = f"{shared_dir(spark).rstrip('/')}/{kind}/{uuid.uuid4().hex}"
    atexit.register(gone, spark, path)
    return path
