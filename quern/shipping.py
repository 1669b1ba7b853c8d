"""Making a session fit for functions in Python workers: the package goes to the executors, Arrow batches are bounded."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Rows and bytes of an Arrow batch, where the session sets none: texts can be long, and each task holds some batches.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def ensure(spark: SparkSession) -> SparkSession:
    """The session, whose workers can import the package; it is sent once for each Spark context.

    Spark's own file server hands the archive to executors; the driver's copy stays until it ends.
    """
    context = spark.sparkContext
    given = spark.conf.getAll
    for name, value in BATCHES.items():
        if name not in given:
            spark.conf.set(name, value)
    if not getattr(context, "_quern_sent", False):
        package = Path(__file__).parent
        folder = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = f"{folder}/quern_package.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for path in sorted(package.rglob("*.py")):
                z.write(path, path.relative_to(package.parent))
        context.addPyFile(archive)
        context._quern_sent = True
    return spark
