"""Session helpers."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("facetry")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``checkpoint()`` usable.

    The folder named by ``spark.checkpoint.dir`` is used.  Only a local session
    that names none gets a temporary one: on a cluster a machine-local folder
    would be lost with its machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="facetry-checkpoint-")
    context.setCheckpointDir(folder)


#: Spark's limit on what a task sends to Python at once, and the value that ``bound_batches`` gives it.
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 1 << 22


def bound_batches(spark: SparkSession) -> None:
    """Let batches of long texts have few rows, unless the session says how many bytes they may have.

    Otherwise 10,000 rows go together, up to 64 MB, which are held on both sides at a time.
    """
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on the workers, which model hooks need.

    Not needed where the package is installed on every machine.
    """
    root = os.path.dirname(os.path.abspath(__file__))
    if any("facetry-package" in name for name in spark.sparkContext.listFiles):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="facetry-"), "facetry-package")
    path = shutil.make_archive(archive, "zip", os.path.dirname(root), os.path.basename(root))
    spark.sparkContext.addPyFile(path)
