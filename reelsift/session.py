"""Session construction and settings that every entry point shares."""

from __future__ import annotations

import os
import tempfile

from pyarrow import fs
from pyspark.sql import SparkSession

from reelsift.errors import ConfigurationError


def get_spark(app: str = "reelsift", cores: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session for tests, the benchmark and notebooks; clusters bring their own."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", "8m")  # some frames at a time, not seventy
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("REELSIFT_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def replace_file(files: fs.FileSystem, temp: str, final: str) -> None:
    """Moves a complete file to its name; stores that don't replace lose the one of an earlier try, which holds the same."""
    try:
        files.move(temp, final)
    except OSError:
        files.delete_file(final)
        files.move(temp, final)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that setting is absent and all work is done on this machine
    (tests) a temporary folder is made, and the context is told of it, so
    ``checkpoint()`` works as well. On a cluster it is a ``ConfigurationError``.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    made = sc.getCheckpointDir()
    if made is None:
        if not sc.master.startswith("local"):
            raise ConfigurationError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="reelsift-"))
        made = sc.getCheckpointDir()
    return made.rstrip("/")


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers on this machine import the package from where the driver has it.

    Clusters install the package or send it with ``--py-files``; the path does no harm there.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark
