"""Session defaults for local runs, and where durable working files go."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", memory: str = "12g", app: str = "gleaner") -> SparkSession:
    """A session for tests and benchmarks; on a cluster use the session you are given."""
    n = 8 if str(cores) == "*" else int(cores)
    # Python workers import this package as well; on a cluster ship it with --py-files.
    root = str(Path(__file__).resolve().parent.parent)
    if root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [root, os.environ.get("PYTHONPATH")]))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only where that setting is
    absent (local runs) a temporary folder is chosen, and remembered for the session.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("gleaner.shared.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    chosen = tempfile.mkdtemp(prefix="gleaner-")
    spark.conf.set("gleaner.shared.dir", chosen)
    return chosen


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df, name: str):
    """Write an intermediate table to the shared folder and read it back.

    Used where several branches start from one costly, narrow result: the input is
    read once, the lineage ends here, and lost executors do not bring it back.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def one_use_shuffles(spark: SparkSession):
    """Shuffle files of what is written here are deleted when the write ends, not when the JVM collects garbage."""
    before = spark.conf.get(FREE, None)
    spark.conf.set(FREE, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE) if before is None else spark.conf.set(FREE, before)
