"""Where intermediate tables go."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    """A temporary folder for local sessions of this process, which is deleted at its end."""
    folder = tempfile.mkdtemp(prefix="strandjoin-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names.

    Only a session whose tasks run in the driver's process may leave the folder unset.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        folder = _own_folder()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffle_files_cleared(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that ends within are deleted at its end.

    Spark otherwise keeps them until the driver happens to collect garbage. A written table needs
    none of them, and the next query plans shuffles of its own.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written_once(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: what reads it twice does not derive it twice."""
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
