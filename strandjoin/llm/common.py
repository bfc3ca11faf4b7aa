"""Helpers that several operators share: the shared folder, word rules and safe columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shuffle_files_cleared

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share.

    Only a local session, whose tasks run in the driver's process, may do without it; it then
    gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    folder = "file://" + tempfile.mkdtemp(prefix="strandjoin-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def run_folder(spark: SparkSession) -> str:
    """The subfolder of the shared folder that holds this application's tables alone."""
    return f"{shared_folder(spark)}/staged-{spark.sparkContext.applicationId}"


def stage(frame: DataFrame, name: str) -> DataFrame:
    """The frame written as a table to the shared folder and read again.

    Cuts the lineage: what follows reads the files and survives lost executors. The files stay
    until drop_stages(); a result that is still to be read may need them.
    """
    spark = frame.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffle_files_cleared(spark):
        frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def numbered_rows(frame: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The frame as a staged table with a column that numbers its rows, and the name of the column.

    The numbers are stored: they stay what they are however a later job splits the table.
    """
    column = "_row"
    while column.lower() in (c.lower() for c in frame.columns):
        column += "_"
    return stage(frame.withColumn(column, F.monotonically_increasing_id()), name), column


def drop_stages(spark: SparkSession) -> None:
    """Delete the tables this application staged; call it when all results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)
