"""Readers and writers of sequence and read tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import decode_sequence, encode_sequence


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """Parquet table with seq_id, seq and optionally offset and is_last."""
    return spark.read.parquet(path)


def decode_packed(packed: DataFrame) -> DataFrame:
    """(id, value) -> (seq_id, offset, is_last, seq)."""
    return packed.select(
        F.col("id").cast("bigint").alias("seq_id"), decode_sequence(F.col("value")).alias("s")
    ).select("seq_id", "s.offset", "s.is_last", "s.seq")


def encode_packed(sequences: DataFrame) -> DataFrame:
    """(seq_id, offset, is_last, seq) -> (id, value)."""
    value = encode_sequence(F.col("is_last"), F.col("offset"), F.col("seq"))
    return sequences.select(F.col("seq_id").cast("int").alias("id"), value.alias("value"))


def read_packed_files(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Hadoop sequence files of (int, bytes) as (id, value).

    Spark SQL has no reader for this container, hence the one RDD scan; it is for importing old
    files once, after which the table belongs in parquet.
    """
    rows = spark.sparkContext.sequenceFile(
        path,
        "org.apache.hadoop.io.IntWritable",
        "org.apache.hadoop.io.BytesWritable",
        minSplits=partitions,
    )
    return spark.createDataFrame(rows, "id int, value binary")


def write_packed_files(packed: DataFrame, path: str) -> None:
    """(id, value) as Hadoop sequence files, for exchange with old readers."""
    pairs = packed.select("id", "value").rdd.map(lambda r: (r[0], bytearray(r[1])))
    pairs.saveAsHadoopFile(
        path,
        "org.apache.hadoop.mapred.SequenceFileOutputFormat",
        keyClass="org.apache.hadoop.io.IntWritable",
        valueClass="org.apache.hadoop.io.BytesWritable",
    )
