"""Whole files and chunked files as rows, and encoded rows as a table of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.selection import candidates, decode, encode, in_chunks, winners

DEFAULT_CHUNK = 16 * 1024 * 1024


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, content`` of every file below ``path``; Spark's reader leaves out files without bytes."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


def read_chunks(spark: SparkSession, path: str, size: int = DEFAULT_CHUNK) -> DataFrame:
    """``file, chunk_no, content`` with chunks of at most ``size`` bytes."""
    return in_chunks(read_files(spark, path), ["file"], size)


def write_frames(rows: DataFrame, keys: list[str], path: str) -> None:
    """Stores each ``content`` as its smallest valid candidate, with its length and SHA-256."""
    best = winners(candidates(rows, keys), keys).select(*keys, "candidate")
    frames = rows.join(best, keys).select(*keys, "candidate", F.octet_length("content").alias("length"), F.sha2("content", 256).alias("sha256"), encode("content", "candidate")["payload"].alias("payload"))
    frames.write.parquet(path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Contents of stored frames; ``error`` says what is wrong where a payload does not give back its content."""
    frames = spark.read.parquet(path).withColumn("back", decode(F.struct("payload", "candidate", "length")))
    good = F.coalesce(F.sha2(F.col("back.content"), 256) == F.col("sha256"), F.lit(False))
    error = F.when(~good, F.coalesce("back.error", F.lit("content differs from its digest")))
    return frames.select("*", F.when(good, F.col("back.content")).alias("content"), error.alias("error")).drop("back", "payload")


def whole_files(chunks: DataFrame) -> DataFrame:
    """Files from their chunks, in order. A file must fit into a row, as it did when it was read."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("chunk_no", "content"))), lambda c: F.hex(c["content"]))
    return chunks.groupBy("file").agg(F.unhex(F.array_join(parts, "")).alias("content"))
