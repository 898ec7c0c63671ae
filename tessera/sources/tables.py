"""Readers for the Parquet tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Rows and bytes that Python gets at a time: with these, what a worker holds does not grow with the table or its texts.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def small_batches(spark: SparkSession) -> None:
    """Sets BATCH for what the session runs from now on; what was set before stays."""
    for key in BATCH.keys() - spark.conf.getAll.keys():
        spark.conf.set(key, BATCH[key])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of ``sf_dir``; Catalyst prunes its columns and pushes filters into it."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows for work that costs more than moving them: dealt to all cores where their files come in fewer pieces than that.

    A large table comes in more pieces than there are cores, and stays as it is read.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
