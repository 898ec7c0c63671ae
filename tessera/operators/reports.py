"""Reports: ratios against deflate and the history of runs over a file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.scalars import percent_saved, smaller


def against_deflate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows(keys..., original, bytes, deflate)`` with the share saved and who is smaller."""
    return rows.select(*keys, "original", "bytes", "deflate", percent_saved(F.col("bytes"), F.col("original")).alias("saved_percent"), smaller(F.col("bytes"), F.col("deflate"), "ours", "deflate").alias("winner"))


def with_previous(runs: DataFrame) -> DataFrame:
    """``runs(file, ts, size, base)``: the change since the file's run before, the share saved, and who is smaller."""
    w = Window.partitionBy("file").orderBy("ts")
    return runs.select("file", "ts", "size", "base", (F.col("size") - F.lag("size").over(w)).alias("change"), percent_saved(F.col("size"), F.col("base")).alias("saved_percent"), smaller(F.col("size"), F.col("base"), "ours", "base").alias("winner"))


def last_runs(runs: DataFrame, most: int = 20) -> DataFrame:
    """The newest runs of each file; ``back`` counts from 1."""
    back = F.row_number().over(Window.partitionBy("file").orderBy(F.col("ts").desc())).cast("bigint")
    return runs.withColumn("back", back).where(F.col("back") <= most)


def without_file(runs: DataFrame, file: str) -> DataFrame:
    return runs.where(~F.col("file").eqNullSafe(F.lit(file)))


def append_runs(runs: DataFrame, path: str) -> None:
    """Adds ``runs(file, ts, size, base)`` to the history table at ``path``; ``with_previous`` and ``last_runs`` read it."""
    runs.select("file", "ts", "size", "base").write.mode("append").parquet(path)
