"""Order within long groups: rows are put in order a range of their numbers at a time, so no task holds a whole group.

What earlier ranges hand on (a count, a sum, last rows) is a row for each range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Numbers of one group that are put in order together.
RANGE = 1 << 16


def ranged(rows: DataFrame, order: str) -> DataFrame:
    return rows.withColumn("range", F.floor(F.col(order) / RANGE))


def earlier_ranges(keys: list[str]):
    """The window over all earlier ranges, one row each."""
    return Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)


def numbered(rows: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Adds ``name``: how many rows of the same key come before by ``order``."""
    rows, part = ranged(rows, order), [*keys, "range"]
    first = F.coalesce(F.sum("rows").over(earlier_ranges(keys)), F.lit(0)).alias("first")
    counts = rows.groupBy(*part).agg(F.count("*").alias("rows")).select(*part, first)
    place = F.row_number().over(Window.partitionBy(*part).orderBy(order)) - 1
    return rows.join(counts, part).withColumn(name, (F.col("first") + place).cast("bigint")).drop("range", "first")


def overlapping(rows: DataFrame, order: str, most: int) -> DataFrame:
    """Adds ``range`` and ``again``: the last ``most`` rows of each range are rows of the next one, too, where ``again`` is true.

    ``order`` counts the rows of each group without gaps, and ``most`` is at most RANGE.
    """
    place = F.floor(F.col(order) / RANGE)
    at = lambda n, again: F.struct((place + n).alias("range"), F.lit(again).alias("again"))
    late = F.pmod(F.col(order), F.lit(RANGE)) >= RANGE - most
    return rows.select("*", F.inline(F.when(late, F.array(at(0, False), at(1, True))).otherwise(F.array(at(0, False)))))
