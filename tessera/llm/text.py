"""Small expressions that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(column, UPPER, LOWER)


def utf8(column: Column) -> Column:
    """The column's UTF-8 bytes; null counts as empty."""
    return F.coalesce(column.cast("binary"), F.lit(b"").cast("binary"))


def id_ranges(rows: DataFrame, count: int) -> list[DataFrame]:
    """Rows in ``count`` ranges of doc_id, in order, with about as many rows each, wherever the ids lie; null ids first."""
    edges = sorted({int(e) for e in rows.approxQuantile("doc_id", [k / count for k in range(1, count)], 0.01)})
    low = [None, *edges]
    found = []
    for a, b in zip(low, [*edges, None], strict=True):
        above = F.lit(True) if a is None else F.col("doc_id") > a
        below = F.lit(True) if b is None else F.col("doc_id") <= b
        inside = above & below
        found.append(rows.where(inside | F.col("doc_id").isNull() if a is None else inside))
    return found
