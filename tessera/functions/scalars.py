"""Scalar expressions over columns: sizes of encoded integers, byte classes, labels of reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def varint_len(x: Column | str) -> Column:
    """Bytes of a number at 7 bits a byte, for numbers below 2^56; as SQL, ``x`` is quicker to plan."""
    if isinstance(x, str):
        cases = " ".join(f"when {x} >= {1 << (7 * more)}L then {1 + more}L" for more in range(7, 0, -1))
        return F.expr(f"case {cases} else 1L end")
    size = F
    for more in range(7, 0, -1):
        size = size.when(x >= (1 << (7 * more)), 1 + more)
    return size.otherwise(1).cast("bigint")


def zigzag(x: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2 to 0, 1, 2, 3; null stays null."""
    return F.when(x < 0, -2 * x - 1).when(x >= 0, 2 * x).cast("bigint")


def unzigzag(z: Column) -> Column:
    return F.when(z % 2 == 1, -(z + 1) / 2).otherwise(z / 2).cast("bigint")


def bit_width(x: Column) -> Column:
    """Bits of a number; 0 for 0 and below."""
    return F.when(x <= 0, 0).otherwise(F.length(F.bin(x))).cast("bigint")


def ceil_bytes(bits: Column) -> Column:
    return F.floor((bits + 7) / 8).cast("bigint")


def human_size(n: Column) -> Column:
    """``N/A`` for null, then bytes, KB and MB with two decimals."""
    kb, mb = F.round(n / 1024, 2), F.round(n / (1024 * 1024), 2)
    return (
        F.when(n.isNull(), F.lit("N/A"))
        .when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.concat(F.format_string("%.2f", kb), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.2f", mb), F.lit(" MB")))
    )


def percent_saved(size: Column, original: Column) -> Column:
    """Share that is saved, in percent; null without an original."""
    return F.when(original > 0, F.round((1 - size / original) * 100, 2))


def smaller(a: Column, b: Column, name_a: str, name_b: str) -> Column:
    return F.when(a < b, F.lit(name_a)).when(b < a, F.lit(name_b)).otherwise(F.lit("tie"))


def pad_number(n: Column, length: Column) -> Column:
    """A number with its leading zeros: ``length`` is at least its number of digits."""
    return F.lpad(n.cast("string"), length, F.lit("0"))
