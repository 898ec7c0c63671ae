"""Exact sizes of twelve reversible encodings of value columns, and the smallest of them.

A column is all rows of one key in ``values(key..., row_no, value)``, in the order of ``row_no``; its values are strings.
Numeric encodings apply where every value has 1 to 15 digits; the lengths of the values go beside them, so that leading
zeros survive. A null size means that the encoding does not apply.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.ranges import earlier_ranges, numbered, overlapping, ranged
from tessera.functions.scalars import bit_width, ceil_bytes, unzigzag, varint_len, zigzag

#: Encodings in the order in which ties are settled.
CODECS = ["raw", "const", "delta", "delta_compact", "delta2_compact", "for_bitpack", "delta_bitpack", "delta2_bitpack", "rice", "rice2", "dict", "dict_packed"]
WIDEST = (1 << 32) - 1
MOST_QUOTIENT, MOST_REMAINDER_BITS = 4096, 20
#: A column with a larger code has too large a quotient for any Rice parameter; so sums of codes stay within 64 bits.
CLIP = MOST_QUOTIENT << (MOST_REMAINDER_BITS + 1)
MOST_ENTRIES = 4096


def with_differences(values: DataFrame, keys: list[str], gapless: bool = False) -> DataFrame:
    """Adds ``len, x`` (null where it is no number), first and second differences ``d1, d2`` and their zigzag codes.

    Rows are put in order in ranges, each behind the last two rows of the one before. That takes numbers without gaps:
    ``row_no`` has none where ``gapless`` is set, else rows are numbered first. ``pos`` is that number, ``changed`` says
    that the value is not the one before. Where the length changes, or starts, ``start`` is ``pos``, ``len_before`` the
    length until there, and ``start_before`` where it started, if it did in this range.
    """
    rows = values.withColumn("pos", F.col("row_no")) if gapless else numbered(values, keys, "row_no", "pos")
    x = F.when(F.col("value").rlike(r"^[0-9]{1,15}\z"), F.col("value").try_cast("bigint"))
    rows = overlapping(rows.withColumns({"len": F.octet_length("value").cast("bigint"), "x": x}), "pos", 2)
    w = Window.partitionBy(*keys, "range").orderBy("pos")
    before = lambda c: F.lag(c).over(w)
    rows = rows.withColumns({"d1": F.col("x") - before("x"), "len_before": before("len"), "pos_before": before("pos"), "changed": ~F.col("value").eqNullSafe(before("value"))})
    rows = rows.withColumn("changed", F.col("changed") & F.col("pos_before").isNotNull())
    rows = rows.withColumn("start", F.when(~F.col("again") & (F.col("pos_before").isNull() | ~F.col("len").eqNullSafe(F.col("len_before"))), F.col("pos")))
    rows = rows.withColumns({"d2": F.col("d1") - before("d1"), "start_before": F.last("start", True).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    rows = rows.where("not again").drop("again", "pos_before")
    return rows.withColumns({"z1": zigzag(F.col("d1")), "z2": zigzag(F.col("d2"))})


def _run_bytes(length: str, run: str) -> Column:
    return varint_len(length) + varint_len(run)


def _of_columns(rows: DataFrame, keys: list[str], found: dict[str, tuple[Callable, Column]], firsts: dict[str, Column], codes: tuple[str, ...] = ()) -> DataFrame:
    """One row for each column, from one for each of its ranges, with the size of its lengths, ``len_bytes``.

    ``found`` has functions that give the same of parts and of their results, ``firsts`` the first values that are not
    null. For each of ``codes`` there are the Rice parameter ``<code>_k`` and the ``<code>_bits`` it takes. The parameter
    follows from the mean of the whole column, so ranges sum quotients for each that there is.
    """
    first = lambda value, order: F.min_by(value, F.when(value.isNotNull(), order))
    pos, start, before = F.col("pos"), F.col("start"), F.col("start_before")
    ended = F.sum(F.when(start.isNotNull() & before.isNotNull(), _run_bytes("len_before", "start - start_before")))
    parts = rows.groupBy(*keys, "range").agg(
        *[f(c).alias(name) for name, (f, c) in found.items()],
        *[first(c, pos).alias(name) for name, c in firsts.items()],
        *[F.expr(f"sum(shiftright(if({z} > {CLIP}, {CLIP}, {z}), {k})) as {z}_{k}") for z in codes for k in range(MOST_REMAINDER_BITS + 1)],
        *[F.count(z).alias(f"{z}_count") for z in codes],
        F.count("start").alias("runs"), ended.alias("ended"), F.min("start").alias("first_start"), F.max("start").alias("last_start"),
        F.min_by("len_before", "start").alias("len_before"), F.max("pos").alias("last_pos"), F.max_by("len", "pos").alias("last_len"),
        F.sum(varint_len("len")).alias("one_by_one"),
    )
    column = Window.partitionBy(*keys)
    mean = lambda z: F.floor(F.sum(F.col(f"{z}_0").cast("decimal(38,0)")).over(column) / F.sum(f"{z}_count").over(column)).cast("bigint")
    parts = parts.withColumns({"begun": F.last("last_start", True).over(earlier_ranges(keys))} | {f"{z}_k": F.least(F.lit(MOST_REMAINDER_BITS), bit_width(F.greatest(F.lit(1), mean(z))) - 1).cast("int") for z in codes})
    # the run that goes on into a range and ends there
    open_run = F.when(F.col("begun").isNotNull() & F.col("first_start").isNotNull(), _run_bytes("len_before", "first_start - begun")).otherwise(0)
    bits = lambda z: F.element_at(F.array(*[f"{z}_{k}" for k in range(MOST_REMAINDER_BITS + 1)]), F.col(f"{z}_k") + 1) + (1 + F.col(f"{z}_k")) * F.col(f"{z}_count")
    whole = parts.groupBy(*keys).agg(
        *[f(name).alias(name) for name, (f, _) in found.items()],
        *[first(F.col(name), F.col("range")).alias(name) for name in firsts],
        *[a for z in codes for a in (F.max(f"{z}_k").alias(f"{z}_k"), F.try_sum(bits(z)).alias(f"{z}_bits"))],
        F.sum("runs").alias("runs"), F.sum("one_by_one").alias("one_by_one"), F.sum(F.coalesce("ended", F.lit(0)) + open_run).alias("ended"),
        F.max_by("last_len", "range").alias("last_len"), (F.max("last_pos") + 1 - F.max("last_start")).alias("last_run"),
    )
    whole = whole.withColumn("as_runs", F.col("ended") + _run_bytes("last_len", "last_run"))
    size = F.when(F.col("runs") == 1, 1 + varint_len("last_len")).when(F.col("as_runs") < F.col("one_by_one"), 1 + varint_len("as_runs") + F.col("as_runs")).otherwise(1 + F.col("one_by_one"))
    return whole.withColumn("len_bytes", size.cast("bigint"))


def length_model(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``len_bytes`` of each column: lengths as one value, as runs, or one by one; ``rows`` are from ``with_differences``."""
    return _of_columns(rows, keys, {}, {}).select(*keys, "len_bytes")


def _distinct(values: DataFrame, keys: list[str]) -> DataFrame:
    return values.groupBy(*keys, "value").agg(F.min("row_no").alias("first_row"), F.count("*").alias("times"))


def dictionary(values: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct values of each column with ``id`` in order of first appearance, numbered in ranges, and how often they occur."""
    return numbered(_distinct(values, keys), keys, "first_row", "id")


def dictionary_ids(values: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with the id of its value."""
    return values.join(dictionary(values, keys).select(*keys, "value", "id"), [*keys, "value"])


def dictionary_values(ids: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """The inverse: each row's value, from ``ids(keys..., row_no, id)`` and ``entries(keys..., id, value)``."""
    return ids.join(entries, [*keys, "id"]).select(*keys, "row_no", "value")


def _packed(count: Column, width: Column) -> Column:
    return 9 + ceil_bytes(count * width)


def _entry_costs(values: DataFrame, keys: list[str]) -> DataFrame:
    """Dictionaries of the columns that may have one; the others' values, however many, are not put in order."""
    values = _distinct(values, keys)
    few = values.groupBy(*keys).agg(F.count("*").alias("distinct"), F.sum("times").alias("rows"), F.max("first_row").alias("last")).where(F.col("last").isNotNull() & (F.col("distinct") <= MOST_ENTRIES) & (F.col("distinct") < F.col("rows")))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("first_row"))
    return values.join(few.select(*keys), keys, "left_semi").withColumn("id", (place - 1).cast("bigint")).groupBy(*keys).agg(
        F.count("*").alias("distinct"),
        F.sum(varint_len("octet_length(value)") + F.octet_length("value")).alias("entry_bytes"),
        F.sum(varint_len("id") * F.col("times")).alias("id_bytes"),
    )


def column_costs(values: DataFrame, keys: list[str], gapless: bool = False) -> DataFrame:
    """One row for each column: ``n`` and a size ``<codec>`` for each of CODECS; ``gapless``: ``row_no`` has no gaps."""
    col, one = F.col, F.lit(1).cast("bigint")
    found = {
        "n": (F.sum, one),
        "numbers": (F.sum, F.when(col("x").isNotNull(), one).otherwise(0)),
        "changes": (F.sum, F.when(col("changed"), one).otherwise(0)),
        "raw_bytes": (F.sum, varint_len("len") + col("len")),
        "low": (F.min, col("x")),
        "high": (F.max, col("x")),
        "delta_bytes": (F.sum, varint_len("len") + varint_len("coalesce(z1, 2 * x)")),
        "z1_bytes": (F.sum, F.when(col("z1").isNotNull(), varint_len("z1"))),
        "z2_bytes": (F.sum, F.when(col("z2").isNotNull(), varint_len("z2"))),
        "z1_max": (F.max, col("z1")),
        "z2_max": (F.max, col("z2")),
    }
    firsts = {"x0": col("x"), "z1_first": col("z1"), "first_len": col("len")}
    agg = _of_columns(with_differences(values, keys, gapless), keys, found, firsts, ("z1", "z2")).join(_entry_costs(values, keys), keys, "left")
    # the largest code has the largest quotient
    few = lambda z: col(f"{z}_max") / F.pow(F.lit(2.0), f"{z}_k") < MOST_QUOTIENT + 1
    n, number, head = col("n"), col("numbers") == col("n"), 1 + col("len_bytes") + varint_len("x0")
    second = F.when(n > 1, varint_len("z1_first")).otherwise(0)
    zero = lambda c: F.coalesce(c, F.lit(0))
    sizes = {
        "raw": 1 + col("raw_bytes"),
        "const": F.when(col("changes") == 0, 1 + varint_len("first_len") + col("first_len")),
        "delta": F.when(number, 1 + col("delta_bytes")),
        "delta_compact": F.when(number, head + zero(col("z1_bytes"))),
        "delta2_compact": F.when(number, head + second + zero(col("z2_bytes"))),
        "for_bitpack": F.when(number & (n >= 8) & (col("high") - col("low") <= WIDEST), 1 + col("len_bytes") + varint_len("low") + _packed(n, bit_width(col("high") - col("low")))),
        "delta_bitpack": F.when(number & (n >= 8) & (col("z1_max") <= WIDEST), head + _packed(n - 1, bit_width(col("z1_max")))),
        "delta2_bitpack": F.when(number & (n >= 12) & (col("z2_max") <= WIDEST), head + second + _packed(n - 2, bit_width(col("z2_max")))),
        "rice": F.when(number & (n >= 8) & few("z1"), head + 9 + ceil_bytes(col("z1_bits"))),
        "rice2": F.when(number & (n >= 12) & few("z2"), head + second + 9 + ceil_bytes(col("z2_bits"))),
        "dict": F.when((n >= 3) & (col("distinct") < n) & (col("distinct") <= MOST_ENTRIES), 1 + varint_len("distinct") + col("entry_bytes") + col("id_bytes")),
        "dict_packed": F.when(
            (n >= 8) & (col("distinct") > 1) & (col("distinct") < n) & (col("distinct") <= 256),
            1 + varint_len("distinct") + col("entry_bytes") + _packed(n, bit_width(F.greatest(F.lit(1), col("distinct") - 1))),
        ),
    }
    return agg.select(*keys, n.alias("n"), *[sizes[c].cast("bigint").alias(c) for c in CODECS])


def codec_choice(costs: DataFrame, keys: list[str]) -> DataFrame:
    """The smallest encoding of each column; of equal ones the first in CODECS."""
    least = F.least(*CODECS)
    name = F.coalesce(*[F.when(F.col(c) == least, F.lit(c)) for c in CODECS])
    return costs.select(*keys, "n", name.alias("codec"), least.alias("bytes"))


def decode_differences(encoded: DataFrame, keys: list[str]) -> DataFrame:
    """Values from zigzag codes ``z`` (the first value's own at the first row) and lengths ``len``: a running sum, padded.

    Sums run inside ranges of rows, from the sums of earlier ranges.
    """
    rows, part = ranged(encoded.withColumn("d", unzigzag(F.col("z"))), "row_no"), [*keys, "range"]
    sums = rows.groupBy(*part).agg(F.sum("d").alias("sum")).select(*part, F.coalesce(F.sum("sum").over(earlier_ranges(keys)), F.lit(0)).alias("carried"))
    w = Window.partitionBy(*part).orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    x = F.col("carried") + F.sum("d").over(w)
    return rows.join(sums, part).select(*keys, "row_no", F.lpad(x.cast("string"), F.col("len").cast("int"), F.lit("0")).alias("value"))
