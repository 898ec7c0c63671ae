"""Line templates: shapes of lines that are worth a dictionary entry, and what lines become with them.

Lines with equal fixed parts and variable types share a shape. A shape with ``hits`` lines saves
(hits - 1) * fixed - 4 * slots - fixed - 16 bytes. Templates are ranked by (hits - 1) * fixed, then by first line.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.ranges import earlier_ranges, numbered, ranged
from tessera.functions.scalars import varint_len
from tessera.operators.lines import with_shape


@dataclass(frozen=True)
class MiningOptions:
    max_templates: int = 1024
    min_hits: int = 2
    min_saving: int = 24
    max_slots: int = 96
    min_fixed: int = 12


STANDARD, STRICT, WIDE = MiningOptions(), MiningOptions(512, 3, 96, 64), MiningOptions(1536, 2, 12, 96)


def mine_templates(lines: DataFrame, by: list[str], options: MiningOptions = STANDARD) -> DataFrame:
    """Templates of each group ``by`` of ``lines(by..., line_no, line)``; an empty ``by`` takes all lines as one file.

    Shapes are counted with map-side combine. For one file the ranking is a distributed top-k; only its at most
    ``max_templates`` rows meet in one task to be numbered.
    """
    return ranked_templates(counted_shapes(lines, by, options), by, options)


def counted_shapes(lines: DataFrame, by: list[str], options: MiningOptions) -> DataFrame:
    """Shapes of each group that ``options``, or stricter ones, may take, with ``hits, first_line, fixed_len, slots``."""
    shapes = with_shape(lines).where((F.col("fixed_len") >= options.min_fixed) & (F.size("vars") >= 1) & (F.size("vars") <= options.max_slots))
    found = shapes.groupBy(*by, "parts", "types").agg(F.count("*").alias("hits"), F.min("line_no").alias("first_line"), F.first("fixed_len").alias("fixed_len"))
    return found.withColumn("slots", F.size("types").cast("bigint"))


def ranked_templates(found: DataFrame, by: list[str], options: MiningOptions) -> DataFrame:
    """The shapes that are worth it, at most ``max_templates`` of each group, numbered by rank."""
    found = found.where((F.col("fixed_len") >= options.min_fixed) & (F.col("slots") <= options.max_slots))
    found = found.withColumn("saving", (F.col("hits") - 1) * F.col("fixed_len") - 4 * F.col("slots") - F.col("fixed_len") - 16)
    found = found.where((F.col("hits") >= options.min_hits) & (F.col("saving") > options.min_saving))
    order = [((F.col("hits") - 1) * F.col("fixed_len")).desc(), F.col("first_line")]
    if not by:
        found = found.orderBy(*order).limit(options.max_templates)
    ranked = found.withColumn("template_id", (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("bigint"))
    return ranked.where(F.col("template_id") < options.max_templates)


def match_lines(lines: DataFrame, templates: DataFrame, by: list[str]) -> DataFrame:
    """Each line with its ``template_id``, null for a raw line; an equi-join on the shape."""
    keys = [*by, "parts", "types"]
    return with_shape(lines).join(templates.select(*keys, "template_id"), keys, "left")


def tagged_entries(matched: DataFrame, by: list[str]) -> DataFrame:
    """``tag``: 0 raw, 1 a template other than the last one of the file, 2 the same again; raw lines don't reset it.

    The template before a line is looked for in its range of lines; the last ones of earlier ranges, a row each, are carried on.
    """
    rows = ranged(matched, "line_no")
    hit = F.when(F.col("template_id").isNotNull(), F.col("line_no"))
    ends = rows.groupBy(*by, "range").agg(F.max_by("template_id", hit).alias("end"))
    carried = ends.select(*by, "range", F.last("end", True).over(earlier_ranges(by)).alias("carried"))
    before = Window.partitionBy(*by, "range").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(carried, [*by, "range"])
    last = F.coalesce(F.last("template_id", True).over(before), F.col("carried"))
    tag = F.when(F.col("template_id").isNull(), 0).when(F.col("template_id").eqNullSafe(last), 2).otherwise(1)
    return rows.withColumn("tag", tag).drop("range", "carried")


def dictionary_bytes(templates: DataFrame, by: list[str]) -> DataFrame:
    """Bytes of each file's template dictionary."""
    size = lambda p: varint_len(F.octet_length(p).cast("bigint")) + F.octet_length(p)
    parts = F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, p: n + size(p))
    one = varint_len(F.col("slots")) + parts + F.col("slots")
    return templates.groupBy(*by).agg((varint_len(F.count("*")) + F.sum(one)).alias("dictionary_bytes"), F.count("*").alias("templates"))


def inline_bytes(matched: DataFrame, by: list[str]) -> DataFrame:
    """Bytes of each file's lines with variables inline: a tag, then template and values, or the raw line."""
    length = lambda c: F.octet_length(c).cast("bigint")
    number = lambda v: v.rlike(r"^[0-9]{1,15}\z")
    value = lambda v: F.when(number(v), 1 + varint_len(length(v)) + varint_len(v.try_cast("bigint"))).otherwise(1 + varint_len(length(v)) + length(v))
    values = F.aggregate("vars", F.lit(0).cast("bigint"), lambda n, v: n + value(v))
    line = F.when(F.col("template_id").isNull(), 1 + varint_len(length("line")) + length("line")).otherwise(1 + varint_len(F.col("template_id")) + values)
    return matched.groupBy(*by).agg(F.sum(line).cast("bigint").alias("line_bytes"), F.count("template_id").alias("hits"), F.sum(F.when(F.col("template_id").isNull(), 1).otherwise(0)).cast("bigint").alias("raw_lines"))


def variable_columns(matched: DataFrame, by: list[str]) -> DataFrame:
    """Long form of the variables of matched lines: ``template_id, slot, row_no, value, slot_type``.

    Rows are numbered inside ranges of lines, plus the rows of earlier ranges.
    """
    hits = numbered(matched.where("template_id is not null"), [*by, "template_id"], "line_no", "row_no")
    long = hits.select(*by, "template_id", "line_no", "row_no", "types", F.posexplode("vars").alias("slot", "value"))
    return long.withColumn("slot_type", F.element_at("types", F.col("slot") + 1)).drop("types")


def rebuilt_lines(columns: DataFrame, templates: DataFrame, raw: DataFrame, by: list[str]) -> DataFrame:
    """The inverse of mining: lines from their variables and templates, and the raw lines; at most ``max_slots`` values a line."""
    rows = columns.groupBy(*by, "template_id", "line_no").agg(F.sort_array(F.collect_list(F.struct("slot", "value"))).alias("sorted"))
    rows = rows.join(templates.select(*by, "template_id", "parts"), [*by, "template_id"])
    zipped = F.zip_with(F.slice("parts", 1, F.size("sorted")), F.col("sorted")["value"], lambda p, v: F.concat(p, v))
    line = F.concat(F.array_join(zipped, ""), F.element_at("parts", -1))
    return rows.select(*by, "line_no", line.alias("line")).unionByName(raw.select(*by, "line_no", "line"))
