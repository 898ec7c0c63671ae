"""Structural candidates of a log: what each file takes as templates, entries and columns, and whether it can be rebuilt.

Two layouts, as relational jobs over all lines:

* ``rows``: header, template dictionary, and each line as a tag with its template and inline values, or raw.
* ``columns``: header, dictionary, one tag a line (raw, another template, the same again), then each variable column by
  its smallest encoding. It is tried with the standard mining options, and with strict and wide ones for large files.

A candidate is valid when its inverse gives back every line at its place. Files of fewer than ``LEAST_LINES`` lines, or
without a template, have none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import varint_len
from tessera.operators.columns import codec_choice, column_costs
from tessera.operators.lines import with_shape
from tessera.operators.selection import FRAME, deflated
from tessera.operators.templates import STANDARD, STRICT, WIDE, MiningOptions, counted_shapes, dictionary_bytes, inline_bytes, match_lines, mine_templates, ranked_templates, rebuilt_lines, tagged_entries, variable_columns

HEADER, LEAST_LINES = 9, 4
VARIANTS = {"columns": STANDARD, "columns-strict": STRICT, "columns-wide": WIDE}
#: Strict and wide mining are for files of this many bytes.
VARIANT_BYTES = 512 * 1024


def _fingerprint(lines: DataFrame, by: list[str]) -> DataFrame:
    """Bytes, lines, and the sum of the lines' hashes with their places: equal for equal sets of lines."""
    each = F.xxhash64("line_no", "line").cast("decimal(20,0)")
    return lines.groupBy(*by).agg(F.sum(F.octet_length("line")).cast("bigint").alias("original"), F.count("*").alias("lines"), F.sum(each).alias("print"))


def entry_bytes(tagged: DataFrame, by: list[str]) -> DataFrame:
    """Bytes of each file's tags and raw lines, and counts of what they are."""
    length = F.octet_length("line").cast("bigint")
    size = F.when(F.col("tag") == 0, 1 + varint_len(length) + length).when(F.col("tag") == 1, 1 + varint_len(F.col("template_id"))).otherwise(F.lit(1).cast("bigint"))
    ones = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    slots = F.sum(F.when(F.col("tag") > 0, F.size("vars")).otherwise(0)).cast("bigint")
    return tagged.groupBy(*by).agg(F.sum(size).alias("entry_bytes"), ones(F.col("tag") > 0).alias("hits"), ones(F.col("tag") == 0).alias("raw_lines"), slots.alias("vars"), ones(F.col("tag") == 2).alias("same"))


def column_bytes(values: DataFrame, by: list[str]) -> DataFrame:
    """Bytes of all columns of each file, each by its smallest encoding behind its length."""
    keys = [*by, "template_id", "slot"]
    chosen = codec_choice(column_costs(values, keys, gapless=True), keys)
    return chosen.groupBy(*by).agg(F.sum(varint_len(F.col("bytes")) + F.col("bytes")).alias("column_bytes"))


def template_candidates(lines: DataFrame, by: list[str], variant_bytes: int = VARIANT_BYTES) -> DataFrame:
    """``candidate, bytes, valid`` and a report (``templates, hits, raw_lines, vars, same, original``) for each file."""
    originals = _fingerprint(lines, by)
    names = F.array(*[F.lit(k) if k == "columns" else F.when(F.col("original") >= variant_bytes, F.lit(k)) for k in VARIANTS])
    wanted = originals.where(F.col("lines") >= LEAST_LINES).select(*by, F.array_compact(names).alias("wanted"))
    templates, matched = _tried(lines, wanted, by)
    keys = [*by, "candidate"]
    columns = variable_columns(matched, keys)
    back = _fingerprint(rebuilt_lines(columns, templates, matched.where("template_id is null"), keys), keys).select(*keys, F.col("print").alias("again"))
    found = dictionary_bytes(templates, keys).join(entry_bytes(tagged_entries(matched, keys), keys), keys).join(column_bytes(columns.select(*keys, "template_id", "slot", "row_no", "value"), keys), keys)
    found = found.join(originals, by).join(back, keys)
    inline = inline_bytes(matched.where("candidate = 'columns'"), by).select(*by, F.lit("columns").alias("candidate"), "line_bytes")
    common = FRAME + HEADER + F.col("dictionary_bytes") + varint_len(F.col("lines"))
    one = lambda name, size: F.struct(name.alias("candidate"), (common + size).cast("bigint").alias("bytes"))
    both = F.array(one(F.col("candidate"), F.col("entry_bytes") + F.col("column_bytes")), F.when(F.col("line_bytes").isNotNull(), one(F.lit("rows"), F.col("line_bytes"))))
    valid = F.col("again").eqNullSafe(F.col("print")).alias("valid")
    report = ["templates", "hits", "raw_lines", "vars", "same", "original"]
    found = found.join(inline, keys, "left").select(*by, F.explode(F.array_compact(both)).alias("c"), valid, *report)
    return found.select(*by, "c.candidate", "c.bytes", "valid", *report)


def _tried(lines: DataFrame, wanted: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Templates of each variant that is ``wanted(by..., wanted)``, and each line matched with those of each, by ``candidate``.

    Lines are searched for variables once for all variants, and take the templates of all in one join.
    """
    shapes = counted_shapes(lines, by, WIDE)
    templates = reduce(DataFrame.unionByName, [ranked_templates(shapes, by, o).withColumn("candidate", F.lit(k)) for k, o in VARIANTS.items()])
    templates = templates.join(wanted, by).where(F.array_contains("wanted", F.col("candidate"))).drop("wanted")
    numbers = F.map_from_entries(F.collect_list(F.struct("candidate", "template_id")))
    shape = [*by, "parts", "types"]
    rows = with_shape(lines).join(wanted, by).join(templates.groupBy(*shape).agg(numbers.alias("numbers")), shape, "left")
    rows = rows.select("*", F.explode("wanted").alias("candidate")).withColumn("template_id", F.element_at("numbers", F.col("candidate")))
    return templates, rows.drop("wanted", "numbers")


def columns_deflated(lines: DataFrame, by: list[str], options: MiningOptions = STANDARD, piece: int = 1 << 16) -> DataFrame:
    """``original, deflate, bytes``: each file deflated as it is, and as columns that are encoded or deflated, whichever is less.

    Columns, tags and raw lines, and the file itself, are deflated in pieces of ``piece`` rows, so no task holds a whole file.
    """
    templates = mine_templates(lines, by, options)
    matched = match_lines(lines, templates, by)

    def size_of(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
        rows = rows.withColumn("piece", F.floor(F.col(order) / piece))
        texts = rows.groupBy(*keys, "piece").agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("all"))
        return texts.select(*keys, F.octet_length(deflated(F.encode(F.array_join(F.col("all")[value], ""), "UTF-8"))).cast("bigint").alias("bytes"))

    keys = [*by, "template_id", "slot"]
    values = variable_columns(matched, by).select(*keys, "row_no", "value")
    encoded = codec_choice(column_costs(values, keys, gapless=True), keys).select(*keys, F.col("bytes").alias("encoded"))
    packed = size_of(values.withColumn("text", F.concat("value", F.lit("\n"))), keys, "row_no", "text").groupBy(*keys).agg(F.sum("bytes").alias("bytes"))
    columns = encoded.join(packed, keys).groupBy(*by).agg(F.sum(1 + varint_len(F.least("encoded", "bytes")) + F.least("encoded", "bytes")).alias("columns"))
    entry = F.concat(F.col("tag").cast("string"), F.when(F.col("tag") == 1, F.concat("template_id", F.lit("\n"))).when(F.col("tag") == 0, F.col("line")).otherwise(F.lit("")))
    entries = size_of(tagged_entries(matched, by).withColumn("text", entry), by, "line_no", "text").groupBy(*by).agg(F.sum("bytes").alias("entries"))
    whole = size_of(lines, by, "line_no", "line").groupBy(*by).agg(F.sum("bytes").alias("deflate"))
    out = _fingerprint(lines, by).select(*by, "original").join(whole, by).join(dictionary_bytes(templates, by), by, "left").join(entries, by).join(columns, by, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(*by, "original", "deflate", (FRAME + HEADER + zero(F.col("dictionary_bytes")) + F.col("entries") + zero(F.col("columns"))).cast("bigint").alias("bytes"))
