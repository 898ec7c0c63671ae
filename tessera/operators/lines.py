"""Lines and the variables in them.

A line keeps its ``\\n``; the last one may lack it. A variable is the leftmost of: a UUID; a run of exactly 16, 24, 32, 40 or
64 hex digits with a letter, up to where the run ends; a run of two or more digits that no letter or digit touches on at
least one side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE = r"[^\n]*\n|[^\n]+"
_H = "[0-9A-Fa-f]"
#: All variables start with a hex digit; asked first, that ends most searches at their first character.
TOKEN = (
    rf"(?={_H})(?:{_H}{{8}}-{_H}{{4}}-{_H}{{4}}-{_H}{{4}}-{_H}{{12}}"
    rf"|(?=[0-9]*[A-Fa-f])(?:{_H}{{64}}|{_H}{{40}}|{_H}{{32}}|{_H}{{24}}|{_H}{{16}})(?!{_H})"
    r"|(?<![0-9A-Za-z])[0-9]{2,}+|[0-9]{2,}+(?![0-9A-Za-z]))"
)
#: Types of variables.
NUMBER, UUID, HEX = 1, 2, 3


def split_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replaces ``text`` by one row for each of its lines: ``line_no`` from 0, and ``line``. Null and empty texts have none."""
    others = [c for c in docs.columns if c != text]
    return docs.select(*others, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(LINE), 0)).alias("line_no", "line"))


def variables(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(TOKEN), 0)


def fixed_parts(line: Column) -> Column:
    """What stands around the variables: one part more than there are variables."""
    return F.split(line, TOKEN, -1)


def variable_type(value: Column) -> Column:
    return F.when(value.contains("-"), UUID).when(value.rlike("[A-Fa-f]"), HEX).otherwise(NUMBER)


def with_shape(lines: DataFrame) -> DataFrame:
    """Adds ``parts, types, vars, fixed_len`` of each line.

    They come out of a generator of one row: filters and joins on them stay above it, so no line is searched again for these.
    """
    found = lines.withColumns({"_parts": fixed_parts(F.col("line")), "_vars": variables(F.col("line"))})
    types = F.transform("_vars", variable_type).alias("types")
    length = F.octet_length(F.array_join("_parts", "")).cast("bigint").alias("fixed_len")
    shape = F.struct(F.col("_parts").alias("parts"), F.col("_vars").alias("vars"), types, length)
    return found.select(*lines.columns, F.inline(F.array(shape)))


def rendered_events(events: DataFrame) -> DataFrame:
    """The event table as a log: one file a day, lines in the order of event_id."""
    line = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "event_type", F.concat(F.lit("user="), "user_id"), F.concat(F.lit("id="), "event_id"), F.concat("props", F.lit("\n")))
    return events.select(F.date_format("ts", "yyyy-MM-dd").alias("file"), F.col("event_id").alias("line_no"), line.alias("line"))
