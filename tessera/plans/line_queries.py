"""Queries over lines and templates: documents split into lines, and the event table as a log of one file a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.lines import rendered_events, split_lines, variable_type, variables
from tessera.operators.templates import STANDARD, STRICT, WIDE, MiningOptions, dictionary_bytes, inline_bytes, match_lines, mine_templates, rebuilt_lines, tagged_entries, variable_columns
from tessera.operators.structural import columns_deflated, template_candidates
from tessera.plans.column_queries import COSTS_OF_VALUES
from tessera.plans.sql import varint
from tessera.sources.tables import spread, table

BY = ["file"]
#: Daily logs of the small tables are below the size from which strict and wide mining are tried.
VARIANT_BYTES = 16 * 1024


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered_events(spread(table(spark, sf_dir, "events")))


def line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = split_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lines.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.octet_length("line").cast("bigint").alias("bytes"), F.md5("line").alias("line_md5"))


def token_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _log(spark, sf_dir).select("file", "line_no", F.posexplode(variables(F.col("line"))).alias("slot", "value"))
    return found.select("file", "line_no", F.col("slot").cast("bigint").alias("slot"), "value")


def token_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.explode(variables(F.coalesce("html", F.lit("")))).alias("value"))
    return pages.groupBy(variable_type(F.col("value")).cast("bigint").alias("type")).agg(F.count("*").alias("tokens"), F.sum(F.length("value")).alias("chars"))


def _mined(options: MiningOptions, by: list[str]):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = mine_templates(_log(spark, sf_dir), by, options)
        return found.select(*by, "template_id", F.array_join("parts", "#").alias("shape"), "hits", "first_line", "fixed_len", "slots", "saving")

    return query


def _matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = _log(spark, sf_dir)
    templates = mine_templates(lines, BY)
    return templates, match_lines(lines, templates, BY)


def template_hits_vs_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inline_bytes(_matched(spark, sf_dir)[1], BY)


def template_repeat_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = tagged_entries(_matched(spark, sf_dir)[1], BY)
    return tagged.select("file", "line_no", F.col("tag").cast("bigint").alias("tag"))


def template_dictionary_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary_bytes(_matched(spark, sf_dir)[0], BY)


def variable_long_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = variable_columns(_matched(spark, sf_dir)[1], BY)
    return columns.select("file", "template_id", F.col("slot").cast("bigint").alias("slot"), "row_no", "value")


def template_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates, matched = _matched(spark, sf_dir)
    lines = rebuilt_lines(variable_columns(matched, BY), templates, matched.where("template_id is null"), BY)
    return lines.select("file", "line_no", F.md5("line").alias("line_md5"))


def template_candidate_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_candidates(_log(spark, sf_dir), BY, VARIANT_BYTES)


def template_ratio_vs_deflate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns_deflated(_log(spark, sf_dir), BY)


QUERIES = {
    "line_split": line_split,
    "token_extract": token_extract,
    "token_type_counts": token_type_counts,
    "template_mining": _mined(STANDARD, BY),
    "template_mining_strict": _mined(STRICT, BY),
    "template_mining_wide": _mined(WIDE, BY),
    "template_mining_one_file": _mined(STANDARD, []),
    "template_hits_vs_raw": template_hits_vs_raw,
    "template_repeat_tags": template_repeat_tags,
    "template_dictionary_bytes": template_dictionary_bytes,
    "variable_long_form": variable_long_form,
    "template_roundtrip": template_roundtrip,
    "template_candidate_bytes": template_candidate_bytes,
    "template_ratio_vs_deflate": template_ratio_vs_deflate,
}

# In the rendered events every variable is a run of digits that touches no letter, so SQL needs no look-around.
_LINES = """
l as (select strftime(ts, '%Y-%m-%d') as file, event_id as line_no,
  strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || event_type || ' user=' || user_id || ' id=' || event_id || ' ' || props || chr(10) as line from events),
s as (select *, regexp_replace(line, '[0-9]{2,}', '#', 'g') as shape, regexp_extract_all(line, '[0-9]{2,}') as vars from l),
k as (select *, len(vars)::bigint as slots, (strlen(shape) - len(vars))::bigint as fixed_len from s)"""


def _templates(o: MiningOptions, by: str = "file") -> str:
    part = f"partition by {by} " if by else ""
    cols = f"{by}, " if by else ""
    return f"""{_LINES},
g as (select {cols}shape, slots, fixed_len, count(*) as hits, min(line_no) as first_line from k
  where fixed_len >= {o.min_fixed} and slots between 1 and {o.max_slots} group by {cols}shape, slots, fixed_len),
v as (select *, (hits - 1) * fixed_len - 4 * slots - fixed_len - 16 as saving from g),
r as (select *, row_number() over ({part}order by (hits - 1) * fixed_len desc, first_line) - 1 as template_id from v
  where hits >= {o.min_hits} and saving > {o.min_saving}),
t as (select * from r where template_id < {o.max_templates})"""


def _mining_sql(o: MiningOptions, by: str = "file") -> str:
    return f"with {_templates(o, by)} select {by + ', ' if by else ''}template_id, shape, hits, first_line, fixed_len, slots, saving from t"


_MATCHED = f"""{_templates(STANDARD)},
m as (select k.*, t.template_id from k left join t on k.file = t.file and k.shape = t.shape)"""

_VALUE = f"list_transform(vars, lambda x: 1 + {varint('strlen(x)')} + {varint('x::bigint')})"


def _candidate_sql(name: str, o: MiningOptions, least: int) -> str:
    """One layout of all files; columns by the sizes of ``COSTS_OF_VALUES``, whose keys are (supp, col)."""
    codecs = "raw, const, delta, delta_compact, delta2_compact, for_bitpack, delta_bitpack, delta2_bitpack, rice, rice2, dict, dict_packed"
    matched = f"""{_templates(o)},
f as (select file, sum(strlen(line))::bigint as original, count(*) as lines from l group by file having count(*) >= 4 and sum(strlen(line)) >= {least}),
m as (select k.*, t.template_id, last_value(t.template_id ignore nulls) over (partition by k.file order by k.line_no rows between unbounded preceding and 1 preceding) as before
  from k left join t on k.file = t.file and k.shape = t.shape),
w as (select file, ({varint('count(*)')} + sum({varint('slots')} + list_sum(list_transform(string_split(shape, '#'), lambda x: {varint('strlen(x)')} + strlen(x))) + slots))::bigint as dict_size, count(*) as templates from t group by file),
e as (select file, count(template_id) as hits, count(*) - count(template_id) as raw_lines, sum(case when template_id is not null then slots else 0 end)::bigint as vars,
  count(*) filter (template_id = before) as same,
  sum(case when template_id is null then 1 + {varint('strlen(line)')} + strlen(line) when template_id = before then 1 else 1 + {varint('template_id')} end)::bigint as entry_bytes,
  sum(case when template_id is null then 1 + {varint('strlen(line)')} + strlen(line) else 1 + {varint('template_id')} + list_sum({_VALUE}) end)::bigint as line_bytes from m group by file),
q as (select *, row_number() over (partition by file, template_id order by line_no) as row_no from m where template_id is not null),
vals as (select file as supp, template_id || ':' || i as col, row_no, vars[i] as value from (select *, unnest(range(1, len(vars) + 1)) as i from q))"""
    size = f"(48 + 9 + dict_size + {varint('lines')} + "
    report = "templates, hits, raw_lines, vars, same, original"
    if name == "rows":
        return f"(with {matched} select file, 'rows' as candidate, {size} line_bytes)::bigint as bytes, true as valid, {report} from f join w using (file) join e using (file))"
    return f"""(with {matched}, {COSTS_OF_VALUES},
y as (select supp as file, sum({varint(f'least({codecs})')} + least({codecs}))::bigint as column_bytes from co group by supp)
select file, '{name}' as candidate, {size} entry_bytes + column_bytes)::bigint as bytes, true as valid, {report} from f join w using (file) join e using (file) join y using (file))"""


ORACLE = {
    "line_split": r"""
select doc_id, i - 1 as line_no, strlen(lines[i]) as bytes, md5(lines[i]) as line_md5
from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from (
  select doc_id, regexp_extract_all(text, '[^\n]*\n|[^\n]+') as lines from documents))""",
    "token_extract": f"with {_LINES} select file, line_no, i - 1 as slot, vars[i] as value from (select *, unnest(range(1, len(vars) + 1)) as i from k)",
    "template_mining": _mining_sql(STANDARD),
    "template_mining_strict": _mining_sql(STRICT),
    "template_mining_wide": _mining_sql(WIDE),
    "template_mining_one_file": _mining_sql(STANDARD, ""),
    "template_hits_vs_raw": f"""with {_MATCHED}
select file, sum(case when template_id is null then 1 + {varint('strlen(line)')} + strlen(line)
  else 1 + {varint('template_id')} + list_sum({_VALUE}) end)::bigint as line_bytes,
  count(template_id) as hits, count(*) - count(template_id) as raw_lines from m group by file""",
    "template_repeat_tags": f"""with {_MATCHED},
p as (select *, last_value(template_id ignore nulls) over (partition by file order by line_no rows between unbounded preceding and 1 preceding) as before from m)
select file, line_no, case when template_id is null then 0 when template_id = before then 2 else 1 end::bigint as tag from p""",
    "template_dictionary_bytes": f"""with {_templates(STANDARD)},
p as (select *, list_sum(list_transform(string_split(shape, '#'), lambda x: {varint('strlen(x)')} + strlen(x))) as parts from t)
select file, ({varint('count(*)')} + sum({varint('slots')} + parts + slots))::bigint as dictionary_bytes, count(*) as templates from p group by file""",
    "variable_long_form": f"""with {_MATCHED},
n as (select *, row_number() over (partition by file, template_id order by line_no) - 1 as row_no from m where template_id is not null)
select file, template_id, i - 1 as slot, row_no, vars[i] as value from (select *, unnest(range(1, len(vars) + 1)) as i from n)""",
    "template_candidate_bytes": " union all ".join(
        [_candidate_sql("rows", STANDARD, 0), _candidate_sql("columns", STANDARD, 0), _candidate_sql("columns-strict", STRICT, VARIANT_BYTES), _candidate_sql("columns-wide", WIDE, VARIANT_BYTES)]
    ),
    "template_roundtrip": f"with {_LINES} select file, line_no, md5(line) as line_md5 from l",
}
