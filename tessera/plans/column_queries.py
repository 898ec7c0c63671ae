"""Queries over value columns: three columns of ``lineitem`` for each supplier, as strings in a total order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.scalars import unzigzag, varint_len, zigzag
from tessera.operators.columns import CODECS, codec_choice, column_costs, decode_differences, dictionary_ids, length_model, with_differences
from tessera.plans.sql import varint, width, zigzag as zz
from tessera.sources.tables import table

KEYS = ["supp", "col"]


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    rows = table(spark, sf_dir, "lineitem").withColumn("row_no", F.row_number().over(order).cast("bigint"))
    cell = lambda name, value: F.struct(F.lit(name).alias("col"), value.alias("value"))
    quantity = F.lpad(F.col("l_quantity").cast("bigint").cast("string"), 4, "0")
    cells = F.array(cell("order", F.col("l_orderkey").cast("string")), cell("quantity", quantity), cell("flag", F.concat("l_returnflag", "l_linestatus")))
    return rows.select(F.col("l_suppkey").alias("supp"), "row_no", F.inline(cells)).select("supp", "col", "row_no", "value")


def column_codec_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_costs(values(spark, sf_dir), KEYS, gapless=True)


def codec_choice_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec_choice(column_costs(values(spark, sf_dir), KEYS, gapless=True), KEYS)


def _one_codec(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return column_costs(values(spark, sf_dir), KEYS, gapless=True).select(*KEYS, F.col(name).alias("bytes"))

    return query


def length_model_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_model(with_differences(values(spark, sf_dir), KEYS, gapless=True), KEYS)


def dict_encode_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary_ids(values(spark, sf_dir), KEYS).select(*KEYS, "row_no", "id")


def zigzag_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_differences(values(spark, sf_dir), KEYS, gapless=True).where("x is not null")
    return rows.select(*KEYS, "row_no", "z1", "z2", unzigzag(F.col("z1")).alias("d1"))


def varint_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_differences(values(spark, sf_dir), KEYS, gapless=True).where("x is not null")
    return rows.groupBy("col", varint_len(F.coalesce("z1", zigzag(F.col("x")))).alias("bytes")).agg(F.count("*").alias("times"))


def delta_decode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_differences(values(spark, sf_dir).where("col != 'flag'"), KEYS, gapless=True)
    encoded = rows.select(*KEYS, "row_no", F.coalesce("z1", zigzag(F.col("x"))).alias("z"), "len")
    return decode_differences(encoded, KEYS)


QUERIES = {
    "column_codec_bytes": column_codec_bytes,
    "codec_choice": codec_choice_query,
    **{f"codec_{name}_bytes": _one_codec(name) for name in CODECS},
    "length_model_bytes": length_model_bytes,
    "dict_encode_ids": dict_encode_ids,
    "zigzag_values": zigzag_values,
    "varint_histogram": varint_histogram,
    "delta_decode_roundtrip": delta_decode_roundtrip,
}

_VALUES = """
li as (select *, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) as row_no from lineitem),
vals as (select l_suppkey as supp, 'order' as col, row_no, l_orderkey::varchar as value from li
  union all select l_suppkey, 'quantity', row_no, lpad(l_quantity::bigint::varchar, 4, '0') from li
  union all select l_suppkey, 'flag', row_no, l_returnflag || l_linestatus from li)"""
#: From ``vals(supp, col, row_no, value)`` on.
_FROM_VALUES = f"""
xs as (select *, strlen(value) as len, case when regexp_full_match(value, '[0-9]{{1,15}}') then value::bigint end as x from vals),
ds as (select *, x - lag(x) over w as d1 from xs window w as (partition by supp, col order by row_no)),
es as (select *, d1 - lag(d1) over w as d2 from ds window w as (partition by supp, col order by row_no)),
zs as (select *, case when d1 is not null then {zz('d1')} end as z1, case when d2 is not null then {zz('d2')} end as z2 from es)"""
_ROWS = f"{_VALUES},{_FROM_VALUES}"
_LENGTHS = f"""
st as (select *, len is distinct from lag(len) over (partition by supp, col order by row_no) as new from zs),
ru as (select supp, col, len, count(*) as run from (select *, sum(new::int) over (partition by supp, col order by row_no) as island from st) group by supp, col, len, island),
lm as (select supp, col, (case when count(*) = 1 then 1 + {varint('min(len)')}
  when sum({varint('len')} + {varint('run')}) < sum({varint('len')} * run) then 1 + {varint(f'sum({varint("len")} + {varint("run")})')} + sum({varint('len')} + {varint('run')})
  else 1 + sum({varint('len')} * run) end)::bigint as len_bytes from ru group by supp, col)"""
_DICT = """
di as (select *, row_number() over (partition by supp, col order by first_row) - 1 as id from (
  select supp, col, value, min(row_no) as first_row, count(*) as times from vals group by supp, col, value))"""
_K = lambda z: f"least(20, length(bin(greatest(1, floor(avg({z}) over (partition by supp, col)))::bigint)) - 1)"
#: Sizes ``co`` of all encodings of the columns in ``vals``.
COSTS_OF_VALUES = f"""{_FROM_VALUES}, {_LENGTHS}, {_DICT},
ks as (select *, {_K('z1')} as k1, {_K('z2')} as k2 from zs),
qs as (select *, z1 >> k1 as q1, z2 >> k2 as q2 from ks),
ag as (select supp, col, count(*) as n, count(x) = count(*) as num, min(value) as least_, max(value) as most_, sum({varint('len')} + len) as raw_bytes,
  min(x) as low, max(x) as high, min_by(x, row_no) as x0, max(case when row_no = 2 then z1 end) as z1_first,
  sum({varint('len')} + {varint(f"coalesce(z1, {zz('x')})")}) as delta_bytes, sum(case when z1 is not null then {varint('z1')} end) as z1_bytes,
  sum(case when z2 is not null then {varint('z2')} end) as z2_bytes, max(z1) as z1_max, max(z2) as z2_max,
  sum(q1 + 1 + k1) as rice_bits, sum(q2 + 1 + k2) as rice2_bits, max(q1) as q1_max, max(q2) as q2_max from qs group by supp, col),
en as (select supp, col, count(*) as dist, sum({varint('strlen(value)')} + strlen(value)) as entry_bytes, sum({varint('id')} * times) as id_bytes from di group by supp, col),
al as (select *, 1 + len_bytes + {varint('x0')} as head, case when n > 1 then {varint('z1_first')} else 0 end as second_ from ag join en using (supp, col) join lm using (supp, col)),
co as (select supp, col, n,
  (1 + raw_bytes)::bigint as raw,
  (case when least_ = most_ then 1 + {varint('strlen(least_)')} + strlen(least_) end)::bigint as const,
  (case when num then 1 + delta_bytes end)::bigint as delta,
  (case when num then head + coalesce(z1_bytes, 0) end)::bigint as delta_compact,
  (case when num then head + second_ + coalesce(z2_bytes, 0) end)::bigint as delta2_compact,
  (case when num and n >= 8 and high - low <= 4294967295 then 1 + len_bytes + {varint('low')} + 9 + (n * {width('high - low')} + 7) // 8 end)::bigint as for_bitpack,
  (case when num and n >= 8 and z1_max <= 4294967295 then head + 9 + ((n - 1) * {width('z1_max')} + 7) // 8 end)::bigint as delta_bitpack,
  (case when num and n >= 12 and z2_max <= 4294967295 then head + second_ + 9 + ((n - 2) * {width('z2_max')} + 7) // 8 end)::bigint as delta2_bitpack,
  (case when num and n >= 8 and q1_max <= 4096 then head + 9 + (rice_bits + 7) // 8 end)::bigint as rice,
  (case when num and n >= 12 and q2_max <= 4096 then head + second_ + 9 + (rice2_bits + 7) // 8 end)::bigint as rice2,
  (case when n >= 3 and dist < n and dist <= 4096 then 1 + {varint('dist')} + entry_bytes + id_bytes end)::bigint as dict,
  (case when n >= 8 and dist > 1 and dist < n and dist <= 256 then 1 + {varint('dist')} + entry_bytes + 9 + (n * {width('greatest(1, dist - 1)')} + 7) // 8 end)::bigint as dict_packed
  from al)"""
_COSTS = f"with {_VALUES}, {COSTS_OF_VALUES}"
_CASES = " ".join(f"when {c} = least({', '.join(CODECS)}) then '{c}'" for c in CODECS)

ORACLE = {
    "column_codec_bytes": f"{_COSTS} select * from co",
    "codec_choice": f"{_COSTS} select supp, col, n, case {_CASES} end as codec, least({', '.join(CODECS)}) as bytes from co",
    **{f"codec_{name}_bytes": f"{_COSTS} select supp, col, {name} as bytes from co" for name in CODECS},
    "length_model_bytes": f"with {_ROWS}, {_LENGTHS} select * from lm",
    "dict_encode_ids": f"with {_VALUES}, {_DICT} select supp, col, row_no, id from vals join di using (supp, col, value)",
    "zigzag_values": f"with {_ROWS} select supp, col, row_no, z1::bigint as z1, z2::bigint as z2, d1::bigint as d1 from zs where x is not null",
    "varint_histogram": f"""with {_ROWS} select col, {varint(f"coalesce(z1, {zz('x')})")} as bytes, count(*) as times from zs where x is not null group by 1, 2""",
    "delta_decode_roundtrip": f"with {_VALUES} select * from vals where col != 'flag'",
}
