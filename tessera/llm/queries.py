"""The registered query of each corpus operator, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_components
from .line_dedup import added_columns, line_dedup
from .mixing import mix
from .piece_bpe import decode_documents, encode_documents
from .quality_rules import quality_rules
from .suffix_dedup import removed_bytes, suffix_dedup
from .token_counts import token_counts
from .url_filter import Rule, filter_urls
from .warc import derive, response_records


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = [
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"), keep="largest")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(_table(spark, sf_dir, "documents"))
    return judged.withColumn("d2", F.round("d2", 3))


def op8_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_documents(_table(spark, sf_dir, "documents"))
    return decode_documents(encoded).select(
        "doc_id",
        F.size("pieces").cast("bigint").alias("n_pieces"),
        F.xxhash64("pieces").alias("pieces_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.col("text")).alias("lossless"),
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_bytes(suffix_dedup(_table(spark, sf_dir, "documents")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    lines, gone_lines, gone_chunks = added_columns(docs)
    return line_dedup(docs, passages=True).select(
        "doc_id",
        F.col(lines).cast("bigint").alias("n_lines"),
        F.col(gone_lines).cast("bigint").alias("n_removed_lines"),
        F.col(gone_chunks).cast("bigint").alias("n_removed_chunks"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derive(response_records(_table(spark, sf_dir, "pages")))
    return made.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "content_length", "block_digest", "source_digest", F.sha2("record", 256).alias("record_sha256"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_quality_rules": op7_quality_rules,
    "op8_piece_bpe": op8_piece_bpe,
    "op9_mixing": op9_mixing,
    "op10_warc": op10_warc,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op3_url_filter": f"""
with parts as (
  select page_id, {_LOWER.format("regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)")} as host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path from pages),
rules(rhost, rpath, verdict) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits as (
  select page_id, host, path, rhost || rpath as rule, r.verdict,
         row_number() over (partition by page_id order by length(rhost || rpath) desc nulls last) as k
  from parts left join rules r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from fits where k = 1""",
    "op4_exact_dedup": f"""
with n as (select doc_id, {_LOWER.format("coalesce(text, '')")} as t from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
       doc_id = max(doc_id) over g as kept, sha256(t) as text_sha256
from n window g as (partition by t)""",
    "op9_mixing": r"""
with s as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
  length(bin(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))) as class from documents),
src as (select source, sum(size)::bigint as source_size from s group by source),
w as (select *, ((row_number() over (order by source nulls last) - 1) % 3 + 1) as weight,
  sum(source_size) over ()::bigint as everything, source_size * 3 as cap from src),
l as (select *, (everything - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)::bigint)
  / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following)::bigint as lev from w),
lv as (select *, first_value(case when lev * weight <= cap then lev end ignore nulls) over (order by cap / weight, source nulls last rows between unbounded preceding and unbounded following) as level from l),
t as (select source, source_size, case when level is null then cap::double else least(cap::double, level * weight) end as target from lv),
c as (select source, class, sum(size)::bigint as class_size from s group by source, class having sum(size) > 0),
c2 as (select c.source, class, class_size, target, class_size * (64 - class) as pull, class_size * 3 as ccap
  from c join t on c.source is not distinct from t.source),
c3 as (select *, (target - coalesce(sum(ccap) over (partition by source order by ccap / pull, class rows between unbounded preceding and 1 preceding), 0)::bigint)
  / sum(pull) over (partition by source order by ccap / pull, class rows between current row and unbounded following)::bigint as lev from c2),
c4 as (select *, first_value(case when lev * pull <= ccap then lev end ignore nulls) over (partition by source order by ccap / pull, class rows between unbounded preceding and unbounded following) as level from c3),
c5 as (select *, least(3.0::double, coalesce(level * (64 - class), 3.0::double)) as e from c4),
p as (select source, class, floor(e)::bigint as whole, e - floor(e) as pi,
  target - sum(floor(e)::bigint * class_size) over (partition by source)::bigint as needed from c5),
u as (select s.*, whole, pi, needed, (('0x' || substr(md5('7:' || doc_id::varchar), 1, 12))::bigint::double + 0.5) / 281474976710656.0::double as u
  from s left join p on s.source is not distinct from p.source and s.class = p.class),
r as (select *, case when pi > 0 then (u / (1 - u)) / (pi / (1 - pi)) end as rank from u),
f as (select *, sum(case when rank is not null then size end) over (partition by source order by rank nulls last, doc_id rows unbounded preceding)::bigint as upto from r)
select doc_id, size, source_size, target, case when size = 0 then 0 else size * (coalesce(whole, 0) + case when rank is not null
  and (upto <= needed or (upto - size < needed and upto - needed <= needed - (upto - size))) then 1 else 0 end) end::bigint as taken
from f join t on f.source is not distinct from t.source""",
}
