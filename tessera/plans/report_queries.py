"""Queries that choose encodings of documents and report on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import human_size as human
from tessera.functions.scalars import percent_saved
from tessera.operators.reports import against_deflate, last_runs, with_previous, without_file
from tessera.operators.selection import CANDIDATES, block_tournament, candidates, chunked_size, decode, deflated, encode, in_chunks, inflated, packed_size, smallest
from tessera.sources.tables import spread, table

CHUNK_BYTES, BLOCK_SIZES = 4096, [8192, 16384]


def _content(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return documents.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary")).alias("content"))


def candidate_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(_content(spark, sf_dir), ["doc_id"]).select("doc_id", "candidate", "bytes", "valid")


def candidate_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _content(spark, sf_dir).select("doc_id", smallest("content").alias("s")).select("doc_id", "s.candidate", "s.bytes")


def candidate_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _content(spark, sf_dir).select("*", F.explode(F.array(*map(F.lit, CANDIDATES))).alias("candidate"))
    back = each.select("doc_id", "candidate", decode(encode("content", "candidate")).alias("back"))
    return back.select("doc_id", "candidate", F.sha2(F.col("back.content"), 256).alias("sha256"))


def chunk_container_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of stored chunks, as its SQL has them; ``chunk_container_packed`` has those of packed ones."""
    chunks = in_chunks(_content(spark, sf_dir), ["doc_id"], CHUNK_BYTES)
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), chunked_size(F.octet_length("content")).alias("bytes"))


def chunk_container_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers whose chunks are packed by their best candidate; a text without chunks has an empty container."""
    rows = _content(spark, sf_dir)
    chunks = in_chunks(rows, ["doc_id"], CHUNK_BYTES).select("doc_id", packed_size("content").alias("packed"))
    empty = rows.where(F.octet_length("content") == 0).select("doc_id", F.lit(None).cast("bigint").alias("packed"))
    return chunks.unionByName(empty).groupBy("doc_id").agg(F.count("packed").alias("chunks"), chunked_size(F.col("packed")).alias("bytes"))


def block_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_tournament(_content(spark, sf_dir), ["doc_id"], BLOCK_SIZES)


def ratio_vs_deflate(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _content(spark, sf_dir).select("doc_id", F.octet_length("content").cast("bigint").alias("original"), smallest("content").alias("s"))
    return against_deflate(sizes.select("doc_id", "original", "s.bytes", "s.deflate"), ["doc_id"])


def deflate_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = _content(spark, sf_dir).select("doc_id", deflated("content").alias("packed"))
    return packed.select("doc_id", F.sha2(inflated("packed"), 256).alias("sha256"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as histories: a run a turn, its size in bytes against its length in characters."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(F.col("conv_id").alias("file"), F.col("turn").alias("ts"), F.octet_length("text").cast("bigint").alias("size"), (F.length("text") + F.col("turn")).cast("bigint").alias("base"))


def run_history_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_previous(_runs(spark, sf_dir))


def last_n_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_runs(_runs(spark, sf_dir), 2).select("file", "ts", "size", "back")


def cleared_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_file(_runs(spark, sf_dir).select("file", "ts", "size"), 1)


def human_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.octet_length("text").cast("bigint")
    return table(spark, sf_dir, "documents").select("doc_id", human(n).alias("size"), human(n * 1000).alias("size_times_1000"), percent_saved(F.length("text"), n).alias("saved_percent"))


QUERIES = {
    "candidate_sizes": candidate_sizes,
    "candidate_winner": candidate_winner,
    "candidate_roundtrip": candidate_roundtrip,
    "chunk_container_sizes": chunk_container_sizes,
    "chunk_container_packed": chunk_container_packed,
    "block_tournament": block_sizes,
    "ratio_vs_deflate": ratio_vs_deflate,
    "deflate_roundtrip": deflate_roundtrip,
    "run_history_delta": run_history_delta,
    "last_n_runs": last_n_runs,
    "cleared_history": cleared_history,
    "human_size": human_size,
}

_RUNS = "runs as (select conv_id as file, turn as ts, strlen(text) as size, length(text) + turn as base from conversations)"
_HUMAN = "case when ({n}) is null then 'N/A' when ({n}) < 1024 then ({n})::varchar || ' B' when ({n}) < 1048576 then printf('%.2f', round(({n}) / 1024, 2)) || ' KB' else printf('%.2f', round(({n}) / 1048576, 2)) || ' MB' end"

ORACLE = {
    "candidate_roundtrip": f"select doc_id, unnest({CANDIDATES}) as candidate, sha256(coalesce(text, '')) as sha256 from documents",
    "chunk_container_sizes": f"select doc_id, (strlen(text) + {CHUNK_BYTES - 1}) // {CHUNK_BYTES} as chunks, 22 + 8 * ((strlen(text) + {CHUNK_BYTES - 1}) // {CHUNK_BYTES}) + strlen(text) as bytes from documents where strlen(text) > 0",
    "deflate_roundtrip": "select doc_id, sha256(coalesce(text, '')) as sha256 from documents",
    "run_history_delta": f"""with {_RUNS} select file, ts, size, base, size - lag(size) over (partition by file order by ts) as change,
  case when base > 0 then round((1 - size / base) * 100, 2) end as saved_percent,
  case when size < base then 'ours' when base < size then 'base' else 'tie' end as winner from runs""",
    "last_n_runs": f"with {_RUNS} select * from (select file, ts, size, row_number() over (partition by file order by ts desc) as back from runs) where back <= 2",
    "cleared_history": f"with {_RUNS} select file, ts, size from runs where file is distinct from 1",
    "human_size": f"select doc_id, {_HUMAN.format(n='strlen(text)')} as size, {_HUMAN.format(n='strlen(text) * 1000')} as size_times_1000, case when strlen(text) > 0 then round((1 - length(text) / strlen(text)) * 100, 2) end as saved_percent from documents",
}
