"""From raw documents to encoded training text, in five stages; each calls one operator of ``tessera.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``.

1. quality: documents that the base rules or the robust outlier test of their language and source reject go.
2. line_dedup: chunks of lines, and runs of lines with 50 words or more, that come earlier go; a document that loses all its lines this way goes.
3. near_duplicates: of documents linked by five-word shingles at a similarity of 0.8 or more, the smallest doc_id stays.
4. mixing: every document is repeated as often as the mix of sources takes it.
5. encode: pieces of each text with merge dropout, and whether they decode to it.

SQL expresses neither the robust estimates, nor rolling hashes, nor the encoder, so there is no ORACLE_SQL; the tests
hold the pipeline against a brute-force version.

Rows without doc_id are judged, mixed and encoded like others; line and near-duplicate removal leave them alone. Repeated
rows of a document are one document to the near duplicates, and rows of their own to the other stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.jaccard_join import jaccard_components
from tessera.llm.line_dedup import added_columns, line_dedup
from tessera.llm.mixing import mix
from tessera.llm.piece_bpe import decode_documents, encode_documents
from tessera.llm.quality_rules import quality_rules
from tessera.llm.scratch import Scratch

ORACLE_SQL = None

#: Tables of the stage before. Its result has been written when a stage starts, so nothing reads them any more.
_before: list[Scratch] = []


def _scratch(spark: SparkSession) -> Scratch:
    while _before:
        _before.pop().clear()
    _before.append(Scratch(spark))
    return _before[0]


def _numbered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """The documents with a number for each row, under a name of its own; rows may repeat, or lack a doc_id."""
    name = "row"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return scratch.save(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch = _scratch(spark)
    rows, number = _numbered(docs, scratch)
    judged = quality_rules(rows.select(F.col(number).alias("doc_id"), "text", "lang", "source"), scratch=scratch)
    rejected = judged.where("not kept").select(F.col("doc_id").alias(number))
    return rows.join(rejected, number, "left_anti").select(docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup(docs, scratch=_scratch(spark), passages=True)
    gone = added_columns(docs)[1]
    emptied = (F.col(gone) > 0) & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return kept.where(~emptied).withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard_components(docs, width=5, percent=80, scratch=_scratch(spark))
    later = found.where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch = _scratch(spark)
    rows, number = _numbered(docs, scratch)
    copies = mix(rows, scratch=scratch, row=number).where("copies > 0").select(F.col("row").alias(number), F.sequence(F.lit(1).cast("bigint"), "copies").alias(f"{number}_times"))
    return rows.join(copies, number).select(*docs.columns, F.explode(f"{number}_times")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _scratch(spark)
    decoded = decode_documents(encode_documents(docs))
    return decoded.select("doc_id", F.size("pieces").cast("bigint").alias("n_pieces"), (F.col("decoded") == F.col("text")).alias("lossless"), "pieces")


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the tables between stages are in the shared scratch folder."""
    between = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = between.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
