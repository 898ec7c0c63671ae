"""Exact dedup: a log-structured index from text digests to the identifier that stays.

``DigestIndex`` takes documents in batches. A batch is one memtable: it is grouped by digest in memory, with map-side
combine, and flushed as a run sorted by digest, with Bloom filters. Before that its digests probe the filters of all older
runs; those that may be there, or that the batch itself repeats, are noted. When a level holds ``fanout`` runs they are
compacted into one run of the next level, where each digest keeps the smallest rank and the sum of its counts, and their
filters are united. ``lookup`` merges the runs for the noted digests only: all others occur once. Every hit is then held
against the bytes of the text that stays; texts that share a digest but not their bytes are grouped by the bytes themselves.

Digests are dealt to buckets, and each run has one filter of fixed size for each bucket; the number of buckets grows with
the documents, so a filter stays sparse and no task holds more than one bucket's digests of a batch.

Defined results: a null text counts as empty, so null and empty texts are one group. Ties cannot occur between different
ids; rows with one id and equal text are all members and share the verdict (rows with one id must have one text). A row
without doc_id is a group of its own. An empty table gives an empty table. Only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .scratch import Scratch
from .text import id_ranges, utf8


def _digester(size: int):
    @F.pandas_udf("binary")
    def digest(texts: pd.Series) -> pd.Series:
        # bytes.lower() changes A-Z only, and so leaves every other character's UTF-8 as it is
        return texts.map(lambda b: hashlib.sha256(bytes(b).lower()).digest()[:size])

    return digest


@F.pandas_udf(BinaryType())
def normalised(texts: pd.Series) -> pd.Series:
    """A-Z lower-cased UTF-8 bytes."""
    return texts.map(lambda b: bytes(b).lower())


#: Digests of all documents for each bucket, and bits of a bucket's filter.
BUCKET_SIZE, FILTER_BITS = 1 << 17, 1 << 21
FILTER = "bucket bigint, bits binary"


def _places(digests: pd.Series) -> np.ndarray:
    """Four bits of the filter for each digest."""
    words = b"".join(bytes(d[:16]).ljust(16, b"\0") for d in digests)
    return np.frombuffer(words, "<u4").reshape(-1, 4) & np.uint32(FILTER_BITS - 1)


def _built(rows: pd.DataFrame) -> pd.DataFrame:
    """The filter of one bucket's digests."""
    bits = np.zeros(FILTER_BITS, bool)
    bits[_places(rows["digest"])] = True
    return pd.DataFrame({"bucket": rows["bucket"].iloc[:1], "bits": [np.packbits(bits).tobytes()]})


def _united(rows: pd.DataFrame) -> pd.DataFrame:
    both = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in rows["bits"]])
    return pd.DataFrame({"bucket": rows["bucket"].iloc[:1], "bits": [both.tobytes()]})


def _probed(rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """Digests of a bucket that some of its filters may hold."""
    found, places = np.zeros(len(rows), bool), _places(rows["digest"])
    for bits in filters["bits"]:
        own = np.unpackbits(np.frombuffer(bits, np.uint8)).view(bool)
        found |= own[places].all(axis=1)
    return rows.loc[found, ["digest"]]


class DigestIndex:
    """Sorted runs of (digest, least, n) in levels, each with filters; ``least`` is the smallest rank that has the digest."""

    def __init__(self, spark: SparkSession, scratch: Scratch, buckets: int = 1, fanout: int = 2):
        self.spark, self.scratch, self.buckets, self.fanout = spark, scratch, buckets, fanout
        self.levels: list[list[tuple[str, DataFrame, DataFrame]]] = []
        self.noted: list[DataFrame] = []
        self.written = 0

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy("digest").agg(F.min("least").alias("least"), F.sum("n").alias("n"))

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.select("digest", F.pmod(F.xxhash64("digest"), F.lit(self.buckets).cast("bigint")).alias("bucket"))

    def _flush(self, rows: DataFrame) -> tuple[str, DataFrame]:
        name = f"run{self.written}"
        self.written += 1
        return name, self.scratch.save(rows.sortWithinPartitions("digest"), name)

    def _runs(self) -> list[tuple[str, DataFrame, DataFrame]]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> None:
        """Flush one memtable: rows of (digest, rank)."""
        name, run = self._flush(self._merged(batch.select("digest", F.col("rank").alias("least"), F.lit(1).cast("bigint").alias("n"))))
        digests = self._bucketed(run)
        self.noted.append(run.where("n > 1").select("digest"))
        older = [filters for _, _, filters in self._runs()]
        if older:
            hits = digests.groupBy("bucket").cogroup(_union(older).groupBy("bucket")).applyInPandas(_probed, "digest binary")
            self.noted.append(self.scratch.save(hits, f"hits_{name}"))
        filters = self.scratch.save(digests.groupBy("bucket").applyInPandas(_built, FILTER), f"filters_{name}")
        level, new = 0, (name, run, filters)
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(new)
            if len(self.levels[level]) < self.fanout:
                return
            runs, self.levels[level] = self.levels[level], []
            name, run = self._flush(self._merged(_union([r for _, r, _ in runs])))
            filters = self.scratch.save(_union([f for _, _, f in runs]).groupBy("bucket").applyInPandas(_united, FILTER), f"filters_{name}")
            for old, _, _ in runs:
                self.scratch.drop(f"filters_{old}")  # the run itself is still read for the digests that it repeats
            level, new = level + 1, (name, run, filters)

    def lookup(self) -> DataFrame:
        """Each digest that may occur more than once, over all runs."""
        noted = self.scratch.save(_union(self.noted).distinct(), "noted")
        return self._merged(_union([run for _, run, _ in self._runs()]).join(noted, "digest", "left_semi"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def exact_dedup(docs: DataFrame, keep: str = "smallest", memtables: int = 4, digest_bytes: int = 32, group_slice: int = 1000) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs(doc_id, text)``.

    ``keep`` says which identifier of equal texts stays: the index keeps the smallest rank, which is the id or its
    negative. ``memtables`` is the number of batches, ranges of doc_id with about as many documents each, that are flushed one after the other.
    ``digest_bytes`` shortens the digest, for tests of the byte verification. ``group_slice`` is the number of members
    that meet one copy of the text that stays, so a group of any size is verified by many tasks.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    sign = {"smallest": 1, "largest": -1}[keep]
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8(F.col("text")).alias("body"))
    rows = scratch.save(
        texts.select("doc_id", _digester(32)("body").alias("full")).select(
            "doc_id", F.lower(F.hex("full")).alias("text_sha256"), F.expr(f"substring(full, 1, {digest_bytes})").alias("digest"), (F.col("doc_id") * sign).alias("rank")
        ),
        "digests",
    )
    index = DigestIndex(spark, scratch, -(-rows.count() // BUCKET_SIZE) or 1)
    for batch in id_ranges(rows, memtables):
        index.add(batch.where("doc_id is not null"))
    found = index.lookup().where("n > 1 and least is not null").select("digest", (F.col("least") * sign).alias("keep_id"), "n")
    joined = scratch.save(rows.drop("rank").join(found, "digest", "left"), "joined")
    alone = joined.where("keep_id is null or doc_id is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    hits = joined.where("keep_id is not null and doc_id is not null")

    # Byte verification: members meet the text that stays, at most group_slice of them at one copy of it.
    slices = F.ceil(F.col("n") / group_slice).cast("int")
    members = hits.withColumn("slice", F.pmod(F.xxhash64("doc_id"), slices.cast("bigint")).cast("int"))
    bodies = texts.join(hits.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", _digester(digest_bytes)("body").alias("digest"), normalised("body").alias("body"))
    bodies = scratch.save(bodies.dropDuplicates(["doc_id", "digest"]), "bodies")
    stays = (
        bodies.join(hits.where("doc_id = keep_id").select("doc_id", "digest", slices.alias("slices")).distinct(), ["doc_id", "digest"])
        .withColumn("slice", F.explode(F.expr("sequence(0, slices - 1)")))
        .select("digest", "slice", F.col("body").alias("stays"))
    )
    verified = members.join(bodies, ["doc_id", "digest"]).join(stays, ["digest", "slice"]).select("doc_id", "text_sha256", "digest", "keep_id", "body", (F.col("body") == F.col("stays")).alias("same"))
    checked = scratch.save(verified.select("doc_id", "text_sha256", "digest", "keep_id", "same", F.when(~F.col("same"), F.col("body")).alias("body")), "checked")
    sizes = checked.where("same").groupBy("digest").agg(F.count("*").alias("group_size"))
    right = checked.where("same").join(sizes, "digest").select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256")
    choose = F.min if sign > 0 else F.max
    wrong = checked.where("not same")
    groups = wrong.groupBy("digest", "body").agg(choose("doc_id").alias("own_id"), F.count("*").alias("own_size"))
    rest = wrong.join(groups, ["digest", "body"]).select("doc_id", F.col("own_id").alias("keep_id"), F.col("own_size").alias("group_size"), (F.col("doc_id") == F.col("own_id")).alias("kept"), "text_sha256")
    return alone.unionByName(right).unionByName(rest)
