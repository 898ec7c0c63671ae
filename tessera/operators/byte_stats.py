"""Byte statistics of texts: histograms, entropy, runs, and what byte-wise encodings of a text would take.

One pass gives each text its 256 counts; what follows is arithmetic on those counts inside Spark. Texts are counted whole.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that look like text besides 32 to 126 and 128 and above.
TEXT_CONTROLS = (9, 10, 13)


@F.pandas_udf(T.ArrayType(T.LongType()))
def byte_counts(content: pd.Series) -> pd.Series:
    return content.map(lambda b: np.bincount(np.frombuffer(b or b"", np.uint8), minlength=256))


@F.pandas_udf(T.StructType().add("runs", T.LongType()).add("longest", T.LongType()).add("repeated", T.LongType()).add("bytes", T.LongType()))
def run_counts(content: pd.Series) -> pd.DataFrame:
    """Runs of equal bytes: how many, the longest, those of two bytes or more, and what byte and length of each take."""

    def count(b):
        data = np.frombuffer(b or b"", np.uint8)
        if not len(data):
            return 0, 0, 0, 0
        runs = np.diff(np.flatnonzero(np.diff(data)), prepend=-1, append=len(data) - 1)
        extra = sum(int((runs >= 1 << bits).sum()) for bits in range(7, int(runs.max()).bit_length(), 7))
        return len(runs), int(runs.max()), int((runs > 1).sum()), 2 * len(runs) + extra

    return pd.DataFrame([count(b) for b in content], columns=["runs", "longest", "repeated", "bytes"], dtype="int64")


@F.pandas_udf(T.ArrayType(T.LongType()))
def context_counts(content: pd.Series) -> pd.Series:
    """Bytes after each of 16 contexts: the high half of the byte before; 0 stands before the first."""

    def count(b):
        data = np.frombuffer(b or b"", np.uint8)
        return np.bincount(np.concatenate(([0], data[:-1] >> 4))[: len(data)], minlength=16)

    return content.map(count)


@F.pandas_udf(T.LongType())
def huffman_bits(counts: pd.Series) -> pd.Series:
    """Bits of an optimal prefix code: every merge of the two rarest nodes adds one bit to all bytes below it."""

    def bits(c):
        heap = [int(x) for x in c if x]
        heapq.heapify(heap)
        total = 0
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            total += both
            heapq.heappush(heap, both)
        return total

    return counts.map(bits)


def counted(docs: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """``id, n, counts`` of each text; null is empty."""
    rows = docs.select(id_col, F.coalesce(F.col(text).cast("binary"), F.lit(b"").cast("binary")).alias("content"))
    return rows.select(id_col, F.octet_length("content").cast("bigint").alias("n"), byte_counts("content").alias("counts"))


def histogram(counts: DataFrame, id_col: str) -> DataFrame:
    return counts.select(id_col, F.posexplode_outer("counts").alias("byte", "times")).where("times > 0")


def entropy(counts: Column, n: Column) -> Column:
    """Bits a byte; 0 for an empty text."""
    share = lambda c: c / n
    return F.aggregate(counts, F.lit(0.0), lambda s, c: s - F.when(c > 0, share(c) * F.log2(share(c))).otherwise(0.0))


def looks_textual(counts: Column, n: Column) -> Column:
    """More than 92 % text bytes and at least two line ends."""
    text = F.aggregate(F.slice(counts, 33, 95), F.lit(0).cast("bigint"), lambda s, c: s + c) + F.aggregate(F.slice(counts, 129, 128), F.lit(0).cast("bigint"), lambda s, c: s + c)
    for b in TEXT_CONTROLS:
        text = text + counts[b]
    return (text > 0.92 * n) & (counts[10] >= 2)


def stream_costs(docs: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """Bytes of each text as a framed stream: raw, one byte filled, run lengths, Huffman; null where it does not apply."""
    rows = docs.select(id_col, F.coalesce(F.col(text).cast("binary"), F.lit(b"").cast("binary")).alias("content"))
    distinct = F.size(F.filter("counts", lambda c: c > 0))
    n = F.col("n")
    rows = rows.select(id_col, F.octet_length("content").cast("bigint").alias("n"), byte_counts("content").alias("counts"), run_counts("content")["bytes"].alias("runs"))
    return rows.select(
        id_col,
        "n",
        (5 + n).alias("raw"),
        F.when((n > 4) & (distinct == 1), F.lit(6)).cast("bigint").alias("fill"),
        F.when(n >= 16, 9 + F.col("runs")).alias("rle"),
        F.when((n >= 32) & (distinct >= 2), 269 + F.floor((huffman_bits("counts") + 7) / 8)).cast("bigint").alias("huffman"),
        F.when((n >= 32) & (distinct >= 2), 269 + F.floor((huffman_bits("counts") + n + 7) / 8)).cast("bigint").alias("huffman_plus_one"),
    )


#: Stream encodings in the order in which ties are settled.
STREAMS = ["raw", "fill", "huffman_plus_one", "rle"]


def stream_choice(costs: DataFrame, id_col: str, names: list[str] = STREAMS) -> DataFrame:
    """The smallest encoding of each text by name; ``huffman_plus_one`` has code lengths one bit above the optimal ones."""
    least = F.least(*names)
    name = F.coalesce(*[F.when(F.col(c) == least, F.lit(c)) for c in names])
    return costs.select(id_col, "n", name.alias("stream"), least.alias("bytes"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def table_frequencies(counts: pd.Series) -> pd.Series:
    """Frequencies of all bytes that sum to 4096: at least 1 each, what is missing to those that lack most, one by one;
    what is too much from the largest. Null for fewer than 64 bytes or two values."""
    total = 4096

    def table(c):
        c = np.asarray(c, np.int64)
        n = int(c.sum())
        used = np.flatnonzero(c)
        if n < 64 or len(used) < 2:
            return None
        f = np.where(c > 0, np.maximum(1, c * total // n), 0)
        while f.sum() < total:
            lack = c[used] / n - f[used] / total
            f[used[int(lack.argmax())]] += 1
        while f.sum() > total:
            f[int(np.where(f > 1, f, -1).argmax())] -= 1
        return f.astype(np.int32)

    return counts.map(table)


def initial_frequencies(counts: DataFrame, id_col: str, total: int = 4096) -> DataFrame:
    """Share of each byte in ``total``, at least 1: where a table of 12-bit probabilities starts."""
    rows = counts.select(id_col, "n", F.posexplode_outer("counts").alias("byte", "times")).where("times > 0")
    return rows.select(id_col, "byte", F.greatest(F.lit(1), F.floor(F.col("times") * total / F.col("n"))).cast("bigint").alias("freq"))
