"""Candidates for storing a text, their sizes, and the smallest one that decodes to the text.

A candidate is a filter followed by deflate, in a frame of its own; plain deflate goes without a frame.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.filters import FILTERS

#: Bytes around a framed text, around a chunked file and each of its chunks, and around blocks.
FRAME, CHUNK_FILE, CHUNK, BLOCK_FILE, BLOCK = 48, 22, 8, 13, 9
LEVEL = 9
#: In the order in which ties are settled.
CANDIDATES = ["plain", "deflate", *(f"{name}+deflate" for name in FILTERS)]


def encoded(content: bytes, name: str) -> bytes:
    if name == "plain":
        return content
    if name != "deflate":
        content = FILTERS[name.removesuffix("+deflate")][0](np.frombuffer(content, np.uint8).copy()).tobytes() if content else b""
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    return deflate.compress(content) + deflate.flush()


def decoded(payload: bytes, name: str, length: int) -> bytes:
    if name == "plain":
        return payload
    content = zlib.decompress(payload, -15)
    if name != "deflate" and content:
        content = FILTERS[name.removesuffix("+deflate")][1](np.frombuffer(content, np.uint8).copy()).tobytes()
    return content[:length]


@F.pandas_udf(T.StructType().add("payload", T.BinaryType()).add("candidate", T.StringType()).add("length", T.IntegerType()))
def encode(content: pd.Series, name: pd.Series) -> pd.DataFrame:
    """Payloads with what ``decode`` takes: one argument, so that both run in one worker and payloads stay there."""
    payloads = [encoded(bytes(c), n) for c, n in zip(content, name, strict=True)]
    return pd.DataFrame({"payload": pd.Series(payloads, dtype=object), "candidate": name, "length": content.str.len()})


@F.pandas_udf(T.StructType().add("content", T.BinaryType()).add("error", T.StringType()))
def decode(packed: pd.DataFrame) -> pd.DataFrame:
    """A payload that is cut or damaged gives an error instead of content."""
    out = []
    for p, k, n in zip(packed["payload"], packed["candidate"], packed["length"], strict=True):
        try:
            out.append((decoded(bytes(p), k, n), None))
        except (zlib.error, ValueError) as error:
            out.append((None, str(error)))
    return pd.DataFrame(out, columns=["content", "error"])


@F.pandas_udf(T.BinaryType())
def deflated(content: pd.Series) -> pd.Series:
    """The baseline: zlib at its best level."""
    return content.map(lambda b: zlib.compress(b or b"", LEVEL))


@F.pandas_udf(T.BinaryType())
def inflated(content: pd.Series) -> pd.Series:
    return content.map(zlib.decompress)


SIZED = T.ArrayType(T.StructType().add("candidate", T.StringType()).add("priority", T.IntegerType()).add("bytes", T.LongType()).add("valid", T.BooleanType()).add("error", T.StringType()))


def _framed(payload: bytes, name: str) -> int:
    return len(payload) + (0 if name == "deflate" else FRAME)


def candidates(rows: DataFrame, keys: list[str], content: str = "content", names: list[str] = CANDIDATES) -> DataFrame:
    """``candidate, priority, bytes, valid, error`` for each key of ``rows(keys..., content)`` and each name; one pass over the contents."""

    @F.pandas_udf(SIZED)
    def sized(contents: pd.Series) -> pd.Series:
        def one(whole: bytes, priority: int, name: str) -> dict:
            payload = encoded(whole, name)
            try:
                valid, error = decoded(payload, name, len(whole)) == whole, None
            except (zlib.error, ValueError) as wrong:
                valid, error = False, str(wrong)
            return {"candidate": name, "priority": priority, "bytes": _framed(payload, name), "valid": valid, "error": error}

        return contents.map(lambda c: [one(bytes(c or b""), k, name) for k, name in enumerate(names)])

    return rows.select(*keys, F.inline(sized(F.col(content))))


def winners(found: DataFrame, keys: list[str]) -> DataFrame:
    """The smallest valid candidate of each key; of equal ones the first."""
    best = F.min_by(F.struct("candidate", "bytes"), F.struct("bytes", "priority"))
    return found.where("valid").groupBy(*keys).agg(best.alias("best")).select(*keys, "best.candidate", "best.bytes")


def packed(content: bytes) -> tuple[int, str, bytes]:
    """Bytes with the frame, candidate and payload of what ``winners`` takes; only payloads that may win are decoded."""
    payloads = [encoded(content, name) for name in CANDIDATES]
    sizes = [_framed(p, name) for p, name in zip(payloads, CANDIDATES, strict=True)]
    best = next(k for k in sorted(range(len(sizes)), key=sizes.__getitem__) if decoded(payloads[k], CANDIDATES[k], len(content)) == content)
    return sizes[best], CANDIDATES[best], payloads[best]


@F.pandas_udf(T.LongType())
def packed_size(content: pd.Series) -> pd.Series:
    return content.map(lambda b: packed(bytes(b))[0]).astype("int64")


@F.pandas_udf(T.StructType().add("candidate", T.StringType()).add("bytes", T.LongType()).add("deflate", T.LongType()))
def smallest(content: pd.Series) -> pd.DataFrame:
    """What ``winners`` takes of all candidates, and the size of the zlib baseline, in one pass."""
    found = [(*packed(bytes(b or b""))[1::-1], len(zlib.compress(b or b"", LEVEL))) for b in content]
    return pd.DataFrame(found, columns=["candidate", "bytes", "deflate"])


def in_chunks(rows: DataFrame, keys: list[str], size: int, content: str = "content") -> DataFrame:
    """Content in chunks of ``size`` bytes: ``chunk_no`` from 0. Empty content has none."""
    count = F.ceil(F.octet_length(content) / size).cast("int")
    numbered = rows.where(F.octet_length(content) > 0).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), count - 1)))
    return numbered.select(*keys, "chunk_no", F.substring(F.col(content), F.col("chunk_no") * size + 1, F.lit(size)).alias("content"))


def chunked_size(sizes: Column) -> Column:
    """Bytes of a chunked file, from the sizes of its packed chunks."""
    return (CHUNK_FILE + F.coalesce(F.sum(CHUNK + sizes), F.lit(0))).cast("bigint")


BLOCKED = T.ArrayType(T.StructType().add("block_size", T.LongType()).add("blocks", T.LongType()).add("bytes", T.LongType()))


def block_tournament(rows: DataFrame, keys: list[str], sizes: list[int]) -> DataFrame:
    """For each key the block size whose blocks, each by its best filter, take the fewest bytes; empty content has none.

    Equal blocks, such as the one of a content below all sizes, are packed once, and only payloads that may win are decoded.
    """

    @F.pandas_udf(BLOCKED)
    def blocked(contents: pd.Series) -> pd.Series:
        def one(whole: bytes) -> list[dict]:
            blocks = {size: [whole[k : k + size] for k in range(0, len(whole), size)] for size in sizes}
            taken = {block: len(packed(block)[2]) for block in {b for some in blocks.values() for b in some}}
            return [{"block_size": size, "blocks": len(some), "bytes": BLOCK_FILE + sum(BLOCK + taken[b] for b in some)} for size, some in blocks.items()]

        return contents.map(lambda c: one(bytes(c)))

    found = rows.where(F.octet_length("content") > 0).select(*keys, blocked("content").alias("all"))
    best = F.array_min(F.transform("all", lambda b: F.struct(b["bytes"], b["block_size"], b["blocks"])))
    return found.select(*keys, best.alias("b")).select(*keys, "b.block_size", "b.blocks", "b.bytes")
