"""Reversible byte filters, as vectorised functions on binary columns, and their inverses.

Each filter is a few array operations; ``FILTERS`` maps names to (forward, inverse).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def delta(d: np.ndarray) -> np.ndarray:
    return np.diff(d, prepend=np.uint8(0))


def undelta(d: np.ndarray) -> np.ndarray:
    return np.cumsum(d, dtype=np.uint8)


def xor(d: np.ndarray) -> np.ndarray:
    return d ^ np.concatenate(([0], d[:-1])).astype(np.uint8)[: len(d)]


def unxor(d: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.accumulate(d) if len(d) else d


def strided(width: int):
    """All bytes at places 0 mod width, then at 1 mod width and so on; a tail shorter than the width stays."""

    def forward(d: np.ndarray) -> np.ndarray:
        n = len(d) // width * width
        return np.concatenate([d[:n].reshape(-1, width).T.ravel(), d[n:]])

    def inverse(d: np.ndarray) -> np.ndarray:
        n = len(d) // width * width
        return np.concatenate([d[:n].reshape(width, -1).T.ravel(), d[n:]])

    return forward, inverse


def _packed(halves: np.ndarray) -> np.ndarray:
    halves = np.append(halves, np.uint8(0)) if len(halves) % 2 else halves
    return (halves[::2] << 4) | halves[1::2]


def nibbles(d: np.ndarray) -> np.ndarray:
    """High halves of all bytes, two a byte, then low halves."""
    return np.concatenate([_packed(d >> 4), _packed(d & 15)])


def unnibbles(d: np.ndarray) -> np.ndarray:
    # of an odd length both parts end in an empty half, which makes one byte more than the length
    half = len(d) // 2
    spread = lambda p: np.stack([p >> 4, p & 15], axis=1).ravel()
    return (spread(d[:half]) << 4) | spread(d[half:])


def bitplanes(d: np.ndarray) -> np.ndarray:
    """Bit 7 of all bytes, then bit 6 and so on, each plane packed."""
    return np.packbits(np.unpackbits(d.reshape(-1, 1), axis=1).T, axis=1).ravel()


def unbitplanes(d: np.ndarray) -> np.ndarray:
    return np.packbits(np.unpackbits(d.reshape(8, -1), axis=1), axis=0).ravel()


def delta32(d: np.ndarray) -> np.ndarray:
    n = len(d) // 4 * 4
    words = d[:n].view("<u4")
    return np.concatenate([np.diff(words, prepend=np.uint32(0)).astype("<u4").view(np.uint8), d[n:]])


def undelta32(d: np.ndarray) -> np.ndarray:
    n = len(d) // 4 * 4
    return np.concatenate([np.cumsum(d[:n].view("<u4"), dtype=np.uint32).astype("<u4").view(np.uint8), d[n:]])


def float_split(d: np.ndarray) -> np.ndarray:
    """32-bit floats apart: exponents, then signs, packed, then the three mantissa bytes of each; a tail stays."""
    n = len(d) // 4 * 4
    bits = d[:n].view("<u4")
    mantissa = (bits & 0x7FFFFF).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    return np.concatenate([(bits >> 23 & 255).astype(np.uint8), np.packbits((bits >> 31).astype(bool)), mantissa.T.ravel(), d[n:]])


def float_joined(d: np.ndarray) -> np.ndarray:
    # n floats take n exponents, ceil(n / 8) bytes of signs and 3 n of mantissas; up to 3 bytes are left over
    n = max(0, (len(d) - 3) * 8 // 33)
    while 4 * (n + 1) + (n + 8) // 8 <= len(d):
        n += 1
    signs = -(-n // 8)
    exponent, sign = d[:n].astype(np.uint32), np.unpackbits(d[n : n + signs])[:n].astype(np.uint32)
    low = np.zeros((n, 4), np.uint8)
    low[:, :3] = d[n + signs : 4 * n + signs].reshape(3, -1).T
    return np.concatenate([(low.view("<u4").ravel() | exponent << 23 | sign << 31).astype("<u4").view(np.uint8), d[4 * n + signs :]])


#: Filters that keep the length; those of half bytes and bits pad, and their inverses are cut to the length; that of floats adds its signs.
FILTERS = {
    "delta": (delta, undelta),
    "xor": (xor, unxor),
    "stride2": strided(2),
    "stride4": strided(4),
    "stride8": strided(8),
    "nibble": (nibbles, unnibbles),
    "bitplane": (bitplanes, unbitplanes),
    "delta32": (delta32, undelta32),
    "float32": (float_split, float_joined),
}


def apply_filter(content: Column, name: str) -> Column:
    forward = FILTERS[name][0]

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda b: forward(np.frombuffer(b, np.uint8).copy()).tobytes() if b else b"")

    return run(content)


def undo_filter(content: Column, name: str, length: Column) -> Column:
    inverse = FILTERS[name][1]

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda b: inverse(np.frombuffer(b, np.uint8).copy()).tobytes() if b else b"")

    # cut outside: without a second argument, filter and inverse run in one worker, and what is between them stays there
    return F.substring(run(content), F.lit(1), length)


@F.pandas_udf(T.StructType().add("exponents", T.ArrayType(T.IntegerType())).add("signs", T.IntegerType()).add("mantissa", T.BinaryType()))
def float_parts(vectors: pd.Series) -> pd.DataFrame:
    """32-bit floats apart: exponents, the number of minus signs, and the mantissas' bytes."""
    bits = [np.asarray(v, np.float32).view(np.uint32) for v in vectors]
    return pd.DataFrame({"exponents": [((b >> 23) & 255).astype(np.int32) for b in bits], "signs": [int((b >> 31).sum()) for b in bits], "mantissa": [(b & 0x7FFFFF).astype("<u4").tobytes() for b in bits]})
