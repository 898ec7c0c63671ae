"""Pieces of oracle SQL that several queries share."""

from __future__ import annotations


def varint(x: str) -> str:
    """Bytes of a number at 7 bits a byte."""
    return "(1 + " + " + ".join(f"(({x}) >= {1 << bits})::bigint" for bits in range(7, 56, 7)) + ")"


def zigzag(x: str) -> str:
    return f"(case when ({x}) < 0 then -2 * ({x}) - 1 else 2 * ({x}) end)"


def width(x: str) -> str:
    """Bits of a number; 0 for 0 and below."""
    return f"(case when ({x}) <= 0 then 0 else length(bin(({x})::bigint)) end)"
