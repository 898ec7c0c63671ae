"""URL filter: many glob rules at once, as one bit-parallel automaton over each canonical URL.

A rule names a host and a path prefix. It becomes two globs over the canonical URL ``host + path``: ``host/path**``
and ``*.host/path**``, where ``*`` stands for any bytes but ``/`` and ``**`` for any bytes. All globs are packed into
one row of 64-bit words, one bit for each prefix of a glob. A byte moves all globs of all URLs of a batch on with a
shift, two masks and an or (Shift-And); a star is a self-loop on the bit before it. Bits that are set at the end of a
URL are the globs that it fits.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and gets the default
verdict. Repeated rows are judged one by one. An empty table gives an empty table. Only ``page_id`` and ``url`` are
read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import ascii_lower


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


class GlobAutomaton:
    """Shift-And masks of all globs, in words of 64 bits.

    Each glob owns one bit for its empty prefix and one for every literal byte. ``step`` has, for each byte value, the
    bits that this byte may enter; ``stay`` the bits that a star keeps alive on it.
    """

    def __init__(self, globs: list[bytes]):
        places = []
        n = 0
        for glob in globs:
            places.append(n)
            n += 1 + len(glob.replace(b"*", b""))
        self.words = max(1, (n + 63) // 64)
        self.step = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.final = []
        for glob, at in zip(globs, places, strict=True):
            self._set(self.start, at)
            i = 0
            while i < len(glob):
                if glob[i : i + 1] == b"*":
                    deep = glob[i : i + 2] == b"**"
                    for byte in range(256):
                        if deep or byte != 0x2F:
                            self._set(self.stay[byte], at)
                    i += 2 if deep else 1
                else:
                    at += 1
                    self._set(self.step[glob[i]], at)
                    i += 1
            self.final.append(divmod(at, 64))

    @staticmethod
    def _set(words: np.ndarray, bit: int) -> None:
        words[bit // 64] |= np.uint64(1) << np.uint64(bit % 64)

    def match(self, urls: list[bytes]) -> np.ndarray:
        """One row for each URL, one column for each glob: whether the whole URL fits it."""
        lengths = np.fromiter(map(len, urls), np.int64, len(urls))
        order = np.argsort(-lengths, kind="stable")
        flat = np.frombuffer(b"".join(urls), np.uint8)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)[order] if len(urls) else lengths
        ranked = lengths[order]
        state = np.repeat(self.start[None, :], len(urls), axis=0)
        one, top = np.uint64(1), np.uint64(63)
        active = len(urls)
        for at in range(int(ranked[0]) if len(urls) else 0):
            while active and ranked[active - 1] <= at:
                active -= 1
            now = state[:active]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            byte = flat[starts[:active] + at]
            state[:active] = (moved & self.step[byte]) | (now & self.stay[byte])
        fits = np.empty((len(urls), len(self.final)), bool)
        for k, (word, bit) in enumerate(self.final):
            fits[order, k] = (state[:, word] >> np.uint64(bit)) & one
        return fits


def rule_globs(rule: Rule) -> list[bytes]:
    """The two globs of a rule; a literal star in a rule cannot occur in a host or path prefix and is refused."""
    if "*" in rule.name:
        raise ValueError(f"a rule is a host and a path prefix, without stars: {rule.name}")
    name = rule.name.encode()
    return [name + b"**", b"*." + name + b"**"]


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages(page_id, url)``.

    The longest rule that fits wins. The rules travel with the task; their automaton is built once per task. No shuffle.
    """
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.name))
    split = r"://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col("url"), F.lit(""))
    parts = pages.select(
        "page_id",
        ascii_lower(F.regexp_extract(url, split, 1)).alias("host"),
        F.regexp_extract(url, split, 2).alias("path"),
    )

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = GlobAutomaton([g for r in ranked for g in rule_globs(r)])
        for batch in batches:
            urls = [(h + p).encode() for h, p in zip(batch["host"], batch["path"], strict=True)]
            fits = automaton.match(urls).reshape(len(urls), len(ranked), 2).any(axis=2)
            hit = fits.any(axis=1) if ranked else np.zeros(len(urls), bool)
            best = fits.argmax(axis=1) if ranked else np.zeros(len(urls), np.int64)
            batch["rule"] = [ranked[b].name if h else None for b, h in zip(best, hit, strict=True)]
            batch["verdict"] = [ranked[b].verdict if h else default for b, h in zip(best, hit, strict=True)]
            yield batch

    page_type = pages.schema["page_id"].dataType.simpleString()
    return parts.mapInPandas(judge, f"page_id {page_type}, host string, path string, rule string, verdict string")
