"""Phrases and lexemes that are worth a dictionary entry, for each text.

Phrases are n-grams of 3 to 10 bytes within a line; lexemes are runs of word-like bytes and quoted literals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.functions.scalars import varint_len
from tessera.operators.byte_stats import byte_counts, looks_textual

SHORTEST, LONGEST, LEAST_TIMES, MOST_PHRASES = 3, 10, 4, 254
#: Texts whose phrases are handed on together.
TEXTS = 64
NO_START = frozenset(b"\xff\n\r\t ")
#: Lexemes, for engines that do not backtrack; and without backtracking for Java, whose stack would grow with each escape. The latter
#: skips runs below 4 bytes, which give nothing.
LEXEME = r"[0-9A-Za-z_\-./:@$]+" + "".join(rf"|{q}[^{q}\\]*(?:\\(?s:.)[^{q}\\]*)*{q}?" for q in "\"'`")
POSSESSIVE = r"[0-9A-Za-z_\-./:@$]{4,}+" + "".join(rf"|{q}[^{q}\\]*+(?:\\(?s:.)[^{q}\\]*+)*+{q}?+" for q in "\"'`")


def frequent_grams(content: bytes) -> list[tuple[bytes, int]]:
    """Grams of SHORTEST to LONGEST bytes that start at a byte that may start one, end in their line, and occur LEAST_TIMES or more.

    Grams grow byte by byte from those that are frequent themselves; a place is dropped once its gram is not.
    """
    data = np.frombuffer(content, np.uint8)
    breaks = np.append(np.flatnonzero((data == 10) | (data == 13)), len(data))
    starts = np.flatnonzero(~np.isin(data, sorted(NO_START)))
    left = breaks[np.searchsorted(breaks, starts)] - starts
    gram, found = np.zeros(len(starts), np.int64), []
    for size in range(1, LONGEST + 1):
        fits = left >= size
        starts, left, gram = starts[fits], left[fits], gram[fits]
        _, first, gram, times = np.unique(gram << 8 | data[starts + size - 1], return_index=True, return_inverse=True, return_counts=True)
        frequent = times >= LEAST_TIMES
        if size >= SHORTEST:
            found += [(content[p : p + size], t) for p, t in zip(starts[first[frequent]].tolist(), times[frequent].tolist(), strict=True)]
        kept = frequent[gram]
        starts, left, gram = starts[kept], left[kept], gram[kept]
    return found


def few_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches in pieces of TEXTS texts: each text gives up to MOST_PHRASES rows, so results of a whole batch would be large."""
    return (batch[k : k + TEXTS] for batch in batches for k in range(0, len(batch), TEXTS))


def phrases(docs: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """``phrase`` (hex), ``length, times, score`` and ``rank`` of the best phrases of each text."""
    fields = f"{id_col} bigint, phrase string, length bigint, times bigint, score bigint, rank bigint"

    def best(content: bytes) -> list[tuple]:
        scored = [(-((len(p) - 2) * t - len(p) - 4), -len(p), p, t) for p, t in frequent_grams(content)]
        scored = sorted(s for s in scored if -s[0] > 16)[:MOST_PHRASES]
        return [(p.hex().upper(), len(p), t, -s, k) for k, (s, _, p, t) in enumerate(scored)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for texts in few_texts(batches):
            rows = [(i, *r) for i, b in zip(texts[id_col], texts["content"], strict=True) for r in best(b or b"")]
            yield pd.DataFrame(rows, columns=[id_col, "phrase", "length", "times", "score", "rank"])

    return docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text).cast("binary").alias("content")).mapInPandas(run, fields)


def token_pieces(token: Column) -> Column:
    """What each lexeme gives: a run of 4 bytes or more, cut at 128, and of one from 16 the first and last 32 bytes, too; a
    quoted literal of 6 to 160 bytes; null for others. Runs are ASCII, so characters are bytes there."""
    is_run, size = ~F.substring(token, 1, 1).isin(*"\"'`"), F.octet_length(token)
    long = F.array(F.substring(token, 1, 128), F.substring(token, 1, 32), F.right(token, F.lit(32)))
    return F.when(is_run & (size >= 16), long).when(is_run & (size >= 4) | ~is_run & size.between(6, 160), F.array(token))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(POSSESSIVE), 0)


def lexeme_pieces(text: Column) -> Column:
    """Every occurrence of a lexeme in a text, runs before quoted literals."""
    quoted = lambda s: F.substring(s, 1, 1).isin(*"\"'`")
    pieces = lambda wanted: F.flatten(F.transform(F.filter(tokens(text), wanted), lambda s: F.coalesce(token_pieces(s), F.array().cast("array<string>"))))
    return F.concat(pieces(lambda s: ~quoted(s)), pieces(quoted))


def lexemes(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``lexeme, length, times`` of every candidate: 4 to 128 bytes, not more than three quarters digits.

    Texts are dealt by their keys, and not their lexemes, which are more; counts and ranks of a key need no other exchange.
    """
    rows = docs.repartition(*keys).select(*keys, F.explode(tokens(F.coalesce(F.col(text), F.lit("")))).alias("token"))
    rows = rows.select(*keys, F.explode(token_pieces(F.col("token"))).alias("lexeme"))
    rows = rows.groupBy(*keys, "lexeme").agg(F.count("*").alias("times")).withColumn("length", F.octet_length("lexeme").cast("bigint"))
    digits = F.length(F.regexp_replace("lexeme", "[^0-9]+", ""))
    return rows.where(F.col("length").between(4, 128) & (~F.col("lexeme").rlike("[0-9]") | (4 * digits <= 3 * F.col("length"))))


def lexeme_scores(found: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates that occur twice and save more than 16 bytes, ranked for each key."""
    score = F.col("times") * (F.col("length") - 2) - (F.col("length") + varint_len(F.col("length")) + 2)
    rows = found.where("times >= 2").withColumn("score", score).where("score > 16")
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("length").desc(), "lexeme")
    return rows.withColumn("rank", (F.row_number().over(order) - 1).cast("bigint"))


def kept_entries(words: list[str], scores: list[int], least: int, leaders: int | None = None) -> list[bool]:
    """Which of ranked words stay: those of ``least`` or more, and those that lie in none of the (first ``leaders``) kept ones before.

    All words below ``least`` are looked for in a kept one at once, so a list takes time and memory as its length.
    """
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for word, score in zip(words, scores, strict=True):
        if score < least:
            automaton.add_word(word, word)
    if not automaton:
        return [True] * len(words)
    automaton.make_automaton()
    held, stay, leading = set(), [], 0
    for word, score in zip(words, scores, strict=True):
        stay.append(score >= least or word not in held)
        if stay[-1] and (leaders is None or leading < leaders):
            held.update(inside for _, inside in automaton.iter(word))
            leading += 1
    return stay


def without_contained(scored: DataFrame, keys: list[str], least: int = 128, leaders: int | None = None) -> DataFrame:
    """Drops entries below ``least`` that lie inside any entry kept before them; ranks the others anew.

    With ``leaders``, only the first so many kept entries are looked into.
    """

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def ranks(words: pd.Series, scores: pd.Series) -> pd.Series:
        """New ranks; -1 for what is dropped."""
        stay = [np.array(kept_entries(w.tolist(), s.tolist(), least, leaders)) for w, s in zip(words, scores, strict=True)]
        return pd.Series([np.where(k, k.cumsum() - 1, -1) for k in stay])

    others = [c for c in scored.columns if c not in [*keys, "rank"]]
    listed = scored.dropna(subset=keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", *others))).alias("all"))
    listed = listed.select(*keys, "all", ranks(F.col("all.lexeme"), F.col("all.score")).alias("again"))
    # outer: else Spark filters the lists by their size first, and looks into their words twice
    rows = listed.select(*keys, F.explode_outer(F.arrays_zip("all", "again")).alias("entry")).where("entry.again >= 0")
    return rows.select(*keys, *[F.col("entry.all")[c].alias(c) for c in others], F.col("entry.again").alias("rank")).select(*scored.columns)


#: A dictionary is tried on texts of so many bytes, if they are textual or large.
LEAST_BYTES, LARGE_BYTES = 2048, 256 * 1024
LEAST_HITS, LEAST_SAVED, LEAST_GAIN = 8, 64, 32
APPLIED = T.StructType().add("bytes", T.LongType()).add("hits", T.LongType()).add("saved", T.LongType()).add("valid", T.BooleanType())


def _varint(x: int) -> bytes:
    out = bytearray()
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    return bytes([*out, x])


def replaced(content: bytes, entries: list[bytes]) -> tuple[bytes, int, int]:
    """The content with the longest entry at every place as 255 and its number from 1, a byte 255 as 255, 0; hits, bytes saved."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for k, e in enumerate(entries):
        automaton.add_word(e.decode("latin-1"), (len(e), _varint(k + 1)))
    automaton.make_automaton()
    out, at, hits, saved = [], 0, 0, 0
    for end, (size, number) in automaton.iter_long(content.decode("latin-1")) if entries else ():
        out += [content[at : end + 1 - size].replace(b"\xff", b"\xff\0"), b"\xff", number]
        at, hits, saved = end + 1, hits + 1, saved + size - 1 - len(number)
    return b"".join([*out, content[at:].replace(b"\xff", b"\xff\0")]), hits, saved


def restored(payload: bytes, entries: list[bytes]) -> bytes:
    out, at = [], 0
    # a number may hold bytes 255 itself, so marks are looked for behind each number
    while (mark := payload.find(b"\xff", at)) >= 0:
        number, shift, end = 0, 0, mark + 1
        while payload[end] > 127:
            number |= (payload[end] & 127) << shift
            shift, end = shift + 7, end + 1
        number |= payload[end] << shift
        out += [payload[at:mark], entries[number - 1] if number else b"\xff"]
        at = end + 1
    return b"".join([*out, payload[at:]])


@F.pandas_udf(APPLIED)
def applied(content: pd.Series, entries: pd.Series) -> pd.DataFrame:
    """Size with dictionary, header and replaced content; valid when it restores to the content."""

    def one(b: bytes, words: list[bytes]) -> tuple:
        payload, hits, saved = replaced(b, words)
        size = 9 + len(_varint(len(words))) + sum(len(_varint(len(w))) + len(w) for w in words) + 4 + len(payload)
        return size, hits, saved, restored(payload, words) == b

    rows = [one(bytes(b), [bytes(w) for w in e]) for b, e in zip(content, entries, strict=True)]
    return pd.DataFrame(rows, columns=["bytes", "hits", "saved", "valid"])


def lexeme_candidate(docs: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """``n, entries, bytes, hits, saved, valid`` of each text that a dictionary of its lexemes makes smaller."""
    rows = docs.select(id_col, F.col(text).cast("binary").alias("content"), F.octet_length(text).cast("bigint").alias("n")).where(F.col("n") >= LEAST_BYTES)
    rows = rows.withColumn("counts", byte_counts("content")).where(looks_textual(F.col("counts"), F.col("n")) | (F.col("n") >= LARGE_BYTES))
    kept = without_contained(lexeme_scores(lexemes(docs, [id_col], text), [id_col]), [id_col])
    words = F.transform(F.sort_array(F.collect_list(F.struct("rank", "lexeme"))), lambda e: e["lexeme"].cast("binary"))
    both = rows.join(kept.groupBy(id_col).agg(words.alias("entries")), id_col)
    found = both.select(id_col, "n", F.size("entries").cast("bigint").alias("entries"), applied("content", "entries").alias("a")).select(id_col, "n", "entries", "a.*")
    return found.where((F.col("hits") >= LEAST_HITS) & (F.col("saved") >= LEAST_SAVED) & (F.col("bytes") < F.col("n") - LEAST_GAIN))
