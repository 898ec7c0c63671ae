"""Line dedup: content-defined chunks of lines, and removal of those that came before anywhere in the corpus.

Texts are cut at ``\\n`` into lines. A rolling hash runs over the hashes of the last ``WINDOW`` lines; where it is divisible
by ``divisor`` a chunk ends. Cuts depend on near lines only, so a passage that moves inside or between documents is cut
alike again after a few lines. A line of at least ``long_words`` words is a chunk of its own. Chunks count when they have
two or more lines and ``least_words`` words, or are one long line.

With ``passages``, every run of consecutive lines with at least ``long_words`` words that also starts earlier in the corpus
goes too, wherever the cuts lie. Each line gives two windows: the shortest run of lines from it, and the shortest run up to
it, that has ``long_words`` words. A window depends on its own lines only. The line k of a repeated run a..b lies in a
window inside the run: in that up to k if a..k has the words, else in that from a. So the windows that occur again
cover exactly the repeated runs. Of a document's repeated windows those that cover the same lines are kept, no more.

Chunks and windows with equal digests are held against the bytes of the first of them (smallest doc_id, then place) and removed
where the bytes agree; the first one stays. What is left of a text keeps its lines in order.

Scale: the digest of a chunk or window travels, not its text. Texts are dealt by doc_id once, and only the bytes of repeated
chunks are compared, at most ``group_slice`` members beside one copy of the first.

Defined results: a null text stays null, an empty one empty. A text without repeated chunks is returned as it is, bytes
and all. Chunks and runs repeated inside one document go too; runs are judged on the input, and may overlap.
``_gone_chunks`` counts chunks, not windows. Rows of one doc_id are one document, and must have one text. Rows
without doc_id are left alone. An empty table gives an empty table. Extra columns are returned unchanged, whatever
their names: the added columns take as many leading underscores as they need to be new (``added_columns``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

WINDOW = 3
#: Odd multipliers of the last lines' hashes, the newest first.
ROLL = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
#: Numbers of windows start here, those of chunks lie below.
PASSAGE = 1 << 30
CHUNK = "doc_id bigint, chunk int, digest binary, first_line int, last_line int"


def chunk_edges(lines: list[bytes], words: np.ndarray, divisor: int, long_words: int) -> list[int]:
    """First line of each chunk, and the number of lines."""
    n = len(lines)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, lines), np.uint64, n)
    rolled = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        rolled[k:] += hashes[: n - k] * ROLL[k]
    ends = (rolled >> np.uint64(11)) % np.uint64(divisor) == 0
    long_ = words >= long_words
    ends |= long_
    ends[:-1] |= long_[1:]
    ends[-1] = True
    return [0, *(np.flatnonzero(ends) + 1).tolist()]


def lines_of(text: str) -> tuple[list[bytes], np.ndarray]:
    """Lines, and the words of each."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    return lines, np.fromiter((len(line.split()) for line in lines), np.int64, len(lines))


def chunks_of(text: str, divisor: int, least_words: int, long_words: int) -> list[tuple[int, bytes, int, int]]:
    """Number, digest, first and last line of every chunk that counts."""
    return _chunks(*lines_of(text), divisor, least_words, long_words)


def _chunks(lines: list[bytes], words: np.ndarray, divisor: int, least_words: int, long_words: int) -> list[tuple[int, bytes, int, int]]:
    edges = chunk_edges(lines, words, divisor, long_words)
    upto = np.concatenate(([0], np.cumsum(words)))
    found = []
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        total = upto[b] - upto[a]
        if total >= long_words if b - a == 1 else total >= least_words:
            found.append((k, xxhash.xxh3_128_digest(b"\n".join(lines[a:b])), a, b - 1))
    return found


def windows_of(ids: list[int], texts: list[tuple[list[bytes], np.ndarray]], least: int) -> pd.DataFrame:
    """Windows of two or more lines of all texts, as chunks. (One long line is a chunk anyway.)"""
    sizes = np.array([len(lines) for lines, _ in texts])
    text = np.repeat(np.arange(len(texts)), sizes)
    n = len(text)
    upto = np.concatenate(([0], np.cumsum(np.concatenate([words for _, words in texts]))))
    # the least end and the greatest start; a window that would need lines of another text has too few words
    first = np.concatenate((np.arange(n), np.searchsorted(upto, upto[1:] - least, "right") - 1))
    last = np.concatenate((np.searchsorted(upto, upto[:-1] + least, "left") - 1, np.arange(n)))
    good = (first >= 0) & (last < n) & (first < last)
    first, last = first[good], last[good]
    both = np.unique((first * n + last)[text[first] == text[last]])
    first, last = np.divmod(both, n)
    # sums of the lines' hashes times powers of an odd number, brought to a common power
    hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(line) for lines, _ in texts for line in lines), np.uint64).reshape(n, 2)
    digests = np.empty((len(first), 2), np.uint64)
    for k, base in enumerate(ROLL[:2]):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes[:, k] * np.cumprod(np.full(n, base)), dtype=np.uint64)))
        back = np.cumprod(np.full(n, pow(int(base), -1, 1 << 64), np.uint64))
        digests[:, k] = (sums[last + 1] - sums[first]) * back[first] + (last - first).astype(np.uint64) * ROLL[2]
    flat, own = digests.tobytes(), text[first]
    before = (np.cumsum(sizes) - sizes)[own]
    return pd.DataFrame({
        "doc_id": np.asarray(ids, np.int64)[own],
        "chunk": PASSAGE + np.arange(len(own)) - np.searchsorted(own, own),
        "digest": [flat[k : k + 16] for k in range(0, len(flat), 16)],
        "first_line": first - before,
        "last_line": last - before,
    })


def needed(marks: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each of the marks (number, first and last line) is needed to cover all their lines; chunks are."""
    keep = [number < PASSAGE for number, _, _ in marks]
    edges = np.zeros((2, max(b for _, _, b in marks) + 2), np.int64)
    for chunk, (_, a, b) in zip(keep, marks, strict=True):
        edges[int(chunk), a] += 1
        edges[int(chunk), b + 1] -= 1
    held = np.cumsum(edges, axis=1) > 0
    windows = sorted((a, b, k) for k, (number, a, b) in enumerate(marks) if number >= PASSAGE)
    at, best = 0, (-1, -1)
    upto = -1
    for line in np.flatnonzero(held[0] & ~held[1]).tolist():
        if line > upto:  # of the windows that hold it, the one that reaches farthest
            while at < len(windows) and windows[at][0] <= line:
                best = max(best, windows[at][1:])
                at += 1
            upto = best[0]
            keep[best[1]] = True
    return keep


def _members(docs: DataFrame, scratch: Scratch, divisor: int, least_words: int, long_words: int, passages: bool) -> DataFrame:
    """All chunks whose digest occurs again, with the place of its first occurrence and the number of members."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts = batch["doc_id"].tolist(), [lines_of(t) for t in batch["text"]]
            rows = [(d, *c) for d, t in zip(ids, texts, strict=True) for c in _chunks(*t, divisor, least_words, long_words)]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "digest", "first_line", "last_line"])
            if passages and ids:
                yield windows_of(ids, texts, long_words)

    chunks = scratch.save(docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(cut, CHUNK), "chunks")
    again = chunks.groupBy("digest").agg(F.min(F.struct("doc_id", "chunk")).alias("first"), F.count("*").alias("n")).where("n > 1")
    members = scratch.save(chunks.join(again, "digest"), "members")
    scratch.drop("chunks")
    if not passages:
        return members

    @F.pandas_udf("array<boolean>")
    def cover(numbers: pd.Series, firsts: pd.Series, lasts: pd.Series) -> pd.Series:
        return pd.Series([needed(list(zip(k.tolist(), a.tolist(), b.tolist(), strict=True))) for k, a, b in zip(numbers, firsts, lasts, strict=True)], dtype=object)

    is_first = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("chunk") == F.col("first.chunk"))
    later = members.where(~is_first).groupBy("doc_id").agg(F.collect_set(F.struct("chunk", "digest", "first_line", "last_line", "first", "n")).alias("m"))
    later = later.withColumn("keep", cover("m.chunk", "m.first_line", "m.last_line"))
    later = later.select("doc_id", F.explode(F.filter("m", lambda m, k: F.get("keep", k))).alias("m")).select("doc_id", "m.*")
    later = scratch.save(later, "later")
    firsts = members.where(is_first).join(later.select("digest").distinct(), "digest", "left_semi")
    return later.unionByName(firsts)


def added_columns(docs: DataFrame) -> tuple[str, str, str]:
    """Names of the columns that ``line_dedup`` adds: lines, lines that are gone and chunks that are gone."""
    taken = {c.lower() for c in docs.columns}
    mark = "_"
    while any(f"{mark}{c}" in taken for c in ("lines", "gone_lines", "gone_chunks")):
        mark += "_"
    return f"{mark}lines", f"{mark}gone_lines", f"{mark}gone_chunks"


def line_dedup(docs: DataFrame, divisor: int = 3, least_words: int = 20, long_words: int = 50, group_slice: int = 1000, scratch: Scratch | None = None, passages: bool = False) -> DataFrame:
    """Every row of ``docs`` with the repeated chunks, and repeated ``passages`` if asked for, taken out of ``text``, and the ``added_columns``."""
    scratch = scratch or Scratch(docs.sparkSession)
    names = added_columns(docs)
    quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in docs.columns}
    # other columns travel in one struct, so that their names meet none of those below
    rest_of = F.struct(F.lit(0).alias("_"), *[quoted[c].alias(f"c{k}") for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")])
    rows = docs.select(F.col("doc_id").alias("user_id"), F.col("doc_id").cast("bigint").alias("doc_id"), "text", rest_of.alias("others"))
    members = _members(rows, scratch, divisor, least_words, long_words, passages)
    slices = F.ceil(F.col("n") / group_slice).cast("int")

    # Texts meet their marks once; a document's list of marks is no longer than its list of chunks.
    marks = members.groupBy("doc_id").agg(F.collect_set(F.struct("chunk", "digest", "first_line", "last_line", "first", "n")).alias("marks"))
    joined = scratch.save(rows.join(marks, "doc_id", "left"), "joined")

    @F.pandas_udf("array<binary>")
    def bytes_of(texts: pd.Series, firsts: pd.Series, lasts: pd.Series) -> pd.Series:
        def cut(text, a, b):
            lines = text.encode("utf-8", "surrogatepass").split(b"\n")
            return [b"\n".join(lines[i : j + 1]) for i, j in zip(a, b, strict=True)]

        return pd.Series([cut(*x) for x in zip(texts, firsts, lasts, strict=True)], dtype=object)

    # Byte comparison. Digests that lie are next to never seen, so what is looked for are chunks unlike their first.
    marked = joined.where("marks is not null")
    bodies = marked.select("doc_id", "marks", bytes_of("text", "marks.first_line", "marks.last_line").alias("bodies"))
    bodies = bodies.select("doc_id", F.explode(F.arrays_zip("marks", "bodies")).alias("m")).select("doc_id", "m.marks.*", F.col("m.bodies").alias("body"))
    is_first = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("chunk") == F.col("first.chunk"))
    firsts = bodies.where(is_first).select("digest", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), F.col("body").alias("stays"))
    later = bodies.where(~is_first).select("doc_id", "chunk", "digest", "body", F.pmod(F.xxhash64("doc_id", "chunk"), slices.cast("bigint")).cast("int").alias("slice"))
    unlike = scratch.save(later.join(firsts, ["digest", "slice"]).where("body != stays").select("doc_id", "chunk").distinct(), "unlike")
    cuts = F.filter("marks", lambda m: ~((m["first"]["doc_id"] == F.col("doc_id")) & (m["first"]["chunk"] == m["chunk"])))
    marked = marked.withColumn("cuts", cuts)
    if unlike.limit(1).count():
        marked = marked.join(unlike.groupBy("doc_id").agg(F.collect_list("chunk").alias("spared")), "doc_id", "left")
        marked = marked.withColumn("cuts", F.filter("cuts", lambda m: ~F.coalesce(F.array_contains("spared", m["chunk"]), F.lit(False))))

    @F.pandas_udf("struct<text: string, lines: int, gone: int>")
    def rest(texts: pd.Series, firsts: pd.Series, lasts: pd.Series) -> pd.DataFrame:
        out = []
        for text, a, b in zip(texts, firsts, lasts, strict=True):
            lines = text.split("\n")
            drop = {k for i, j in zip(a, b, strict=True) for k in range(i, j + 1)}
            out.append(("\n".join(x for k, x in enumerate(lines) if k not in drop), len(lines), len(drop)))
        return pd.DataFrame(out, columns=["text", "lines", "gone"])

    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n", -1)))
    zero = F.lit(0)
    columns = ["user_id", "others", "text", "lines", "gone_lines", "gone_chunks"]
    whole = lambda rows: rows.select("user_id", "others", "text", n_lines.alias("lines"), zero.alias("gone_lines"), zero.alias("gone_chunks"))
    cut = marked.where("size(cuts) > 0").withColumn("rest", rest("text", "cuts.first_line", "cuts.last_line"))
    gone_chunks = F.size(F.filter("cuts", lambda m: m["chunk"] < PASSAGE))
    cut = cut.select("user_id", "others", F.col("rest.text").alias("text"), F.col("rest.lines").alias("lines"), F.col("rest.gone").alias("gone_lines"), gone_chunks.alias("gone_chunks"))
    found = whole(joined.where("marks is null")).unionByName(whole(marked.where("size(cuts) = 0"))).unionByName(cut).select(*columns)
    back = {c: F.col(f"others.c{k}") for k, c in enumerate(docs.columns)} | {"doc_id": F.col("user_id"), "text": F.col("text")}
    return found.select(*[back[c].alias(c) for c in docs.columns], *[F.col(c).alias(n) for c, n in zip(columns[3:], names, strict=True)])
