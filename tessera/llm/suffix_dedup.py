"""Suffix-array dedup: takes out every byte covered by a ``length``-byte string that also starts earlier in the corpus.

The corpus enters a logarithmic family of suffix arrays in batches of documents.

* A suffix array holds sampled suffixes. A string of ``length`` bytes has an anchor, the ``ANCHOR``-byte gram in it with the
  least keyed hash (the leftmost on ties), so equal strings have equal anchors at equal places. Neighbouring strings share
  their anchor; each run of them is one entry: (key of the anchor, digest of the run's bytes, document, place). About
  one byte in 35 starts an entry, and no string is missed, whatever its text.
* A new batch is sorted by key and digest, and merge-scanned against the levels: one merge brings entries of equal keys
  together. Entries with an equal digest repeat an earlier run of strings as a whole. Entries with an equal key and
  another digest may share some of their strings; they are noted as candidates.
* What is new in a batch becomes a level of size one; two levels of equal size merge into one of twice the size, sorted
  by key, before the next batch comes.
* Candidates are settled by the 64-bit hashes of all their ``length``-byte strings: the earliest of equal strings stays.

Earlier means: smaller doc_id, or the same document and a smaller start. Strings are judged on the input. Two strings
count as equal when their anchors' and their own 64-bit hashes agree.

Scale: copies meet in an aggregate with map-side combine, then in a join that Spark splits where keys are skewed.
Candidates of a key are settled in one task up to ``group_most`` of them; of more common keys each string is a row of its
own, aggregated by hash. Texts are read once to be sampled and joined twice by doc_id.

Defined results: a null text is empty; texts under ``length`` bytes are kept whole. Texts are taken as UTF-8 bytes, and
what is left need not be UTF-8. Rows of one doc_id are one document, and must have one text. A row without doc_id is
kept whole and makes nothing else go. An empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .metric_join import whole_groups
from .scratch import Scratch
from .text import id_ranges, utf8

ANCHOR = 32
#: Bytes that are hashed at once; places in a block fit into 20 bits.
BLOCK = 1 << 19
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
PLACE = np.uint64((1 << 20) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD[0]
    x = (x ^ (x >> np.uint64(29))) * ODD[1]
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """Hashes of all grams of each size: grams of 1, 2, 4, ... bytes by doubling, then the binary parts of the size."""
    grams = {1: _mix(data.astype(np.uint64) + np.uint64(1))}
    width = 1
    while width * 2 <= min(max(sizes), len(data)):
        last = grams[width]
        joined = last[:-width] * ODD[2 + width.bit_length() % 4] + last[width:]
        width *= 2
        grams[width] = joined ^ (joined >> np.uint64(31))
    out = []
    for size in sizes:
        n, at, made = len(data) - size + 1, 0, None
        for part in (1 << b for b in range(size.bit_length() - 1, -1, -1) if size >> b & 1):
            piece = grams[part][at : at + n]
            made = piece if made is None else made * ODD[5] + piece
            at += part
        out.append(_mix(made))
    return out


def entries_of(data: np.ndarray, owner: np.ndarray, left: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Entries of one block: key, digest, first place and number of strings.

    ``owner`` numbers the texts of the block, ``left`` is the number of bytes from a place to the end of its text.
    """
    anchors, strings = gram_hashes(data, ANCHOR, length)
    n = len(strings)
    # hash above, place below: the least is the anchor, and of equal hashes the leftmost
    least = (anchors & ~PLACE) | np.arange(len(anchors), dtype=np.uint64)
    window, width = length - ANCHOR + 1, 1
    while width * 2 <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if window > width:
        least = np.minimum(least[: n], least[window - width : window - width + n])
    at = (least & PLACE).astype(np.int64)
    good = left[:n] >= length
    new = np.ones(n, bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[1:n] != owner[: n - 1])
    first = np.flatnonzero(new & good)
    count = np.add.reduceat(good, np.flatnonzero(new))[np.cumsum(new)[first] - 1]
    digest = _mix(strings[first] * ODD[3] ^ strings[first + count - 1] * ODD[4] ^ count.astype(np.uint64))
    return anchors[at[first]], digest, first, count


def blocks_of(ids: list[int], texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in blocks: bytes, and for each byte its document, its place there and the bytes left to read.

    Longer texts come in pieces that share ``length`` - 1 bytes, so each string lies whole in one piece.
    """
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def block():
        data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
        sizes = np.array([len(p) for _, _, p in held])
        number = np.repeat(np.arange(len(held)), sizes)
        place = np.arange(len(data)) - (np.cumsum(sizes) - sizes)[number]
        return data, number, sizes[number] - place, np.array([d for d, _, _ in held])[number], np.array([o for _, o, _ in held])[number] + place

    for i, text in zip(ids, texts, strict=True):
        if len(text) < length:
            continue
        for at in range(0, len(text) - length + 1, BLOCK):
            piece = text[at : at + BLOCK + length - 1]
            if held and size + len(piece) > BLOCK + length - 1:
                yield block()
                held, size = [], 0
            held.append((i, at, piece))
            size += len(piece)
    if held:
        yield block()


ENTRY = "key bigint, digest bigint, doc_id bigint, place bigint"


def sampled(texts: DataFrame, length: int) -> DataFrame:
    """Entries of all texts(doc_id, body). ``place`` is the start times 128 plus the number of strings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data, owner, left, doc, place in blocks_of(batch["doc_id"].tolist(), batch["body"].tolist(), length):
                key, digest, first, count = entries_of(data, owner, left, length)
                yield pd.DataFrame({"key": key.view(np.int64), "digest": digest.view(np.int64), "doc_id": doc[first], "place": place[first] * 128 + count})

    return texts.mapInPandas(run, ENTRY)


class SuffixIndex:
    """Levels of entries sorted by key; no two of their entries have the same key and digest."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.levels, self.batches = scratch, [], 0
        self.copies: list[DataFrame] = []
        self.candidates: list[DataFrame] = []

    def _merge_levels(self) -> None:
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, one, names), (_, two, more) = self.levels.pop(), self.levels.pop()
            name = f"level{self.batches}_{2 * size}"
            merged = self.scratch.save(one.unionByName(two).repartition("key").sortWithinPartitions("key"), name)
            for old in names + more:
                self.scratch.drop(old)
            self.levels.append((2 * size, merged, [name]))

    def add(self, entries: DataFrame) -> None:
        """A batch of later documents: finds its copies and candidates among itself and all levels, then adds it."""
        self._merge_levels()
        k = self.batches = self.batches + 1
        entries = self.scratch.save(entries, f"entries{k}")
        array = entries.groupBy("key", "digest").agg(F.min(F.struct("doc_id", "place")).alias("f"), F.count("*").alias("n"))
        scan = array.select("key", "digest", "f.doc_id", "f.place", "n", F.lit(True).alias("new"))
        for _, level, _ in self.levels:
            scan = scan.unionByName(level.select("*", F.lit(0).cast("bigint").alias("n"), F.lit(False).alias("new")))
        same_key, same_run = Window.partitionBy("key"), Window.partitionBy("key", "digest")
        scan = scan.repartition("key").withColumns({"first": F.min(F.struct("doc_id", "place")).over(same_run)})
        scan = scan.withColumns({"some_new": F.max("new").over(same_key), "least": F.min("digest").over(same_key), "most": F.max("digest").over(same_key), "c": F.count("*").over(same_key)})
        own = F.struct("doc_id", "place") == F.col("first")
        scan = scan.withColumn("fresh", own).withColumn("open", F.col("some_new") & (F.col("least") < F.col("most")) & own)
        scan = self.scratch.save(scan.where("new or open").select("key", "digest", "doc_id", "place", "n", "new", "first", "fresh", "open", "c"), f"scan{k}")
        repeated = scan.where("new and (n > 1 or not fresh)").select("key", "digest", "first")
        copies = entries.join(repeated, ["key", "digest"]).where(F.struct("doc_id", "place") != F.col("first"))
        self.copies.append(self.scratch.save(copies.select("doc_id", "place"), f"copies{k}"))
        self.scratch.drop(f"entries{k}")
        self.candidates.append(self.scratch.save(scan.where("open").select("key", "doc_id", "place", "c"), f"open{k}"))
        self.levels.append((1, scan.where("new and fresh").select("key", "digest", "doc_id", "place"), [f"scan{k}"]))

    def close(self) -> None:
        for _, _, names in self.levels:
            for name in names:
                self.scratch.drop(name)
        self.levels = []


def _settled(candidates: DataFrame, texts: DataFrame, length: int, group_most: int, scratch: Scratch) -> DataFrame:
    """Places (doc_id, place) of candidates' strings that start earlier elsewhere; runs of strings, as in entries."""
    # A key's count can fall from batch to batch; all its candidates go by the greatest, or some would not meet.
    common = candidates.groupBy("key").agg(F.max("c").alias("most")).where(F.col("most") > group_most)
    noted = candidates.groupBy("doc_id", "place", "key").agg(F.max("c").alias("c")).join(common, "key", "left").withColumn("c", F.coalesce("most", "c"))
    noted = noted.groupBy("doc_id").agg(F.collect_list(F.struct("place", "key", "c")).alias("at"))

    def hash_strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            runs = pd.DataFrame(
                [(k, a["place"] >> 7, a["place"] & 127, a["key"], a["c"]) for k, at in enumerate(batch["at"]) for a in at], columns=["row", "start", "count", "key", "c"]
            )
            sizes = runs["count"].to_numpy() + length - 1
            # as many runs at once as fill a block, whichever documents they are from
            for _, part in runs.groupby(np.cumsum(sizes) // BLOCK):
                row, start, count = (part[c].to_numpy() for c in ("row", "start", "count"))
                size = sizes[part.index]
                rows = np.unique(row)
                bodies = [np.frombuffer(b, np.uint8) for b in batch["body"].iloc[rows]]
                spot = np.searchsorted(rows, row)
                slot = np.cumsum(size) - size
                data = np.concatenate([bodies[k][s : s + n] for k, s, n in zip(spot.tolist(), start.tolist(), size.tolist(), strict=True)])
                (hashes,) = gram_hashes(data, length)
                hashes = hashes.view(np.int64)
                strings = [hashes[s : s + c] for s, c in zip(slot.tolist(), count.tolist(), strict=True)]
                yield pd.DataFrame({"key": part["key"], "c": part["c"], "doc_id": batch["doc_id"].to_numpy()[row], "start": start, "strings": strings})

    hashed = texts.join(noted, "doc_id").mapInPandas(hash_strings, "key bigint, c bigint, doc_id bigint, start bigint, strings array<bigint>")
    hashed = scratch.save(hashed, "hashed")

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, group in whole_groups(batches, ["key"]):
            once = ~part.duplicated(["key", "doc_id", "start"]).to_numpy()  # a document's rows may repeat
            part, group = part[once], group[once]
            sizes = part["strings"].map(len).to_numpy()
            row = np.repeat(np.arange(len(part)), sizes)
            # rows come by document and start, so of equal strings the one that comes first is the earliest
            own = np.concatenate(part["strings"].to_numpy()).view(np.uint64) ^ _mix(group.astype(np.uint64))[row]
            order = np.argsort(own)
            own = own[order]
            heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            first = np.repeat(np.minimum.reduceat(order, heads), np.diff(np.append(heads, len(own))))
            late = np.sort(order[order != first])
            start = part["start"].to_numpy()[row[late]] + late - (np.cumsum(sizes) - sizes)[row[late]]
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[row[late]], "place": start * 128 + 1})

    cold = hashed.where(F.col("c") <= group_most).repartition("key").sortWithinPartitions("key", "doc_id", "start").mapInPandas(settle, "doc_id bigint, place bigint")
    each = hashed.where(F.col("c") > group_most).select("key", "doc_id", "start", F.posexplode("strings").alias("k", "string"))
    each = each.select("key", "string", "doc_id", (F.col("start") + F.col("k")).alias("start"))
    firsts = each.groupBy("key", "string").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    hot = each.join(firsts, ["key", "string"]).where(F.struct("doc_id", "start") != F.col("first"))
    return cold.unionByName(hot.select("doc_id", (F.col("start") * 128 + 1).alias("place")))


def spans_of(places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed runs, as starts and ends in bytes."""
    order = np.sort(np.asarray(places, np.int64))
    start = order >> 7
    end = np.maximum.accumulate(start + (order & 127) + length - 1)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    heads = np.flatnonzero(new)
    return start[heads], end[np.append(heads[1:] - 1, len(end) - 1)]


KEPT = "doc_id bigint, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary"


def suffix_dedup(docs: DataFrame, length: int = 100, batches: int = 4, group_most: int = 10_000, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` for every row of ``docs(doc_id, text)``: what goes and the bytes that are left.

    ``length`` is from 2 * ANCHOR to 127 bytes. ``batches`` ranges of doc_id, with about as many documents each, enter the index one after the other.
    """
    if not 2 * ANCHOR <= length <= 127:
        raise ValueError("length must be from 64 to 127")
    scratch = scratch or Scratch(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8(F.col("text")).alias("body"))
    named = texts.where("doc_id is not null")
    index = SuffixIndex(scratch)
    for batch in id_ranges(named, batches):
        index.add(sampled(batch, length))
    index.close()
    gone = _settled(_union(index.candidates), named, length, group_most, scratch)
    gone = _union([*index.copies, gone]).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list("place").alias("places"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                rows = []
                for doc, body, places in batch.iloc[at : at + 512].itertuples(index=False):
                    spans = []
                    if places is not None and len(places):
                        starts, ends = spans_of(places, length)
                        spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
                    edges = [0, *(x for span in spans for x in span), len(body)]
                    rows.append((doc, len(body), [{"start": a, "end": b} for a, b in spans], b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))))
                made = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "spans", "kept"])
                made["doc_id"] = made["doc_id"].astype("Int64")
                yield made

    return texts.join(gone, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "body", "places").mapInPandas(cut, KEPT)


def removed_bytes(kept: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of what ``suffix_dedup`` returns."""
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return kept.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out
