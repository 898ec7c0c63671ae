"""N-gram Jaccard join: exact links between documents whose shingle sets are alike, and their components.

Two documents link when 100 * |A ∩ B| >= percent * |A ∪ B|. The Jaccard distance is a metric with most documents at
distance 1 of each other, where it tells nothing. So the join first brings together what can be near at all, and then
works with the metric:

1. Classes. Documents with equal sets are one class, and only its representative takes part (distance 0).
2. Meeting. A set within the radius can lack at most n - ceil(n * percent / 100) of a set's shingles. In one global order
   of shingles linked sets therefore share one of their first n - ceil(n * percent / 100) + 1, and meet at it. Shingles
   at which more than ``hot`` documents meet, which frequent lines and phrases make, go to the end of the order and the
   documents meet again, so a common shingle brings together only documents that hold little else. Of shingles at
   which the same documents meet one is kept.
3. Lower bounds. Where documents meet, only sizes and sketches are compared: the parity of a set in each cell of the
   shingle space. Cells with different parities are at most |A Δ B|, which a link bounds, so no link is lost. What is
   returned is a spanning forest of the pairs that pass, fewer rows than documents. Documents look around at their
   first shingles first; afterwards only meetings of several components are held again.
4. Regions. The components of that forest are regions: no link leaves one, and nearly all documents are in none. Each of
   their documents is read once more, whole, and ``metric_join`` finds the links of a region exactly: document pivots,
   Voronoi cells, triangle-inequality windows that replicate boundary documents, recursion.

Meetings of more than ``block`` documents are dealt to tasks by blocks: first each block by itself, then one document of
every component, and pairs of blocks only where components are left.

Defined results: a document without words, or with a null text, has no shingles, links with nothing and is its own
component. With fewer words than ``width`` the whole sequence is the one shingle. Rows with one doc_id are one document
(and must have one text). A row without doc_id has a null component. Shingles are compared by 64-bit hashes. An empty
table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .metric_join import Parts, join_regions, whole_groups
from .scratch import Scratch

#: Least cells of a sketch; a set has five to ten cells for each shingle that a link lets it lack.
FEWEST_CELLS = 1 << 8
#: Documents look around at their first shingles first; one of them does for most families of near copies.
FIRST = 4
#: Most shingles that are put last; they are sent to every task (8 MB).
MOST_HOT = 1_000_000


class WordHashes(dict):
    """Hashes of words; a bounded table that empties when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingle_set(text: str | None, width: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of a text, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)] if words else [], np.uint64).view(np.int64)
    one = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(words) - width + 1
    mixed = one[:n] * ODD[0]
    for k in range(1, width):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * ODD[k % len(ODD)] + one[k : k + n]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * ODD[1]
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view(np.int64))


def window_length(n: int, percent: int) -> int:
    """Regions that a set of n shingles is sent to."""
    return n - (n * percent + 99) // 100 + 1


def sketch_of(shingles: np.ndarray, percent: int) -> bytes:
    """Parity of the set's members in each cell; cells are the low bits of the shingles, so halves of a sketch fold."""
    cells = max(1 << (len(shingles) * (100 - percent) // 20).bit_length(), FEWEST_CELLS)
    odd = np.bincount(shingles & (cells - 1), minlength=cells) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


class Sketches:
    """Sketches of a batch by number of cells; those with more cells also stand, folded, with those that have fewer."""

    def __init__(self, sketches: pd.Series):
        self.words = sketches.map(len).to_numpy() // 8
        self.by_words: dict[int, np.ndarray] = {}
        values = sketches.to_numpy()
        above = None
        for words in sorted(set(self.words.tolist()), reverse=True):
            own = np.flatnonzero(self.words == words)
            table = np.zeros((len(sketches), words), np.uint64) if above is None else self._folded(above, words)
            table[own] = np.frombuffer(b"".join(values[own]), np.uint64).reshape(-1, words)
            above = self.by_words[words] = table

    @staticmethod
    def _folded(table: np.ndarray, words: int) -> np.ndarray:
        while table.shape[1] > words:
            half = table.shape[1] // 2
            table = table[:, :half] ^ table[:, half:]
        return table.copy()

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Cells in which the sets differ by an odd number, for each pair."""
        out = np.zeros(len(a), np.int64)
        least = np.minimum(self.words[a], self.words[b])
        for words, table in self.by_words.items():
            some = np.flatnonzero(least == words)
            if len(some):
                out[some] = np.bitwise_count(table[a[some]] ^ table[b[some]]).sum(axis=1, dtype=np.int64)
        return out


SIGNATURE = "id bigint, n bigint, digest binary, sketch binary, pivots array<bigint>"


def _signatures(texts: DataFrame, width: int, percent: int, last: np.ndarray) -> DataFrame:
    """Size, digest, sketch and first shingles of every set; those in ``last`` (sorted) are at the end of the order."""
    shared = texts.sparkSession.sparkContext.broadcast(last)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            rows = []
            for i, text in zip(batch["id"], batch["text"], strict=True):
                own = ordered = shingle_set(text, width, known)
                if len(shared.value):
                    late = shared.value[np.minimum(np.searchsorted(shared.value, own), len(shared.value) - 1)] == own
                    ordered = np.concatenate([own[~late], own[late]])
                first = ordered[: window_length(len(own), percent)] if len(own) else own
                rows.append((i, len(own), xxhash.xxh3_128_digest(own.tobytes()), sketch_of(own, percent), first))
            yield pd.DataFrame(rows, columns=["id", "n", "digest", "sketch", "pivots"])

    return texts.mapInPandas(run, SIGNATURE)


def _near(sketches: Sketches, n: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets a and b may link, by their sizes and their sketches."""
    small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
    fits = 100 * small >= percent * large
    at = np.flatnonzero(fits)
    for start in range(0, len(at), 1 << 14):
        some = at[start : start + (1 << 14)]
        fits[some] = sketches.apart(a[some], b[some]) * (100 + percent) <= (n[a[some]] + n[b[some]]) * (100 - percent)
    return fits


KEYS = ["pivot", "low", "high"]


def _forest(percent: int) -> Callable:
    """A spanning forest of the near pairs of each group, beyond the components that it comes with.

    Rows are sorted by size, so the size window closes early.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, group in whole_groups(batches, KEYS):
            ids, n = part["id"].to_numpy(), part["n"].to_numpy()
            sketches = Sketches(part["sketch"])
            order = np.lexsort((part["comp"].to_numpy(), group))
            comp, of = part["comp"].to_numpy()[order], group[order]
            label = np.empty(len(part), np.int64)
            label[order] = np.cumsum(np.append(False, (comp[1:] != comp[:-1]) | (of[1:] != of[:-1])))
            parts = Parts(label)
            active, lag = np.arange(len(part)), 1
            a, b = [], []
            while len(active):
                active = active[active + lag < len(part)]
                other = active + lag
                open_ = (group[active] == group[other]) & (100 * n[active] >= percent * n[other])
                active, other = active[open_], other[open_]
                differ = parts.label[active] != parts.label[other]
                x, y = active[differ], other[differ]
                near = _near(sketches, n, x, y, percent)
                if near.any():
                    x, y = x[near], y[near]
                    used = parts.join(x, y)
                    a.append(x[used])
                    b.append(y[used])
                lag += 1
            if a:
                yield pd.DataFrame({"a": ids[np.concatenate(a)], "b": ids[np.concatenate(b)]}).drop_duplicates()

    return run


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """``id, n, own``: the whole shingle set of every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            own = [shingle_set(t, width, known) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "n": [len(s) for s in own], "own": [s.tobytes() for s in own]})

    return texts.mapInPandas(run, "id bigint, n bigint, own binary")


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90, hot: int = 256, block: int = 4096, most: int = 1 << 21, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs(doc_id, text)``."""
    scratch = scratch or Scratch(docs.sparkSession)
    classes, links = _joined(docs, width, percent, hot, block, most, scratch, every=False)
    labels = connected_components(links, scratch, "all")
    comps = classes.join(labels, classes["rep"] == labels["id"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "rep", "doc_id").alias("component_id"))
    least = comps.where("component_id is not null").groupBy("component_id").agg(F.min("doc_id").alias("least"))
    return comps.join(least, "component_id", "left").select("doc_id", "n_shingles", F.col("least").alias("component_id"))


def jaccard_links(docs: DataFrame, width: int = 3, percent: int = 90, hot: int = 256, block: int = 4096, most: int = 1 << 21, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """All links ``a < b`` between representatives of classes, and the classes ``doc_id, n, rep``."""
    classes, links = _joined(docs, width, percent, hot, block, most, scratch or Scratch(docs.sparkSession), every=True)
    return links.distinct(), classes


def _joined(docs: DataFrame, width: int, percent: int, hot: int, block: int, most: int, scratch: Scratch, every: bool) -> tuple[DataFrame, DataFrame]:
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text")
    signed = scratch.save(_signatures(texts, width, percent, np.empty(0, np.int64)), "signed")

    # 1. Classes of equal sets; a class is named by its smallest document.
    firsts = signed.where("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("rep"))
    classes = scratch.save(signed.select(F.col("id").alias("doc_id"), "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("digest")).alias("digest")).join(firsts, "digest", "left").select("doc_id", "n", "rep"), "classes")
    reps = classes.where("doc_id = rep").select(F.col("rep").alias("id")).distinct()

    # 2. Meeting places, taken again with those of too many documents at the end of the order.
    def meetings(signed: DataFrame, name: str) -> DataFrame:
        sent = signed.join(reps, "id", "left_semi").dropDuplicates(["id"]).select("id", F.posexplode("pivots").alias("at", "pivot"))
        return scratch.save(sent.select("id", "pivot", (F.col("at") < FIRST).alias("first")), f"sent{name}")

    def sized(sent: DataFrame, name: str) -> DataFrame:
        """Those of two documents or more. ``x`` and ``y`` tell which: ids are distinct, so their hashes' parities do."""
        members = sent.groupBy("pivot").agg(F.count("*").alias("count"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
        return scratch.save(members.where("count > 1"), f"sizes{name}")

    sent = meetings(signed, "0")
    sizes = sized(sent, "0")
    limit = max(hot, -(-sent.count() // MOST_HOT))
    late = sizes.where(F.col("count") > limit).select("pivot").toPandas()["pivot"].to_numpy(np.int64)
    if len(late):
        signed = scratch.save(_signatures(texts, width, percent, np.sort(late)), "signed1")
        scratch.drop("sent0")
        scratch.drop("signed")
        sent = meetings(signed, "1")
        sizes = sized(sent, "1")
    # Near copies share most of their shingles: of the meetings of the same documents one does.
    sizes = scratch.save(sizes.groupBy("count", "x", "y").agg(F.min("pivot").alias("pivot")).select("pivot", "count"), "chosen")
    blocks = F.ceil(F.col("count") / block).cast("bigint")
    shared = sent.join(sizes, "pivot").select("pivot", blocks.alias("blocks"), "id", "first", F.pmod(F.xxhash64("id"), blocks).alias("block"))
    shared = scratch.save(shared, "shared")
    scratch.drop("sent1" if len(late) else "sent0")
    about = signed.select("id", "n", "sketch").dropDuplicates(["id"])

    # 3. Near pairs, by lower bounds.
    def forest(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.select(*KEYS, "id", "comp").join(about, "id").repartition(*KEYS).sortWithinPartitions(*KEYS, "n", "id")
        return scratch.save(rows.select(*KEYS, "id", "n", "sketch", "comp").mapInPandas(_forest(percent), "a bigint, b bigint"), f"near_{name}")

    def named(rows: DataFrame, labels: DataFrame) -> DataFrame:
        return rows.join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))

    def mixed(rows: DataFrame) -> DataFrame:
        """Rows at meeting places of several components."""
        several = rows.groupBy("pivot").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("pivot")
        return rows.join(several, "pivot", "left_semi")

    alone = shared.where("first").select("pivot", F.col("block").alias("low"), F.col("block").alias("high"), "id", F.col("id").alias("comp"))
    near = forest(alone, "first")
    labels = connected_components(near, scratch, "first")
    if sizes.where(F.col("count") > block).limit(1).count():
        heads = named(shared.where("blocks > 1"), labels).groupBy("pivot", "comp").agg(F.min("id").alias("id"))
        few = heads.groupBy("pivot").count().where((F.col("count") > 1) & (F.col("count") <= block)).select("pivot")
        zero = F.lit(0).cast("bigint")
        near = near.unionByName(forest(heads.join(few, "pivot", "left_semi").select("pivot", zero.alias("low"), zero.alias("high"), "id", "comp"), "heads"))
        labels = connected_components(near, scratch, "heads")
    rows = mixed(scratch.save(named(shared, labels), "named"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    near = near.unionByName(forest(rows.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}), "all"))
    for name in ("named", "shared", "signed1" if len(late) else "signed"):
        scratch.drop(name)

    # 4. Regions, joined exactly.
    regions = connected_components(near, scratch, "near").withColumnRenamed("comp", "region")
    rows = _sets(texts.join(regions.select("id"), "id", "left_semi"), width).dropDuplicates(["id"]).join(regions, "id")
    return classes, join_regions(scratch.save(rows.select("region", "id", "n", "own"), "regions"), percent, scratch, every, most)
