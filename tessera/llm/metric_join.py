"""Exact links inside regions of a Jaccard metric space, around pivots that are documents.

A region is a set of documents of which some may link. ``join_regions`` finds its links by the metric:

* Pivots are documents of the region, chosen by hash. Every other document's exact distance to each pivot is computed.
* Voronoi cells: a document's home is the cell of its nearest pivot. Documents within the radius of a pivot link with it.
* Windows: if x and y link, d(y, p) <= d(x, p) + r for the pivot p of x's home. So a cell takes in, besides its own
  documents, those y with d(y, p) <= (largest distance of its own documents) + r; no link crosses a cell's edge unseen.
* Recursion: cells are regions again, with new pivots, until they are small. Where windows take in most of a region (all
  its documents lie within about the radius of each other, and no choice of pivots can part them) its pairs are
  compared one row against all others, exactly, on bit maps of the shingles that two or more of the documents share.

Only pairs that join two components are returned, at most one fewer than documents, unless all links are asked for.

A region of up to ``most`` shingles is one task's work. Larger ones are parted by Spark: pivots meet the documents in
blocks, and the cells become regions of their own. Cells that no pivot parts are first stripped of those whose
documents are one component already, then compared in pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch

#: Documents that are compared without pivots, and pivots of a region.
LEAF, PIVOTS = 128, 8
#: Bits of the maps that are compared at once; a region with more is counted a row at a time.
MAP_BITS = 1 << 28
#: A cell that holds more than this share of its region was not parted.
PARTED = 0.7
#: Levels of recursion that Spark deals out.
LEVELS = 3


class Parts:
    """Components of numbered rows, joined many pairs at a time."""

    def __init__(self, label: np.ndarray):
        self.label = label

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Joins the rows of all pairs; returns which of the pairs joined two components."""
        x, y = self.label[a], self.label[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        _, first = np.unique(low * len(self.label) + high, return_index=True)
        root: dict[int, int] = {}

        def top(k: int) -> int:
            while k in root:
                k = root[k]
            return k

        used = []
        for k in first.tolist():
            p, q = top(int(low[k])), top(int(high[k]))
            if p != q:
                root[max(p, q)] = min(p, q)
                used.append(k)
        if used:
            to = np.arange(len(self.label))
            for k in root:
                to[k] = top(k)
            self.label = to[self.label]
        return np.array(used, np.int64)


class Region:
    """The shingle sets of a region, as numbers of the shingles that two or more of them hold."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets], np.int64)
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        kept = times[column] > 1
        self.width = int((times > 1).sum())
        self.column = (np.cumsum(times > 1) - 1)[column[kept]]
        row = np.repeat(np.arange(len(sets)), self.n)[kept]
        self.start = np.searchsorted(row, np.arange(len(sets) + 1))

    def shared_with(self, pivot: int) -> np.ndarray:
        """Shingles that each set shares with one."""
        held = np.zeros(self.width, bool)
        held[self.column[self.start[pivot] : self.start[pivot + 1]]] = True
        upto = np.concatenate(([0], np.cumsum(held[self.column])))
        out = upto[self.start[1:]] - upto[self.start[:-1]]
        out[pivot] = self.n[pivot]
        return out

    def maps(self, rows: np.ndarray) -> np.ndarray | None:
        """Bit maps of some sets over the shingles that two of them share; none if they are too large."""
        own = np.concatenate([np.arange(self.start[r], self.start[r + 1]) for r in rows.tolist()])
        _, column, times = np.unique(self.column[own], return_inverse=True, return_counts=True)
        width = int((times > 1).sum())
        if len(rows) * width > MAP_BITS:
            return None
        bits = np.zeros((len(rows), (width // 64 + 1) * 64), bool)
        kept = times[column] > 1
        row = np.repeat(np.arange(len(rows)), self.start[rows + 1] - self.start[rows])
        bits[row[kept], (np.cumsum(times > 1) - 1)[column[kept]]] = True
        return np.packbits(bits, axis=1).view(np.uint64).reshape(len(rows), -1)


def linked(both: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * both >= percent * (n + m - both)


def region_links(sets: list[np.ndarray], percent: int, every: bool, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) between sets: all, or a spanning forest of the components (given ``label``: of what is not joined yet)."""
    region = Region(sets)
    parts = Parts(np.arange(len(sets)) if label is None else label.astype(np.int64))
    found: list[tuple[int, int]] = []
    radius = 1 - percent / 100 + 1e-9

    def add(a: np.ndarray, b: np.ndarray) -> None:
        if not every:
            some = parts.join(a, b)
            a, b = a[some], b[some]
        found.extend(zip(a.tolist(), b.tolist(), strict=True))

    def pairs(rows: np.ndarray) -> None:
        maps = region.maps(rows)
        for k in range(len(rows) - 1):
            others = np.arange(k + 1, len(rows))
            if not every:
                others = others[parts.label[rows[others]] != parts.label[rows[k]]]
            n, m = region.n[rows[k]], region.n[rows[others]]
            others = others[100 * np.minimum(n, m) >= percent * np.maximum(n, m)]
            if not len(others):
                continue
            if maps is None:
                both = region.shared_with(int(rows[k]))[rows[others]]
            else:
                both = np.bitwise_count(maps[others] & maps[k]).sum(axis=1, dtype=np.int64)
            hit = others[linked(both, n, region.n[rows[others]], percent)]
            if len(hit):
                add(np.full(len(hit), rows[k]), rows[hit])

    def part(rows: np.ndarray) -> None:
        if len(rows) <= LEAF:
            return pairs(rows)
        pivots = rows[np.linspace(0, len(rows) - 1, PIVOTS).astype(np.int64)]
        both = np.stack([region.shared_with(int(p))[rows] for p in pivots])
        far = 1 - both / (region.n[pivots][:, None] + region.n[rows][None, :] - both)
        home = far.argmin(axis=0)
        for k, p in enumerate(pivots.tolist()):
            near = rows[linked(both[k], region.n[p], region.n[rows], percent) & (rows != p)]
            if len(near):
                add(np.full(len(near), p), near)
        cells = []
        for k in range(len(pivots)):
            own = home == k
            if own.any():
                cells.append(rows[far[k] <= far[k][own].max() + radius])
        if max(map(len, cells)) > PARTED * len(rows):
            return pairs(rows)
        for cell in cells:
            if every or (parts.label[cell] != parts.label[cell[0]]).any():
                part(cell)

    # in an order that has nothing to do with ids, so that pivots are any documents
    part(np.random.default_rng(len(sets)).permutation(len(sets)))
    return list({(min(p), max(p)) for p in found})


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches of whole groups of rows that are sorted by ``keys``, with the number of each row's group."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        same = np.ones(len(batch), bool)
        for key in keys:
            values = batch[key].to_numpy()
            same &= values == values[-1]
        start = 0 if same.all() else len(batch) - int(np.argmin(same[::-1]))
        if start or (held and any(held[-1][k].iloc[-1] != batch[k].iloc[0] for k in keys)):
            part = pd.concat([*held, batch.iloc[:start]], ignore_index=True)
            held = []
            if len(part):
                yield part, numbers(part, keys)
        held.append(batch.iloc[start:])
    if held:
        part = pd.concat(held, ignore_index=True)
        yield part, numbers(part, keys)


def numbers(part: pd.DataFrame, keys: list[str]) -> np.ndarray:
    new = np.zeros(len(part), bool)
    for key in keys:
        values = part[key].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.cumsum(new)


def _each_group(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    for part, group in whole_groups(batches, keys):
        for rows in np.split(np.arange(len(part)), np.flatnonzero(np.diff(group)) + 1):
            yield part.iloc[rows]


def _sets(rows: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(b, np.int64) for b in rows["own"]]


def _join(percent: int, every: bool, keys: list[str]) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _each_group(batches, keys):
            ids = rows["id"].to_numpy()
            found = region_links(_sets(rows), percent, every, pd.factorize(rows["comp"])[0]) if len(rows) > 1 else []
            pairs = np.array(found, np.int64).reshape(-1, 2)
            a, b = ids[pairs[:, 0]], ids[pairs[:, 1]]
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


CELLS = "region bigint, cell bigint, id bigint, n bigint, own binary, home boolean, far double, pivot bigint, near boolean"


def _cells(percent: int) -> Callable:
    """Every document of a block with its distance to each pivot of its region, where a window may take it in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _each_group(batches, ["region", "block"]):
            is_pivot = ~rows["member"].to_numpy()
            pivots = _sets(rows[is_pivot])
            names = rows["id"].to_numpy()[is_pivot]
            for at in range(len(pivots), len(rows), 2000):
                some = rows.iloc[at : at + 2000]
                n, own = some["n"].to_numpy(), _sets(some)
                flat, ends = np.concatenate(own), np.concatenate(([0], np.cumsum(n)))
                far, near = np.empty((len(pivots), len(some))), np.empty((len(pivots), len(some)), bool)
                for k, p in enumerate(pivots):
                    spot = np.searchsorted(p, flat)
                    upto = np.concatenate(([0], np.cumsum(p[np.minimum(spot, len(p) - 1)] == flat)))
                    both = upto[ends[1:]] - upto[ends[:-1]]
                    far[k] = 1 - both / (n + len(p) - both)
                    near[k] = linked(both, n, np.int64(len(p)), percent)
                home = far.argmin(axis=0)
                # d(y, p) <= d(x, p) + r and d(x, p) <= d(x, home of y) <= d(y, home of y) + r
                for k in range(len(pivots)):
                    inside = np.flatnonzero(far[k] <= far.min(axis=0) + 2 * (1 - percent / 100) + 1e-9)
                    yield pd.DataFrame({
                        "region": some["region"].to_numpy()[inside], "cell": k, "id": some["id"].to_numpy()[inside], "n": n[inside], "own": some["own"].to_numpy()[inside],
                        "home": home[inside] == k, "far": far[k][inside], "pivot": names[k], "near": near[k][inside],
                    })

    return run


def join_regions(rows: DataFrame, percent: int, scratch: Scratch, every: bool = False, most: int = 1 << 21, name: str = "join") -> DataFrame:
    """Links ``a < b`` inside the regions of ``rows(region, id, n, own)``; ``own`` are sorted 64-bit hashes as bytes.

    Without ``every`` the links are those that the components need.
    """
    links: list[DataFrame] = []
    tight: list[DataFrame] = []
    radius = 1 - percent / 100 + 1e-9
    for level in range(LEVELS + 1):
        weights = scratch.save(rows.groupBy("region").agg(F.sum("n").alias("weight"), F.count("*").alias("count")).where("count > 1"), f"{name}_weights{level}")
        small = rows.join(weights.where(F.col("weight") <= most).select("region"), "region")
        small = small.select("region", "id", "own", F.col("id").alias("comp")).repartition("region").sortWithinPartitions("region", "id")
        links.append(scratch.save(small.mapInPandas(_join(percent, every, ["region"]), "a bigint, b bigint"), f"{name}_links{level}"))
        large = weights.where((F.col("weight") > most) & (F.col("count") > PIVOTS))
        if not weights.where(F.col("weight") > most).limit(1).count():
            break
        tight.append(rows.join(weights.where((F.col("weight") > most) & (F.col("count") <= PIVOTS)).select("region", "weight"), "region").select("region", "weight", "id", "n", "own"))
        rows = scratch.save(rows.join(large.select("region", "weight"), "region"), f"{name}_large{level}")
        if level == LEVELS:
            tight.append(rows)
            break
        blocks = F.ceil(F.col("weight") / most).cast("bigint")
        pivots = rows.groupBy("region", "weight").agg(*[F.min_by(F.struct("id", "n", "own"), F.xxhash64("id", F.lit(k))).alias(f"p{k}") for k in range(PIVOTS)])
        pivots = pivots.select("region", "weight", F.explode(F.array_distinct(F.array(*[f"p{k}" for k in range(PIVOTS)]))).alias("p"))
        pivots = pivots.select("region", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("block"), F.lit(False).alias("member"), "p.*")
        members = rows.select("region", F.pmod(F.xxhash64("id", F.lit("block")), blocks).alias("block"), F.lit(True).alias("member"), "id", "n", "own")
        both = pivots.unionByName(members).repartition("region", "block").sortWithinPartitions("region", "block", "member", "id")
        cells = scratch.save(both.mapInPandas(_cells(percent), CELLS), f"{name}_cells{level}")
        links.append(cells.where("near and pivot != id").select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b")).distinct())
        edges = cells.where("home").groupBy("region", "cell").agg(F.max("far").alias("edge"))
        inside = cells.join(edges, ["region", "cell"]).where(F.col("far") <= F.col("edge") + radius)
        inside = scratch.save(inside.select("region", "cell", F.xxhash64("region", "cell").alias("to"), "id", "n", "own"), f"{name}_inside{level}")
        sizes = inside.groupBy("region", "cell").agg(F.sum("n").alias("inner")).join(weights, "region")
        whole = scratch.save(sizes.where(F.col("inner") > PARTED * F.col("weight")).select("region").distinct(), f"{name}_whole{level}")
        tight.append(rows.join(whole, "region", "left_semi"))
        rows = inside.join(whole, "region", "left_anti").select(F.col("to").alias("region"), "id", "n", "own")
    out = _union(links)
    if not tight:
        return out
    rows = _union(tight)
    if every:
        rows = rows.withColumn("comp", F.col("id"))
    else:
        labels = connected_components(out, scratch, f"{name}_tight")
        rows = scratch.save(rows.join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id")), f"{name}_tight")
        mixed = rows.groupBy("region").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("region")
        rows = rows.join(mixed, "region", "left_semi")
    blocks = F.ceil(F.col("weight") * 2 / most).cast("bigint")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit("pair")), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    rows = rows.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).select("region", "low", "high", "id", "own", "comp")
    rows = rows.repartition("region", "low", "high").sortWithinPartitions("region", "low", "high", "id")
    last = rows.mapInPandas(_join(percent, every, ["region", "low", "high"]), "a bigint, b bigint")
    return out.unionByName(scratch.save(last.distinct(), f"{name}_pairs"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out
