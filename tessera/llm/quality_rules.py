"""Quality rules: base counts per document, then robust multivariate outliers per language and source.

Base rules reject short documents and documents that repeat themselves. The statistics of the others, transformed to
stable scales, are held against a minimum-covariance-determinant (MCD) estimate of their language and source: the mean
and covariance of the ``coverage`` share of documents whose covariance has the smallest determinant. It is searched for as
in the deterministic MCD: from three starts (medians and quartile ranges; moments of all documents; moments of the half
nearest to the medians) estimates are concentrated step by step: distances to the last estimate, the distance below which
``coverage`` of the group lies, moments of the documents below it. After two steps the start with the smallest
determinant goes on, until no group's determinant falls any more. All documents take part in every step. Documents whose
squared Mahalanobis distance exceeds ``cutoff`` go.

Every step is one aggregation with map-side combine: a group of any size sends one histogram and one row of moments
per task. Features are whole multiples of 1/SCALE, so sums are exact integers and a rerun gives the same verdicts
whatever order rows come in.

Defined results: a null or empty text has all counts 0 and fails the base rules. Null languages and sources are groups
of their own. A floor is added to each variance, so groups of few, equal or tied documents reject only what is far off;
a group without any document that passes the base rules rejects nothing more. Repeated rows count once each. An empty
table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

#: Features are stored as whole multiples of 1 / SCALE.
SCALE = 256
FEATURES = ["f_word_length", "f_symbols", "f_dup_lines", "f_repeats", "f_capitals", "f_stutter"]
#: Least standard deviation of each feature, in its own units: what clean short texts vary by.
FLOORS = [0.14, 0.05, 0.16, 0.16, 0.10, 0.10]
#: A determinant has fallen when its logarithm has by this much.
FALL = 1e-6
#: Concentration steps that all starts take, before the best goes on.
FIRST_STEPS = 2
#: The 0.99999 quantile of chi-square with six degrees of freedom.
CUTOFF = 33.11
WINDOW = 8
SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a ``width``-word window which occurs twice or more in the text, the first one included.

    Windows get exact ids by doubling: ids of words, of pairs of them, of pairs of pairs. ``width`` is a power of two.
    """
    n = len(words)
    if n <= width:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    span = 1
    while span < width:
        pairs = ids[:-span] * n + ids[span:]
        _, ids = np.unique(pairs, return_inverse=True)
        span *= 2
    twice = np.bincount(ids)[ids] > 1
    if not twice.any():
        return 0
    edges = np.zeros(n + 1, np.int64)
    edges[: len(twice)] += twice
    edges[width : width + len(twice)] -= twice
    return int((np.cumsum(edges[:n]) > 0).sum())


def text_counts(text: str | None) -> tuple[int, int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_stutter (words like the word before)."""
    if not text:
        return 0, 0, 0, 0, 0, 0, 0, 0
    body = text.encode("utf-8", "surrogatepass")
    words = body.split()  # of bytes: splits at space and 9 to 13 only
    lines = [line for line in body.split(b"\n") if line.strip(SPACE)]
    return (
        len(words),
        len(text) - (len(body) - len(body.translate(None, SPACE))),
        len(body) - len(body.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(body) - len(body.translate(None, CAPITALS)),
        sum(map(operator.eq, words[1:], words)),
    )


def chi_square(x: float, dof: int) -> float:
    """Distribution function of chi-square with an even number of degrees of freedom."""
    term = total = 1.0
    for k in range(1, dof // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def consistency(coverage: float, k: int = len(FEATURES)) -> float:
    """What the covariance of the closest ``coverage`` of normal points in k (even) dimensions is too small by."""
    if coverage >= 1:
        return 1.0
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, k) < coverage else (low, mid)
    return coverage / chi_square(low, k + 2)


def _precision(share: float):
    """Rows of group, start, n and sums to centre, inverse of the covariance (flat) and logarithm of its determinant."""
    k, factor = len(FEATURES), consistency(share)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                sums = np.array(row.sums, dtype=float)
                centre = sums[:k] / row.n
                cross = np.zeros((k, k))
                cross[np.triu_indices(k)] = sums[k:] / row.n
                cross = np.triu(cross) + np.triu(cross, 1).T
                cov = factor * (cross - np.outer(centre, centre)) + np.diag((np.array(FLOORS) * SCALE) ** 2)
                out.append((row.g_lang, row.g_source, row.start, centre.tolist(), np.linalg.inv(cov).ravel().tolist(), np.linalg.slogdet(cov)[1]))
            yield pd.DataFrame(out, columns=["g_lang", "g_source", "start", "centre", "inverse", "logdet"])

    return run


GROUP = ["g_lang", "g_source"]
PARAMS = "g_lang string, g_source string, start int, centre array<double>, inverse array<double>, logdet double"


def _distance(rows: DataFrame, params: DataFrame, how: str = "left") -> DataFrame:
    """Adds the squared Mahalanobis distance ``d2`` to each estimate of the group; null where the group has none."""
    k = len(FEATURES)
    off = [F.col(f) - F.col("centre")[i] for i, f in enumerate(FEATURES)]
    terms = [off[i] * off[j] * F.col("inverse")[i * k + j] * (1 if i == j else 2) for i in range(k) for j in range(i, k)]
    return rows.join(params.drop("logdet"), GROUP, how).withColumn("d2", sum(terms[1:], terms[0])).drop("centre", "inverse")


def _moments(rows: DataFrame, share: float) -> DataFrame:
    """Estimates from the sums over ``rows`` of each group and start, which are ``share`` of the group."""
    k = len(FEATURES)
    sums = [F.sum(f) for f in FEATURES] + [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])) for i in range(k) for j in range(i, k)]
    return rows.groupBy(*GROUP, "start").agg(F.count("*").alias("n"), F.array(*sums).alias("sums")).mapInPandas(_precision(share), PARAMS)


def _concentrated(rows: DataFrame, params: DataFrame, share: float, scratch: Scratch, name: str) -> DataFrame:
    """One step: the closest rows of each group to each of its estimates, then their moments."""
    by = [*GROUP, "start"]
    near = _distance(rows, params, "inner").withColumn("shell", F.least(F.floor(F.col("d2") * 16), F.lit(1 << 20)))
    shells = near.groupBy(*by, "shell").count()
    ranked = shells.withColumn("upto", F.sum("count").over(Window.partitionBy(*by).orderBy("shell"))).withColumn("all", F.sum("count").over(Window.partitionBy(*by)))
    limit = scratch.save(ranked.groupBy(*by).agg(F.min(F.when(F.col("upto") >= share * F.col("all"), F.col("shell"))).alias("limit")), f"limit_{name}")
    return scratch.save(_moments(near.join(limit, by).where("shell <= limit"), share), f"params_{name}")


def document_counts(docs: DataFrame) -> DataFrame:
    """The base columns, group keys and features of every row; one pass, no shuffle."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    fields = ["doc_id", "g_lang", "g_source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_stutter"]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = pd.DataFrame([text_counts(t) for t in batch["text"]], columns=fields[3:], dtype="int64")
            yield pd.concat([batch[fields[:3]], counts], axis=1)

    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    rows = docs.select("doc_id", key("lang").alias("g_lang"), key("source").alias("g_source"), "text").mapInPandas(
        count, f"doc_id {id_type}, g_lang string, g_source string, " + ", ".join(f"{c} bigint" for c in fields[3:])
    )
    scaled = lambda c: F.round(c * SCALE).cast("bigint")
    least = lambda c: F.greatest(F.col(c), F.lit(1))
    return rows.select(
        "*",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        scaled(F.log(least("word_chars") / least("n_words"))).alias(FEATURES[0]),
        scaled(F.sqrt(F.col("n_symbols") / least("word_chars"))).alias(FEATURES[1]),
        scaled(F.sqrt(F.col("n_dup_lines") / least("n_lines"))).alias(FEATURES[2]),
        scaled(F.sqrt(F.col("n_repeat_words") / least("n_words"))).alias(FEATURES[3]),
        scaled(F.sqrt(F.col("n_capitals") / least("word_chars"))).alias(FEATURES[4]),
        scaled(F.sqrt(F.col("n_stutter") / least("n_words"))).alias(FEATURES[5]),
    )


def fit_mcd(rows: DataFrame, scratch: Scratch, coverage: float = 0.75, steps: int = 12) -> DataFrame:
    """Centre and inverse covariance of each language and source, from all rows that pass the base rules.

    ``steps`` bounds the concentration steps; they end when no determinant falls.
    """
    k = len(FEATURES)
    rows = rows.where("not base_failed").select(*GROUP, *FEATURES)

    # Medians and quartile ranges, from one exact histogram of each feature.
    melted = rows.select(*GROUP, F.posexplode(F.array(*FEATURES)).alias("feature", "value"))
    counts = melted.groupBy(*GROUP, "feature", "value").count()
    up = Window.partitionBy(*GROUP, "feature").orderBy("value")
    ranked = counts.withColumn("upto", F.sum("count").over(up)).withColumn("all", F.sum("count").over(Window.partitionBy(*GROUP, "feature")))
    quartile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("value")))
    start = ranked.groupBy(*GROUP, "feature").agg(quartile(0.5).alias("mid"), ((quartile(0.75) - quartile(0.25)) / 1.349).alias("spread"))
    floors = F.array(*[F.lit(f * SCALE) for f in FLOORS])
    start = start.withColumn("inv", 1 / F.pow(F.greatest(F.col("spread"), floors[F.col("feature")]), 2))
    at = lambda i, c: F.max(F.when(F.col("feature") == i, F.col(c)).cast("double"))
    middle = scratch.save(
        start.groupBy(*GROUP).agg(
            F.lit(0).alias("start"),
            F.array(*[at(i, "mid") for i in range(k)]).alias("centre"),
            F.array(*[at(i, "inv") if i == j else F.lit(0.0) for i in range(k) for j in range(k)]).alias("inverse"),
            F.lit(None).cast("double").alias("logdet"),
        ),
        "middle",
    )
    everything = _moments(rows.withColumn("start", F.lit(1)), 1.0)
    half = _concentrated(rows, middle, 0.5, scratch, "half").withColumn("start", F.lit(2))
    params = scratch.save(middle.unionByName(everything).unionByName(half), "starts")

    for step in range(FIRST_STEPS):
        params = _concentrated(rows, params, coverage, scratch, f"first{step}")
    best = F.min_by(F.struct("start", "centre", "inverse", "logdet"), F.struct("logdet", "start"))
    params = scratch.save(params.groupBy(*GROUP).agg(best.alias("p")).select(*GROUP, "p.*"), "best0")
    for step in range(1, steps - FIRST_STEPS + 1):
        further = _concentrated(rows, params, coverage, scratch, f"step{step}")
        both = params.withColumn("old", F.lit(True)).unionByName(further.withColumn("old", F.lit(False)))
        chosen = F.min_by(F.struct("start", "centre", "inverse", "logdet", "old"), F.struct(F.col("logdet") - F.when(F.col("old"), FALL).otherwise(0.0), ~F.col("old")))
        both = scratch.save(both.groupBy(*GROUP).agg(chosen.alias("p")).select(*GROUP, "p.*"), f"best{step}")
        params = both.drop("old")
        if not both.where("not old").limit(1).count():
            break
    return params


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF, coverage: float = 0.75, steps: int = 12, scratch: Scratch | None = None) -> DataFrame:
    """Base columns, ``d2`` and ``kept`` for every row of ``docs(doc_id, text, lang, source)``."""
    scratch = scratch or Scratch(docs.sparkSession)
    rows = scratch.save(document_counts(docs), "counts")
    judged = _distance(rows, fit_mcd(rows, scratch, coverage, steps))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True))).alias("kept"),
        "d2",
    )
