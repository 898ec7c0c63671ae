"""Mixing sources to target weights by Pareto order sampling.

``mix`` decides how often each document is taken, so that every source's taken words come near its target.

1. Targets. Sources share the total size of all documents by weight; a target stops at ``most`` times its source's
   size and the excess is shared again by weight until no target is above (water filling).
2. Expected copies. Inside a source the target is filled the same way over size classes (bit length of the size), whose
   importance falls with the class, so long documents repeat a little less: each document expects e copies, at most ``most``.
3. Certain copies. Whole copies, floor(e), are taken for certain; the rest, p = e - floor(e), is an inclusion probability.
4. Pareto order. Documents rank by (u / (1 - u)) / (p / (1 - p)), u being a keyed hash of doc_id. Smallest ranks come
   first, until the words still missing to the target are reached; the document that crosses it is taken if that ends
   nearer to the target. So the size is fixed, and probabilities are unequal.

Scale: sources and classes are aggregates with map-side combine; the windows of step 1 and 2 hold one row per source or
class, not per document. The running sum of step 4 never sorts a source: it goes through two histograms of rank bins
and orders only the documents of the one bin in which the target is crossed.

Defined results: null or empty texts have size 0 and are never taken. Null sources are one source, last in order.
Ties in rank fall to the smaller doc_id. Repeated rows of a document are ranked alike, one after the other, and the mix
may take some of them and leave the others. A row without doc_id is hashed by its text. An empty table gives an empty
table. Extra columns are not read, but ``row`` names one that is handed through. All sums are exact integers, so reruns
agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

BINS = 4096
#: Importance of a size class: this minus the bit length of the size; no size has more bits.
IMPORTANCE = 64


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space and 9 to 13."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def water_fill(rows: DataFrame, group: list[str], total: str, weight: str, cap: str, order: list[str]) -> DataFrame:
    """Adds ``level``: rows of a group share ``total`` by ``weight``, none above ``cap``: least(cap, level * weight).

    Rows fill up in the order of cap / weight. ``level`` is what is left for the rows that do not fill up, per weight.
    """
    by = Window.partitionBy(*group).orderBy(F.col(cap) / F.col(weight), *order)
    until = by.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by.rowsBetween(0, Window.unboundedFollowing)
    left = F.col(total) - F.coalesce(F.sum(cap).over(until), F.lit(0))
    level = left / F.sum(weight).over(onwards)
    rows = rows.withColumn("_level", level).withColumn("_fits", F.col("_level") * F.col(weight) <= F.col(cap))
    # the first row that doesn't fill up sets the level; if all fill up, none limits the others
    found = F.min_by(F.when(F.col("_fits"), F.col("_level")), F.when(F.col("_fits"), F.struct(F.col(cap) / F.col(weight), *order))).over(Window.partitionBy(*group))
    return rows.withColumn("level", found).drop("_level", "_fits")


def mix(docs: DataFrame, seed: int = 7, most: int = 3, weights: tuple[int, ...] = (1, 2, 3), scratch: Scratch | None = None, row: str | None = None) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, copies`` for every row of ``docs(doc_id, text, source)``.

    With ``row``, the name of a column that tells all rows apart, the result has it as ``row``.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    share = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), name)), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    number = F.col(row) if row else F.monotonically_increasing_id()
    rows = scratch.save(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), share.alias("u"), number.alias("row")), "sizes")
    rows = rows.withColumn("src", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))).withColumn("class", F.length(F.bin("size")))

    classes = scratch.save(rows.groupBy("src", "class").agg(F.sum("size").alias("class_size")), "classes")
    ordered = Window.orderBy(F.col("src") == "", "src")
    sources = classes.groupBy("src").agg(F.sum("class_size").alias("source_size"))
    place = (F.row_number().over(ordered) - 1) % len(weights)
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), place + 1)).withColumn("everything", F.sum("source_size").over(Window.partitionBy()))
    sources = water_fill(sources.withColumn("cap", F.col("source_size") * most), [], "everything", "weight", "cap", ["src"])
    sources = sources.withColumn("target", F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))))

    inner = classes.where("class_size > 0").join(sources.select("src", "source_size", "target"), "src")
    inner = inner.withColumn("pull", F.col("class_size") * (F.lit(IMPORTANCE) - F.col("class"))).withColumn("cap", F.col("class_size") * most)
    inner = water_fill(inner, ["src"], "target", "pull", "cap", ["class"])
    expected = F.least(F.lit(float(most)), F.coalesce(F.col("level") * (F.lit(IMPORTANCE) - F.col("class")), F.lit(float(most))))
    inner = inner.withColumn("expected", expected).withColumn("whole", F.floor("expected"))
    inner = inner.withColumn("odds_of", F.col("expected") - F.col("whole"))
    needed = F.col("target") - F.sum(F.col("whole") * F.col("class_size")).over(Window.partitionBy("src"))
    plan = scratch.save(inner.select("src", "class", "whole", "odds_of", needed.alias("needed")), "plan")
    sources = scratch.save(sources.select("src", "source_size", "target"), "targets")

    ranked = (
        rows.join(plan, ["src", "class"], "left")
        .withColumn("rank", F.when(F.col("odds_of") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("odds_of") / (1 - F.col("odds_of")))))
        .withColumn("share", F.col("rank") / (1 + F.col("rank")))
        .withColumn("bin", F.least(F.floor(F.col("share") * BINS), F.lit(BINS - 1)))
        .withColumn("fine", F.least(F.floor((F.col("share") * BINS - F.col("bin")) * BINS), F.lit(BINS - 1)))
    )

    def crossed(counts: DataFrame, name: str, base: Column) -> DataFrame:
        """The bin of each source in which its running words pass ``needed``, and the words before it."""
        upto = F.sum("words").over(Window.partitionBy("src").orderBy(name).rowsBetween(Window.unboundedPreceding, 0)) + base
        before = counts.withColumn("upto", upto).where("upto >= needed")
        return before.groupBy("src").agg(F.min(name).alias(f"at_{name}"), F.min_by(F.col("upto") - F.col("words"), name).alias(f"before_{name}"))

    counts = ranked.where("rank is not null").groupBy("src", "needed", "bin").agg(F.sum("size").alias("words"))
    coarse = scratch.save(crossed(counts, "bin", F.lit(0)), "coarse")
    within = ranked.where("rank is not null").join(coarse, "src").where("bin = at_bin")
    counts = within.groupBy("src", "needed", "before_bin", "fine").agg(F.sum("size").alias("words"))
    fine = scratch.save(coarse.join(crossed(counts, "fine", F.col("before_bin")), "src", "left"), "fine")
    edge = ranked.where("rank is not null").join(fine, "src").where("bin = at_bin and fine = at_fine")
    line = Window.partitionBy("src").orderBy("rank", "doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("upto", F.sum("size").over(line) + F.col("before_fine")).withColumn("prior", F.col("upto") - F.col("size"))
    nearer = (F.col("upto") <= F.col("needed")) | ((F.col("prior") < F.col("needed")) & (F.col("upto") - F.col("needed") <= F.col("needed") - F.col("prior")))
    last = scratch.save(edge.where(nearer).groupBy("src").agg(F.max(F.struct("rank", "doc_id", "row")).alias("last")), "last")

    chosen = ranked.join(fine, "src", "left").join(last, "src", "left").join(sources, "src")
    first_bins = (F.col("bin") < F.col("at_bin")) | ((F.col("bin") == F.col("at_bin")) & (F.col("fine") < F.col("at_fine")))
    up_to_last = (F.col("bin") == F.col("at_bin")) & (F.col("fine") == F.col("at_fine")) & F.coalesce(F.struct("rank", "doc_id", "row") <= F.col("last"), F.lit(False))
    # without a crossing the source's words never reach what is missing, and every candidate is taken
    drawn = F.col("rank").isNotNull() & (F.col("at_bin").isNull() | first_bins | up_to_last)
    copies = (F.coalesce(F.col("whole"), F.lit(0)) + F.when(drawn, 1).otherwise(0)).cast("bigint")
    copies = F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("bigint")
    return chosen.select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), *(["row"] if row else []))
