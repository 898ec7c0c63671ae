"""What Python workers hold at a time: batches are bounded in rows and bytes, however large tables and texts are."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import phrases as phrase_ops
from tessera.operators import selection
from tessera.operators.filters import FILTERS, apply_filter, undo_filter
from tessera.operators.templates import match_lines, mine_templates, tagged_entries
from tessera.plans.registry import QUERIES
from tessera.sources.tables import small_batches, table

SF = "/root/testdata/sf0.001"


@F.pandas_udf(T.StructType().add("rows", T.LongType()).add("bytes", T.LongType()))
def batch_size(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"rows": [len(texts)] * len(texts), "bytes": [int(texts.str.len().sum())] * len(texts)})


def largest(rows):
    return tuple(rows.select(batch_size("text").alias("b")).agg(F.max("b.rows"), F.max("b.bytes")).first())


def test_batches_are_bounded_in_rows_and_bytes(spark):
    table(spark, SF, "documents")
    wide = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("x"), 20_000).alias("text"))
    rows, size = largest(wide)
    assert rows < 1000 and size < 5 << 20
    assert largest(spark.range(0, 5000, 1, 1).select(F.lit("x").alias("text")))[0] == 1000


def test_settings_of_the_session_stay(spark):
    other = spark.newSession()
    other.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    small_batches(other)
    assert other.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "17"


def test_filters_and_inverses_run_in_one_worker(spark):
    data = [bytes(range(k)) for k in (0, 1, 2, 7, 33, 255)]
    rows = spark.createDataFrame([(b,) for b in data], "content binary").repartition(1)
    for name in FILTERS:
        filtered = rows.select("content", F.octet_length("content").alias("n"), apply_filter(F.col("content"), name).alias("filtered"))
        back = filtered.select("content", undo_filter(F.col("filtered"), name, F.col("n")).alias("back"))
        assert back._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1, name
        assert all(bytes(r.content) == bytes(r.back) for r in back.collect()), name


def test_phrases_are_handed_on_a_few_texts_at_a_time():
    """Results of 300 texts are made for TEXTS texts at a time; before, for whole batches."""
    batch = pd.DataFrame({"doc_id": range(300)})
    pieces = list(phrase_ops.few_texts(iter([batch, batch[:5]])))
    assert [len(p) for p in pieces] == [64, 64, 64, 64, 44, 5] and pd.concat(pieces[:5]).equals(batch)


def test_numbers_of_entries_may_hold_the_mark():
    """Entry 255 is written as 255, 1 behind the mark; before, that was taken for another mark."""
    entries = [f"word{k:04}".encode() for k in range(400)]
    content = b" \xff ".join(entries) + b"\xff"
    payload, hits, _ = phrase_ops.replaced(content, entries)
    assert hits == 400 and phrase_ops.restored(payload, entries) == content


def test_lexemes_of_a_key_meet_in_one_exchange(spark):
    """Texts are dealt by key once; counts, ranks and pruning need no other exchange, and texts are searched once."""
    docs = spark.createDataFrame([(1, "alpha_beta_gamma_delta 'a quoted one' " * 3 + "1234567 abc12345"), (2, None)], "doc_id long, text string")
    found = phrase_ops.lexemes(docs, ["doc_id"])
    plan = phrase_ops.without_contained(phrase_ops.lexeme_scores(found, ["doc_id"]), ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("regexp_extract_all") == 1
    assert {(r.lexeme, r.times) for r in found.collect()} == {("alpha_beta_gamma_delta", 9), ("'a quoted one'", 3), ("abc12345", 1)}


def test_block_tournament_against_blocks_one_by_one(spark):
    contents = {0: b"", 1: b"short", 2: b"abcd" * 100, 3: bytes(range(256)) * 3, 4: b"x" * 100 + bytes(range(100))}
    rows = spark.createDataFrame([(k, bytearray(c)) for k, c in contents.items()], "k long, content binary")
    found = selection.block_tournament(rows, ["k"], [64, 256])
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()

    def taken(c, size):
        blocks = [c[k : k + size] for k in range(0, len(c), size)]
        least = [min((len(p := selection.encoded(b, n)) + (n != "deflate") * selection.FRAME, i, len(p)) for i, n in enumerate(selection.CANDIDATES))[2] for b in blocks]
        return 13 + sum(9 + x for x in least), size, len(blocks)

    assert {r.k: (r.bytes, r.block_size, r.blocks) for r in found.collect()} == {k: min(taken(c, 64), taken(c, 256)) for k, c in contents.items() if c}


def python_steps(query, spark):
    return QUERIES[query](spark, SF)._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")


def test_candidates_are_encoded_and_decoded_in_one_worker(spark):
    """Payloads stay in the worker that made them; before, a second worker of each core held them, too."""
    assert python_steps("candidate_roundtrip", spark) == 1


def test_bytes_are_counted_once(spark):
    """Spark filters a generator's input by its size; before, that counted all texts a second time."""
    assert python_steps("rans_initial_freq", spark) == 1
    assert python_steps("byte_histogram", spark) == 1


def test_lines_are_searched_once_a_pass(spark):
    """Filters on shapes are above the search, and tags take one pass more; before, filters searched again, and tags took two."""
    lines = spark.createDataFrame([("a", k, f"entry {k + 10} of the log, again\n") for k in range(9)], "file string, line_no long, line string")
    templates = mine_templates(lines, ["file"])
    searches = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString().count("split(")
    assert searches(templates) == 1
    matched = match_lines(lines, templates, ["file"])
    assert searches(matched) == 2
    tagged = tagged_entries(matched, ["file"])
    assert searches(tagged) == 4
    assert [r.tag for r in tagged.orderBy("line_no").collect()] == [1] + [2] * 8
