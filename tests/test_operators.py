"""Operators against small Python restatements of their rules, and round trips on edge cases."""

import random
import struct
from collections import Counter
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.scalars import human_size
from tessera.functions.scalars import zigzag as zigzag_code
from tessera.operators.columns import CODECS, codec_choice, column_costs, decode_differences, dictionary, dictionary_ids, dictionary_values, length_model, with_differences
from tessera.operators.filters import FILTERS
from tessera.operators.lines import split_lines, variable_type, variables
from tessera.functions import ranges
from tessera.operators.byte_stats import run_counts, stream_choice, stream_costs, table_frequencies
from tessera.operators.phrases import frequent_grams, lexeme_candidate, lexeme_pieces, replaced, restored, without_contained
from tessera.operators.reports import append_runs, last_runs, with_previous
from tessera.operators.selection import CANDIDATES, FRAME, candidates, decoded, encoded, in_chunks, packed, winners
from tessera.operators.templates import match_lines, mine_templates, rebuilt_lines, tagged_entries, variable_columns
from tessera.operators.structural import columns_deflated, template_candidates
from tessera.plans import report_queries
from tessera.sources.files import read_chunks, read_files, read_frames, whole_files, write_frames
from tessera.streaming.micro_batches import mine_batches

EDGES = [b"", b"hola " * 8, b"GET /api/v1/users 200\n" * 3, bytes(7 if k % 2 == 0 else 65 + k % 26 for k in range(4096)), random.Random(1).randbytes(513), b"\xff\n\r\t \x00", b"A" * 512]


@pytest.mark.parametrize("name", FILTERS)
def test_filters_round_trip(name):
    forward, inverse = FILTERS[name]
    for size in [*range(18), 511, 512, 513]:
        data = np.frombuffer(random.Random(size).randbytes(size), np.uint8).copy()
        if size:
            assert inverse(forward(data).copy())[:size].tobytes() == data.tobytes()


@pytest.mark.parametrize("name", CANDIDATES)
def test_candidates_round_trip(spark, name):
    assert [decoded(encoded(b, name), name, len(b)) for b in EDGES] == EDGES


def test_lines_keep_their_ends(spark):
    texts = ["a\nb", "a\r\n\n", "", None, "\n\n", "x"]
    rows = split_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    by = {k: [r.line for r in sorted(rows, key=lambda r: r.line_no) if r.doc_id == k] for k in range(len(texts))}
    assert by == {0: ["a\n", "b"], 1: ["a\r\n", "\n"], 2: [], 3: [], 4: ["\n", "\n"], 5: ["x"]}


@pytest.mark.parametrize(
    ("line", "found"),
    [
        ("a 1 22 x33 44y z55z 6", ["22", "33", "44"]),
        ("id 123e4567-e89b-12d3-a456-426614174000!", ["123e4567-e89b-12d3-a456-426614174000"]),
        ("h deadbeefdeadbeef.", ["deadbeefdeadbeef"]),
        ("h 1234567890123456.", ["1234567890123456"]),
        ("h adeadbeefdeadbeef", ["deadbeefdeadbeef"]),
        ("none", []),
    ],
)
def test_variables(spark, line, found):
    row = spark.createDataFrame([(line,)], "line string").select(variables(F.col("line")).alias("v")).first()
    assert row.v == found


def test_variable_types(spark):
    rows = spark.createDataFrame([("12",), ("deadbeefdeadbeef",), ("123e4567-e89b-12d3-a456-426614174000",)], "v string")
    assert [r[0] for r in rows.select(variable_type(F.col("v"))).collect()] == [1, 3, 2]


def log(n):
    lines = [f'{{"at":"2024-01-02T03:04:{k % 60:02d}.{k * 137 % 1000:03d}","tx":{100000 + k},"status":{400 if k % 17 == 0 else 200},"ms":{40 + k % 70}}}\n' for k in range(n)]
    return [("f", k, line) for k, line in enumerate(lines)]


def test_one_template_of_a_json_log(spark):
    lines = spark.createDataFrame(log(300) + [("f", 1000, "raw line\n")], "file string, line_no long, line string")
    templates = mine_templates(lines, ["file"])
    assert [(r.hits, r.slots) for r in templates.collect()] == [(300, 10)]
    matched = match_lines(lines, templates, ["file"])
    tags = {r.line_no: r.tag for r in tagged_entries(matched, ["file"]).collect()}
    assert tags[0] == 1 and tags[1] == 2 and tags[1000] == 0
    back = rebuilt_lines(variable_columns(matched, ["file"]), templates, matched.where("template_id is null"), ["file"])
    assert sorted((r.line_no, r.line) for r in back.collect()) == sorted((r.line_no, r.line) for r in lines.collect())


def varint(x):
    return max(1, (x.bit_length() + 6) // 7)


def zigzag(x):
    return -2 * x - 1 if x < 0 else 2 * x


def test_column_sizes_against_an_emitter(spark):
    dice = random.Random(2)
    columns = [[str(dice.randrange(10 ** dice.randrange(1, 12))) for _ in range(dice.choice([1, 2, 3, 7, 8, 11, 12, 60]))] for _ in range(25)] + [["007"] * 9, ["x", "yy"] * 6, ["1" * 16]]
    rows = [(k, i, v) for k, c in enumerate(columns) for i, v in enumerate(c)]
    costs = column_costs(spark.createDataFrame(rows, "key long, row_no long, value string"), ["key"])
    found = {r.key: r for r in costs.collect()}
    for k, c in enumerate(columns):
        assert found[k].n == len(c)
        assert found[k].raw == 1 + sum(varint(len(v)) + len(v) for v in c)
        assert found[k].const == (1 + varint(len(c[0])) + len(c[0]) if len(set(c)) == 1 else None)
        number = all(v.isdigit() and len(v) <= 15 for v in c)
        x = [0, *map(int, c)] if number else []
        assert found[k].delta == (1 + sum(varint(len(v)) + varint(zigzag(b - a)) for v, a, b in zip(c, x, x[1:], strict=False)) if number else None)
        ids = {v: i for i, v in enumerate(dict.fromkeys(c))}
        entries = sum(varint(len(v)) + len(v) for v in ids)
        assert found[k].dict == (1 + varint(len(ids)) + entries + sum(varint(ids[v]) for v in c) if len(c) >= 3 and len(ids) < len(c) else None)
    for r in codec_choice(costs, ["key"]).collect():
        sizes = [(found[r.key][c], p, c) for p, c in enumerate(CODECS) if found[r.key][c] is not None]
        assert (r.bytes, r.codec) == (min(sizes)[0], min(sizes)[2])


def test_ranges_of_columns_make_no_difference(spark, monkeypatch):
    """Sizes, ids and decoded values are the same when columns are put in order three rows at a time."""
    dice = random.Random(3)
    columns = {k: [str(dice.randrange(10 ** dice.randrange(1, 16))) for _ in range(k)] for k in (1, 2, 3, 4, 7, 30)} | {49: ["12"] * 300 + ["9"] * 2 + ["13"] * 140} | {50: ["7"] * 20, 51: ["x", "yy", "7"] * 5, 52: ["999999999999999", "0"] * 40}
    df = spark.createDataFrame([(k, 5 * i // 2, v) for k, c in columns.items() for i, v in enumerate(c)], "key long, row_no long, value string")
    encoded = with_differences(df.where("key != 51"), ["key"]).select("key", "row_no", F.coalesce("z1", zigzag_code(F.col("x"))).alias("z"), "len")

    def found():
        ids = dictionary_ids(df, ["key"])
        frames = column_costs(df, ["key"]), ids, decode_differences(encoded, ["key"]), dictionary_values(ids.drop("value"), dictionary(df, ["key"]).select("key", "id", "value"), ["key"])
        return [sorted(map(str, f.collect())) for f in frames]

    whole = found()
    monkeypatch.setattr(ranges, "RANGE", 3)
    encoded = with_differences(df.where("key != 51"), ["key"]).select("key", "row_no", F.coalesce("z1", zigzag_code(F.col("x"))).alias("z"), "len")
    assert found() == whole
    dense = spark.createDataFrame([(k, i, v) for k, c in columns.items() for i, v in enumerate(c)], "key long, row_no long, value string")
    assert sorted(map(str, column_costs(dense, ["key"], gapless=True).collect())) == whole[0]
    sizes = {r.key: r.len_bytes for r in length_model(with_differences(dense, ["key"], gapless=True), ["key"]).collect()}
    for k, c in columns.items():
        runs = [(n, len(list(r))) for n, r in groupby(map(len, c))]
        as_runs, singly = sum(varint(n) + varint(r) for n, r in runs), sum(varint(len(v)) for v in c)
        assert sizes[k] == (1 + varint(runs[0][0]) if len(runs) == 1 else 1 + varint(as_runs) + as_runs if as_runs < singly else 1 + singly)
    assert whole[2] == sorted(map(str, df.where("key != 51").collect())) and whole[3] == sorted(map(str, df.collect()))


def test_long_columns_of_large_numbers(spark):
    """Codes whose sum is beyond 64 bits: no Rice code, and no overflow."""
    df = spark.range(12000).selectExpr("1L as key", "id as row_no", "if(id % 2 = 0, '1', '999999999999999') as value")
    (row,) = column_costs(df, ["key"]).collect()
    assert (row.rice, row.rice2) == (None, None) and row.dict_packed == 1 + 1 + 2 + 16 + 9 + 12000 // 8


def test_frames_and_chunks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, b in enumerate(EDGES):
        (tmp_path / "in" / str(k)).write_bytes(b)
    files = read_files(spark, str(tmp_path / "in"))
    write_frames(files, ["file"], str(tmp_path / "out"))
    assert sorted(bytes(r.content) for r in read_frames(spark, str(tmp_path / "out")).where("error is null").collect()) == sorted(b for b in EDGES if b)
    chunks = read_chunks(spark, str(tmp_path / "in"), 100)
    assert sorted(bytes(r.content) for r in whole_files(chunks).collect()) == sorted(b for b in EDGES if b)


def test_damaged_payloads_give_errors(spark, tmp_path):
    rows = spark.createDataFrame([(1, bytearray(b"abc " * 100))], "k int, content binary")
    write_frames(rows, ["k"], str(tmp_path / "good"))
    frames = spark.read.parquet(str(tmp_path / "good"))
    frames.withColumn("payload", F.expr("substring(payload, 1, 3)")).write.parquet(str(tmp_path / "bad"))
    (row,) = read_frames(spark, str(tmp_path / "bad")).collect()
    assert row.content is None and row.error


def test_winner_is_the_smallest_valid(spark):
    rows = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(EDGES)], "k int, content binary")
    found = candidates(rows, ["k"]).collect()
    assert all(r.valid for r in found)
    least = {k: min(r.bytes for r in found if r.k == k) for k in range(len(EDGES))}
    assert {r.k: r.bytes for r in winners(candidates(rows, ["k"]), ["k"]).collect()} == least
    assert in_chunks(rows, ["k"], 64).where("k = 0").count() == 0


def test_packed_chunk_containers_against_an_emitter(spark, tmp_path):
    size = report_queries.CHUNK_BYTES
    dice = random.Random(2)
    texts = ["", None, "A" * 512, "hola " * 3000, "".join(dice.choices("abcdé ", k=9000)), "x", "ab" * (size // 2), "é" * size]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    best = lambda b: min((len(encoded(b, c)) + (0 if c == "deflate" else FRAME), k) for k, c in enumerate(CANDIDATES))

    def container(content):
        chunks = [content[k : k + size] for k in range(0, len(content), size)]
        out = b"NDCB1\x01" + struct.pack("<QII", len(content), size, len(chunks))
        for chunk in chunks:
            length, k = best(chunk)
            payload = encoded(chunk, CANDIDATES[k])
            assert packed(chunk) == (length, CANDIDATES[k], payload)
            out += struct.pack("<II", len(chunk), length) + bytes(length - len(payload)) + payload
        return len(chunks), len(out)

    got = {r.doc_id: (r.chunks, r.bytes) for r in report_queries.chunk_container_packed(spark, str(tmp_path)).collect()}
    assert got == {k: container((t or "").encode()) for k, t in enumerate(texts)}
    assert got[0] == got[1] == (0, 22) and got[3][1] < 2000


def test_reports(spark):
    runs = spark.createDataFrame([("f", 1, 10, 20), ("f", 2, 8, 8), ("g", 1, 5, 0)], "file string, ts int, size long, base long")
    assert sorted((r.file, r.ts, r.change, r.saved_percent, r.winner) for r in with_previous(runs).collect() if r.file == "f") == [("f", 1, None, 50.0, "ours"), ("f", 2, -2, 0.0, "tie")]
    sizes = spark.createDataFrame([(None,), (1023,), (1152,), (3 << 20,)], "n long").select(human_size(F.col("n")).alias("s"))
    assert [r.s for r in sizes.collect()] == ["N/A", "1023 B", "1.13 KB", "3.00 MB"]


def test_micro_batches(spark, tmp_path):
    spark.createDataFrame(log(50), "file string, line_no long, line string").write.parquet(str(tmp_path / "lines"))
    stream = spark.readStream.schema("file string, line_no long, line string").parquet(str(tmp_path / "lines"))
    mine_batches(stream, str(tmp_path / "templates"), str(tmp_path / "checkpoint")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "templates")).first().hits == 50


def test_ranges_of_lines_make_no_difference(spark, monkeypatch):
    """Rows and tags are numbered the same when a file is cut into ranges of three lines."""
    lines = [("f", 2 * k, line if k % 5 else "raw line of its own\n") for _, k, line in log(40)] + [("f", 200 + k, f"another line of text {k:03d}\n") for k in range(9)] + [("g", k, "no variable\n") for k in range(5)]
    df = spark.createDataFrame(lines, "file string, line_no long, line string")
    matched = match_lines(df, mine_templates(df, ["file"]), ["file"])

    def found():
        tags = sorted((r.file, r.line_no, r.tag) for r in tagged_entries(matched, ["file"]).collect())
        return tags, sorted((r.template_id, r.slot, r.row_no, r.value) for r in variable_columns(matched, ["file"]).collect())

    whole = found()
    monkeypatch.setattr(ranges, "RANGE", 3)
    assert found() == whole and [t for _, _, t in whole[0]].count(2) > 30


def test_structural_candidates_of_a_log(spark):
    """The log of 3,000 lines: one template with ten slots, every line hit, rebuilt, and smaller than deflate."""
    df = spark.createDataFrame(log(3000), "file string, line_no long, line string")
    found = {r.candidate: r for r in template_candidates(df, ["file"], variant_bytes=0).collect()}
    assert set(found) == {"rows", "columns", "columns-strict", "columns-wide"}
    for r in found.values():
        assert r.valid and (r.templates, r.hits, r.raw_lines, r.vars, r.same) == (1, 3000, 0, 30_000, 2999)
    assert found["columns"].bytes < found["rows"].bytes < found["rows"].original
    sizes = columns_deflated(df, ["file"]).first()
    assert sizes.bytes < sizes.deflate < sizes.original == found["rows"].original
    few = spark.createDataFrame(log(3) + [("g", k, "no variable\n") for k in range(9)], "file string, line_no long, line string")
    assert template_candidates(few, ["file"]).count() == 0


def test_texts_of_many_escapes(spark):
    """Quoted literals of 100,000 escapes neither fill the stack nor change what is found."""
    texts = ['"' + "\\\\n" * 100_000 + '" and run_of_bytes', "'it''s' \\", '"open ' + "\\\\x" * 50_000, "`a\\`b` word"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(lexeme_pieces(F.col("text")).alias("p")).collect()
    assert [r.p for r in rows][0] == ["run_of_bytes"] and [r.p for r in rows][3] == ["word", "`a\\`b`"]


def test_numbers_end_where_the_value_ends(spark):
    """A line end behind the digits makes a value text, whose bytes all count."""
    df = spark.createDataFrame([(0, k, v) for k, v in enumerate(["12\n", "13\n", "14\n"])], "key long, row_no long, value string")
    (row,) = column_costs(df, ["key"]).collect()
    assert row.delta is None and row.raw == 1 + 3 * 4


def test_entries_inside_the_first_kept_ones_go(spark):
    dice = random.Random(7)
    words = {"".join(dice.choice("ab") for _ in range(dice.randrange(3, 9))) for _ in range(150)}
    ranked = [(1, w, 300 - 2 * k, k) for k, w in enumerate(sorted(words, key=lambda w: (-len(w), w)))]
    dice.shuffle(ranked)
    ranked = [(1, w, 300 - 2 * k, k) for k, (_, w, _, _) in enumerate(ranked)]
    kept = []
    for _, word, score, _ in ranked:
        if score >= 250 or not any(word in k for k in kept[:30]):
            kept.append(word)
    df = spark.createDataFrame(ranked, "doc_id long, lexeme string, score long, rank long")
    found = without_contained(df, ["doc_id"], least=250, leaders=30).orderBy("rank").collect()
    assert [r.lexeme for r in found] == kept and [r.rank for r in found] == list(range(len(kept))) and len(kept) < len(ranked)


def test_entries_inside_any_kept_one_go(spark):
    """No limit on the entries that are kept or looked into; before, 4,096 and the first 64."""
    dice = random.Random(8)
    random_words = sorted({"".join(dice.choice("abé") for _ in range(dice.randrange(3, 12))) for _ in range(900)}, key=lambda _: dice.random())
    ranked = [*((1, w, 300 - k // 4, k) for k, w in enumerate(random_words)), *((2, f"<{k:05}>", 200, k) for k in range(4600))]
    ranked += [(2, f"{k:05}", 20, 4600 + i) for i, k in enumerate((3, 70, 4400, 4590, 9999))]
    kept = {1: [], 2: [f"<{k:05}>" for k in range(4600)] + ["09999"]}
    for _, word, score, _ in ranked[: len(random_words)]:
        if score >= 250 or not any(word in k for k in kept[1]):
            kept[1].append(word)
    rows = spark.createDataFrame(ranked, "doc_id long, lexeme string, score long, rank long").repartition(3, "lexeme")
    found = without_contained(rows, ["doc_id"], least=250).orderBy("doc_id", "rank").collect()
    for key in kept:
        assert [r.lexeme for r in found if r.doc_id == key] == kept[key] and [r.rank for r in found if r.doc_id == key] == list(range(len(kept[key])))
    assert len(kept[1]) < len(random_words)


@pytest.mark.parametrize("content", [*EDGES, b"key=12 key=13\r\nkey=14 key=15\n\nkey=16", b"abcabcabcabcabcabcabc", "año año año año ".encode() * 3])
def test_frequent_grams_against_counting(content):
    times = Counter(line[i : i + size] for line in content.replace(b"\r", b"\n").split(b"\n") for i in range(len(line)) for size in range(3, 11) if i + size <= len(line) and line[i] not in b"\xff\t ")
    found = frequent_grams(content)
    assert dict(found) == {g: t for g, t in times.items() if t >= 4} and len(dict(found)) == len(found)


def test_replaced_lexemes_are_restored(spark):
    dice = random.Random(3)
    entries = [bytes(dice.choice(b"ab\xff") for _ in range(n)) for n in (4, 5, 6, 7)] + [b"abcd"] * 1 + [b"w%03d_" % k for k in range(200)]
    for _ in range(50):
        content = b"".join(dice.choice([*entries, b"\xff", b"x", b"ab"]) for _ in range(dice.randrange(0, 60)))
        payload, hits, saved = replaced(content, entries)
        assert restored(payload, entries) == content
        at, greedy = 0, 0
        while at < len(content):
            fit = max((len(e) for e in entries if content.startswith(e, at)), default=0)
            greedy += fit > 0
            at += fit or 1
        assert hits == greedy and len(payload) == len(content) - saved + content.count(b"\xff") - sum(e.count(b"\xff") for e in matched_entries(content, entries))
    text = "\n".join(f"GET /api/v1/resource/{k % 3} status=ok client=browser" for k in range(200))
    (row,) = lexeme_candidate(spark.createDataFrame([(1, text), (2, "short"), (3, None)], "doc_id long, text string"), "doc_id").collect()
    assert row.valid and row.bytes < row.n / 2 and row.hits >= 400


def matched_entries(content, entries):
    at = 0
    while at < len(content):
        fit = max((e for e in entries if content.startswith(e, at)), key=len, default=b"")
        if fit:
            yield fit
        at += len(fit) or 1


def test_streams_and_frequencies(spark):
    texts = ["", "a" * 3, "a" * 500, "ab" * 40, "".join(map(chr, range(32, 127))) * 3, "x" * 300 + "yz" * 5, "a" * 5000 + "bc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    chosen = {r.doc_id: (r.stream, r.bytes) for r in stream_choice(stream_costs(docs, "doc_id"), "doc_id").collect()}
    assert chosen[0] == ("raw", 5) and chosen[2] == ("fill", 6) and chosen[5][0] == "rle"
    # two symbols take two bits each where one would do
    assert chosen[3] == ("raw", 85) and {r.doc_id: r.huffman_plus_one for r in stream_costs(docs, "doc_id").collect()}[3] == 269 + 20
    runs = {r.doc_id: tuple(r.r) for r in docs.select("doc_id", run_counts(F.encode("text", "UTF-8")).alias("r")).collect()}
    assert runs[0] == (0, 0, 0, 0) and runs[2] == (1, 500, 1, 3) and runs[6] == (3, 5000, 1, 7) and runs[3] == (80, 1, 0, 160)
    counts = [[0] * 256, [60, 4] + [0] * 254, [10**6] + [1] * 255, [7] * 256, [3, 60] + [0] * 254]
    tables = [r.f for r in spark.createDataFrame([(c,) for c in counts], "c array<long>").select(table_frequencies("c").alias("f")).collect()]
    assert tables[0] is None and tables[4] is None or sum(tables[4]) == 4096
    for c, f in zip(counts[1:4], tables[1:4], strict=True):
        assert sum(f) == 4096 and all((x > 0) == (y > 0) for x, y in zip(c, f, strict=True))
    assert tables[1][:2] == [3840, 256] and tables[2][0] == 4096 - 255 and set(tables[3]) == {16}


def test_appended_histories(spark, tmp_path):
    for ts in range(3):
        append_runs(spark.createDataFrame([("f", ts, 10 - ts, 20), ("g", ts, 5, 5)], "file string, ts int, size long, base long"), str(tmp_path / "runs"))
    runs = spark.read.parquet(str(tmp_path / "runs"))
    assert runs.count() == 6 and sorted((r.ts, r.change) for r in with_previous(runs).where("file = 'f'").collect()) == [(0, None), (1, -1), (2, -1)]
    assert last_runs(runs, 2).count() == 4
