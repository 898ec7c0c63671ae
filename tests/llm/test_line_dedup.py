"""Line dedup against one pass over all chunks in order."""

import random

from tessera.llm.line_dedup import PASSAGE, added_columns, chunks_of, line_dedup, needed


def test_repeated_chunks_go(spark):
    dice = random.Random(4)
    line = lambda n: " ".join(f"w{dice.randrange(5000)}" for _ in range(n))
    passages = [[line(dice.randrange(3, 12)) for _ in range(30)] for _ in range(3)]
    long_line = line(90)
    docs = [(0, None, "x"), (1, "", "x"), (2, "one line", "x"), (None, "one line", "x")]
    for k in range(3, 40):
        lines = [line(dice.randrange(0, 9)) for _ in range(dice.randrange(1, 12))]
        for shared in dice.sample([*passages, [long_line]], dice.randrange(0, 3)):
            at = dice.randrange(len(lines) + 1)
            lines[at:at] = shared
        docs.append((k, "\n".join(lines), "x"))
    settings = {"divisor": 4, "least_words": 8, "long_words": 50}
    got = {r["doc_id"]: r["text"] for r in line_dedup(spark.createDataFrame(docs, "doc_id bigint, text string, digest string"), **settings).collect()}
    seen, gone = set(), 0
    for doc_id, text, _ in docs:
        if doc_id is None or not text:
            assert got[doc_id] == text
            continue
        lines = text.split("\n")
        keep = [True] * len(lines)
        for _, _, first, last in chunks_of(text, **settings):
            own = "\n".join(lines[first : last + 1])
            if own in seen:
                keep[first : last + 1] = [False] * (last + 1 - first)
            seen.add(own)
        gone += keep.count(False)
        assert got[doc_id] == "\n".join(x for x, k in zip(lines, keep, strict=True) if k)
    assert gone > 100 and len(got) == len(docs)


def test_repeated_passages_go(spark):
    dice = random.Random(9)
    line = lambda n: " ".join(f"w{dice.randrange(5000)}" for _ in range(n))
    passages = [[line(dice.randrange(0, 30)) for _ in range(n)] for n in (2, 3, 3, 4, 4, 5, 6, 6, 12)] + [["", "", line(49), "", line(1)], [line(20)] * 7]
    docs = []
    for k in range(60):
        lines = [line(dice.randrange(0, 9)) for _ in range(dice.randrange(1, 6))]
        for shared in dice.sample(passages, dice.randrange(0, 4)):
            at = dice.randrange(len(lines) + 1)
            lines[at:at] = shared[dice.randrange(2) :]
        docs.append((k, "\n".join(lines)))
    settings = {"divisor": 3, "least_words": 20, "long_words": 50}
    frame = spark.createDataFrame([*docs, (99, None), (98, "")], "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: r["text"] for r in line_dedup(frame, **settings, passages=True).collect()}
    short = {r["doc_id"]: r["text"] for r in line_dedup(frame, **settings).collect()}
    assert got.pop(99) is None and got.pop(98) == ""
    seen, chunks, more = set(), set(), 0
    for doc_id, text in docs:
        lines = text.split("\n")
        keep = [True] * len(lines)
        for _, _, a, b in chunks_of(text, **settings):
            if (own := tuple(lines[a : b + 1])) in chunks:
                keep[a : b + 1] = [False] * (b + 1 - a)
            chunks.add(own)
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                own = tuple(lines[a : b + 1])
                if len(" ".join(own).split()) >= 50:
                    if own in seen:
                        keep[a : b + 1] = [False] * (b + 1 - a)
                    seen.add(own)
        assert got[doc_id] == "\n".join(x for x, k in zip(lines, keep, strict=True) if k)
        more += len(short[doc_id]) > len(got[doc_id])
    assert more > 10 and len(got) == len(docs)


def test_needed_windows_cover_the_same_lines():
    dice = random.Random(3)
    for _ in range(3000):
        marks = [(k + dice.choice([0, PASSAGE]), a, a + dice.randrange(1, 7)) for k, a in enumerate(dice.choices(range(40), k=dice.randrange(1, 15)))]
        keep = needed(marks)
        covered = lambda some: {x for _, a, b in some for x in range(a, b + 1)}
        assert covered(m for m, k in zip(marks, keep, strict=True) if k) == covered(marks)


def test_chunks_end_where_the_rolling_hash_says():
    """Edges restated a line at a time: a window of three lines' hashes, divisible by the divisor; long lines stand alone."""
    import xxhash

    dice = random.Random(8)
    odd = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
    for _ in range(60):
        lines = [" ".join(f"w{dice.randrange(9)}" for _ in range(dice.choice([0, 1, 4, 9, 60]))) for _ in range(dice.randrange(1, 40))]
        chunks, start = [], 0
        for k, line in enumerate(lines):
            rolled = sum(xxhash.xxh64_intdigest(lines[k - j].encode()) * odd[j] for j in range(min(3, k + 1))) % (1 << 64)
            long = len(line.split()) >= 50
            following = k + 1 < len(lines) and len(lines[k + 1].split()) >= 50
            if (rolled >> 11) % 3 == 0 or long or following or k == len(lines) - 1:
                total = sum(len(x.split()) for x in lines[start : k + 1])
                if total >= (50 if start == k else 20):
                    chunks.append((start, k))
                start = k + 1
        assert [(a, b) for _, _, a, b in chunks_of("\n".join(lines), 3, 20, 50)] == chunks


def test_edges_of_line_dedup(spark):
    """Clashing names, null and repeated rows, very long texts, an empty table."""
    schema = "doc_id int, text string, _id int, _marks string, _cuts int, _lines string, __gone_lines int, digest string, first string, n int, `a.b` string, others int"
    body = "\n".join(f"line {k} of a passage with quite some words in it" for k in range(12))
    far = "\n".join(f"own line {k}" for k in range(30_000))
    texts = [(1, body), (2, "head\n" + body), (2, "head\n" + body), (3, None), (4, ""), (None, body), (5, far), (6, far + "\nlast line")]
    df = spark.createDataFrame([(d, t, 7, "m", 8, "l", 9, "d", "f", 10, "ab", 11) for d, t in texts], schema)
    assert added_columns(df) == ("___lines", "___gone_lines", "___gone_chunks")
    found = line_dedup(df, passages=True)
    assert found.columns == [*df.columns, "___lines", "___gone_lines", "___gone_chunks"] and found.schema["doc_id"].dataType.simpleString() == "int"
    rows = sorted((r.doc_id or 0, r.text or "") for r in found.collect())
    assert rows == sorted([(0, body), (1, body), (2, "head"), (2, "head"), (3, ""), (4, ""), (5, far), (6, "last line")])
    assert all(tuple(r)[2:12] == (7, "m", 8, "l", 9, "d", "f", 10, "ab", 11) for r in found.collect())
    assert line_dedup(spark.createDataFrame([], schema), passages=True).count() == 0
