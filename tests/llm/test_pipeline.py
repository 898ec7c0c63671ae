"""The pipeline against its stages restated in plain Python, on tables with hard rows."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_jaccard_join import brute as near_brute
from test_quality_rules import CUTOFF, base, distances, mcd

import corpus_pipeline
from tessera.llm.line_dedup import chunks_of
from tessera.llm.queries import ORACLE

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sample():
    dice = random.Random(21)
    line = lambda n: " ".join(f"{dice.choice('abcdefgh')}{dice.randrange(3000)}" for _ in range(n))
    passage = "\n".join(line(15) for _ in range(5))
    docs = []
    for k in range(150):
        lines = [line(dice.randrange(3, 14)) for _ in range(dice.randrange(2, 14))]
        if k % 5 == 0:
            lines.insert(dice.randrange(len(lines)), passage)
        if k % 13 == 0:
            lines = [" ".join("#$%" if dice.random() < 0.8 else w for w in x.split()) for x in lines]
        docs.append((k, "\n".join(lines), dice.choice(["en", "de"]), dice.choice(["web", "web", "book", None])))
    for k in range(0, 150, 6):  # near copies: most words stay, lines are wrapped anew
        words = docs[k][1].split()
        words[dice.randrange(len(words))] = "changed"
        docs.append((200 + k, "\n".join(" ".join(words[at : at + 11]) for at in range(0, len(words), 11)), "en", "web"))
    docs += [(400 + k, docs[k][1], "en", "book") for k in range(0, 60, 7)]
    docs += [(500, None, None, None), (501, "", "en", "web"), (502, "too short", "en", "web"), (503, "\n".join(line(12) for _ in range(900)), "en", "web")]
    return [(*d, len(d[1] or "")) for d in docs]


def quality(docs):
    judged = [(d, *base(d[1])[1:]) for d in docs]
    groups = {}
    for d, failed, features in judged:
        groups.setdefault((d[2], d[3]), []).append((d, failed, features))
    kept = []
    for rows in groups.values():
        good = np.array([f for _, failed, f in rows if not failed], float)
        if len(good):
            near = distances(np.array([f for _, _, f in rows], float), *mcd(good)) <= CUTOFF
            kept += [d for (d, failed, _), k in zip(rows, near, strict=True) if not failed and k]
    return sorted(kept)


def line_dedup(docs):
    seen, chunks, out = set(), set(), []
    for d in sorted(docs):
        lines = d[1].split("\n")
        keep = [True] * len(lines)
        for _, _, a, b in chunks_of(d[1], 3, 20, 50):
            if (own := tuple(lines[a : b + 1])) in chunks:
                keep[a : b + 1] = [False] * (b + 1 - a)
            chunks.add(own)
        for a in range(len(lines)):
            words = 0
            for b in range(a, min(len(lines), a + 30)):
                words += len(lines[b].split())
                if words >= 50:
                    if (own := tuple(lines[a : b + 1])) in seen:
                        keep[a : b + 1] = [False] * (b + 1 - a)
                    seen.add(own)
        text = "\n".join(x for x, k in zip(lines, keep, strict=True) if k)
        if all(keep) or text.split():
            out.append((d[0], text, d[2], d[3], len(text)))
    return out


def mixed(docs, tmp_path, spark):
    spark.createDataFrame(docs, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/to_mix")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/to_mix/*.parquet'")
    return {d: t // s for d, s, t in con.execute(f"select doc_id, size, taken from ({ORACLE['op9_mixing']}) where size > 0").fetchall()}


def test_like_stages_in_plain_python(spark, tmp_path):
    docs = sample()
    spark.createDataFrame(docs, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    df, found = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, str(tmp_path))
        df.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        found[name] = df
    rows = lambda name: sorted(map(tuple, found[name].collect()))
    expected = quality(docs)
    assert rows("quality") == expected and 10 < len(docs) - len(expected) < 60
    expected, before = line_dedup(expected), expected
    assert rows("line_dedup") == expected and sum(d[4] for d in expected) < sum(d[4] for d in before)
    comps, _ = near_brute([d[:2] for d in expected], 5, 80)
    later = {d for d, _, c in comps if d != c}
    expected = [d for d in expected if d[0] not in later]
    assert rows("near_duplicates") == expected and len(later) > 10
    copies = mixed(expected, tmp_path, spark)
    expected = sorted(d for d in expected for _ in range(copies.get(d[0], 0)))
    assert rows("mixing") == expected
    encoded = found["encode"].collect()
    assert Counter(r.doc_id for r in encoded) == Counter(d[0] for d in expected)
    assert all(r.lossless and r.n_pieces == len(r.pieces) for r in encoded)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.n_pieces) for r in whole.collect()) == sorted((r.doc_id, r.n_pieces) for r in encoded)


@pytest.mark.parametrize("rows", ["none", "hard"])
def test_hard_rows(spark, rows, tmp_path):
    """No rows at all; rows without doc_id, repeated rows, and columns that clash with the stages' own."""
    good = " ".join(f"word{k}" for k in range(60))
    docs = [(None, "short", "en", "a", 5), (None, good, "en", "a", 9), (1, good + " x", "en", "a", 9), (1, good + " x", "en", "a", 9), (2, None, None, None, None), (3, "short", "en", "a", 5)]
    df = spark.createDataFrame(docs if rows == "hard" else [], SCHEMA)
    for name in ("row", "_copies", "copies", "kept", "marks", "id", "u", "_lines"):
        df = df.withColumn(name, F.lit(3))
    columns = df.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, "")
        assert df.columns == columns, name
        df.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "quality" and rows == "hard":
            assert sorted(str(r.doc_id) for r in df.collect()) == ["1", "1", "None"]
    if rows == "hard":  # one source: everything is taken about once, whatever its rows
        assert sum(len(r.text.split()) for r in df.collect()) == pytest.approx(60 + 61 * 2, abs=61)
        assert {r.doc_id for r in df.collect()} <= {None, 1}
    done = corpus_pipeline.STAGES[-1][1](spark, df, "").collect()
    assert all(r.lossless for r in done) and (len(done) > 0) == (rows == "hard")
