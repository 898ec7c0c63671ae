"""op1 against brute force: every 100-byte string of every document, in a dictionary."""

import hashlib
import random

import pytest

from tessera.llm.suffix_dedup import removed_bytes, suffix_dedup

SCHEMA = "doc_id bigint, text string, kept string, key bigint"


def brute(docs, length=100):
    seen, out = set(), []
    for doc, text in sorted(docs, key=lambda d: d[0]):
        body = (text or "").encode()
        gone = [False] * len(body)
        for at in range(len(body) - length + 1):
            string = body[at : at + length]
            if string in seen:
                gone[at : at + length] = [True] * length
            seen.add(string)
        left = bytes(b for b, g in zip(body, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((doc, len(body), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def sample():
    dice = random.Random(5)
    words = [f"w{dice.randrange(400)}é"[: dice.randrange(2, 6)] for _ in range(300)]
    text = lambda n: " ".join(dice.choice(words) for _ in range(n))
    passages = [text(40) for _ in range(6)]
    docs = [(k, text(dice.randrange(1, 200))) for k in range(60)]
    docs += [(100 + k, text(30) + passages[k % 6][dice.randrange(20) :] + text(10) + passages[(k + 1) % 6]) for k in range(60)]
    docs += [(300 + k, docs[k][1]) for k in range(0, 60, 7)]
    docs += [(400, "a" * 5000), (401, "ab" * 900), (402, None), (403, ""), (404, "x" * 99), (405, "x" * 100), (406, "x" * 100), (407, "y" * 101), (408, text(30_000) + passages[0])]
    return docs


@pytest.mark.parametrize("group_most", [10_000, 3])
def test_like_brute_force(spark, group_most):
    docs = sample()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA).repartition(5)
    found = removed_bytes(suffix_dedup(df, group_most=group_most)).collect()
    assert sorted(map(tuple, found)) == brute(docs)


def test_texts_longer_than_a_block_and_repeated_rows(spark, monkeypatch):
    """Repeats across the edges of blocks, inside one long text and between two; rows that stand twice; one outlying id."""
    monkeypatch.setattr("tessera.llm.suffix_dedup.BLOCK", 4096)
    dice = random.Random(12)
    text = lambda n: "".join(dice.choices("abcdefgh \n", k=n))
    passage = text(5000)
    docs = [(1, text(4000) + passage + text(9000)), (2, text(4090) + passage[:300] + text(700) + passage), (3, text(50) + "é" * 6000), (2**40, passage[2000:2150])]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA)
    found = removed_bytes(suffix_dedup(df)).collect()
    assert sorted(map(tuple, found)) == brute(docs)
    twice = removed_bytes(suffix_dedup(df.unionByName(df.where("doc_id = 2")))).collect()
    assert sorted(map(tuple, twice)) == sorted([*brute(docs), brute(docs)[1]])


def test_key_that_is_common_in_one_batch_only(spark):
    """Its count is 12 in the second batch and 8 in the third, whose string starts earlier only in rows noted before."""
    dice = random.Random(8)
    text = lambda n: "".join(dice.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    passage = text(130)
    variant = lambda: text(150) + passage + text(150)
    docs = [(k, variant()) for k in range(6)]
    docs += [(100 + k, docs[k][1]) for k in range(5)] + [(105, variant()), (299, variant())]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA)
    found = removed_bytes(suffix_dedup(df, batches=3, group_most=8)).collect()
    assert sorted(map(tuple, found)) == brute(docs)


def test_empty_table_and_row_without_id(spark):
    assert suffix_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(None, "z" * 150, "", 0), (1, "z" * 120, "", 0)], SCHEMA)
    assert {(r.doc_id, r.n_bytes, r.n_removed) for r in removed_bytes(suffix_dedup(df)).collect()} == {(None, 150, 0), (1, 120, 119)}
