"""Exact dedup, URL filter, quality counts, mixing and encoding against plain restatements."""

import hashlib
import random
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm.exact_dedup import DigestIndex, exact_dedup
from tessera.llm.mixing import mix
from tessera.llm.piece_bpe import decode_documents, encode_documents
from tessera.llm.quality_rules import quality_rules, text_counts
from tessera.llm.queries import ORACLE, QUERIES, URL_RULES
from tessera.llm.scratch import Scratch
from tessera.llm.url_filter import filter_urls

DOCS = "doc_id bigint, text string, lang string, source string, kept string"


def sample():
    dice = random.Random(9)
    text = lambda n: " ".join(dice.choice(["alpha", "Beta", "gamma", "delta,", "Straße", "数据"]) for _ in range(n))
    docs = [(k, text(dice.randrange(0, 120)), "en", dice.choice(["a", "a", "a", "b", None]), "") for k in range(80)]
    docs += [(100 + k, docs[k][1].upper().replace("STRASSE", "Straße"), "de", "b", "") for k in range(0, 80, 9)]
    return docs + [(200 + k, "Same TEXT" if k % 2 else "same text", "en", "a", "") for k in range(30)] + [(300, None, None, None, ""), (301, "", "en", "a", "")]


@pytest.mark.parametrize(("keep", "digest_bytes"), [("largest", 32), ("smallest", 32), ("largest", 1)])
def test_exact_dedup(spark, keep, digest_bytes):
    docs = sample()
    groups = defaultdict(list)
    lower = {d[0]: (d[1] or "").encode().lower() for d in docs}
    for d, t in lower.items():
        groups[t].append(d)
    stays = {d: (max if keep == "largest" else min)(groups[t]) for d, t in lower.items()}
    expected = sorted((d, stays[d], len(groups[t]), d == stays[d], hashlib.sha256(t).hexdigest()) for d, t in lower.items())
    found = exact_dedup(spark.createDataFrame(docs, DOCS), keep=keep, digest_bytes=digest_bytes, group_slice=7).collect()
    assert sorted(map(tuple, found)) == expected


def test_filters_note_all_digests_that_occur_again(spark, monkeypatch):
    """Memtables probe the filters of older runs, compacted ones too: what is noted holds all repeats and few others."""
    dice = random.Random(4)
    rows = [(k, hashlib.sha256(str(dice.randrange(3000)).encode()).digest()) for k in range(4000)]
    df = spark.createDataFrame([(bytearray(d), k) for k, d in rows], "digest binary, rank bigint")
    index = DigestIndex(spark, Scratch(spark), buckets=3)
    for start in range(0, 4000, 800):
        index.add(df.where(F.col("rank").between(start, start + 799)))
    groups = defaultdict(list)
    for k, d in rows:
        groups[d].append(k)
    found = {bytes(r.digest): (r.least, r.n) for r in index.lookup().collect()}
    again = {d: (min(ks), len(ks)) for d, ks in groups.items() if len(ks) > 1}
    assert {d: v for d, v in found.items() if v[1] > 1} == again and len(found) < len(again) * 1.05


def test_edges_of_exact_dedup(spark):
    """Rows without doc_id, repeated rows, long texts, one outlying id, an empty table."""
    long = "Word " * 200_000
    rows = [(None, "same", "", "", ""), (None, "same", "", "", ""), (1, "same", "", "", ""), (1, "same", "", "", ""), (5, "SAME", "", "", ""), (2**50, long, "", "", ""), (7, long.upper(), "", "", ""), (8, None, "", "", ""), (9, "", "", "", "")]
    found = exact_dedup(spark.createDataFrame(rows, DOCS), keep="smallest").collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in found) == sorted([("None", "None", 1, True)] * 2 + [("1", "1", 3, True)] * 2 + [("5", "1", 3, False), (str(2**50), "7", 2, False), ("7", "7", 2, True), ("8", "8", 2, True), ("9", "8", 2, False)])
    assert exact_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_edges_of_url_filter(spark):
    """Very long urls, repeated rows, an empty table."""
    schema = "page_id bigint, url string, rule int"
    far = "http://a.org/" + "x/" * 20_000
    rows = [(1, far, 0), (1, far, 0), (2, "http://" + "sub." * 2000 + "example.org/es/", 0), (3, None, 0)]
    found = filter_urls(spark.createDataFrame(rows, schema), URL_RULES).collect()
    assert sorted((r.page_id, r.rule, r.verdict) for r in found if r.rule) == [(1, "org/", "allow"), (1, "org/", "allow"), (2, "example.org/es/", "block")]
    assert filter_urls(spark.createDataFrame([], schema), URL_RULES).count() == 0


def test_url_filter(spark):
    urls = ["http://a.Example.ORG/es/x?y", "https://example.org/en/12", "x://notexample.org/es/", "http://b.com/fr/", "http://com/de/#f", "http://org", "nothing", None, "", "a://b://c"]
    pages = spark.createDataFrame([(k, u, 1) for k, u in enumerate(urls)], "page_id bigint, url string, rule int")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, URL_RULES).collect()}
    assert found[0] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert found[1][2:] == ("example.org/en/1", "block")
    assert found[2][2:] == ("org/", "allow")
    assert found[3][2:] == ("com/fr/", "allow") and found[4][2:] == ("com/de/", "block")
    assert found[5] == ("org", "", None, "allow")
    assert found[6] == found[7] == found[8] == ("", "", None, "allow")
    assert found[9] == ("b:", "//c", None, "allow")


def test_quality_counts_and_empty_table(spark):
    words = [f"w{k}" for k in range(8)]
    text = " ".join(words + ["x"] + words) + "\nx\nx\n \n#*"
    assert text_counts(text)[:5] == (20, sum(map(len, text.split())), 2, 1, 18)
    assert text_counts(None) == text_counts("") == (0,) * 8
    assert quality_rules(spark.createDataFrame([], DOCS)).count() == 0
    found = {r.doc_id: r for r in quality_rules(spark.createDataFrame(sample(), DOCS)).collect()}
    assert found[300].base_failed and not found[300].kept and found[300].n_words == 0


def test_mixing_meets_targets_and_reruns_agree(spark):
    df = spark.createDataFrame(sample(), DOCS)
    first, again = ({r.doc_id: r for r in mix(d).collect()} for d in (df, df.repartition(7)))
    assert first == again
    everything = sum(r.size for r in first.values())
    by = defaultdict(list)
    for r in first.values():
        assert r.taken <= 3 * r.size
        by[r.source].append(r)
    assert sum(rs[0].target for rs in by.values()) == pytest.approx(everything)
    for rs in by.values():
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(r.size for r in rs)
    assert mix(spark.createDataFrame([], DOCS)).count() == 0


def test_mixing_of_repeated_rows_and_long_texts(spark):
    """Targets are met when a source has one document many times, ties, texts without words and very long ones."""
    dice = random.Random(3)
    docs = [(7, "one two three four five six seven eight nine ten", "en", "a", "") for _ in range(60)]
    docs += [(None, "no name " * 5, "en", "a", "")] * 3 + [(None, "other " * 9, None, "c", "")]
    docs += [(100 + k, "w " * dice.randrange(0, 50), "en", "b", "") for k in range(80)] + [(300, "long " * 40_000, "en", "d", ""), (301, None, "en", "d", "")]
    df = spark.createDataFrame(docs, DOCS)
    first, again = (sorted((r.doc_id or 0, r.size, r.source, r.taken, r.target) for r in mix(d).collect()) for d in (df, df.repartition(5)))
    assert first == again and len(first) == len(docs)
    by = defaultdict(list)
    for r in first:
        assert r[3] <= 3 * r[1]
        by[r[2]].append(r)
    for rs in by.values():
        assert abs(sum(r[3] for r in rs) - rs[0][4]) <= max(r[1] for r in rs)
    numbered = df.withColumn("n", F.monotonically_increasing_id())
    assert mix(numbered, row="n").select("row").distinct().count() == len(docs)


@pytest.mark.parametrize("repeats", [False, True])
def test_mixing_like_its_sql(spark, tmp_path, repeats):
    duckdb = pytest.importorskip("duckdb")
    docs = [d for d in sample() if d[0] is not None] + ([(7, "one two three four", "en", "a", "")] * 40 + [(8, "five six", "en", None, "")] * 9 if repeats else [])
    docs = [d for d in docs if not repeats or d[0] not in (7, 8) or d[1] in ("one two three four", "five six")]
    spark.createDataFrame(docs, DOCS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    expected = sorted(con.execute(f"select doc_id, size, source_size, round(target, 6), taken from ({ORACLE['op9_mixing']})").fetchall())
    found = QUERIES["op9_mixing"](spark, str(tmp_path)).withColumn("target", F.round("target", 6)).collect()
    assert sorted(map(tuple, found)) == expected


def test_encoding_is_lossless_and_exact_without_dropout(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    tokenizers = pytest.importorskip("public_tokenizers")
    docs = [d for d in sample() if d[1]] + [(400, "  two  spaces ▁ mark\n\ttab \u0301", "", "", ""), (401, "a" * 500, "", "", "")]
    df = spark.createDataFrame(docs, DOCS)
    assert all(r.decoded == r.text for r in decode_documents(encode_documents(df)).collect())
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
    plain = {r.doc_id: r for r in encode_documents(df, dropout=0.0).collect()}
    assert all(list(r.pieces) == model.encode(r.text) for d, r in plain.items() if d < 300)


def test_dropout_like_an_agenda_in_plain_python(spark):
    """Every text's pieces with dropout: best candidate first, leftmost on ties, candidates skipped by their hash."""
    sentencepiece = pytest.importorskip("sentencepiece")
    tokenizers = pytest.importorskip("public_tokenizers")
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
    ids = {model.id_to_piece(k): k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k) or model.is_byte(k))}
    order = {k: rank for rank, k in enumerate(sorted(ids.values(), key=lambda k: (-model.get_score(k), k)))}
    most = 1 << 64

    def mix(x):
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, None):
            x ^= x >> 33
            x = x * factor % most if factor else x
        return x

    def agenda(doc_id, text, dropout, seed=17):
        shown = " " + text
        salt = xxhash.xxh64_intdigest(str(doc_id), seed)
        symbols = [(k, k + 1, None if c == "▁" else c.replace(" ", "▁")) for k, c in enumerate(shown)]  # a mark in the text is no space

        def candidate(left, right):
            (a, b, x), (_, c, y) = left, right
            if x is None or y is None or x not in ids or y not in ids or x + y not in ids:
                return None
            key = (salt + a * 0x9E3779B97F4A7C15) % most ^ ((b - a) * 0xC2B2AE3D27D4EB4F + (c - b) * 0x165667B19E3779F9) % most
            return None if mix(key) < int(dropout * 2**64) else (order[ids[x + y]], a)

        while True:
            found = [(c, k) for k in range(len(symbols) - 1) if (c := candidate(symbols[k], symbols[k + 1]))]
            if not found:
                break
            _, k = min(found)
            (a, _, x), (_, c, y) = symbols[k : k + 2]
            symbols[k : k + 2] = [(a, c, x + y)]
        out = []
        for a, b, x in symbols:
            out += [ids[x]] if x in ids else [model.piece_to_id(f"<0x{v:02X}>") for v in shown[a:b].encode()]
        return out

    texts = ["the quick brown fox", "  two  spaces ▁ mark\n\ttab \u0301", "internationalization " * 3, "a" * 130, "数据 Straße", " ", "x"]
    rows = [(k, t, "", "", "") for k, t in enumerate(texts)] + [(0, texts[0], "", "", ""), (90, None, "", "", ""), (91, "", "", "", "")]
    for dropout in (0.0, 0.1, 0.5):
        found = encode_documents(spark.createDataFrame(rows, DOCS), dropout=dropout)
        for r in decode_documents(found).collect():
            assert list(r.pieces) == (agenda(r.doc_id, r.text, dropout) if r.text else []) and r.decoded == r.text
    assert encode_documents(spark.createDataFrame([], DOCS)).count() == 0
