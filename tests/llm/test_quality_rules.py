"""The robust outlier test against an estimate in numpy, and its edge cases."""

import math
import random
import re

import numpy as np
import pytest

from tessera.llm.quality_rules import CUTOFF, FLOORS, consistency, quality_rules

SCHEMA = "doc_id bigint, text string, lang string, source string, d2 string, start int, kept string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    n = len(words)
    windows = [tuple(words[k : k + 8]) for k in range(n - 7)]
    repeated = set()
    for k, w in enumerate(windows):
        if windows.count(w) > 1:
            repeated.update(range(k, k + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    counts = (n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated))
    chars = max(counts[1], 1)
    stutter = sum(a == b for a, b in zip(words, words[1:], strict=False))
    features = [math.log(chars / max(n, 1)), math.sqrt(counts[2] / chars), math.sqrt(counts[3] / max(len(lines), 1)), math.sqrt(counts[4] / max(n, 1)), math.sqrt(sum(c.isascii() and c.isupper() for c in text or "") / chars), math.sqrt(stutter / max(n, 1))]
    return counts, n < 20 or 100 * len(repeated) > 30 * n, [math.floor(f * 256 + 0.5) for f in features]


def moments(x, share):
    return x.mean(axis=0), consistency(share) * np.cov(x.T, bias=True) + np.diag((np.array(FLOORS) * 256) ** 2)


def distances(x, centre, cov):
    off = x - centre
    return np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off)


def closest(x, centre, cov, share):
    shell = np.floor(distances(x, centre, cov) * 16)
    return x[shell <= np.sort(shell)[math.ceil(share * len(x)) - 1]]


def mcd(x, coverage=0.75):
    q = lambda p: np.sort(x, axis=0)[math.ceil(p * len(x)) - 1]
    spread = np.maximum((q(0.75) - q(0.25)) / 1.349, np.array(FLOORS) * 256)
    middle = (q(0.5), np.diag(spread**2))
    starts = [middle, moments(x, 1.0), moments(closest(x, *middle, 0.5), 0.5)]
    for _ in range(2):
        starts = [moments(closest(x, *s, coverage), coverage) for s in starts]
    best = min(starts, key=lambda s: np.linalg.slogdet(s[1])[1])
    for _ in range(10):
        further = moments(closest(x, *best, coverage), coverage)
        if np.linalg.slogdet(further[1])[1] >= np.linalg.slogdet(best[1])[1] - 1e-6:
            break
        best = further
    return best


def sample():
    dice = random.Random(12)
    vocabulary = ["a", "to", "word", "Words", "longer", "Something", "x#y", "straße", "数据", "considerable"]
    docs = []
    for k in range(260):
        words = [dice.choice(vocabulary) for _ in range(dice.randrange(15, 120))]
        if k % 11 == 0:
            words = ["#*$%" if dice.random() < 0.7 else w for w in words]
        if k % 17 == 0:
            words = [w for w in words for _ in range(2)]
        lines = [" ".join(words[at : at + 9]) for at in range(0, len(words), 9)]
        docs.append((k, "\n".join(lines), dice.choice(["en", "en", "de", None]), dice.choice(["web", "web", "web", "book", None]), "x", 5, "y"))
    return docs


def test_estimates_like_numpy(spark):
    docs = sample()
    found = {r.doc_id: r for r in quality_rules(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()}
    groups, rejected = {}, 0
    for d in docs:
        counts, failed, features = base(d[1])
        r = found[d[0]]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts and r.base_failed == failed
        groups.setdefault((d[2], d[3]), []).append((d[0], failed, features))
    for rows in groups.values():
        good = np.array([f for _, failed, f in rows if not failed], float)
        centre, cov = mcd(good)
        for (i, failed, _), d2 in zip(rows, distances(np.array([f for _, _, f in rows], float), centre, cov), strict=True):
            assert found[i].d2 == pytest.approx(d2, rel=1e-6, abs=1e-6)
            assert found[i].kept == (not failed and d2 <= CUTOFF)
            rejected += not failed and d2 > CUTOFF
    assert rejected > 5


def test_edges_of_quality_rules(spark):
    """Null and repeated rows, ties, groups of one or none, a very long text."""
    text = " ".join(f"word{k}" for k in range(40))
    long = " ".join(f"word{k}" for k in range(100_000))
    rows = [(1, text, "en", "a")] * 5 + [(None, text, None, None), (2, None, None, "a"), (3, "", "en", None), (4, long, "en", "a"), (5, text, "fr", "alone"), (6, "short", "xx", "none")]
    found = quality_rules(spark.createDataFrame([(*r, "", 0, "") for r in rows], SCHEMA)).collect()
    assert len(found) == len(rows)
    kept = {(r.doc_id, r.kept, r.base_failed) for r in found}
    assert kept == {(1, True, False), (None, True, False), (2, False, True), (3, False, True), (4, True, False), (5, True, False), (6, False, True)}
    assert quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0


def test_consistency_factor():
    dice = np.random.default_rng(1)
    x = dice.standard_normal((200_000, 6))
    d2 = (x**2).sum(axis=1)
    for share in (0.5, 0.75, 0.9):
        inside = x[d2 <= np.quantile(d2, share)]
        assert consistency(share) == pytest.approx(1 / inside.var(), rel=0.02)
