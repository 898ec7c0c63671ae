"""op6 against all pairs, and the pipeline's near duplicates."""

import random
import re

import pytest

import numpy as np

from tessera.llm.jaccard_join import jaccard_components, jaccard_links
from tessera.llm.metric_join import region_links

SCHEMA = "doc_id bigint, text string, id bigint, pivot string"


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def brute(docs, width, percent):
    sets = {d: shingles(t, width) for d, t in docs}
    comp = {d: d for d in sets}

    def root(d):
        while comp[d] != d:
            d = comp[d]
        return d

    links = set()
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                links.add((a, b))
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return sorted((d, len(sets[d]), root(d)) for d in ids), links


def sample():
    dice = random.Random(3)
    vocabulary = [f"Wort{k}" for k in range(900)]
    text = lambda n: [dice.choice(vocabulary) for _ in range(n)]
    line = " ".join(text(12))
    docs, k = [], 0
    for family in range(12):
        base = text(dice.randrange(20, 700))
        for _ in range(dice.randrange(2, 9)):
            words = list(base)
            for _ in range(dice.randrange(0, 6)):
                words[dice.randrange(len(words))] = dice.choice(vocabulary)
            docs.append((k, line + "\n" + " ".join(words) if family % 2 else " ".join(words)))
            k += 1
    chain = text(120)
    for step in range(8):  # neighbours link, the ends don't
        docs.append((k, " ".join(chain[step:] + chain[:step]).upper()))
        k += 1
    docs += [(k, None), (k + 1, ""), (k + 2, " \n\t"), (k + 3, "one two"), (k + 4, "ONE  two"), (k + 5, "one"), (k + 6, "é é é é"), (k + 7, " ".join(text(9000)))]
    return docs


def family(first, n, length=160, edits=12):
    """Copies of one text that is not there itself; most of them are about a radius apart."""
    dice = random.Random(n)
    base = [f"v{dice.randrange(4000)}" for _ in range(length)]
    out = []
    for k in range(n):
        words = list(base)
        for _ in range(dice.randrange(edits)):
            words[dice.randrange(length)] = f"u{dice.randrange(4000)}"
        out.append((first + k, " ".join(words)))
    return out


@pytest.mark.parametrize(
    ("width", "percent", "hot", "block", "most"),
    [(3, 90, 2000, 4096, 1 << 21), (3, 90, 5, 4, 1 << 21), (3, 90, 2000, 4096, 1000), (5, 80, 2000, 4096, 1 << 21), (5, 80, 6, 3, 2000)],
)
def test_like_all_pairs(spark, width, percent, hot, block, most):
    docs = sample() + family(1000, 70)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], SCHEMA).repartition(3)
    expected, _ = brute(docs, width, percent)
    found = jaccard_components(df, width=width, percent=percent, hot=hot, block=block, most=most).collect()
    assert sorted(map(tuple, found)) == expected


@pytest.mark.parametrize("most", [1 << 21, 3000])
def test_all_links_between_classes(spark, most):
    docs = sample() + family(1000, 60)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], SCHEMA)
    links, classes = jaccard_links(df, most=most)
    rep = {r.doc_id: r.rep for r in classes.collect()}
    expected = {(rep[a], rep[b]) for a, b in brute(docs, 3, 90)[1] if rep[a] != rep[b]}
    assert {tuple(sorted(r)) for r in links.collect()} == {tuple(sorted(p)) for p in expected}


def test_empty_table_and_repeated_rows(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(5, "a b c d", 0, ""), (5, "a b c d", 0, ""), (None, "a b c d", 0, ""), (9, "A b c d", 0, "")]
    found = jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, found), key=str) == sorted([(5, 2, 5), (5, 2, 5), (9, 2, 5), (None, 2, None)], key=str)


@pytest.mark.parametrize("kind", ["tight", "loose", "mixed", "maps too large"])
def test_links_of_a_region(kind, monkeypatch):
    """Families around several centres, by pivots and windows, against all pairs."""
    if kind == "maps too large":
        monkeypatch.setattr("tessera.llm.metric_join.MAP_BITS", 1)
    dice = np.random.default_rng(4)
    sets, numbers = [], iter(range(1, 10**9))
    for _ in range({"tight": 1, "loose": 60}.get(kind, 12)):
        base = np.array([next(numbers) for _ in range(100)])
        for _ in range({"tight": 500, "loose": 9}.get(kind, 45)):
            own = base.copy()
            for spot in dice.choice(100, dice.integers(0, 9), replace=False):
                own[spot] = next(numbers)
            sets.append(np.unique(own[: dice.integers(92, 101)]).astype(np.int64))
    members = [set(s.tolist()) for s in sets]
    expected = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(members[i] & members[j]) >= 90 * len(members[i] | members[j])}
    assert set(region_links(sets, 90, every=True)) == expected
    forest = region_links(sets, 90, every=False)
    assert set(forest) <= expected and len(forest) < len(sets)

    def roots(links):
        label = list(range(len(sets)))
        for i, j in links:
            old, new = label[max(i, j)], label[min(i, j)]
            label = [new if x == old else x for x in label]
        return {frozenset(i for i, y in enumerate(label) if y == x) for x in label}

    assert roots(forest) == roots(expected)


def test_very_long_texts(spark):
    """Sets of more than 20,000 shingles: copies are found, and unrelated texts do not become a region."""
    dice = random.Random(6)
    words = lambda n: [f"w{dice.randrange(100_000)}" for _ in range(n)]
    line = "one line that all of them hold"
    long = [words(22_000) for _ in range(6)]
    docs = [(k, " ".join([line, *w])) for k, w in enumerate(long)]
    docs += [(10 + k, " ".join([line, *(f"x{i}" if i % 60 == 0 else w for i, w in enumerate(ws))])) for k, ws in enumerate(long[:2])]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], SCHEMA)
    found = {r.doc_id: (r.component_id, r.n_shingles) for r in jaccard_components(df).collect()}
    assert all(n > 20_000 for _, n in found.values())
    assert {d: c for d, (c, _) in found.items()} == {**{k: k for k in range(6)}, 10: 0, 11: 1}
