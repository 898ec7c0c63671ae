"""Token counts against every segmentation of whole texts."""

import random

import pytest

from tessera.llm.token_counts import MARK, TextCounter, token_counts

PIECES = [(p, -0.37 * k - 1.01) for k, p in enumerate([MARK, MARK + "ab", "a", "b", "ab", MARK * 2, "ba", "aba", MARK * 3 + "b", "bab", "数据", "数", "abab", MARK * 4, "\t"])]
#: With pieces that hold a mark behind another character, or without the mark, texts cannot be cut.
CROSSING = [*PIECES, ("b" + MARK + "a", -0.9)]
NO_MARK = [p for p in PIECES if p[0] != MARK]
SCHEMA = "doc_id string, text string, n_units int, piece int"


def segmentations(text, scores, unknown):
    """(score, pieces, unknown characters) of every path; a character may be unknown only if it is no piece itself."""
    if not text:
        yield 0.0, (), 0
        return
    for size in range(1, len(text) + 1):
        piece = text[:size]
        odd = size == 1 and piece not in scores
        if piece in scores or odd:
            for score, rest, n in segmentations(text[size:], scores, unknown):
                yield score + (unknown if odd else scores[piece]), (None if odd else piece, *rest), n + odd


def best(text, pieces):
    """Score, and all (pieces, unknown characters) that best paths over the whole text have."""
    scores = dict(pieces)
    found = list(segmentations(MARK + text.replace(" ", MARK), scores, min(scores.values()) - 10))
    most = max(f[0] for f in found)
    # neighbouring unknown characters are one piece
    return most, {(sum(p is not None or k == 0 or path[k - 1] is not None for k, p in enumerate(path)), n) for s, path, n in found if abs(s - most) < 1e-9}


TEXTS = [" x", "x ", "   ", " ", "a    b", "    ab", "ab  ba   b", "\tab", "a\tb \t", f"a{MARK}b", f"{MARK}{MARK}", "数据 z", "zz  zz", "z z z", "aba bab"]


@pytest.mark.parametrize("pieces", [PIECES, CROSSING, NO_MARK])
def test_counts_are_those_of_the_best_segmentation(pieces):
    counter, dice = TextCounter(pieces), random.Random(5)
    texts = TEXTS + ["".join(dice.choice("aabbz  数据") for _ in range(dice.randrange(1, 10))) for _ in range(300)]
    for text in texts:
        _, n, odd, score = counter.count_text(text)
        most, sizes = best(text, pieces)
        assert abs(score - most) < 1e-9, text
        assert (n, odd) in sizes, text


def test_table_of_texts(spark):
    long = "ab ba  zz" * 4000
    rows = [(str(k), t, 1, 2) for k, t in enumerate([*TEXTS, None, "", long, TEXTS[0]])] + [("0", TEXTS[0], 1, 2), (None, "ab", 1, 2)]
    found = token_counts(spark.createDataFrame(rows, SCHEMA), pieces=PIECES).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        assert by.setdefault(r.doc_id, r) == r  # repeated rows are counted alike
    for k, text in enumerate(TEXTS):
        most, sizes = best(text, PIECES)
        r = by[str(k)]
        assert abs(r.score - most) < 1e-9 and (r.n_pieces, r.n_unknown) in sizes
    assert tuple(by[str(len(TEXTS))])[1:] == tuple(by[str(len(TEXTS) + 1)])[1:] == (0, 0, 0, 0.0)
    # a text is the sum of its words where no piece crosses, and its first word has the leading space
    one, whole = best("ab ba  zz", PIECES), by[str(len(TEXTS) + 2)]
    assert whole.n_pieces > 4000 * min(n for n, _ in one[1]) // 2 and whole.n_unknown == 8000
    assert token_counts(spark.createDataFrame([], SCHEMA), pieces=PIECES).count() == 0


def test_vocabulary_of_the_public_model(spark):
    pytest.importorskip("public_tokenizers")
    texts = ["        return x", "a    b", " x", "x"]
    found = {r.doc_id: r for r in token_counts(spark.createDataFrame([(str(k), t, 1, 2) for k, t in enumerate(texts)], SCHEMA)).collect()}
    assert found["0"].n_pieces == 3 and found["1"].n_pieces == 3 and found["2"].n_pieces == 2 and found["3"].n_pieces == 1
