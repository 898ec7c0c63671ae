"""Token counts: how many pieces a unigram tokenizer makes of each text, without making them.

The text gets a leading space, and spaces become the space mark, as in unigram tokenizers. Over the whole string an
Aho-Corasick automaton names, at every character, all vocabulary pieces that end there, longest first. Dynamic
programming carries, per end, the best score and the number of pieces on its path; no path is kept. The tokenizer's own
tie rules hold: of equally good paths to an end the one with the longer last piece wins; a character that is no piece
costs the least score minus ``UNKNOWN_PENALTY`` and competes last; neighbouring unknown characters on the best path are
one piece.

The string is cut only where no piece can cross: before a run of marks, if the mark is a piece and no piece holds a mark
behind another character. A unit is then a run of marks with the word behind it, runs of spaces and all, and the best
path is the sum of the units' best paths. With another vocabulary the whole string is one unit. Units repeat, so each
task keeps a bounded table of units that it has counted; it is emptied when full.

Defined results: a null or empty text has no units, pieces or score. A mark in the text itself counts as a space. Texts
are read whole; a text without spaces is one unit. Repeated rows are counted one by one. An empty table gives an empty
table. Extra columns are not read. There is no shuffle and no state between rows but the table of units.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

MARK = "▁"
UNIT = re.compile(f"{MARK}+[^{MARK}]*")
UNKNOWN_PENALTY = 10.0
#: Units that a task remembers, and the longest that it does.
TABLE, REMEMBERED = 300_000, 64


def vocabulary(model_file: str) -> list[tuple[str, float]]:
    """Pieces of a SentencePiece model in file order, scored by Zipf's law: minus the log of the place.

    The public files hold merge ranks but no unigram model, so the ranks stand in for log probabilities.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
    plain.sort(key=lambda i: (-model.get_score(i), i))
    return [(model.id_to_piece(i), -math.log(k + 2)) for k, i in enumerate(plain)]


class TextCounter:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        names = {p for p, _ in pieces}
        self.cuts = MARK in names and not any(MARK in p.lstrip(MARK) for p in names)
        self.known: dict[str, tuple[int, int, float]] = {}

    def count(self, unit: str) -> tuple[int, int, float]:
        """Pieces, unknown characters and score of the best path through a string."""
        n = len(unit)
        score, pieces, odd, open_ = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        matches = self.automaton.iter(unit)
        at, (size, own) = next(matches, (n, (0, 0.0)))
        for end in range(n):
            best, via, single = None, 0, False
            while at == end:  # the automaton gives the longest match first
                value = score[end + 1 - size] + own
                if best is None or value > best:
                    best, via = value, size
                single = single or size == 1
                at, (size, own) = next(matches, (n, (0, 0.0)))
            value = score[end] + self.unknown
            if not single and (best is None or value > best):
                score[end + 1] = value
                pieces[end + 1] = pieces[end] + (not open_[end])
                odd[end + 1] = odd[end] + 1
                open_[end + 1] = True
            else:
                score[end + 1] = best
                pieces[end + 1] = pieces[end + 1 - via] + 1
                odd[end + 1] = odd[end + 1 - via]
        return pieces[n], odd[n], score[n]

    def count_text(self, text: str | None) -> tuple[int, int, int, float]:
        """Units, pieces, unknown characters and score of a text."""
        if not text:
            return 0, 0, 0, 0.0
        whole = MARK + text.replace(" ", MARK)
        units = UNIT.findall(whole) if self.cuts else [whole]
        known, get = self.known, self.known.get
        pieces = odd = 0
        score = 0.0
        for unit in units:
            found = get(unit)
            if found is None:
                found = self.count(unit)
                if len(unit) <= REMEMBERED:
                    if len(known) >= TABLE:
                        known.clear()
                    known[unit] = found
            pieces += found[0]
            odd += found[1]
            score += found[2]
        return len(units), pieces, odd, score


@functools.lru_cache(maxsize=1)
def counter(model_file: str) -> TextCounter:
    return TextCounter(vocabulary(model_file))


def token_counts(docs: DataFrame, model_file: str | None = None, pieces: list[tuple[str, float]] | None = None) -> DataFrame:
    """``doc_id, n_units, n_pieces, n_unknown, score`` for every row of ``docs(doc_id, text)``.

    The vocabulary is that of ``model_file``, or scored ``pieces``.
    """
    from .piece_bpe import default_model

    path = None if pieces else model_file or default_model()
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = (TextCounter(pieces) if pieces else counter(path)).count_text
        for batch in batches:
            found = pd.DataFrame([count(t) for t in batch["text"]], columns=["n_units", "n_pieces", "n_unknown", "score"])
            yield pd.concat([batch[["doc_id"]], found.astype({"n_units": "int64", "n_pieces": "int64", "n_unknown": "int64", "score": "float64"})], axis=1)

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {id_type}, n_units bigint, n_pieces bigint, n_unknown bigint, score double")
