"""SentencePiece encoding and decoding with seeded merge dropout.

Encoding is the agenda algorithm of a SentencePiece BPE model: among all neighbouring symbols whose concatenation is a
piece, the piece with the best score merges first, the leftmost on ties. With ``dropout`` each candidate merge, given by
document, place and the lengths of its two symbols, is skipped when its keyed hash falls below that share. One seed and
document give the same segmentation on every run and machine; other seeds give others, and each decodes to the text.

The text gets a leading space, as the model asks; spaces become the model's space mark. A mark that stands in the text
itself, like every character without a piece, is written as byte pieces, so decoding gives back every text unchanged.

Pieces never go from a non-mark to a mark, so a text falls into units (marks and the word behind them) that do not
affect each other. ``Encoder.encode`` runs the agendas of all units of a block of texts side by side in arrays, one merge
per unit and round; units of more than ``LONG`` characters get a heap of their own.

Defined results: a null or empty text has no pieces and decodes to the empty text. Repeated rows get the same pieces,
as hashes are keyed by doc_id. Texts are never cut: very long ones are a block of their own. Extra columns are not read.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
LONG = 96
BLOCK = 1 << 16
NONE = np.int64(1 << 62)
LOW = np.int64((1 << 32) - 1)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


STEP, LEFT, RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class PairTable:
    """(left piece, right piece) to the rank of the merged piece, by open addressing."""

    BITS = 20

    def __init__(self, pairs: dict[int, int]):
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.ranks = np.full(1 << self.BITS, -1, np.int32)
        for key, rank in pairs.items():
            at = ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.BITS)
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.BITS) - 1)
            self.keys[at], self.ranks[at] = key, rank

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the merged pieces, -1 where there is none; pieces below 0 merge with nothing."""
        key = (left.astype(np.int64) << 20) | right
        at = ((key.astype(np.uint64) * STEP) >> np.uint64(64 - self.BITS)).astype(np.int64)
        found = self.keys[at]
        out = np.where(found == key, self.ranks[at], np.int32(-1))
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.BITS) - 1)
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        out[(left < 0) | (right < 0)] = -1
        return out


class Encoder:
    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        self.piece_of = {model.id_to_piece(i): i for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.piece_of):
            raise ValueError("a piece holds a space mark behind another character; such models need whole-text agendas")
        self.by_rank = np.array(sorted(plain, key=lambda i: (-model.get_score(i), i)), np.int32)
        rank_of = {int(piece): rank for rank, piece in enumerate(self.by_rank)}
        pairs = {}
        for piece, i in self.piece_of.items():
            for cut in range(1, len(piece)):
                a, b = self.piece_of.get(piece[:cut]), self.piece_of.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[(a << 20) | b] = rank_of[i]
        self.pairs, self.table = pairs, PairTable(pairs)
        self.char_piece = np.full(0x110000, -1, np.int32)
        for piece, i in self.piece_of.items():
            if len(piece) == 1:
                self.char_piece[ord(piece)] = i
        self.byte_piece = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.bytes_of = [b""] * n
        for piece, i in self.piece_of.items():
            self.bytes_of[i] = piece.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte_piece):
            self.bytes_of[i] = bytes([b])

    def encode(self, texts: list[str], salts: list[int], dropout: float = 0.0) -> list[np.ndarray]:
        """Pieces of each text; ``salts`` are the keys of the texts' hashes."""
        out, at = [], 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= BLOCK):
                chars += len(texts[end]) + 1
                end += 1
            out += self._block(texts[at:end], salts[at:end], dropout)
            at = end
        return out

    def _block(self, texts: list[str], salts: list[int], dropout: float) -> list[np.ndarray]:
        lengths = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        code = np.frombuffer("".join(f" {t}" for t in texts if t).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(code)
        starts = np.cumsum(lengths) - lengths
        if n == 0:
            return [np.empty(0, np.int32) for _ in texts]
        space = code == 0x20
        tok = self.char_piece[np.where(space, ord(MARK), code)]
        tok[code == ord(MARK)] = -1
        doc = np.repeat(np.arange(len(texts)), lengths)
        salt = np.array(salts, np.uint64)[doc] + (np.arange(n) - starts[doc]).astype(np.uint64) * STEP
        first = np.zeros(n, bool)
        first[1:] = space[1:] & ~space[:-1]
        first[starts[lengths > 0]] = True
        limit = np.uint64(min(int(dropout * 2**64), 2**64 - 1))
        self._merge(tok, first, salt, limit)
        return self._collect(tok, code, doc, len(texts))

    def _collect(self, tok: np.ndarray, code: np.ndarray, doc: np.ndarray, n_docs: int) -> list[np.ndarray]:
        """Drops merged-away places (-2) and spells characters without a piece (-1) as byte pieces."""
        live = np.flatnonzero(tok != -2)
        pieces, owner = tok[live], doc[live]
        if (pieces == -1).any():
            odd = np.flatnonzero(pieces == -1)
            spelled = [chr(c).encode("utf-8", "surrogatepass") for c in code[live[odd]]]
            times = np.ones(len(pieces), np.int64)
            times[odd] = [len(s) for s in spelled]
            to = np.cumsum(times) - times
            pieces, owner = np.repeat(pieces, times), np.repeat(owner, times)
            flat = np.frombuffer(b"".join(spelled), np.uint8)
            places = np.repeat(to[odd], times[odd]) + np.concatenate([np.arange(len(s)) for s in spelled])
            pieces[places] = self.byte_piece[flat]
        return np.split(pieces, np.searchsorted(owner, np.arange(1, n_docs)))

    def _ranks(self, tok, place, after, behind, left_of, salt, limit):
        """Agenda keys (rank above, place below) of pairs: pieces at left_of and after[left_of]; NONE where nothing merges."""
        right = after[left_of]
        ok = right >= 0
        rank = self.table.ranks_of(tok[left_of], np.where(ok, tok[right], -1))
        key = (rank.astype(np.int64) << 32) | left_of
        key[rank < 0] = NONE
        if limit:
            end = behind[right]
            spans = (place[right] - place[left_of]).astype(np.uint64) * LEFT + (end - place[right]).astype(np.uint64) * RIGHT
            key[_mix(salt[place[left_of]] ^ spans) < limit] = NONE
        return key

    def _merge(self, tok_out: np.ndarray, first: np.ndarray, salt: np.ndarray, limit: np.uint64) -> None:
        """Runs every unit's agenda; writes pieces to the place of their first character, -2 to the others."""
        n = len(tok_out)
        unit_at = np.flatnonzero(first)
        sizes = np.diff(np.append(unit_at, n))
        for u in np.flatnonzero(sizes > LONG):
            self._agenda(tok_out, int(unit_at[u]), int(unit_at[u] + sizes[u]), salt, limit)
        take = np.repeat((sizes <= LONG) & (sizes > 1), sizes)
        place = np.flatnonzero(take)
        tok = tok_out[place]
        head = first[place]
        behind = place + 1  # where each symbol ends
        while len(place):
            m = len(place)
            heads = np.flatnonzero(head)
            after = np.arange(1, m + 1)
            after[heads[1:] - 1] = -1
            after[-1] = -1
            before = np.arange(-1, m - 1)
            before[heads] = -1
            key = self._ranks(tok, place, after, behind, np.arange(m), salt, limit)
            running = len(heads)
            while True:
                best = np.minimum.reduceat(key, heads)
                best = best[best < NONE]
                if len(best) <= running // 2:
                    break
                at = (best & LOW).astype(np.int64)
                gone = after[at]
                tok[at] = self.by_rank[best >> np.int64(32)]
                tok[gone] = -2
                key[gone] = NONE
                behind[at] = behind[gone]
                then = after[gone]
                after[at] = then
                before[then[then >= 0]] = at[then >= 0]
                prior = before[at]
                prior = prior[prior >= 0]
                redo = np.concatenate([at, prior])
                key[redo] = self._ranks(tok, place, after, behind, redo, salt, limit)
            # finished units leave, the others close up
            tok_out[place] = tok
            if not len(best):
                return
            busy = np.repeat(np.minimum.reduceat(key, heads) < NONE, np.diff(np.append(heads, m)))
            busy &= tok != -2
            place, tok, head, behind = place[busy], tok[busy], head[busy], behind[busy]

    def _agenda(self, tok: np.ndarray, start: int, end: int, salt: np.ndarray, limit: np.uint64) -> None:
        """The same, with a heap, for one long unit."""
        after = list(range(start + 1, end)) + [-1]
        before = [-1, *range(start, end - 1)]
        stop = list(range(start + 1, end + 1))
        ids = tok[start:end].tolist()
        heap: list[tuple[int, int, int, int]] = []

        def offer(left: int) -> None:
            right = after[left - start]
            if right < 0 or ids[left - start] < 0 or ids[right - start] < 0:
                return
            rank = self.pairs.get((ids[left - start] << 20) | ids[right - start])
            if rank is None:
                return
            if limit:
                spans = np.uint64(right - left) * LEFT + np.uint64(stop[right - start] - right) * RIGHT
                if _mix(np.array([salt[left] ^ spans]))[0] < limit:
                    return
            heapq.heappush(heap, (rank, left, right, stop[right - start]))

        with np.errstate(over="ignore"):
            for left in range(start, end):
                offer(left)
            while heap:
                rank, left, right, till = heapq.heappop(heap)
                if ids[left - start] == -2 or ids[right - start] == -2 or after[left - start] != right or stop[right - start] != till:
                    continue
                ids[left - start], ids[right - start] = int(self.by_rank[rank]), -2
                stop[left - start] = till
                then = after[left - start] = after[right - start]
                if then >= 0:
                    before[then - start] = left
                if before[left - start] >= 0:
                    offer(before[left - start])
                offer(left)
        tok[start:end] = ids

    def decode(self, pieces: np.ndarray | list[int]) -> bytes:
        """UTF-8 bytes of the text, without the leading space that encoding added."""
        return b"".join(map(self.bytes_of.__getitem__, np.asarray(pieces).tolist()))[1:]


@functools.lru_cache(maxsize=2)
def encoder(model_file: str) -> Encoder:
    return Encoder(model_file)


def encode_documents(docs: DataFrame, seed: int = 17, dropout: float = 0.1, model_file: str | None = None) -> DataFrame:
    """``doc_id, text, pieces`` for every row of ``docs(doc_id, text)``: the text (null: empty) and its piece ids."""
    path = model_file or default_model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(path)
        for batch in batches:
            salts = [xxhash.xxh64_intdigest(str(d), seed) for d in batch["doc_id"]]
            texts = [t or "" for t in batch["text"]]
            for at in range(0, len(texts), 512):  # so that a batch's pieces never stand whole beside its texts
                part = batch.iloc[at : at + 512].copy()
                part["pieces"] = coder.encode(texts[at : at + 512], salts[at : at + 512], dropout)
                yield part

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, f"doc_id {id_type}, text string, pieces array<int>")


def decode_documents(rows: DataFrame, model_file: str | None = None) -> DataFrame:
    """Adds ``decoded``, the text that ``pieces`` stand for."""
    path = model_file or default_model()

    @F.pandas_udf("binary")
    def decode(pieces: pd.Series) -> pd.Series:
        return pieces.map(encoder(path).decode)

    return rows.withColumn("decoded", decode("pieces").cast("string"))
