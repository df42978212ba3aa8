"""Token counts of a SentencePiece BPE vocabulary by rank-synchronous merging of ragged arrays.

Every text is escaped as the library does (a dummy prefix, spaces as U+2581) and cut into
pre-tokens where no piece of the vocabulary can reach across. The distinct new pre-tokens of a
batch become ragged arrays of symbol ids. In each round every sequence merges its lowest-rank pair at
the same time, wherever it has it, as far as merging one after the other from the left would do the
same; sequences without a pair leave. The symbols that survive are counted, a symbol outside the
vocabulary as its UTF-8 bytes. A sequence takes about as many rounds as it has ranks, so its length
needs no other method.

Defined cases: a null or empty text has no bytes and no tokens; repeated rows are counted each; an
endless word is a sequence like any other; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps

SPACE = "▁"
#: Symbols that are merged together, about, and the length up to which a pre-token's count is remembered.
MERGED, KEPT = 400_000, 400
#: Counts of pre-tokens that a worker remembers; beyond it, the memory starts anew.
REMEMBERED = 400_000
NONE = np.int64(1) << 40

_models: dict[str, "PieceBpe"] = {}


class PieceBpe:
    """Merge table of a ``.model`` file with byte fallback and the identity normaliser."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        if any(sp.is_unused(i) for i in normal) or sp.encode("a  b cﬁ", out_type=str) == []:
            raise ValueError("vocabularies with unused pieces are not supported")
        probe = " a  b ﬁ Ａ "
        if sp.decode(sp.encode(probe)) not in (probe, probe[1:]):
            raise ValueError("only the identity normaliser is supported")
        pieces = {sp.id_to_piece(i): i for i in normal}
        scores = np.array([sp.get_score(i) for i in range(n)])
        rank_of = {s: r for r, s in enumerate(sorted({scores[i] for i in normal}, reverse=True))}
        self.unknown = n
        self.base = n + 1
        keys, merged, ranks = [], [], []
        inner: set[str] = set()
        for piece, i in pieces.items():
            if len(piece) < 2:
                continue
            inner.update(piece)
            for cut in range(1, len(piece)):
                left, right = pieces.get(piece[:cut]), pieces.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.base + right)
                    merged.append(i)
                    ranks.append(rank_of[scores[i]])
        order = np.argsort(keys, kind="stable")
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.merged = np.append(np.array(merged, np.int64)[order], -1)
        self.ranks = np.append(np.array(ranks, np.int64)[order], NONE)
        # Symbols that make a pair of no higher rank than their own.
        own, lowest = np.full(self.base, -1), np.full(self.base, NONE)
        own[self.merged[:-1]] = self.ranks[:-1]
        for side in (self.keys[:-1] // self.base, self.keys[:-1] % self.base):
            np.minimum.at(lowest, side, self.ranks[:-1])
        self.risky = lowest <= own
        self.ids = np.full(0x110000, self.unknown, np.int32)
        for piece, i in pieces.items():
            if len(piece) == 1:
                self.ids[ord(piece)] = i
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece holds a space after another character")
        if any(p.startswith(SPACE * 2) and p.strip(SPACE) for p in pieces):
            raise ValueError("a piece holds several leading spaces and other characters")
        # Characters fall into sets that no piece joins; a cut between two sets costs nothing. One set is
        # that of the letter "a", a line feed that no longer piece holds is cut off, the rest stays together.
        near: dict[str, set[str]] = {}
        for piece in pieces:
            for left, right in zip(piece.lstrip(SPACE), piece.lstrip(SPACE)[1:]):
                near.setdefault(left, set()).add(right)
                near.setdefault(right, set()).add(left)
        letters, edge = {"a"}, ["a"]
        while edge:
            edge = [c for x in edge for c in near.get(x, ()) if c not in letters and not letters.add(c)]
        word = "".join(re.escape(c) for c in sorted(letters))
        line = "" if "\n" in inner else "\n"
        self.split = re.compile(f"{SPACE}*(?:[{word}]+|[^{word}{SPACE}{line}]+)|{SPACE}+|\n")
        self.known: dict[str, int] = {}

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, at, len(self.keys) - 1)

    def _at_once(self, sym: np.ndarray, owner: np.ndarray, pair: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the places of each sequence's lowest rank, from the left, those that merge in this round.

        Of overlapping ones every second does. A merge whose symbol makes a pair of no higher rank with
        what stands beside it is the last of its sequence: that pair has to come before those further right.
        """
        start = np.maximum.accumulate(np.where(np.r_[True, at[1:] != at[:-1] + 1], np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - start) % 2 == 0]
        made = self.merged[pair[at]]
        risky = np.flatnonzero(self.risky[made])
        if not len(risky):
            return at
        p, m, bound = at[risky], made[risky], self.ranks[pair[at[risky]]]
        joined = np.r_[False, at[1:] == at[:-1] + 2][risky]
        left = np.where(joined, made[np.maximum(risky - 1, 0)], sym[np.maximum(p - 1, 0)])
        has_left = (p > 0) & (owner[np.maximum(p - 1, 0)] == owner[p])
        behind = np.minimum(p + 2, len(sym) - 1)
        has_right = (p + 2 < len(sym)) & (owner[behind] == owner[p])
        stop = np.zeros(len(at), np.int64)
        stop[risky] = (has_left & (self.ranks[self._pair(left, m)] <= bound)) | (has_right & (self.ranks[self._pair(m, sym[behind])] <= bound))
        stopped = np.cumsum(stop) - stop
        new = np.r_[True, owner[at[1:]] != owner[at[:-1]]]
        return at[stopped == stopped[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]]

    def merge_all(self, words: list[str]) -> np.ndarray:
        """Token counts of the pre-tokens, which are not empty."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = self.ids[points].astype(np.int64)
        lost = np.where(sym == self.unknown, 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000) - 1, 0)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        extra = np.add.reduceat(lost, starts)
        owner = np.repeat(np.arange(len(words)), lengths)
        counts = lengths.copy()
        none = len(self.keys) - 1

        def pairs_at(where: np.ndarray) -> np.ndarray:
            """Index in the merge table of the pair that starts at each place; ``none`` at a word's end."""
            out = np.full(len(where), none)
            inside = where + 1 < len(sym)
            inside[inside] = owner[where[inside]] == owner[where[inside] + 1]
            w = where[inside]
            out[inside] = self._pair(sym[w], sym[w + 1])
            return out

        pair = pairs_at(np.arange(len(sym)))
        while len(sym):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            size = np.diff(np.append(first, len(sym)))
            rank = self.ranks[pair]
            least = np.minimum.reduceat(rank, first)
            live = least < NONE
            if not live.any():
                break
            at = self._at_once(sym, owner, pair, np.flatnonzero((rank == np.repeat(least, size)) & (rank < NONE)))
            sym[at] = self.merged[pair[at]]
            counts -= np.bincount(owner[at], minlength=len(counts))
            keep = np.repeat(live, size)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            sym, owner, pair = sym[keep], owner[keep], pair[keep]
            at = moved[at]
            before = at[(at > 0)] - 1
            touched = np.concatenate((at, before))
            pair[touched] = pairs_at(touched)
        return counts + extra

    def count(self, texts: list[str | None]) -> list[int]:
        cut = [self.split.findall(SPACE + t.replace(" ", SPACE)) if t else () for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        new = [w for w in set().union(*cut) if w not in known]
        # A long pre-token is remembered for its batch alone, and so is not kept from memory.
        new.sort(key=len)
        start, held = 0, 0
        for end in range(1, len(new) + 1):
            held += len(new[end - 1])
            if held >= MERGED or end == len(new):
                part = new[start:end]
                known.update(zip(part, self.merge_all(part).tolist()))
                start, held = end, 0
        out = [sum(map(known.__getitem__, words)) for words in cut]
        for w in new:
            if len(w) > KEPT:
                del known[w]
        return out


def model(path: str) -> PieceBpe:
    if path not in _models:
        _models[path] = PieceBpe(path)
    return _models[path]


def count_tokens(docs: DataFrame, path: str | None = None, vocabulary: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` -> (id, n_bytes, n_tokens, over_limit), one row per input row; a map without a shuffle.

    ``path`` is the vocabulary file, readable on every executor. Instead of it, ``vocabulary`` names a
    file of the ``public_tokenizers`` package, which each worker then finds where it is installed there.
    """
    if (path is None) == (vocabulary is None):
        raise ValueError("give either path or vocabulary")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = path
        if where is None:
            import public_tokenizers

            where = public_tokenizers.path(vocabulary)
        bpe = model(where)
        for batch in steps(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(bpe.count(batch.column("text").to_pylist()), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("doc_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
