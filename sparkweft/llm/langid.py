"""Language identification by language-bitmask n-gram filters.

Training counts character n-grams per language and keeps for each language those that are typical of
it. A bit-sliced Bloom filter holds them all: every slot is a bitmask over languages, and the AND of
an n-gram's slots tells at once all languages that contain it. A text's score for a language is how
many of its n-grams the filter reports, less what the fill of that language's bits alone would report.

Training is bounded: ``per_lang`` texts of each language at most in expectation, chosen by a hash of
their ids, and the ``keep`` most typical n-grams of a language; only these reach the driver.

Defined cases: a null text or one without a letter is ``und`` with score 0; a text none of whose
n-grams is known, and a tie, go to the language with more training texts (then the first by name); with
nothing to learn from everything is ``und``. Rows without lang or id train nothing; repeated rows count.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import steps

LENGTHS = (2, 3, 4)
HASHES = 3
PER_LANG = 2_000
KEEP = 30_000
#: Share of its highest rate over languages that an n-gram needs in a language to be typical of it.
TYPICAL = 0.2


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Whether each code point is a letter, and whether it is a letter or a mark on one."""
    kind = np.fromiter((ord(unicodedata.category(chr(c))[0]) for c in range(0x110000)), np.uint8, 0x110000)
    return kind == ord("L"), (kind == ord("L")) | (kind == ord("M"))


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt)) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(29))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams, the number of the text each comes from, and whether each text has a letter."""
    joined = "\0" + "\0".join(t.lower().replace("\0", " ") for t in texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    wall = points == 0
    of = np.cumsum(wall) - 1
    only, letter = (kind[points] for kind in _letters())
    has = np.zeros(len(texts) + 1, bool)
    has[of[only]] = True
    # Everything that is no letter is one space: words alone count.
    points = np.where(letter, points, 32).astype(np.uint64)
    keep = letter | wall | np.r_[True, letter[:-1]]
    points, of, wall = points[keep], of[keep], wall[keep]
    out, owner = [], []
    for n in LENGTHS:
        if len(points) < n:
            continue
        m = len(points) - n + 1
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + points[k : m + k]
        inside = of[:m] == of[n - 1 :]
        out.append(_mix(h[inside], 0))
        owner.append(of[:m][inside])
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has[: len(texts)]
    return np.concatenate(out), np.concatenate(owner), has[: len(texts)]


@dataclass(frozen=True)
class LanguageModel:
    """``langs`` in the order of preference; ``slots`` has one row of 64-bit masks a slot."""

    langs: tuple[str, ...]
    slots: np.ndarray
    false_rate: np.ndarray

    @classmethod
    def build(cls, langs: tuple[str, ...], members: list[np.ndarray]) -> LanguageModel:
        size = 1 << max(12, int(np.ceil(np.log2(max(1, sum(map(len, members))) * 8))))
        slots = np.zeros((size, max(1, -(-len(langs) // 64))), np.uint64)
        for i, hashes in enumerate(members):
            for k in range(HASHES):
                at = np.unique(_mix(hashes, k + 1) & np.uint64(size - 1)).astype(np.int64)
                slots[at, i // 64] |= np.uint64(1 << i % 64)
        fill = np.array([np.mean((slots[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)) for i in range(len(langs))])
        return cls(langs, slots, fill**HASHES)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        hashes, owner, has = grams(texts)
        mask = np.uint64(self.slots.shape[0] - 1)
        masks = self.slots[(_mix(hashes, 1) & mask).astype(np.int64)]
        for k in range(1, HASHES):
            masks &= self.slots[(_mix(hashes, k + 1) & mask).astype(np.int64)]
        total = np.bincount(owner, minlength=len(texts)).astype(float)[: len(texts)]
        hits = np.zeros((len(self.langs), len(texts)))
        for i in range(len(self.langs)):
            bit = (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            hits[i] = np.bincount(owner, weights=bit, minlength=len(texts))[: len(texts)]
        true = np.maximum(0, hits - self.false_rate[:, None] * total) / np.maximum(1e-9, 1 - self.false_rate[:, None])
        best = np.argmax(true, axis=0)
        mass = true.sum(axis=0)
        score = np.where(has & (mass > 0), true.max(axis=0) / np.maximum(mass, 1e-12), 0.0)
        return [self.langs[b] if h else "und" for b, h in zip(best, has)], np.clip(score, 0, 1)


def held_out(doc_id: Column) -> Column:
    """Whether the document is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_lang: int = PER_LANG, keep: int = KEEP, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from the rows of ``docs``; the caller leaves out what must not be learned from."""
    rows = docs.filter(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counted = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = tuple(sorted(counted, key=lambda x: (-counted[x], x)))
    if not langs:
        return LanguageModel((), np.zeros((1, 1), np.uint64), np.zeros(0))
    number = {x: i for i, x in enumerate(langs)}
    share = F.create_map(*[F.lit(v) for x in langs for v in (x, min(1.0, per_lang / counted[x]))])
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("langid")), 11) / F.lit(float(1 << 53))
    sample = rows.filter(draw < F.element_at(share, F.col("lang"))).select("text", "lang")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, most=1 << 20):
            of = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            hashes, owner, _ = grams(batch.column("text").to_pylist())
            for i in np.unique(of).tolist():
                gram, n = np.unique(hashes[of[owner] == i], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), i, np.int32)), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    per_gram = sample.mapInArrow(count, "lang int, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    totals = per_gram.groupBy("lang").agg(F.sum("n").alias("total"))
    of_gram = per_gram.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))  # a row for each language
    top = of_gram.groupBy("gram").agg(F.max("rate").alias("top"))
    typical = of_gram.filter("n >= 3").join(top, "gram").filter(F.col("rate") >= TYPICAL * F.col("top"))
    # The sample bounds what meets here, whatever the corpus.
    best = Window.partitionBy("lang").orderBy(F.col("rate").desc(), "gram")
    kept = typical.select("lang", "gram", F.row_number().over(best).alias("place")).filter(F.col("place") <= keep).select("lang", "gram").toArrow()
    lang, gram = kept.column("lang").to_numpy(), kept.column("gram").to_numpy().view(np.uint64)
    return LanguageModel.build(langs, [gram[lang == i] for i in range(len(langs))])


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` -> (id, the ``carry`` columns, lang_pred, score), one row per input row.

    A map; predictions see the texts alone.
    """
    held = [f"carried_{i}" for i in range(len(carry))]
    kinds = "".join(f", {h} {docs.schema[c].dataType.simpleString()}" for c, h in zip(carry, held))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, most=1 << 20):
            lang, score = model.predict([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[batch.column(h) for h in held], pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", *held, "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(h) for c, h in zip(carry, held)])
    out = rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}{kinds}, lang_pred string, score double")
    return out.select(F.col("doc_id").alias(id_col), *[F.col(h).alias(c) for c, h in zip(carry, held)], "lang_pred", "score")
