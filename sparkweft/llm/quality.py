"""Quality rules: countable base rules, then a hashed n-gram log-likelihood ratio.

Byte n-grams are hashed to buckets. The raw multinomial is counted over every document, the trusted
one over documents that the labels call good. A document's score is the mean over its n-grams of
log P(trusted) - log P(raw), so length doesn't matter, and the same threshold judges all documents.

The labels are a bounded sample (``max_labels`` rows, in the order of a hash of their ids); they give
the trusted counts and the threshold. For the threshold each labelled document is scored by the others
alone. Of the bounds that keep ``keep_good`` of the labelled good documents that pass the base rules, it is
the one that rejects most of the bad ones (the lowest of equals). Where the
labels know only one kind, nothing is rejected beyond the base rules.

Defined cases: other columns may have any names; a null text has no words and fails; texts shorter than an n-gram score 0; repeated rows
and ties get the same verdict; a label without id or quality is ignored, of repeated labels the worst
counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps

SPACES = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
GRAM = 4
BUCKETS = 1 << 16
MAX_LABELS = 20_000
UNIT = float(1 << 32)


def gram_buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, and how many each text has."""
    counts = np.array([max(0, len(t) - GRAM + 1) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    if len(data) < GRAM:
        return np.zeros(0, np.int64), counts
    packed = data[: len(data) - GRAM + 1].copy()
    for k in range(1, GRAM):
        packed |= data[k : len(data) - GRAM + 1 + k] << np.uint32(8 * k)
    ends = np.cumsum([len(t) for t in texts])
    inside = np.ones(len(packed) + GRAM, bool)
    for k in range(1, GRAM):  # the last places of each text start no n-gram of it
        at = ends - k
        lower = np.concatenate(([0], ends[:-1]))
        inside[at[at >= lower]] = False
    packed = packed[inside[: len(packed)]] * np.uint32(2654435761)
    return (packed >> np.uint32(32 - 16)).astype(np.int64), counts


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    solid = len(raw.translate(None, SPACES))
    word_chars = len(text) - (len(raw) - solid)
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup_lines = 0
    for line in raw.split(b"\n"):
        if line.strip(SPACES):
            if line in seen:
                dup_lines += 1
            else:
                seen.add(line)
    repeated = 0
    n = len(words)
    if n >= 4:
        index = {w: i for i, w in enumerate(dict.fromkeys(words))}
        if len(index) < n:
            ids = np.fromiter(map(index.__getitem__, words), np.int64, n)
            pair = ids[:-1] * len(index) + ids[1:]
            if len(index) > 2_000_000:
                pair = np.unique(pair, return_inverse=True)[1]
            three = pair[:-1] * len(index) + ids[2:]
            _, where, times = np.unique(three, return_inverse=True, return_counts=True)
            hit = times[where] > 1
            if hit.any():
                covered = np.zeros(n, bool)
                for k in range(3):
                    covered[k : k + n - 2] |= hit
                repeated = int(covered.sum())
    return n, word_chars, symbols, dup_lines, repeated


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


@dataclass(frozen=True)
class QualityModel:
    """``weights`` are whole numbers of ``1 / UNIT``: their sums are exact, so a score doesn't depend on the batch."""

    weights: np.ndarray
    threshold: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        buckets, counts = gram_buckets(texts)
        total = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.weights[buckets])))
        ends = np.cumsum(counts)
        return np.where(counts > 0, (total[ends] - total[ends - counts]) / (np.maximum(counts, 1) * UNIT), 0.0)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def choose_threshold(scores: np.ndarray, good: np.ndarray, keep_good: float) -> float:
    """The lowest score to keep."""
    if good.all() or not good.any():
        return float("-inf")
    bad_scores, good_scores = np.sort(scores[~good]), np.sort(scores[good])
    spare = int((1 - keep_good) * len(good_scores))
    bounds = np.unique(np.concatenate((good_scores[: spare + 1], bad_scores[bad_scores < good_scores[spare]])))
    rejected = np.searchsorted(bad_scores, bounds, "left") / len(bad_scores) - np.searchsorted(good_scores, bounds, "left") / len(good_scores)
    best = bounds[np.argmax(rejected)]
    below = scores[scores < best]
    return float((best + below.max()) / 2) if len(below) else float(best)


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, keep_good: float = 0.995, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Count both multinomials and choose the threshold. Only the buckets' sums and the sample reach the driver."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels).collect()
    quality = {r["doc_id"]: int(r["quality"] > 0) for r in sample}
    trusted = {d for d, q in quality.items() if q}
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in steps(batches):
            buckets, counts = gram_buckets(_texts(batch))
            raw += np.bincount(buckets, minlength=BUCKETS)
            of = np.array([d in trusted for d in batch.column("doc_id").to_pylist()], bool)
            good += np.bincount(buckets[np.repeat(of, counts)], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(good[at])], ["bucket", "raw", "good"])

    summed = rows.mapInArrow(count, "bucket int, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toArrow()
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = summed.column("bucket").to_numpy()
    raw[at], good[at] = summed.column("raw").to_numpy(), summed.column("good").to_numpy()
    if not good.any():
        return QualityModel(np.zeros(BUCKETS, np.int64), float("-inf"))
    log_raw = np.log((raw + 1) / (raw.sum() + BUCKETS))
    weights = np.rint((np.log((good + 1) / (good.sum() + BUCKETS)) - log_raw) * UNIT).astype(np.int64)

    def held_out_score(text: bytes, is_trusted: bool) -> float:
        """The score of a labelled text by the others alone: what it gave to the trusted counts is taken out."""
        at, n = np.unique(gram_buckets([text])[0], return_counts=True)
        if not len(at):
            return 0.0
        own, total = (n, n.sum()) if is_trusted else (0, 0)
        return float((n * (np.log((good[at] - own + 1) / (good.sum() - total + BUCKETS)) - log_raw[at])).sum() / n.sum())

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            texts = batch.column("text").to_pylist()
            base = [base_counts(t) for t in texts]
            ok = [not base_failed(b[0], b[4]) for b in base]
            part = batch.filter(pa.array(ok))
            scores = [held_out_score(t, d in trusted) for t, d in zip(_texts(part), part.column("doc_id").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    ids = docs.sparkSession.createDataFrame([(d,) for d in quality], f"doc_id {labels.schema['doc_id'].dataType.simpleString()}")
    # At most max_labels ids: a broadcast of proven size.
    judged = rows.join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(judge, f"doc_id {kind}, score double").toArrow()
    scores = judged.column("score").to_numpy()
    is_good = np.array([quality[d] for d in judged.column("doc_id").to_pylist()], bool)
    return QualityModel(weights, choose_threshold(scores, is_good, keep_good))


def judge(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, the base counts, ``base_failed``, ``score`` and ``kept``; ``carry`` adds columns of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            base = [base_counts(t) for t in batch.column("text").to_pylist()]
            failed = np.array([base_failed(b[0], b[4]) for b in base], bool)
            scores = model.scores(_texts(batch))
            columns = [pa.array([b[k] for b in base], pa.int64()) for k in range(5)]
            kept = pa.array(~failed & (scores >= model.threshold))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array(failed), pa.array(scores, pa.float64()), kept, *[batch.column(c) for c in held]], ["doc_id", *names, "base_failed", "score", "kept", *held])

    held = [f"carried_{i}" for i in range(len(carry))]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(h) for c, h in zip(carry, held)])
    more = "".join(f", {h} {docs.schema[c].dataType.simpleString()}" for c, h in zip(carry, held))
    out = rows.mapInArrow(run, f"doc_id {kind}, {', '.join(f'{n} long' for n in names)}, base_failed boolean, score double, kept boolean{more}")
    return out.select(F.col("doc_id").alias(id_col), *names, "base_failed", "score", "kept", *[F.col(h).alias(c) for c, h in zip(carry, held)])
