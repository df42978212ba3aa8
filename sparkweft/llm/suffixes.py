"""Removal of repeated byte strings by longest-previous-factor arrays over partitioned suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id.
All windows of that length are dealt out by their minimiser, the least hash of the ``GRAM``-byte strings
in them: equal windows have equal minimisers, so what has one minimiser can be judged by itself, and
consecutive windows with one minimiser travel as one string.

1. A task tells buckets its documents' distinct minimisers, five bytes each. One that several of its own
   documents have is known to repeat, and is told once; of the others the buckets report those that other
   tasks have too. Nothing else of the text can repeat.
2. Of these alone the strings are gathered, equal ones in a task as one, which is what the task combines
   before the exchange: the least document's goes on, the others' are told apart in the same pass.
3. In a bucket the windows are put in suffix order up to ``LENGTH`` bytes, with the lengths that neighbours
   share. From each window the previous and the next one of a smaller document give its longest previous
   factor; where that reaches ``LENGTH``, the window is removed. Equal strings are one here too, that of
   the least document: to sort them all again took 1369 CPU seconds a GB, where 960 are allowed.
4. A document's runs come from as many buckets as its windows lie in, which grows with the number of buckets.
   So a bucket tells them in one row for each part of the documents, and a part makes one row of each
   document. These meet their document again, which is joined by its id in both directions from one
   exchange of the texts.

A bucket's size follows from the number of buckets and thus the bytes of the input; a string that millions
of documents share reaches its bucket once from each task. What can still fill a bucket is a short phrase
that very many documents have in surroundings of their own: each of these is a different string.

Defined cases: null texts are empty; texts under ``LENGTH`` bytes keep everything; rows with one id are
one document, so none removes from another of them; a null id is neither smaller nor larger than another,
so such rows keep everything; overlapping matches count in full; other columns may have any names.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import steps

LENGTH = 50
GRAM = 24
BUCKET_BYTES = 16 << 20
BUCKETS = 8
#: Columns of what goes to buckets, and of what passes through them: answers, and parcels of runs.
SENT = ["bucket", "part", "blob"]
MASK40 = np.uint64((1 << 40) - 1)
_P = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_P, n, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def minimisers(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimiser: (its hash, the text's number, the first window's place in the text).

    A fourth array with the number of windows is the difference of places, and is returned last.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = np.maximum(0, sizes - LENGTH + 1)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((2, 0), np.int64)
    h1 = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64) + np.uint64(1)
    h2 = h1[:-1] * _power(1) + h1[1:]
    h4 = h2[:-2] * _power(2) + h2[2:]
    h8 = h4[:-4] * _power(4) + h4[4:]
    h16 = h8[:-8] * _power(8) + h8[8:]
    least = _mix(h16[: len(h16) - 8] * _power(8) + h8[16:])
    span = LENGTH - GRAM + 1
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(total) - np.repeat(first, counts)
    value = least[place + np.repeat(starts, counts)]
    new = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])])
    length = np.diff(np.append(new, total))
    return value[new], owner[new], np.stack((place[new], length))


def _pack(*arrays: np.ndarray) -> bytes:
    raw = b"".join(struct.pack("<q", a.nbytes) + a.tobytes() for a in arrays)
    return struct.pack("<q", len(raw)) + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(blob[8:], struct.unpack("<q", blob[:8])[0], asbytes=True)
    out, at = [], 0
    for kind in kinds:
        n = struct.unpack_from("<q", raw, at)[0]
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at + 8))
        at += 8 + n
    return out


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _rows(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names)


def _announce(buckets: int):
    """Documents -> (bucket, null, blob) for the buckets: distinct minimisers, shortened to 40 bits; and (bucket, part, blob): answers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            ids, marks = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            order = np.argsort(marks, kind="stable")
            ids, marks = ids[order], marks[order]
            first = np.flatnonzero(np.r_[True, marks[1:] != marks[:-1]])
            least = np.minimum.reduceat(ids, first)
            several = least < np.maximum.reduceat(ids, first)
            known = np.repeat(several, np.diff(np.append(first, len(ids))))
            parts, answers = _answer_parcels(ids[known], marks[known], buckets)
            # One record for each minimiser; those known to repeat need no answer.
            ids, marks = least, marks[first]
            bucket = (marks % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ids, marks, bucket, several = ids[order], marks[order], bucket[order], several[order]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            blobs = []
            for a, b in zip(cuts, np.append(cuts[1:], len(ids))):
                blobs.append(_pack(ids[a:b], (marks[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32), (marks[a:b] >> np.uint64(32)).astype(np.uint8), several[a:b].astype(np.uint8)))
            return _rows(SENT, pa.array([*bucket[cuts].tolist(), *parts], pa.int64()), pa.array([*[None] * len(cuts), *parts], pa.int64()), pa.array([*blobs, *answers], pa.binary()))

        for batch in steps(batches):
            value, owner, _ = minimisers(_texts(batch))
            if not len(value):
                continue
            marks = np.unique((owner.astype(np.uint64) << np.uint64(40)) | (_mix(value) & MASK40))
            ids = np.array(batch.column("doc_id").to_pylist(), np.int64)
            held.append((ids[(marks >> np.uint64(40)).astype(np.int64)], marks & MASK40))
            n += len(marks)
            if n > 1_500_000:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    return run


def _answers(ids: np.ndarray, marks: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Documents and the minimisers of each, packed to five bytes."""
    if not len(ids):
        return [], []
    order = np.argsort(ids, kind="stable")
    ids, marks = ids[order], marks[order]
    cuts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    five = np.ascontiguousarray(marks.view(np.uint8).reshape(-1, 8)[:, :5])
    return ids[cuts].tolist(), [five[a:b].tobytes() for a, b in zip(cuts, np.append(cuts[1:], len(ids)))]


def _answer_parcels(ids: np.ndarray, marks: np.ndarray, parts: int) -> tuple[list[int], list[bytes]]:
    """Documents' minimisers by part, which has all of a document: parts, and one blob for each."""
    part = (_mix(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    ids, marks, part = ids[order], marks[order], part[order]
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)])
    low, high = (marks & np.uint64(0xFFFFFFFF)).astype(np.uint32), (marks >> np.uint64(32)).astype(np.uint8)
    return part[cuts].tolist(), [_pack(ids[a:b], low[a:b], high[a:b]) for a, b in zip(cuts, np.append(cuts[1:], len(part)))]


def _answered(group: pa.Table) -> pa.Table:
    """A part's parcels of answers -> (doc_id, marks), one row for each document."""
    parcels = [_unpack(blob, np.int64, np.uint32, np.uint8) for blob in group.column("blob").to_pylist()]
    ids, low, high = (np.concatenate([p[k] for p in parcels]) for k in range(3))
    docs, answers = _answers(ids, low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32)))
    return pa.table({"doc_id": pa.array(docs, pa.int64()), "marks": pa.array(answers, pa.binary())})


def _repeated(group: pa.Table, buckets: int) -> pa.Table:
    """A bucket of announcements -> (part, answers): the minimisers of a document that another has too; answers pass through."""
    known, blobs, parts = [], [], []
    for part, blob in zip(group.column("part").to_pylist(), group.column("blob").to_pylist()):
        if part is None:
            parts.append(_unpack(blob, np.int64, np.uint32, np.uint8, np.uint8))
        else:
            known.append(part), blobs.append(blob)
    if parts:
        ids, low, high, several = (np.concatenate([p[k] for p in parts]) for k in range(4))
        marks = low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))
        order = np.argsort(marks, kind="stable")
        ids, marks, several = ids[order], marks[order], several[order]
        first = np.flatnonzero(np.r_[True, marks[1:] != marks[:-1]])
        again = (np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first)) | (np.maximum.reduceat(several, first) > 0)
        keep = np.repeat(again, np.diff(np.append(first, len(ids)))) & (several == 0)
        more, answers = _answer_parcels(ids[keep], marks[keep], buckets)
        known, blobs = known + more, blobs + answers
    return pa.table({"part": pa.array(known, pa.int64()), "blob": pa.array(blobs, pa.binary())})


def _unmark(blobs: list[bytes]) -> np.ndarray:
    five = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 5)
    wide = np.zeros((len(five), 8), np.uint8)
    wide[:, :5] = five
    return wide.view(np.uint64)[:, 0]


class _Strings:
    """Strings with the documents that have them: (minimiser, string) -> text, and refs (id, text hash, place)."""

    def __init__(self):
        self.of: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
        self.size = 0

    def add(self, mark: int, string: bytes, refs: list[tuple[int, int, int]]) -> None:
        known = self.of.get((mark, string))
        if known is None:
            self.of[(mark, string)] = refs
            self.size += len(string) + 200
        else:
            known.extend(refs)
            self.size += 100 * len(refs)

    def split(self) -> tuple[dict[tuple[int, bytes], list], list[tuple[int, int, int, int]]]:
        """What the least document of each string has, and the runs (id, text hash, place, length) of all others."""
        first, gone = {}, []
        for (mark, string), refs in self.of.items():
            least = min(r[0] for r in refs)
            first[(mark, string)] = [r for r in refs if r[0] == least]
            if len(first[(mark, string)]) < len(refs):
                gone += [(*r, len(string)) for r in refs if r[0] != least]
        return first, gone


def _merged(gone) -> list[np.ndarray]:
    """Removed runs (id, text hash, place, length), in order, those that touch as one: the four columns."""
    doc, text_hash, place, length = np.array(gone, np.int64).reshape(-1, 4).T
    order = np.lexsort((place, text_hash, doc))
    doc, text_hash, place, length = doc[order], text_hash[order], place[order], length[order]
    other = np.r_[True, (doc[1:] != doc[:-1]) | (text_hash[1:] != text_hash[:-1])][: len(doc)]
    # The furthest end so far within a text; texts are set apart by an offset that no end reaches.
    base = np.cumsum(other) * (np.int64(1) << 40)
    end = np.maximum.accumulate(base + place + length)
    new = np.flatnonzero(other | np.r_[True, (base + place)[1:] > end[:-1]][: len(doc)])
    last = np.append(new[1:] - 1, len(doc) - 1)[: len(new)]
    return [doc[new], text_hash[new], place[new], end[last] - base[last] - place[new]]


def _runs(gone) -> tuple[list[int], list[bytes]]:
    """Removed runs by document: ids, and blobs of (text hash, place, length), those that touch as one."""
    doc, *rest = _merged(gone)
    rows = np.stack(rest, axis=1)
    cuts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]][: len(doc)])
    return doc[cuts].tolist(), [rows[a:b].tobytes() for a, b in zip(cuts, np.append(cuts[1:], len(rows)))]


def _parcels(gone, parts: int) -> tuple[list[int], list[bytes]]:
    """Removed runs by part, which has all of a document: parts, and one blob for each."""
    columns = _merged(gone)
    part = (_mix(columns[0].view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)])
    return part[cuts].tolist(), [_pack(*(c[a:b] for c in columns)) for a, b in zip(cuts, np.append(cuts[1:], len(part)))]


def _gathered(group: pa.Table) -> pa.Table:
    """A part's parcels -> (doc_id, runs), one row for each document."""
    parcels = [_unpack(blob, *[np.int64] * 4) for blob in group.column("blob").to_pylist()]
    ids, runs = _runs(np.stack([np.concatenate([p[k] for p in parcels]) for k in range(4)], axis=1))
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "runs": pa.array(runs, pa.binary())})


def _send(buckets: int):
    """(doc_id, text, marks) -> (bucket, null, strings) for the buckets, and (bucket, part, runs) that are known to go."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Strings()

        def flush() -> pa.RecordBatch:
            first, gone = held.split()
            by: dict[int, list] = {}
            for (mark, string), refs in first.items():
                by.setdefault(mark % buckets, []).append((mark, string, refs))
            blobs = []
            for rows in by.values():
                blobs.append(_pack(
                    np.array([r[0] for r in rows], np.uint64), np.array([len(r[1]) for r in rows], np.int64), np.frombuffer(b"".join(r[1] for r in rows), np.uint8),
                    np.array([len(r[2]) for r in rows], np.int64), np.array([x for r in rows for ref in r[2] for x in ref], np.int64),
                ))
            parts, parcels = _parcels(gone, buckets)
            return _rows(SENT, pa.array([*by, *parts], pa.int64()), pa.array([*[None] * len(by), *parts], pa.int64()), pa.array([*blobs, *parcels], pa.binary()))

        for batch in steps(batches):
            texts = _texts(batch)
            ids = batch.column("doc_id").to_pylist()
            marked = batch.column("marks").to_pylist()
            value, owner, (place, count) = minimisers(texts)
            short = _mix(value) & MASK40
            lower, upper = np.searchsorted(owner, np.arange(len(texts))), np.searchsorted(owner, np.arange(len(texts)), "right")
            for i, (text, doc, marks) in enumerate(zip(texts, ids, marked)):
                part = slice(lower[i], upper[i])
                wanted = np.flatnonzero(np.isin(short[part], _unmark(marks))) + part.start
                if not len(wanted):
                    continue
                text_hash = xxhash.xxh64_intdigest(text) - (1 << 63)
                for m, p, c in zip(value[wanted].tolist(), place[wanted].tolist(), count[wanted].tolist()):
                    held.add(m, text[p : p + c + LENGTH - 1], [(doc, text_hash, p)])
                if held.size > 24 << 20:
                    yield flush()
                    held = _Strings()
        if held.of:
            yield flush()

    return run


def _bytes_shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of their first bytes two different words of eight bytes share."""
    z = x ^ y
    out = np.zeros(len(z), np.int64)
    for k in range(1, 8):
        out += z < (np.uint64(1) << np.uint64(64 - 8 * k))
    return out


def _smaller(doc: np.ndarray, shared: np.ndarray, least: int) -> np.ndarray:
    """How much each suffix shares with the previous one, in suffix order, of a smaller document; 0 without one.

    ``shared`` has how much each shares with its neighbour before. Links to a suffix that isn't smaller are
    followed by its own link, all at once, so their reach doubles; below ``least`` none is followed further.
    """
    to, low = np.arange(len(doc)) - 1, shared.copy()
    at = np.arange(1, len(doc))
    while True:
        at = at[(to[at] >= 0) & (low[at] >= least)]
        at = at[doc[to[at]] >= doc[at]]
        if not len(at):
            break
        via = to[at]
        low[at], to[at] = np.minimum(low[at], low[via]), to[via]
    return np.where((to >= 0) & (low >= least), low, 0)


def longest_previous_factors(strings: list[bytes], docs: list[int], length: int = LENGTH, least: int = 1) -> list[np.ndarray]:
    """For each string and window of ``length`` bytes the longest match, up to ``length``, with one of a smaller document.

    Matches under ``least`` bytes count as none. The windows are sorted as suffixes; the previous and the next
    one of a smaller document share more with a window than any other of a smaller document.
    """
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    counts = np.maximum(0, sizes - length + 1)
    if not counts.sum():
        return [np.zeros(0, np.int64) for _ in strings]
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    owner = np.repeat(np.arange(len(strings)), counts)
    at = np.arange(int(counts.sum())) - np.repeat(np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.repeat(starts, counts)
    data = np.frombuffer(b"".join(strings), np.uint8)
    eight = np.zeros(len(data) - 7, np.uint64)
    for k in range(8):
        eight |= data[k : len(data) - 7 + k].astype(np.uint64) << np.uint64(8 * (7 - k))
    offsets = [*range(0, length - 7, 8), length - 8]
    order = np.lexsort([eight[at + o] for o in reversed(offsets)])
    doc = np.array(docs, np.int64)[owner][order]
    at = at[order]
    shared = np.full(len(at), length, np.int64)
    shared[0] = 0
    for o in reversed(offsets):
        word = eight[at + o]
        differ = np.flatnonzero(word[1:] != word[:-1]) + 1
        shared[differ] = o + _bytes_shared(word[differ], word[differ - 1])
    after = np.append(shared[1:], 0)
    found = np.zeros(len(at), np.int64)
    found[order] = np.maximum(_smaller(doc, shared, least), _smaller(doc[::-1], after[::-1], least)[::-1])
    return np.split(found, np.cumsum(counts)[:-1])


def _judge(group: pa.Table, parts: int) -> pa.Table:
    """A bucket of strings -> (part, runs), one row for each part; runs known before pass through."""
    held = _Strings()
    known, parcels = [], []
    for part, blob in zip(group.column("part").to_pylist(), group.column("blob").to_pylist()):
        if part is not None:
            known.append(part)
            parcels.append(blob)
            continue
        marks, sizes, data, refs_of, refs = _unpack(blob, np.uint64, np.int64, np.uint8, np.int64, np.int64)
        data, at, k = data.tobytes(), 0, 0
        refs = refs.reshape(-1, 3).tolist()
        for m, n, r in zip(marks.tolist(), sizes.tolist(), refs_of.tolist()):
            held.add(m, data[at : at + n], [tuple(x) for x in refs[k : k + r]])
            at, k = at + n, k + r
    first, gone = held.split()
    by: dict[int, list[tuple[bytes, list]]] = {}
    for (mark, string), refs in first.items():
        by.setdefault(mark, []).append((string, refs))
    several = [rows for rows in by.values() if len(rows) > 1]
    part: list[tuple[bytes, list]] = []
    size = 0
    for k, rows in enumerate(several):
        part += rows
        size += sum(len(s) for s, _ in rows)
        if k + 1 < len(several) and size < 4 << 20:
            continue
        for (string, refs), factors in zip(part, longest_previous_factors([s for s, _ in part], [r[0][0] for _, r in part], least=LENGTH)):
            hit = factors >= LENGTH
            if hit.any():
                edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    gone += [(doc, text_hash, place + a, b - a + LENGTH - 1) for doc, text_hash, place in refs]
        part, size = [], 0
    more, found = _parcels(gone, parts)
    return pa.table({"part": pa.array(known + more, pa.int64()), "blob": pa.array(parcels + found, pa.binary())})


def _cut(with_text: bool):
    """(doc_id, text, runs) -> what is left of each document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            n_bytes, removed, spans, digests, kept_texts = [], [], [], [], []
            for text, runs in zip(_texts(batch), batch.column("runs").to_pylist()):
                kept, gone, n = text, 0, 0
                if runs:
                    text_hash = xxhash.xxh64_intdigest(text) - (1 << 63)
                    rows = np.frombuffer(runs, np.int64).reshape(-1, 3)
                    rows = rows[rows[:, 0] == text_hash]
                    if len(rows):
                        rows = rows[np.argsort(rows[:, 1], kind="stable")]
                        end = np.maximum.accumulate(rows[:, 1] + rows[:, 2])
                        new = np.flatnonzero(np.r_[True, rows[1:, 1] > end[:-1]])
                        lower, upper = rows[new, 1].tolist(), end[np.append(new[1:] - 1, len(rows) - 1)].tolist()
                        n, gone = len(lower), sum(upper) - sum(lower)
                        kept = b"".join(text[a:b] for a, b in zip([0, *upper], [*lower, len(text)]))
                n_bytes.append(len(text)), removed.append(gone), spans.append(n)
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    kept_texts.append(kept)
            columns = [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
            yield _rows(["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text], *columns, *[pa.array(kept_texts, pa.binary())] * with_text)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``docs`` -> (id, n_bytes, n_removed, n_spans, kept_sha256), one row per input row; ``with_text`` adds the bytes kept."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    # A plain column where it will do: an alias in one plan but not in the other hides that they are the same.
    doc_id = F.col("doc_id") if id_col == "doc_id" and docs.schema["doc_id"].dataType == T.LongType() else F.col(id_col).cast("long").alias("doc_id")
    rows = docs.select(doc_id, text.cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(BUCKETS, -(-total // BUCKET_BYTES))
    # Both joins below read this one: their exchanges of the texts are the same, and made once.
    with_id = rows.filter(F.col("doc_id").isNotNull())
    named = with_id.filter(F.octet_length("text") >= LENGTH)

    told = named.mapInArrow(_announce(buckets), "bucket long, part long, blob binary").groupBy("bucket").applyInArrow(lambda group: _repeated(group, buckets), "part long, blob binary")
    marks = told.groupBy("part").applyInArrow(_answered, "doc_id long, marks binary").select("doc_id", F.array("marks").alias("marks"))
    sent = with_id.join(marks, "doc_id").select("doc_id", "text", "marks").mapInArrow(_send(buckets), "bucket long, part long, blob binary")
    judged = sent.groupBy("bucket").applyInArrow(lambda group: _judge(group, buckets), "part long, blob binary")
    gone = judged.groupBy("part").applyInArrow(_gathered, "doc_id long, runs binary")
    last = with_id.join(gone, "doc_id", "left").select("doc_id", "text", "runs")
    last = last.union(rows.filter(F.col("doc_id").isNull()).select("doc_id", "text", F.lit(None).cast("binary")))
    out = last.mapInArrow(_cut(with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
    return out.withColumnRenamed("doc_id", id_col)
