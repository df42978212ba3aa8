"""SimHash near-duplicates by multi-index hashing.

A fingerprint's two halves are looked up in a table of halves: two fingerprints that differ in three
bits at most have a half that differs in one bit at most, so the exact half and the halves with one of
its set bits cleared find every such pair from one side or the other. Whatever shares an entry of the
table is verified on all 64 bits.

Documents with equal fingerprints are one node from the start, so copies cost nothing. Within an entry
only a spanning forest of the links is kept, by a search that compares each fingerprint with those not
reached yet. An entry of more than ``CROWD`` fingerprints is dealt out again, to tasks of their own: of
the eight hex digits of the other half three at most differ, so each set of five is a key. What shares
one has 12 free bits left, which bounds such a group whatever the data, and no link is lost. Components
of the forest are found by star contraction.

Defined cases: a null text, or one without words, has the fingerprint zero and is linked like any
other; one or two words are one shingle; other columns may have any names; repeated rows share a component; a null id never names one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.operators.stars import star_components
from sparkweft.storage import materialise

from .common import steps

RADIUS = 3
#: Fingerprints that one task compares within an entry of the table.
CROWD = 20_000
LEVELS = 2
#: Masks of every five of the eight hex digits of a half.
FIVE_OF_EIGHT = [sum(0xF << 4 * j for j in five) for five in combinations(range(8), 5)]
#: Entries up to this size are compared all with all, at once for many entries.
SMALL = 8


def fingerprints(texts: list[bytes], width: int) -> np.ndarray:
    """The 64-bit SimHash of each text, as int64."""
    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    held: list[int] = []
    where: list[int] = []
    starts: list[int] = []

    def flush() -> None:
        if where:
            hashes = np.array(held, np.uint64)
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
            sizes = np.diff(np.append(starts, len(held)))
            out[where] = np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
            held.clear(), where.clear(), starts.clear()

    for i, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        n = len(words) - width + 1
        if n > 100_000:  # counted in parts
            ones = np.zeros(64, np.int64)
            for k in range(0, n, 100_000):
                part = np.array([digest(b" ".join(words[j : j + width]), 42) for j in range(k, min(n, k + 100_000))], np.uint64)
                ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]
            continue
        where.append(i)
        starts.append(len(held))
        if n <= 1:
            held.append(digest(b" ".join(words), 42))
        else:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            held.extend([digest(joined[a:b], 42) for a, b in zip([0, *ends[: n - 1].tolist()], (ends[width - 1 :] - 1).tolist())])
        if len(held) > 100_000:
            flush()
    flush()
    return out.view(np.int64)


def set_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """The 64-bit SimHash of each set of hashes, as int64; zero without any."""
    out = np.zeros(len(sets), np.uint64)
    for i, s in enumerate(sets):
        ones = np.zeros(64, np.int64)
        for k in range(0, len(s), 100_000):  # counted in parts
            ones += np.unpackbits(s[k : k + 100_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > len(s), bitorder="little").view(np.uint64)[0]
    return out.view(np.int64)


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which fingerprints differ in ``RADIUS`` bits at most; unsigned, as bits of a signed number are counted in its absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64)) <= RADIUS


def _forest(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    rest = fps
    while len(rest) > 1:
        edge, rest = [rest[0]], rest[1:]
        while edge and len(rest):
            f = edge.pop()
            near = _near(rest, f)
            if near.any():
                found, rest = rest[near], rest[~near]
                yield np.full(len(found), f), found
                edge.extend(found)


def _links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys; the rows are in the order of (key, fp) without repeats."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.append(first, len(keys)))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    many = np.repeat(size > SMALL, size)
    for d in range(1, SMALL):
        same = (keys[d:] == keys[:-d]) & ~many[d:]
        if not same.any():
            break
        a, b = fps[:-d][same], fps[d:][same]
        near = _near(a, b)
        out.append((a[near], b[near]))
    for start, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist()):
        out.extend(_forest(fps[start : start + n]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _entries(level: int):
    """A task over (key, fp) rows in the order of both: rows (crowded, a, b).

    Links come as (false, fp, fp). The rows of a crowded entry leave as (true, key of the next level, fp).
    On the last level nothing is crowded.
    """

    def spread(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # The entry's key has the number of its half in the lowest bit; the other half is what may differ yet.
        u = fps.view(np.uint64)
        other = np.where(keys & 1 == 0, u >> np.uint64(32), u & np.uint64(0xFFFFFFFF))
        parts = [((keys.view(np.uint64) * np.uint64(56) + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)) ^ ((other & np.uint64(m)) * np.uint64(0xC2B2AE3D27D4EB4F)) for k, m in enumerate(FIVE_OF_EIGHT)]
        return np.concatenate(parts).view(np.int64), np.tile(fps, len(parts))

    def batch_of(a: np.ndarray, b: np.ndarray, crowded: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), crowded)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["crowded", "a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
        overfull = None
        for batch in _then_none(batches):
            if batch is not None:
                keys = np.concatenate((keys, batch.column("key").to_numpy()))
                fps = np.concatenate((fps, batch.column("fp").to_numpy()))
            if not len(keys):
                continue
            whole = len(keys) if batch is None else int(np.searchsorted(keys, keys[-1], "left"))
            if overfull is not None:  # more of an entry that is dealt out already
                n = int(np.searchsorted(keys, overfull, "right"))
                if n:
                    yield batch_of(*spread(keys[:n], fps[:n]), True)
                    keys, fps, whole = keys[n:], fps[n:], max(0, whole - n)
                if len(keys):
                    overfull = None
            if whole:
                part_k, part_f = keys[:whole], fps[:whole]
                new = np.r_[True, (part_k[1:] != part_k[:-1]) | (part_f[1:] != part_f[:-1])]
                part_k, part_f = part_k[new], part_f[new]
                yield batch_of(*_links(part_k, part_f), False)
                keys, fps = keys[whole:], fps[whole:]
            if level < LEVELS and len(keys) > CROWD and batch is not None:
                overfull = keys[-1]
                yield batch_of(*spread(keys, fps), True)
                keys, fps = keys[:0], fps[:0]

    return run




def _then_none(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def links(nodes: DataFrame) -> DataFrame:
    """Distinct ``fp`` -> (u, v): links that join up all fingerprints within ``RADIUS`` bits."""
    half = "shiftleft({0}, 1) | {1}"
    parts = []
    for side, h in ((0, "(fp & 4294967295L)"), (1, "shiftrightunsigned(fp, 32)")):
        cleared = half.format(f"({h} & ~shiftleft(1L, i))", f"{side}L")
        parts += [f"array({half.format(h, f'{side}L')})", f"transform(filter(sequence(0, 31), i -> (shiftright({h}, i) & 1L) = 1L), i -> {cleared})"]
    probes = f"concat({', '.join(parts)})"
    rows = nodes.select("fp", F.explode(F.expr(probes)).alias("key"))
    found: DataFrame | None = None
    for level in range(1, LEVELS + 1):
        dealt = rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_entries(level), "crowded boolean, a long, b long")
        dealt = materialise(dealt, "links")
        mine = dealt.filter(~F.col("crowded")).select(F.col("a").alias("u"), F.col("b").alias("v"))
        found = mine if found is None else found.union(mine)
        rows = dealt.filter("crowded").select(F.col("a").alias("key"), F.col("b").alias("fp"))
        if rows.isEmpty():
            break
    return found.distinct()


def fingerprint_table(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` -> (doc_id, fp), one row per input row; a map."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints(texts, width))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def near_duplicates(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` -> (id, fingerprint, component_id), one row per input row."""
    prints = materialise(fingerprint_table(docs, width, id_col, text_col), "prints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes")
    member = materialise(star_components(links(nodes.select("fp"))), "members").withColumnRenamed("node", "fp")
    least = member.join(nodes, "fp").groupBy("root").agg(F.min("first").alias("least"))
    named = member.join(least, "root").select("fp", "least")
    component = nodes.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"), "n")
    return to_rows(prints, component, "fp").select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def to_rows(rows: DataFrame, keyed: DataFrame, key: str, most: int = 10_000) -> DataFrame:
    """``rows`` with the columns of ``keyed``, which has a row for each of their keys and in ``n`` how many rows have it.

    The keys of more than one row in ``most`` are fewer than ``most``, so they are broadcast; the rows of
    all others are dealt out by the key, and no task gets many of one.
    """
    keyed = materialise(keyed, "keyed")
    total = keyed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(keyed.filter(F.col("n") * most > total).drop("n"))
    rest = rows.join(hot.select(key), key, "left_anti").join(keyed.filter(F.col("n") * most <= total).drop("n"), key)
    return rows.join(hot, key).unionByName(rest)
