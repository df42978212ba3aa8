"""Near-duplicates by SimHash and shingle similarity: every pair of Jaccard similarity 0.8 or more is found.

Texts with the same set of shingles are one node. Nodes whose fingerprints differ in three bits at most are
found first, by the multi-index hashing of ``simhash``, and linked where their sets are similar. Three bits
miss many similar pairs, and no radius of 64 bits that finds them all leaves few candidates, so a second
search makes the result whole: two sets of that similarity share a shingle among the first fifth (and one
more) of each, in any order that holds for all sets. These prefixes are the keys that are joined, so no
pair is lost. The order puts shingles last that are common in a sample of texts, which keeps groups small
whatever the sample is.

What the fingerprints have linked, and links from one node of each low key to the others, join up large
clusters first, so that the second search compares only what is not connected yet. A group of up to ``CROWD`` nodes emits its pairs. Pairs whose parity sketches
differ in more bits than similar sets could have shingles in one alone are none; each bit that differs
needs a shingle of its own. A larger group is compared by sketches within its task. It emits the likely
pairs, or where these are more than ``CROWD`` / 2 for each node, the nodes that have any: their whole sets
are compared within a task by counting over postings, and only links come out. What is left is verified
on the whole sets, which are made again from the texts of the nodes concerned.

Defined cases: a null text, or one without words, has no shingles and equals any other such; a text of
fewer words than a shingle is one shingle; repeated rows share a component; a null id never names one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.operators.stars import star_components
from sparkweft.storage import drop_scratch, materialise

from .common import steps
from .simhash import links as fingerprint_links
from .simhash import set_fingerprints, to_rows

WIDTH = 5
#: Nodes of a key up to which their pairs are emitted.
CROWD = 32
#: Texts of the sample that tells common shingles, about, and how many of it have one; both only affect speed.
SAMPLE, COMMON, MOST_COMMON = 10_000, 5, 200_000
#: Least shingles of a set that are keys of the first links.
LOW = 4
#: Bits of the map that sifts texts before they are dealt out: half a million rows of 64 bits at most.
MAP_BITS = 1 << 25


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - width + 1)
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    hashes = [xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip([0, *ends[: n - 1].tolist()], (last - 1).tolist())]
    return np.unique(np.array(hashes, np.uint64).view(np.int64))


def _node(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), 7) - (1 << 63)


def _sketch(s: np.ndarray) -> bytes:
    """How many shingles fall on each of about as many bits as there are, modulo 2."""
    m = 1 << max(6, (len(s) - 1).bit_length())
    return np.packbits(np.bincount(s & (m - 1), minlength=m) & 1, bitorder="little").tobytes()


def _differ(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the longer one folded to the length of the other."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    for n in (len(a), len(b)):
        least = min(len(a), len(b))
        while n > least:
            n //= 2
            low = (1 << 8 * n) - 1
            x, y = (((x >> 8 * n) ^ x) & low, y) if len(a) > len(b) else (x, ((y >> 8 * n) ^ y) & low)
    return (x ^ y).bit_count()


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def _sets(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in steps(batches):
        yield batch, [shingles(t, width) for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _common(docs: DataFrame, width: int) -> np.ndarray:
    """Hashes of shingles that many texts of a sample have, sorted."""
    every = max(1, docs.count() // SAMPLE)
    part = docs.filter(F.pmod("th", F.lit(every)) == 0).dropDuplicates(["th"]).select("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, width):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets))], ["s"])

    found = part.mapInArrow(run, "s long").groupBy("s").count().filter(F.col("count") >= COMMON).orderBy(F.desc("count"), "s").limit(MOST_COMMON)
    return np.sort(np.array([r[0] for r in found.select("s").collect()], np.int64))


def _keyed(docs: DataFrame, common: np.ndarray, width: int) -> DataFrame:
    """(doc_id, th, node, n, fp, sketch, low, keys): a map."""

    def prefix(s: np.ndarray) -> np.ndarray:
        if not len(s):
            return s
        often = np.zeros(len(s), bool)
        if len(common):
            often = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
        return np.concatenate((s[~often], s[often]))[: len(s) - -(-4 * len(s) // 5) + 1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, width):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array([_node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(set_fingerprints(sets)), pa.array([_sketch(s) for s in sets], pa.binary()), _lists([s[:LOW] for s in sets]), _lists([prefix(s) for s in sets])],
                ["doc_id", "th", "node", "n", "fp", "sketch", "low", "keys"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, th long, node long, n int, fp long, sketch binary, low array<long>, keys array<long>")


def _sifted(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """Of ``docs`` those whose ``th`` is among ``hashes``.

    A bit map of the hashes, of a size that doesn't grow beyond ``MAP_BITS``, is broadcast, so that texts
    whose bit is not set are never dealt out; the semi-join then takes the exact ones.
    """
    word, bit = F.expr(f"pmod(th, {MAP_BITS}) div 64"), F.expr("shiftleft(1L, cast(th & 63 AS int))")
    words = hashes.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    maybe = docs.join(F.broadcast(words), word == F.col("word")).filter(F.col("bits").bitwiseAND(bit) != 0)
    return maybe.select(*docs.columns).join(hashes, "th", "left_semi")


def _sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, set) of the wanted nodes, made from one text of each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, width):
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), _lists(sets)], ["node", "set"])

    hashes = materialise(nodes.join(wanted.select("node").distinct(), "node", "left_semi").select("th"), "hashes")
    texts = _sifted(docs, hashes).dropDuplicates(["th"]).select("text")
    return materialise(texts.mapInArrow(run, "node long, set array<long>").dropDuplicates(["node"]), "sets")


def _within_bits(nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) that join up all nodes whose fingerprints differ in three bits at most, by multi-index hashing."""
    faces = materialise(nodes.groupBy("fp").agg(F.min("node").alias("u"), F.count("*").alias("n")), "faces")
    same = to_rows(nodes.select("fp", F.col("node").alias("v")), faces.filter("n > 1"), "fp").filter("u <> v").select("u", "v")
    one, other = faces.select(F.col("fp").alias("a"), "u"), faces.select(F.col("fp").alias("b"), F.col("u").alias("v"))
    near = fingerprint_links(faces.select("fp")).toDF("a", "b").join(one, "a").join(other, "b").select("u", "v")
    found = materialise(same.union(near), "near")
    drop_scratch(faces)
    return found


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sketches allow that they are similar."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                both = batch.column("n").to_numpy() + batch.column("m").to_numpy()
                apart = np.array([_differ(a, b) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())])
                yield batch.select(["u", "v"]).filter(pa.array(9 * apart <= both))

    one = nodes.select(F.col("node").alias("u"), F.col("sketch").alias("a"), "n")
    other = nodes.select(F.col("node").alias("v"), F.col("sketch").alias("b"), F.col("n").alias("m"))
    return pairs.join(one, "u").join(other, "v").select("u", "v", "a", "b", "n", "m").mapInArrow(run, "u long, v long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of which the sets are similar."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("set").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("set").alias("b")), "v")
    return both.filter(9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))).select("u", "v")


def _whole_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows, sorted by ``key``, in tables that no run of a key is cut by."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key").to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if held and (cut or held[-1].column("key")[-1].as_py() != keys[-1]):
            held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held)
            held = [batch.slice(cut)]
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, n, comp) by key -> pairs of small groups, and the (key, node) of crowded ones."""

    def out(crowded: bool, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), crowded)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["crowded", "u", "v"])

    for rows in _whole_runs(batches):
        key, node, n, comp = (rows.column(c).to_numpy() for c in ("key", "node", "n", "comp"))
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.append(first, len(key)))
        mixed = np.minimum.reduceat(comp, first) < np.maximum.reduceat(comp, first)
        crowded = np.repeat(mixed & (size > CROWD), size)
        if crowded.any():
            yield out(True, key[crowded], node[crowded])
        at = np.flatnonzero(np.repeat(mixed & (size <= CROWD), size))
        for d in range(1, CROWD):
            at = at[at + d < len(key)]
            at = at[key[at + d] == key[at]]
            if not len(at):
                break
            to = at + d
            near = (comp[at] != comp[to]) & (5 * np.minimum(n[at], n[to]).astype(np.int64) >= 4 * np.maximum(n[at], n[to]))
            if near.any():
                a, b = node[at[near]], node[to[near]]
                yield out(False, np.minimum(a, b), np.maximum(a, b))


def _fronts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, n, comp, sketch) of crowds by key -> likely pairs, or the (key, node) of those with too many."""
    for rows in _whole_runs(batches):
        rows = rows.combine_chunks()
        keys = rows.column("key").to_numpy()
        edges = [*np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]).tolist(), len(keys)]
        for a, z in zip(edges, edges[1:]):
            part = rows.slice(a, z - a)
            node, n, comp = (part.column(c).to_numpy() for c in ("node", "n", "comp"))
            u, v, near = _near(n.astype(np.int64), comp, part.column("sketch").to_pylist(), CROWD // 2 * (z - a))
            if u is None:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(near.sum(), True)), pa.array(np.full(near.sum(), keys[a])), pa.array(node[near])], ["crowded", "u", "v"])
            else:
                one, other = node[u], node[v]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), False)), pa.array(np.minimum(one, other)), pa.array(np.maximum(one, other))], ["crowded", "u", "v"])


def _near(n: np.ndarray, comp: np.ndarray, sketches: list[bytes], most: int) -> tuple[np.ndarray | None, np.ndarray | None, np.ndarray]:
    """Places of the likely pairs of different components, None if more than ``most``, and which places are in any."""
    size = np.array([len(s) for s in sketches])
    has = np.zeros(len(n), bool)
    left, right, count = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

    def of(length: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(size == length)
        at = at[np.argsort(n[at], kind="stable")]
        return at, np.frombuffer(b"".join(sketches[i] for i in at.tolist()), np.uint64).reshape(len(at), length // 8)

    # Similar sets' sizes differ by a quarter at most, so sketches have one length or its double.
    for length in np.unique(size).tolist():
        at, bits = of(length)
        longer, double = of(2 * length)
        folded = double[:, : double.shape[1] // 2] ^ double[:, double.shape[1] // 2 :]
        for same, to, other in ((True, at, bits), (False, longer, folded)):
            if not len(to):
                continue
            ends = np.searchsorted(n[to], 5 * n[at] // 4, "right").tolist()
            for i, (place, end) in enumerate(zip(at.tolist(), ends)):
                start = i + 1 if same else 0
                if start >= end:
                    continue
                part = to[start:end]
                apart = np.bitwise_count(other[start:end] ^ bits[i]).sum(axis=1, dtype=np.int64)
                part = part[(9 * apart <= n[place] + n[part]) & (comp[part] != comp[place])]
                if len(part):
                    has[part] = has[place] = True
                    count += len(part)
                    if count <= most:
                        left.append(np.full(len(part), place)), right.append(part)
    if count > most:
        return None, None, has
    return np.concatenate(left), np.concatenate(right), has


def _crowds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, set) by key -> links (u, v) that join up each group's similar sets."""
    for rows in _whole_runs(batches):
        rows = rows.combine_chunks()
        keys = rows.column("key").to_numpy()
        edges = [*np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]).tolist(), len(keys)]
        for a, z in zip(edges, edges[1:]):
            part = rows.slice(a, z - a)
            u, v = _compared(part.column("node").to_numpy(), [np.asarray(s) for s in part.column("set").to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _compared(nodes: np.ndarray, sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    n = np.array([len(s) for s in sets])
    _, word = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(n)), n)[np.argsort(word, kind="stable")]
    start = np.concatenate(([0], np.cumsum(np.bincount(word))))
    at = np.concatenate(([0], np.cumsum(n)))
    label = np.arange(len(n))
    u, v = [], []
    for i in range(len(n)):
        lists = [owner[start[w] : start[w + 1]] for w in word[at[i] : at[i + 1]].tolist()]
        shared = np.bincount(np.concatenate(lists), minlength=len(n))
        for j in np.flatnonzero((9 * shared >= 4 * (n + n[i])) & (label != label[i])).tolist():
            if label[j] != label[i]:
                u.append(int(nodes[i])), v.append(int(nodes[j]))
                label[label == label[j]] = label[i]
    return u, v


def similar(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` (doc_id, text) -> (doc_id, component_id), one row per input row."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    keyed = materialise(_keyed(docs, _common(docs, width), width), "keyed")
    nodes = materialise(keyed.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("th").alias("th"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch"), F.first("low").alias("low"), F.first("keys").alias("keys")), "nodes")
    rows = materialise(keyed.select("doc_id", "node"), "rows")
    drop_scratch(keyed)

    near = _within_bits(nodes)
    # From the node of each low key that has most copies to the others.
    low = nodes.select("node", "n", "copies", F.explode("low").alias("key"))
    hub = low.groupBy("key").agg(F.min(F.struct((-F.col("copies")).alias("c"), F.col("node").alias("u"), F.col("n").alias("m"))).alias("hub"), F.count("*").alias("k")).filter("k > 1")
    spokes = low.join(hub, "key").filter("node <> hub.u AND 5 * least(n, hub.m) >= 4 * greatest(n, hub.m)").select(F.col("hub.u").alias("u"), F.col("node").alias("v"))
    spokes = materialise(spokes.union(near).distinct(), "spokes")
    spokes = materialise(_likely(spokes, nodes), "spokes")
    ends = lambda p: p.select(F.col("u").alias("node")).union(p.select("v"))
    sets = _sets_of(docs, nodes, ends(spokes), width)
    links = materialise(_verified(spokes, sets), "links")
    drop_scratch(sets)
    known = materialise(star_components(links), "members")

    placed = nodes.select("node", "n", "sketch", "keys").join(known, "node", "left").withColumn("comp", F.coalesce("root", "node"))
    keys = placed.select("node", "n", "comp", F.explode("keys").alias("key"))
    dealt = keys.select("key", "node", "n", "comp").repartition("key").sortWithinPartitions("key").mapInArrow(_pairs, "crowded boolean, u long, v long")
    dealt = materialise(dealt, "dealt")
    pairs = materialise(dealt.filter(~F.col("crowded")).select("u", "v").distinct(), "pairs")
    pairs = materialise(_likely(pairs, nodes), "pairs")
    crowds = dealt.filter("crowded").select(F.col("u").alias("key"), F.col("v").alias("node"))
    crowds = crowds.join(placed.select("node", "n", "comp", "sketch"), "node").select("key", "node", "n", "comp", "sketch")
    fronts = materialise(crowds.repartition("key").sortWithinPartitions("key").mapInArrow(_fronts, "crowded boolean, u long, v long"), "fronts")
    drop_scratch(dealt)
    pairs = materialise(pairs.union(fronts.filter(~F.col("crowded")).select("u", "v")).distinct(), "pairs")
    crowds = fronts.filter("crowded").select(F.col("u").alias("key"), F.col("v").alias("node"))
    sets = _sets_of(docs, nodes, ends(pairs).union(crowds.select("node")), width)
    more = crowds.join(sets, "node").select("key", "node", "set").repartition("key").sortWithinPartitions("key").mapInArrow(_crowds, "u long, v long")
    links = materialise(links.union(_verified(pairs, sets)).union(more).distinct(), "links")
    drop_scratch(sets)
    drop_scratch(fronts)

    member = materialise(star_components(links), "members")
    least = member.join(nodes.select("node", "first"), "node").groupBy("root").agg(F.min("first").alias("least"))
    named = nodes.select("node", "first", "copies").join(member.join(least, "root").select("node", "least"), "node", "left")
    named = named.select("node", F.coalesce("least", "first").alias("component_id"), F.col("copies").alias("n"))
    return to_rows(rows, named, "node").select("doc_id", "component_id")
