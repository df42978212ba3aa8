"""The near-duplicate stage against the similarity of all pairs."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from sparkweft.llm import simhash, similar, stages


def sets(text):
    ws = (text or "").lower().split()
    return frozenset(" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def components(rows):
    """Least id of what pairs of similarity 0.8 or more connect, for each row, by comparing all."""
    of = [sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(of):
        for j in range(i):
            b = of[j]
            if a == b or (a & b and 5 * len(a & b) >= 4 * len(a | b)):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [least.get(top(i)) for i in range(len(rows))]


def corpus():
    r = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    base = [r.choice(words) for _ in range(200)]
    passage = [r.choice(words) for _ in range(40)]
    texts = []
    for subs in [0, 0, 1, 2, 3, 4, 5, 6, 8] * 8:  # one large cluster, some of it only connected through others
        t = list(base)
        for _ in range(subs):
            t[r.randrange(len(t))] = r.choice(words)
        texts.append(" ".join(t))
    for n in (40, 80, 200, 600):  # pairs on both sides of the threshold
        for k in range(12):
            t = [r.choice(words) for _ in range(n)]
            other = list(t)
            for _ in range(max(1, n * k // 400)):
                other[r.randrange(n)] = r.choice(words)
            texts += [" ".join(t), " ".join(other).upper()]
    texts += [" ".join([*passage, *(r.choice(words) for _ in range(k))]) for k in range(5, 60)]
    return [*enumerate([*texts, None, "", " \t", "one two", "One  two", "one"]), (None, texts[0]), (3, texts[3])]


@pytest.mark.parametrize(("crowd", "common"), [(32, 5), (3, 2), (1000, 10**9)])
def test_all_pairs_above_the_threshold(spark, monkeypatch, crowd, common):
    monkeypatch.setattr(similar, "CROWD", crowd)
    monkeypatch.setattr(similar, "COMMON", common)
    rows = corpus()
    want = components(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = similar.similar(docs).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter((d, c) for (d, _), c in zip(rows, want))
    assert similar.similar(docs.limit(0)).count() == 0


def test_stage_drops_near_copies(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = Counter(r["doc_id"] for r in stages.near_dedup(spark, docs, "").collect())
    assert left == Counter(d for (d, _), c in zip(rows, components(rows)) if d is None or d == c)


def fingerprint(text):
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sets(text)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_stage_joins_fingerprints_within_three_bits(spark, monkeypatch):
    asked = []
    found = similar._within_bits
    monkeypatch.setattr(similar, "_within_bits", lambda nodes: asked.append((nodes.select("node", "fp").collect(), found(nodes))) or asked[-1][1])
    rows = corpus()
    stages.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    (nodes, pairs), *more = asked
    assert not more
    fps = {r["node"]: r["fp"] & (1 << 64) - 1 for r in nodes}
    assert Counter(fps.values()) == Counter(fingerprint(" ".join(t)) if t else 0 for t in {tuple(sorted(sets(t))): (t or "").lower().split() for _, t in rows}.values())
    got, want = ({n: n for n in fps} for _ in range(2))
    linked = [(r["u"], r["v"]) for r in pairs.collect()]
    near = [(u, v) for u in fps for v in fps if u < v and (fps[u] ^ fps[v]).bit_count() <= 3]
    assert {(min(p), max(p)) for p in linked} <= set(near) and len(near) > 10
    for root, some in ((got, linked), (want, near)):
        for u, v in some:
            a, b = sorted((root[u], root[v]))
            root.update({n: a for n in root if root[n] == b})
    assert got == want


@pytest.mark.parametrize("others", [0, 20])  # compared all with all, and as a forest
def test_links_see_the_highest_bit(others):
    fps = np.sort(np.array([5, (5 ^ 0b11) - (1 << 63), -3, *(0x5555_5555_5555 * k for k in range(7, 7 + others))], np.int64))
    u, v = simhash._links(np.zeros(len(fps), np.int64), fps)
    got = {frozenset(p) for p in zip(u.tolist(), v.tolist())}
    assert got <= {frozenset((a, b)) for a in fps.tolist() for b in fps.tolist() if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert frozenset((5, (5 ^ 0b11) - (1 << 63))) in got
