"""Longest previous factors against a comparison of all windows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sparkweft.llm import suffixes
from sparkweft.llm.suffixes import _runs, longest_previous_factors


def shared(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize(("seed", "letters", "length"), [(1, b"ab", 9), (2, b"abc", 12), (3, b"a", 10), (4, bytes(range(256)), 8)])
def test_longest_previous_factors(seed, letters, length):
    r = random.Random(seed)
    strings = [bytes(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(14)]
    strings += strings[:4]
    docs = [r.randint(0, 6) for _ in strings]
    windows = [(d, s[i : i + length]) for s, d in zip(strings, docs) for i in range(len(s) - length + 1)]
    for least in (1, length):
        got = longest_previous_factors(strings, docs, length, least)
        for s, d, found in zip(strings, docs, got):
            want = [max((shared(s[i : i + length], w) for e, w in windows if e < d), default=0) for i in range(len(s) - length + 1)]
            assert found.tolist() == [w if w >= least else 0 for w in want]


def test_runs_that_touch_are_one():
    ids, blobs = _runs([(2, 5, 10, 5), (2, 5, 15, 5), (2, 5, 30, 2), (1, 7, 0, 50), (2, 6, 16, 4), (2, 5, 11, 2)])
    rows = {i: np.frombuffer(b, np.int64).reshape(-1, 3).tolist() for i, b in zip(ids, blobs)}
    assert rows == {1: [[7, 0, 50]], 2: [[5, 10, 10], [5, 30, 2], [6, 16, 4]]}


def test_a_bucket_tells_runs_in_one_row_for_each_part():
    r = random.Random(9)
    repeated = [bytes(r.choice(b"abcdefgh") for _ in range(60)) for _ in range(40)]
    buckets, rows = 8, []
    for start in (0, 300):  # two tasks
        texts = [b"".join([b"%d:" % d, *r.sample(repeated, 6)]) for d in range(start, start + 300)]
        own = [(suffixes._mix(suffixes.minimisers([t])[0]) & suffixes.MASK40).view(np.uint8).reshape(-1, 8)[:, :5].tobytes() for t in texts]
        batch = pa.record_batch({"doc_id": pa.array(range(start, start + 300)), "text": pa.array(texts, pa.binary()), "marks": pa.array([[m] for m in own], pa.list_(pa.binary()))})
        rows += list(suffixes._send(buckets)([batch]))
    sent = pa.Table.from_batches(rows)
    out = []
    for b in range(buckets):
        group = sent.filter(pa.array([x == b for x in sent.column("bucket").to_pylist()]))
        out.append(suffixes._judge(group, buckets))
        assert len(out[-1]) <= sum(p is not None for p in group.column("part").to_pylist()) + buckets
    told = pa.concat_tables(out)
    assert len(told) <= 3 * buckets * buckets
    found = {}
    for p in range(buckets):
        part = suffixes._gathered(told.filter(pa.array([x == p for x in told.column("part").to_pylist()])))
        for d, runs in zip(part.column("doc_id").to_pylist(), part.column("runs").to_pylist()):
            assert d not in found
            found[d] = np.frombuffer(runs, np.int64).reshape(-1, 3)[:, 1:].tolist()
    r = random.Random(9)
    repeated = [bytes(r.choice(b"abcdefgh") for _ in range(60)) for _ in range(40)]
    first = {}
    for d in range(600):
        text = b"".join([b"%d:" % d, *r.sample(repeated, 6)])
        hit = {p + k for p in range(len(text) - 49) if first.setdefault(text[p : p + 50], d) < d for k in range(50)}
        assert {p + k for p, n in found.get(d, []) for k in range(n)} == hit


def test_a_bucket_answers_in_one_row_for_each_part():
    r = random.Random(4)
    buckets = 4
    texts = [bytes(r.choice(b"abcdefgh") for _ in range(90)) for _ in range(30)]
    docs = [r.choice(texts) + b"%d" % d for d in range(200)]
    told = pa.Table.from_batches([b for k in (0, 100) for b in suffixes._announce(buckets)([pa.record_batch({"doc_id": pa.array(range(k, k + 100)), "text": pa.array(docs[k : k + 100], pa.binary())})])])
    of = lambda table, column, k: table.filter(pa.array([x == k for x in table.column(column).to_pylist()]))
    answers = pa.concat_tables([suffixes._repeated(of(told, "bucket", b), buckets) for b in range(buckets)])
    assert len(answers) <= 3 * buckets * buckets
    parts = pa.concat_tables([suffixes._answered(of(answers, "part", p)) for p in range(buckets) if len(of(answers, "part", p))])
    got = {d: set(suffixes._unmark([m]).tolist()) for d, m in zip(parts.column("doc_id").to_pylist(), parts.column("marks").to_pylist())}
    own = [set((suffixes._mix(suffixes.minimisers([t])[0]) & suffixes.MASK40).tolist()) for t in docs]
    many = {m for i, a in enumerate(own) for m in a if any(m in b for b in own[:i])}
    # What one task has several times is told once, so each repeated minimiser of each document must be there.
    assert len(got) == len(parts) and got == {d: a & many for d, a in enumerate(own) if a & many}
