"""Each operator against a brute-force version on a small corpus with the awkward rows."""

import hashlib
import random
import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkweft.llm import chat, decontaminate, langid, mixing, quality, secrets, simhash, suffixes, tokens, warc

R = random.Random(5)
WORDS = [f"{a}{b}" for a in "ba ke lo mi nu ra se to".split() for b in "dan fer gol his jun kap".split()]
SAY = lambda n: " ".join(R.choice(WORDS) for _ in range(n))
BASE, ITEM, SHORT = SAY(120), SAY(24), "Three short words"
KEY = "Zx9" + "q7Lm2Rt8Vw4Kp6Yd3Nb5Hs1Gf0Jc"

TEXTS = [
    BASE, None, "", BASE, BASE.replace(" ", "  ", 3), BASE + " tail", SAY(200), f"{SAY(30)} {ITEM.upper()} {SAY(30)}", f"x {SHORT}, y", "one two",
    SAY(20) + f' api_key = "{KEY}" ' + SAY(20), "same line\nsame line\n" * 40, "ünïcödé ｶﾅ 漢字 🙂 " * 30, SAY(9_000), SAY(60) + BASE[:90], "\t \n", SAY(50) + ITEM[10:70],
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, bucket string, hash string, at string"


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, "en", ["web", None, "code"][i % 3], len(t or ""), "a", "b", "c", "d") for i, t in enumerate(TEXTS)]
    return [*out, out[6], (None, TEXTS[6], None, None, 0, "a", "b", "c", "d")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def bag(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_decontaminate(spark, docs, rows, none):
    items = [(1, ITEM), (2, SHORT), (3, None), (4, "!?"), (5, ITEM), (None, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for r in rows:
        ws, hit, ids = split(r[1]), set(), set()
        for i, t in items:
            iw = split(t)
            n = min(10, len(iw))
            windows = {tuple(iw[s : s + n]) for s in range(len(iw) - n + 1)} if n else set()
            for s in range(len(ws) - n + 1 if n else 0):
                if tuple(ws[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    ids |= {str(i)} if i is not None else set()
        want[(r[0], len(ws), len(hit), tuple(sorted(ids)), bool(hit))] += 1
    for most in (100_000, 0):  # broadcast, and joined by a shuffle
        got = decontaminate.decontaminate(docs, bench, broadcast_rows=most).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in got) == want
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert not decontaminate.decontaminate(docs, bench.limit(0)).filter("contaminated").count()


def test_secrets(spark, docs, rows, none):
    forest = secrets.fit(spark)
    out = secrets.scan(docs, forest).collect()
    assert len(out) == len(rows)
    masked = {r["doc_id"]: r["redacted"] for r in out if any(f["secret"] for f in r["findings"])}
    assert set(masked) == {10} and KEY not in masked[10] and secrets.MASK in masked[10]
    assert Counter((r["doc_id"], r["redacted"]) for r in out if r["doc_id"] not in masked) == Counter((r[0], r[1]) for r in rows if r[0] not in masked)
    assert secrets.scan(none, forest).count() == 0
    held = secrets.labelled_findings(600, seed=99)
    from sparkweft.llm.forest import predict

    found = secrets.finding_features(spark.createDataFrame(held, "path string, text string, label int")).collect()
    right = [(predict(forest, r["features"]) >= secrets.THRESHOLD) == bool(r["label"]) for r in found]
    assert sum(right) / len(right) >= 0.95


def test_language(spark, none):
    rows = [(i, " ".join(R.choice(w) for _ in range(40)), lang) for lang, w in (("aa", WORDS), ("bb", "der die und nicht ein".split()), ("cc", "よい 日本 の です".split())) for i in range(0, 300)]
    docs = spark.createDataFrame([(k, t, lang) for k, (_, t, lang) in enumerate(rows)] + [(9_001, None, "aa"), (9_002, "123 !?", "bb"), (None, "und nicht", None)], "doc_id long, text string, lang string")
    train = docs.filter(~langid.held_out(F.col("doc_id")))
    model = langid.fit(train)
    out = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert all(out[k]["lang_pred"] == lang and 0 <= out[k]["score"] <= 1 for k, (_, _, lang) in enumerate(rows))
    assert out[9_001]["lang_pred"] == out[9_002]["lang_pred"] == "und" and out[None]["lang_pred"] == "bb"
    assert langid.fit(none).predict(["x"])[0] == ["und"]


def test_warc(spark, tmp_path):
    big = "<p>" + "x" * 1200
    pages = [(1, "http://a/\r\n b", big), (5, None, big), (3, "u", big), (2, "u", None), (4, "u", "small"), (6, "u", "small"), (7, "ü", "é" * 700), (None, "n", big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_archives(df, folder)
    got = {r["page_id"]: r for r in warc.read_archives(manifest, payloads=True).collect()}
    assert len(got) == len(pages) and all(r["digest_ok"] for r in got.values())
    for i, _, html in pages:
        raw = (html or "").encode()
        revisit = html == big and i != 5
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["record_type"], got[i]["refers_to"]) == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None)
        assert revisit or got[i]["payload"] == raw
    bad = tmp_path / "bad.warc.gz"
    bad.write_bytes(warc.member(warc.record("response", 1, "u", b"abc").replace(b"abc", b"abd")))
    assert not next(warc.read_records(bad.open("rb")))["ok"]
    assert warc.round_trip(df.limit(0)).count() == 0


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(three)
    covered = {i + k for i, t in enumerate(three) if many[t] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs, rows, none):
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(14)] + [(3, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    grams = lambda t: [(int.from_bytes(t[i : i + 4], "little") * 2654435761 % 2**32) >> 16 for i in range(len(t) - 3)]
    raw, good = Counter(), Counter()
    for r in rows:
        g = grams((r[1] or "").encode())
        raw.update(g)
        if r[0] is not None and r[0] < 14 and r[0] % 2 == 0:
            good.update(g)
    weight = lambda b: np.log((good[b] + 1) / (good.total() + 65536)) - np.log((raw[b] + 1) / (raw.total() + 65536))
    got = quality.judge(docs, model).collect()
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == Counter((r[0], *counts(r[1])) for r in rows)
    for r in got:
        if r["doc_id"] is not None:
            g = grams((TEXTS[r["doc_id"]] or "").encode())
            assert r["score"] == pytest.approx(np.mean([weight(b) for b in g]) if g else 0.0)
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["score"] >= model.threshold)
    assert quality.judge(none, quality.fit(none, labels)).count() == 0


def test_roles(spark):
    def cheapest(roles):
        best = {0: 0.0}
        for role in roles:
            nxt = {}
            for s, c in best.items():
                for t in (1, 2, 3):
                    new = c + chat.OPTIONS[role][s][t][0]
                    if new < nxt.get(t, 1e9):
                        nxt[t] = new
            best = nxt
        return min(c + chat.INSERT * len(chat.CLOSING[t]) for t, c in best.items())

    names = ["system", "user", "assistant", "tool", None]
    rows = [(c, k, R.choice(names), R.choice(["a", None, "b" * 50])) for c in range(12) for k in range(R.randint(1, 9))]
    rows += [(99, k, "user" if k % 3 else "assistant", f"t{k}") for k in range(40)] + [(0, 0, *rows[0][2:]), (None, 1, "user", "x"), (None, 1, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    one, cut = chat.format_chats(df).collect(), chat.format_chats(df, block=4).collect()
    assert Counter(map(tuple, one)) == Counter(map(tuple, cut))
    for c in {r[0] for r in rows if r[0] is not None}:
        mine = sorted((r for r in one if r["conv_id"] == c), key=lambda r: r["turn"])
        assert sum(r["cost"] for r in mine) == cheapest([chat.code(r["role"]) for r in mine])
        heads = re.findall(r"<\|im_start\|>(\w+)\n", "".join(r["rendered"] for r in mine))
        body = heads[1:] if heads[0] == "system" else heads
        assert body[0] == "user" and body[-1] == "assistant" and all(a != b for a, b in pairwise(body))
    assert chat.format_chats(df.limit(0)).count() == 0


def test_repeats(docs, rows, none):
    want = Counter()
    for r in rows:
        t = (r[1] or "").encode()
        gone = [False] * len(t)
        if r[0] is not None:
            earlier = {(x[1] or "").encode()[i : i + 50] for x in rows if x[0] is not None and x[0] < r[0] for i in range(len((x[1] or "").encode()) - 49)}
            for i in range(len(t) - 49):
                if t[i : i + 50] in earlier:
                    gone[i : i + 50] = [True] * 50
        kept = bytes(b for b, g in zip(t, gone) if not g)
        want[(r[0], len(t), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())] += 1
    assert bag(suffixes.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert suffixes.remove_repeats(none).count() == 0


def fingerprint(text, width=3):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(ws[i : i + width]) for i in range(len(ws) - width + 1)] if len(ws) >= width else [" ".join(ws)] if ws else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(fps):
    """Component of each of the fingerprints by comparing all of them."""
    root = {f: f for f in fps}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 3:
                root[top(a)] = top(b)
    return {f: top(f) for f in fps}


@pytest.mark.parametrize("crowd", [20_000, 3])
def test_near_duplicates(docs, rows, none, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    prints = [fingerprint(r[1]) for r in rows]
    of = joined(set(prints))
    least = {}
    for r, f in zip(rows, prints):
        if r[0] is not None:
            least[of[f]] = min(r[0], least.get(of[f], r[0]))
    want = Counter((r[0], f"{f:016x}", least[of[f]]) for r, f in zip(rows, prints))
    assert bag(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(none).count() == 0


def test_links_of_a_crowded_entry(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 50)
    fps = {R.getrandbits(11) << 3 | 0xABC << 40 for _ in range(400)} | {R.getrandbits(64) for _ in range(200)}
    nodes = spark.createDataFrame([(f - (f >> 63 << 64),) for f in fps], "fp long")
    root = {f: f for f in fps}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for r in simhash.links(nodes).collect():
        assert ((r["u"] ^ r["v"]) % 2**64).bit_count() <= 3
        root[top(r["u"] % 2**64)] = top(r["v"] % 2**64)
    want = joined(fps)
    assert len({(want[f], top(f)) for f in fps}) == len(set(want.values())) == len({top(f) for f in fps})


def test_mix(spark, docs, rows, none):
    out = mixing.mix(docs, fan=4)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({r[3] for r in rows if r[3]}) + [None]
    total = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in names}
    open_, left, target = dict(zip(names, (3, 1, 2))), 1.5 * sum(total.values()), {}
    while open_:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        full = [s for s in share if share[s] > 2 * total[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * total[s]
            left -= target[s]
            del open_[s]
    by = {}
    got = out.collect()
    assert len(got) == len(rows)
    source = {r[0]: r[3] for r in rows}
    for r in got:
        assert r["target"] == pytest.approx(target[source[r["doc_id"]]]) and r["source_size"] == total[source[r["doc_id"]]]
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        by[source[r["doc_id"]]] = by.get(source[r["doc_id"]], 0) + r["taken"]
    largest = {s: max(size(r[1]) for r in rows if r[3] == s) for s in names}
    assert all(abs(by[s] - target[s]) <= largest[s] / 2 + 1 for s in names)
    assert bag(out, "doc_id", "taken") == bag(mixing.mix(docs.repartition(1), fan=4), "doc_id", "taken")
    assert mixing.mix(none).count() == 0


def test_tokens(docs, rows, none):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter((r[0], len((r[1] or "").encode()), len(sp.encode(r[1] or "")), len(sp.encode(r[1] or "")) > 4096) for r in rows)
    assert bag(tokens.count_tokens(docs, vocabulary="piece_bpe_32k.model"), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    bpe = tokens.model(public_tokenizers.path("piece_bpe_32k.model"))
    for odd in ("x" * 3000, "  a   b ", "\n\n a\n", "<s> </s> <unk>", "a▁b", "é" * 900, "\t1234567 $%^", "naïve—“q” ﬁ"):
        assert bpe.count([odd]) == [len(sp.encode(odd))], odd
    assert tokens.count_tokens(none, vocabulary="piece_bpe_32k.model").count() == 0
