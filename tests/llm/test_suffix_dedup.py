import hashlib
import random
from collections import Counter

import numpy as np

from veriscribe.llm import suffix_dedup as sd


def brute(texts):
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdé fgh") for _ in range(n))
    passages = [noise(n) for n in (150, 199, 200, 201, 260, 700, 3000)]
    texts = [noise(rng.randint(0, 300)) + rng.choice(passages) + noise(rng.randint(0, 400)) for _ in range(70)]
    for _ in range(12):  # near copies
        t = list(rng.choice(texts))
        for _ in range(rng.randint(1, 3)):
            t[rng.randrange(len(t))] = "X"
        texts.append("".join(t))
    texts += ["a" * 200, "a" * 199, "b" * 201, "c" * 1000, "ha " * 300, "ha " * 70, "line of text\n" * 40, noise(500) * 2, None, "", texts[0], passages[4], passages[4]]
    return texts


def check(spark, texts, **options):
    rows = [(i if i % 9 else None, t, "clash", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, own string, place int")
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.repeats(df, **options).collect())
    assert got == sorted(brute([(t or "").encode() for t in texts]))


def test_repeats_equal_brute_force(spark):
    check(spark, corpus())


def test_repeats_with_small_shards_and_blocks(spark):
    check(spark, corpus(), most=3, shard=5)


def test_copies_without_an_id_and_a_very_long_text(spark):
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    once, shared = noise(900), noise(260)
    texts = [once] * 150 + [noise(40) + shared + noise(40) for _ in range(80)] + [noise(60_000) + shared]
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.repeats(df, most=20).collect())
    assert got == sorted(brute([t.encode() for t in texts]))


def test_empty_table_and_kept_bytes(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sd.repeats(df).count() == 0
    df = spark.createDataFrame([(1, "x" + "ab" * 100), (2, "y" + "ab" * 100 + "é")], "doc_id long, text string")
    assert {(r.doc_id, bytes(r.kept)) for r in sd.repeats(df, with_kept=True).collect()} == {(1, b"x"), (2, "yé".encode())}


def test_anchors_of_equal_strings_agree(monkeypatch):
    rng = random.Random(1)
    noise = lambda n: bytes(rng.choice(b"abc") for _ in range(n))
    for block in (1 << 21, 1 << 10):
        monkeypatch.setattr(sd, "BLOCK", block)
        common = noise(200)
        texts = [noise(rng.randint(0, 2500)) + common + noise(rng.randint(0, 300)) for _ in range(20)]
        number, place, own, *_ = sd.anchors_of(texts)
        at = [{(int(p) - t.index(common), int(h)) for p, h in zip(place[number == k], own[number == k]) if 0 <= p - t.index(common) <= 136} for k, t in enumerate(texts)]
        assert set.intersection(*at)


def test_sorter_sorts():
    rng = random.Random(2)
    data = np.frombuffer(b"".join(rng.choice([b"ab", b"aab", b"b"]) * rng.randint(1, 60) for _ in range(60)) + b"z" * 200, np.uint8)
    suffixes = np.arange(len(data) - 200)
    rng2 = np.random.default_rng(0)
    rng2.shuffle(suffixes)
    groups = np.sort(rng2.integers(0, 4, len(suffixes)))
    order = sd.Sorter(data, sd.BASES[1]).sorted(suffixes, groups)
    for g in range(4):
        own = [bytes(data[s : s + 200]) for s in suffixes[order[groups == g]]]
        assert own == sorted(own)
