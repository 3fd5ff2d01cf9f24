import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from veriscribe.llm import language_model as lm


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [x for x in re.split("[ \t\n\x0b\x0c\r]+", low) if x] + [None]


def corpus():
    """Words that depend on the ones before them."""
    rng = random.Random(4)
    vocabulary = sorted({"".join(rng.choice("abcDé") for _ in range(rng.randint(1, 4))) for _ in range(60)})
    texts = []
    for _ in range(150):
        at, own = rng.randrange(len(vocabulary)), []
        for _ in range(rng.randint(0, 80)):
            at = (7 * at + rng.randint(0, 2)) % len(vocabulary)
            own.append(vocabulary[at])
        texts.append(" ".join(own))
    return [(i, t, "x", i) for i, t in enumerate(texts)] + [(150, None, "", 0), (151, "  ", "", 0), (7, "a b", "", 0), (7, "a b", "", 0), (None, "a zz", "", 0)]


def test_scores_equal_brute_force(spark):
    rows = corpus()
    fold = lambda d: 0 if d is None else zlib.crc32(str(d).encode()) % 7
    training = [words(t) for d, t, *_ in rows if fold(d) != 2]
    single = Counter(w for t in training for w in t)
    double = Counter(p for t in training for p in zip(["^", *t], t))
    context = Counter(p[0] for t in training for p in zip(["^", *t], t))
    n, v = sum(single.values()), len(single)
    got = lm.scores(spark.createDataFrame(rows, "doc_id long, text string, score string, shard int"), shard_bytes=600).collect()
    assert len(got) == len(rows)
    wanted = sorted((d or -1, len(words(t)), sum(w in single for w in words(t)), round(sum(math.log10((single[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for d, t, *_ in rows)
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == wanted
    assert {r.train_tokens for r in got} == {n}
    assert all(r.held_out == (fold(r.doc_id) == 2) for r in got)

    # the weights that the engine learned are those of token-by-token expectation maximisation, up to its cells
    deleted = [words(t) for d, t, *_ in rows if lm.part_of(d)[1]]
    kept = [words(t) for d, t, *_ in rows if fold(d) != 2 and not lm.part_of(d)[1]]
    k1, k2 = Counter(w for t in kept for w in t), Counter(p for t in kept for p in zip(["^", *t], t))
    kc = Counter(p[0] for t in kept for p in zip(["^", *t], t))
    tokens = [(int(lm.bucket(np.array([kc[a]]))[0]), 1, k2[a, b] / max(1, kc[a]), k1[b] / sum(k1.values())) for t in deleted for a, b in zip(["^", *t], t)]
    weights = lm.learned(tokens, len(k1))
    text = {d: t for d, t, *_ in rows}
    off = []
    for r in got:
        if r.doc_id is not None and r.doc_id != 7:
            want = 0.0
            own = words(text[r.doc_id])
            for a, b in zip(["^", *own], own):
                w = weights[lm.bucket(np.array([context[a]]))[0]]
                want += math.log10(w[0] / (v + 1) + w[1] * single[b] / n + w[2] * double[a, b] / max(1, context[a]))
            off.append(abs(r.score - want) / max(1, abs(want)))
    assert max(off) < 0.02, max(off)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_empty_and_untrained(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert lm.scores(frame([])).count() == 0
    out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = lm.scores(frame([(out, "a b")])).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)


def test_packing_of_integers():
    x = np.array([0, 1, 2**64 - 1, 300], np.uint64)
    assert (lm.unpacked(lm.packed(x)) == x).all() and len(lm.unpacked(lm.packed(x[:0]))) == 0
