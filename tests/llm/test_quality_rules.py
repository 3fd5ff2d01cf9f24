import math
import random
import re

import pytest

from veriscribe.llm import quality_rules as q

WS = "[ \t\n\x0b\x0c\r]+"


def brute(text):
    text = text or ""
    words = [w for w in re.split(WS, text) if w]
    lines = [x for x in text.split("\n") if re.search("[^ \t\n\x0b\x0c\r]", x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_brute_force(spark):
    rng = random.Random(2)
    parts = ["a", "b", "Cé", "##", "x|y", "𝄞"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "\n", "\t ", "\r\n", " \n\n", "\x0b"]) for _ in range(rng.randint(0, 70))) for _ in range(80)]
    texts += [None, "", " \n ", " a", "q w e r t y u i\n" * 40, "a a a a a a a a a", "é" * 3000 + " " + "z " * 5000]
    rows = [(i, t, "n_words") for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in q.statistics(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id").collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_exact_bound():
    assert q.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100))
    assert q.upper_bound(5, 5, 0.05) == 1.0
    assert q.at_most(3, 10, q.upper_bound(3, 10, 0.01)) == pytest.approx(0.01)


def test_verdicts_limit_false_rejection(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(3, 7)))
    rows = []
    for i in range(9000):
        bad = i % 10 == 0
        text = " ".join(word() + ("%%%" if bad else "") for _ in range(30))
        rows.append((i, text, "en" if i % 9 else "xx", 0 if bad else 1))
    docs = spark.createDataFrame([r[:3] for r in rows] + [(None, None, None), (20_000, "short", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(None, 1), (4, None)], "doc_id long, quality int")
    got = {r.doc_id: (r.base_failed, r.kept) for r in q.judged(docs, labels, risk=0.004).collect()}
    assert got[None] == got[20_000] == (True, False)
    large = [(got[d][1], y) for d, _, s, y in rows if s == "en"]
    assert all(k for k, y in large if y) and not any(k for k, y in large if not y)
    assert all(got[d][1] for d, _, s, _ in rows if s == "xx")  # too few labels to certify a rule
    assert q.judged(docs.limit(0), labels).count() == 0 and q.judged(docs, labels.limit(0)).where("kept").count() == 9000


def test_bounds_add_up_to_the_risk_at_most():
    counts = [("s", rule, 0, 1, 5000) for rule in range(len(q.RULES))] + [("s", rule, 9, 0, 500) for rule in range(len(q.RULES))]
    level = q.ALPHA / sum(len(g) for *_, g in q.RULES)
    chosen = q.certified(counts, risk=0.005)
    assert len(chosen) == int(0.005 / q.upper_bound(0, 5000, level)) and q.certified(counts, risk=0.0001) == []


def test_tails_of_large_counts_are_summed_whole():
    n, p = 40_000_000, 0.03
    sd = math.sqrt(n * p * (1 - p))
    for z in (-4, -1, 0, 1, 3):
        assert q.at_most(round(n * p + z * sd), n, p) == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), rel=0.02)
    for n, p in ((1, 0.5), (30, 0.02), (30, 0.9), (300, 0.4)):
        for k in range(n):
            assert q.at_most(k, n, p) == pytest.approx(math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-9)
