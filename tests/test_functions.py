import difflib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from veriscribe.functions import detect as D
from veriscribe.functions import layout as L
from veriscribe.functions import metrics as M
from veriscribe.functions import text as T

GOLDEN = [  # reference, hypothesis, CER, WER, token BLEU, keyword F1, mix, exact match, line diff
    ("def f(x):\n    return x", "def f(x):\n    return x", 0, 0, 1, 1, 1, 1, (1.0, 0, 0, 0, 0)),
    ("def f(x):\n    return x", "", 1, 1, 0, 0, 0, 0, (0.0, 0, 2, 0, 1)),
    ("", "abc", 1, 1, 0, 1, 0.2, 0, (0.0, 1, 0, 0, 1)),
    ("def f(x):\n    return x", "def f(x):\n    retum x", 0.090909, 0.25, 0.707107, 0.666667, 0.699019, 0.5, (0.5, 0, 0, 1, 1)),
    ("a b c d", "a b", 0.571429, 0.5, 0.367879, 1, 0.494304, 0, (0.0, 0, 0, 1, 1)),
    ("if a:\n    b = 1\n    c = 2", "if a:\n    c = 2", 0.4, 0.375, 0.446896, 1, 0.557516, 0.333333, (0.8, 0, 1, 0, 1)),
    ("é中x", "e国x", 0.666667, 1, 0, 1, 0.2, 0, (0.0, 0, 0, 1, 1)),
    ("a", "aaaa", 3, 1, 0, 1, 0.2, 0, (0.0, 0, 0, 1, 1)),
    ("x\ny\nz", "x\nq\nz\nz", 0.6, 0.666667, 0.5, 1, 0.6, 0.666667, (0.5714, 1, 0, 1, 2)),
]
FLAGS = [
    ("Visual_Typo", "all 0", "a11 0", "all 0", "all"),
    ("Symbol_Loss", "f(a)", "f a", ",,,,,", ",,,,"),
    ("Indentation_Error", "x", "  x", "x", " x"),
    ("Line_Skipped", "\n".join("abcdefghij"), "\n".join("abcdefgh"), "\n".join("abcdefghij"), "\n".join("abcdefghi")),
    ("Variable_Hallucination", "a", "foo bar baz", "a", "foo bar"),
    ("Code_Invention", "x", "completely_new_line = 1", "x", "short = 1"),
    ("Repetition", "any", "abcdef\nabcdef\nabcdef", "any", "abcdef\nabcdef"),
    ("Comment_Loss", "# note", "x", "# note", "# note"),
]


def texts(n, seed, parts):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def pairs_frame(spark, rows):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, r string, h string")


def test_golden_metrics(spark):
    df = pairs_frame(spark, [g[:2] for g in GOLDEN])
    r, h = F.col("r"), F.col("h")
    got = df.select("i", M.cer(r, h).alias("cer"), M.wer(r, h).alias("wer"), M.token_scores(r, h).alias("t"), M.exact_match_rate(r, h).alias("em"), M.codediff(r, h).alias("d")).orderBy("i").collect()
    for g, row in zip(GOLDEN, got):
        found = (row.cer, row.wer, row.t.token_bleu, row.t.keyword_f1, row.t.codebleu, row.em)
        assert found == pytest.approx(g[2:8], abs=1e-6), g
        assert tuple(row.d)[:5] == pytest.approx(g[8])


def test_golden_flags(spark):
    for name, r1, h1, r0, h0 in FLAGS:
        df = pairs_frame(spark, [(r1, h1), (r0, h0)])
        assert [x.f for x in df.select("i", D.DETECTORS[name](F.col("r"), F.col("h")).alias("f")).orderBy("i").collect()] == [1, 0], name
    df = pairs_frame(spark, [("", ""), ("x", ""), ("", "x")])
    assert df.select(D.detected(D.taxonomy(F.col("r"), F.col("h")))).count() == 3


def test_edit_distance_of_long_pairs(spark):
    rng = random.Random(1)
    a = "".join(rng.choice("abcdé𝄞") for _ in range(3000))
    b = "".join(c for c in a if rng.random() > 0.1)
    df = pairs_frame(spark, [(a, b), (a, a), (a, "")])
    assert [x.d for x in df.select("i", M.char_distance(F.col("r"), F.col("h")).alias("d")).orderBy("i").collect()] == [x.d for x in df.select("i", F.levenshtein("r", "h").alias("d")).orderBy("i").collect()]


def normalize(x):
    out = []
    for line in x.splitlines():
        line = line.replace("\t", "    ").rstrip()
        if line or (out and out[-1]):
            out.append(line)
    while out and not out[-1]:
        out.pop()
    return "\n".join(out)


def test_text_functions_equal_plain_ones(spark):
    rows = texts(400, 3, ["a", "B_1", " ", "\t", "\n", "\r\n", "\u2028", "\x85", "\x1c", "\x1f", "\xa0", "#", "é", "x # y", ".", "中", "\n\n\n"])
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    x = F.col("x")
    got = df.select("i", T.normalize(x).alias("n"), T.strip(x).alias("s"), T.words(x).alias("w"), T.tokens(x).alias("t"), T.stripped_lines(x).alias("l"), T.comments(x).alias("c"), T.diff_lines(x).alias("d"), T.identifiers(x).alias("v")).orderBy("i").collect()
    for text, r in zip(rows, got):
        assert r.n == normalize(text) and r.s == text.strip() and r.w == text.split()
        assert r.t == re.findall(r"\w+|[^\w\s]", text)
        assert r.l == [y.strip() for y in text.split("\n") if y.strip()]
        assert r.d == [z for z in (y.replace("\t", "    ").rstrip() for y in text.splitlines()) if z]
        assert set(r.v) == set(re.findall(r"\b[a-zA-Z_][a-zA-Z0-9_]*\b", text))
        comments = []
        for line in text.split("\n"):
            comments += [line.strip()] * line.strip().startswith("#")
            after = line.split("#", 1)[1].strip() if "#" in line else ""
            comments += ["#" + after] * bool(after)
        assert r.c == comments


def test_metrics_equal_plain_ones(spark):
    rows = list(zip(texts(200, 5, ["a ", "if ", "b\n", "for ", "x=1 ", "\n"]), texts(200, 6, ["a ", "if ", "b\n", "for ", "x=1 ", "\n"])))
    df = pairs_frame(spark, rows)
    got = df.select("i", M.codediff(F.col("r"), F.col("h")).alias("d"), M.cer(F.col("r"), F.col("r")).alias("zero"), M.token_scores(F.col("r"), F.col("r")).alias("one")).orderBy("i").collect()
    for (a, b), r in zip(rows, got):
        x, y = ([z.rstrip() for z in t.split("\n") if z.rstrip()] for t in (a, b))
        assert r.d.line_similarity == round(difflib.SequenceMatcher(None, x, y, autojunk=False).ratio(), 4)
        assert r.zero == 0 and (r.one.token_bleu == pytest.approx(1) if a.split() else r.one.token_bleu == 0)


def test_paths(spark):
    cases = {"a/c/f/page_001_ratio2.png": ("c", 1, 2), "a/c/f/page_001_ratio1.5.png": ("c", 1, 1.5), "a\\c\\f\\page_012_ratio1_5.png": ("c", 12, 1.5), "c/f/page_001.png": ("c", 1, 1), "page_003_ratioX.png": (None, 3, 1), "cover.png": (None, 0, 1)}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    got = {r.p: (r.c, r.n, r.r) for r in df.select("p", T.code_of(F.col("p")).alias("c"), T.page_of(F.col("p")).alias("n"), T.ratio_of(F.col("p")).alias("r")).collect()}
    assert got == cases


def test_layout_anchors(spark):
    sizes = {(112, 112): 12, (224, 224): 49, (1024, 1024): 1024, (2240, 2240): 4900, (14, 14): 0, (56, 56): 3}
    df = spark.createDataFrame(list(sizes), "w int, h int")
    assert {(r.w, r.h): r.t for r in df.select("w", "h", L.image_tokens(F.col("w"), F.col("h")).alias("t")).collect()} == sizes
    assert all(L.image_tokens_of(w) == t for (w, _), t in sizes.items())
    row = spark.range(1).select(L.initial_font_size(F.lit(1000), F.lit(1120)).alias("f"), L.page_count(F.lit(1000), F.lit(1120), F.lit(20)).alias("p")).first()
    width = 1120 - 2 * 11.2
    assert row.f == int(int(math.sqrt(width * width * 0.95 / (3500 * 0.6))) * 1.1)
    across, down = int(width / 12), int(width / 20)
    assert row.p == math.ceil((3500 * 1.3 + 70 * (across * 0.3)) / (across * down))


def test_sql_functions(spark):
    from veriscribe.functions.register import register

    register(spark)
    row = spark.sql("SELECT image_tokens(224, 224) AS t, ratio_label(1.0D) AS a, ratio_label(1.5D) AS b, count_of('aaaa', 'aa') AS c, short_cer('abc', 'abd') AS d, wer('a b', 'a c') AS w, ast_parsable('x =') AS p").first()
    assert (row.t, row.a, row.b, row.c, row.w, row.p) == (49, "ratio_1x", "ratio_1.5x", 2, 0.5, False) and row.d == pytest.approx(1 / 3)
