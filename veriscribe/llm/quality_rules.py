"""Quality rules with risk-controlled thresholds.

Statistics of whole texts are compared with cut-offs on fixed grids. For each stratum (the language column),
rule and cut-off, the labelled holdout gives the good documents that the rule would reject, and an exact
(Clopper-Pearson) binomial bound on their share, at a level that is ALPHA divided by the number of
all strata, rules and cut-offs (Bonferroni). Cut-offs are chosen, one for a rule, so that the bounds of a stratum
add up to RISK at most, and only where bad documents are rejected more often than the bound on good ones. So with probability
1 - ALPHA at most RISK of the good documents of every certified stratum are rejected. Where labels are too few for any
certificate, only the base rules decide.

Statistics, counts and verdicts are DataFrame expressions; the driver gets one count for each stratum, rule,
cut-off and label, for strata with enough good labels to certify anything.

Null texts have no words. Repeated labels of an id count once, as good only if all are. Null languages are a stratum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscribe.llm.common import materialise, table

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
RISK, ALPHA = 0.03, 0.05
#: Rules as (name, statistic, cut-offs): a document fails where the statistic is above the cut-off.
RULES = [
    ("symbols", "n_symbols / greatest(n_words, 1)", [0.1, 0.2, 0.3, 0.5, 0.75, 1, 1.5, 2, 3]),
    ("duplicate_lines", "n_dup_lines / greatest(n_lines, 1)", [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9]),
    ("repeated_words", "n_repeat_words / greatest(n_words, 1)", [0.02, 0.05, 0.1, 0.15, 0.2, 0.25]),
    ("long_words", "word_chars / greatest(n_words, 1)", [8, 9, 10, 12, 15, 20, 40]),
    ("short_words", "- word_chars / greatest(n_words, 1)", [-4, -3.5, -3, -2.5, -2]),
    ("few_words", "- n_words", [-60, -50, -40, -30, -25]),
    ("few_kinds", "- n_kinds / greatest(n_words, 1)", [-0.5, -0.4, -0.3, -0.2, -0.1, -0.05]),
    ("capitals", "n_capitals / greatest(word_chars, 1)", [0.1, 0.2, 0.3, 0.5, 0.7, 0.9]),
]


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns, and the counts that the rules use."""
    df = docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text"))
    df = df.withColumn("__words", F.array_remove(F.split("__text", SPACE, -1), ""))
    lines = F.filter(F.split("__text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    last = F.size("__words") - WINDOW
    windows = F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(F.slice("__words", i, WINDOW)))
    none = F.expr("cast(array() as array<bigint>)")
    df = df.select(
        *keep,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("__text", r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
        F.size(F.array_distinct("__words")).cast("long").alias("n_kinds"),
        lines.alias("__lines"),
        F.when(last >= 0, windows).otherwise(none).alias("__windows"),
    )
    # nearly all texts have no repeated window, and only the others are sorted
    again = F.size(F.array_distinct("__windows")) < F.size("__windows")
    df = df.withColumns(
        {
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__pairs": F.when(again, F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
        }
    ).drop("__lines", "__windows")
    pairs = F.col("__pairs")
    twice = F.filter(pairs, lambda p, k: F.coalesce(F.get(pairs, k - 1)["h"] == p["h"], F.lit(False)) | F.coalesce(F.get(pairs, k + 1)["h"] == p["h"], F.lit(False)))
    df = df.withColumn("__at", F.array_sort(F.transform(twice, lambda p: p["i"]))).drop("__pairs")
    steps = F.zip_with(F.slice("__at", 1, F.size("__at") - 1), F.slice("__at", 2, F.size("__at")), lambda a, b: F.least(b - a, F.lit(WINDOW)).cast("long"))
    covered = F.aggregate(steps, F.lit(WINDOW).cast("long"), lambda n, x: n + x)
    return df.withColumn("n_repeat_words", F.when(F.size("__at") > 0, covered).otherwise(F.lit(0).cast("long"))).drop("__at")


#: The share of a tail that may be left out of its sum.
EPSILON = 1e-15


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def at_most(k: int, n: int, p: float) -> float:
    """The probability of k or fewer of n, each of probability p."""
    if p <= 0 or k >= n:
        return 1.0
    if p >= 1:
        return 0.0
    # from the largest term, each from its neighbour; ratios fall on the way, so what is left out is under a geometric series
    first = min(k, int((n + 1) * p))
    log = math.lgamma(n + 1) - math.lgamma(first + 1) - math.lgamma(n - first + 1) + first * math.log(p) + (n - first) * math.log1p(-p)
    total = 1.0
    down = (i * (1 - p) / ((n - i + 1) * p) for i in range(first, 0, -1))
    up = ((n - i) * p / ((i + 1) * (1 - p)) for i in range(first, k))
    for ratios in (down, up):
        term = 1.0
        for r in ratios:
            term *= r
            total += term
            if r < 1 and term * r <= EPSILON * total * (1 - r):
                break
    return min(1.0, math.exp(log) * total)


def upper_bound(k: int, n: int, level: float) -> float:
    """The Clopper-Pearson bound: the greatest share under which k or fewer of n still have the probability level."""
    low, high = (k / n if n else 1.0), 1.0
    if k >= n:
        return 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if at_most(k, n, mid) > level else (low, mid)
    return high


def certified(counts: list[tuple], risk: float = RISK, alpha: float = ALPHA) -> list[tuple[str, int, float]]:
    """(stratum, rule, cut-off) to reject above, of (stratum, rule, cut-offs passed, good, rows).

    All bounds of a stratum hold at once, so those of the chosen rules may add up to the risk. Rules are taken by
    the bad documents that they reject for each part of the risk that they use.
    """
    strata = sorted({c[0] for c in counts})
    level = alpha / max(1, len(strata) * sum(len(g) for *_, g in RULES))
    chosen = []
    for stratum in strata:
        offers = []
        for rule, (_, _, grid) in enumerate(RULES):
            own = [c for c in counts if c[0] == stratum and c[1] == rule]
            good, bad = (sum(n for _, _, _, g, n in own if g == x) for x in (1, 0))
            for i, cut in enumerate(grid):
                lost, caught = (sum(n for _, _, passed, g, n in own if g == x and passed > i) for x in (1, 0))
                bound = upper_bound(lost, good, level)
                if caught > bound * bad:
                    offers.append((caught / bound, rule, cut, bound))
        left, done = risk, set()
        for _, rule, cut, bound in sorted(offers, key=lambda x: (-x[0], x[1], x[2])):
            if rule not in done and bound <= left:
                left -= bound
                done.add(rule)
                chosen.append((stratum, rule, cut))
    return chosen


def thresholds(stats: DataFrame, labels: DataFrame, risk: float = RISK, alpha: float = ALPHA) -> list[tuple[str, int, float]]:
    """Cut-offs certified on the labelled rows of stats(doc_id, stratum, ...) that pass the base rules."""
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    passed = [sum(((F.expr(s) > c).cast("int") for c in grid), F.lit(0)) for _, s, grid in RULES]
    rows = stats.join(known, "doc_id").where(~base_failed())
    rows = rows.select("stratum", "good", F.posexplode(F.array(*passed)).alias("rule", "passed"))
    counts = rows.groupBy("stratum", "rule", "passed", "good").agg(F.count("*").alias("n"))
    fewest = math.log(sum(len(g) for *_, g in RULES) / alpha) / risk  # good rows below which no bound can hold
    enough = counts.where("rule = 0 and good = 1").groupBy("stratum").agg(F.sum("n").alias("all")).where(F.col("all") >= fewest).select("stratum")
    return certified([tuple(r) for r in counts.join(enough, "stratum").collect()], risk, alpha)


def verdict(cuts: list[tuple[str, int, float]]) -> Column:
    """Whether a row with its stratum and statistics passes the certified rules."""
    keep = F.lit(True)
    for stratum, rule, cut in cuts:
        keep = keep & ~((F.col("stratum") == stratum) & (F.expr(RULES[rule][1]) > cut))
    return keep


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, stratum, statistics, base_failed, kept) of every row."""
    own = docs.select("doc_id", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), "text")
    stats = materialise(statistics(own, "doc_id", "stratum"))
    cuts = thresholds(stats, labels.select("doc_id", "quality"), risk, alpha)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(cuts))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
