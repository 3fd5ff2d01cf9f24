"""Personal data: candidates of high recall, selected by gradient-boosted trees.

Base findings (e-mail addresses, IP addresses, card and phone numbers) are exact patterns with checks, and
always stand. Further generators propose overlapping spans: long numbers with any separators, grouped numbers,
account numbers with a country code, masked e-mail addresses, names after titles, dates of birth, street addresses and national
identity numbers. A candidate's format and the words before it give features; boosted trees turn them into a score; a
threshold for each generator, calibrated on examples the trees have not seen, selects. Of overlapping selected spans the best
stays, and none that touches a base span.

The trees are grown on the driver, in a second or two, and become CASE expressions: nothing but DataFrame expressions runs on the
executors. They learn from the whole table and from written examples. Every base finding written another way (a
phone number without its country code, a card number with points, an address masked), where it stood, is positive; so is
every candidate that a generator of numbers finds elsewhere negative, as long as no word before it speaks for it. What has the same value
after the same words counts once. The executors count them all by their features, and the driver gets the distinct features with their
counts: as many as formats allow, however long the table. Trees and thresholds use the counts as weights, scaled down where the table would outweigh
the written examples. These bring the formats
that have no base kind, and dates, versions, orders, prices and the like; half of them stand after words of the table.

Patterns are written with possessive quantifiers and look-behinds, so that no text makes them quadratic.
Null texts count as empty, long ones are scanned whole; repeated rows and ids, and rows without one, are scanned one by one. Candidates that tie
in score go by their start. An empty table gives no rows (and a model of written examples). Input columns come back inside `row`, so they may have any names.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscribe.llm.common import nested, table
from veriscribe.llm.native import BEFORE, digits, luhn, tagged, with_spans, written

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: The generators: kind, pattern, and what a text must have to be searched.
NUMBER = r"(?<![0-9A-Za-z])\(?[0-9](?:[\x20().:/-]{0,2}[0-9]){6,24}(?![0-9A-Za-z])"
GROUPED = r"(?<![0-9A-Za-z-])\(?[0-9]{3}\)?[\x20.-]?[0-9]{2,3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
MASKED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:\x20?[(\[{]at[)\]}]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[(\[{]dot[)\]}]|\x20dot\x20|\.)\x20?[A-Za-z0-9-]{2,63}){1,4}|\x20at\x20[A-Za-z0-9-]{1,63}(?:\x20dot\x20[A-Za-z0-9-]{2,63}){1,4})"
TITLE = r"(?<![\p{L}0-9])(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señora?|Sra?)(?![\p{L}0-9])"
NAME = TITLE + r"\.?\x20\p{Lu}[\p{L}'-]{1,30}+(?:\x20\p{Lu}[\p{L}'-]{1,30}+){0,2}"
BORN = r"(?i:born|birth|dob|geboren|née?|nacid[oa]|nacimiento)"
BIRTH = r"(?<=" + BORN + r"[a-z:,.\x20]{1,8})(?<![0-9])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.?\x20\p{L}{3,10}\x20[0-9]{4})(?![0-9])"
ADDRESS = (
    r"(?<![0-9\p{L}])(?:[0-9]{1,5}\x20(?:\p{Lu}\p{L}{1,20}\x20){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Way|Court)(?!\p{L})"
    r"|(?:[0-9]{1,4},?\x20)?(?:Rue|rue|Calle|calle|Plaza|plaza)\x20(?:d[eu]\x20|la\x20|l'){0,2}\p{Lu}\p{L}{1,20}(?:,?\x20[0-9]{1,4})?(?![0-9\p{L}])"
    r"|\p{Lu}\p{L}{1,20}(?:straße|strasse|weg|platz|allee)\x20[0-9]{1,4}[a-z]?(?![0-9\p{L}]))"
)
IDENTITY = r"(?<![0-9A-Za-z])(?:[0-9]{8}-?[A-HJ-NP-TV-Z]|[XYZ]-?[0-9]{7}-?[A-Z]|[12]\x20?[0-9]{2}\x20?(?:0[1-9]|1[0-2])\x20?[0-9]{2}\x20?[0-9]{3}\x20?[0-9]{3}(?:\x20?[0-9]{2})?|[A-CEGHJ-PR-TW-Z]{2}\x20?[0-9]{2}\x20?[0-9]{2}\x20?[0-9]{2}\x20?[A-D])(?![0-9A-Za-z])"
GENERATORS = [
    ("number", NUMBER, r"[0-9](?:[\x20().:/-]{0,2}[0-9]){6}"),
    ("grouped", GROUPED, r"[0-9]{2}[\x20.-][0-9]{4}"),
    ("iban", IBAN, r"[A-Z]{2}[0-9]{2}"),
    ("masked", MASKED, r"[(\[{]at[)\]}]|\x20dot\x20"),
    # these begin with a class of first letters, so that most places of a text fail at once
    ("name", NAME, r"[MDPHFS](?:rs?|s|rof|err|rau|onsieur|adame|me|eñora?|ra?)\.?\x20\p{Lu}"),
    ("birth", BIRTH, r"[bBdDgGnN](?:orn|irth|ob|OB|eboren|ée?|acid[oa]|acimiento)[a-z:,.\x20]{1,8}[0-9]"),
    ("address", ADDRESS, r"[SARLDBWC](?:treet|t|ve|venue|oad|d|ane|n|rive|oulevard|lvd|ay|ourt)(?!\p{L})|[rRcCpP](?:ue|alle|laza)\x20(?:d|l|\p{Lu})|[swpa](?:tra(?:ß|ss)e|eg|latz|llee)\x20[0-9]"),
    ("identity", IDENTITY, r"[0-9]{7}-?[A-Z](?![0-9A-Za-z])|[12]\x20?[0-9]{2}\x20?(?:0[1-9]|1[0-2])\x20?[0-9]{2}\x20?[0-9]{3}\x20?[0-9]{3}|[A-Z]{2}\x20?[0-9]{2}\x20?[0-9]{2}\x20?[0-9]{2}\x20?[A-D]"),
]
#: Words before a candidate that speak for or against it (fixed values).
#: Words in a name that make it an office or a brand (fixed values).
OFFICE = r"(?:President|Manager|Engineer|Director|Speaker|Chairman|Editor|Minister|Pepper|Analyst|Developer|Officer)"
CALL = r"(?i)(?:tel|phone|call|mobile|cell|fax|whatsapp|contact|handy|anruf|appel|llam|móvil|portable)"
HOLDER = r"(?i)(?:card|account|iban|bank|ssn|social|passport|tax id|konto|tarjeta|cuenta|carte|compte|ausweis|dni)"
AGAINST = r"(?i)(?:version|order|invoice|page|isbn|issn|doi|date|total|chapter|figure|port|build|serial|batch|price|since|between|\bno\b|\bnr\b|[$€£#=])"
DATE = r"(?:[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}|[0-9]{1,2}:[0-9]{2}:[0-9]{2}|(?:19|20)[0-9]{2}\x20?-\x20?(?:19|20)[0-9]{2})"
FORMATS = [r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$", r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", r"^[0-9]+$", r"[()\[\]{}]", r"\x20dot\x20|[(\[{]dot[)\]}]", OFFICE]
#: Cuts of a feature that a tree tries, about.
CUTS = 12
TREES, DEPTH, RATE, LEAST, EXAMPLES, PRECISION, SEED = 25, 3, 0.4, 8, 400, 0.99, 11
#: Above FINE, numbers are learned from in steps of STEP, so that distinct features stay few.
FINE, STEP = 64, 16


def features(s: Column, kind: int) -> list[Column]:
    """Numbers that describe a candidate (value, before) of a generator."""
    value, before = s["value"], s["before"]
    flag = lambda x: x.cast("double")
    count = lambda pattern: F.regexp_count(value, F.lit(pattern)).cast("double")
    return [
        count("[0-9]"),
        F.length(value).cast("double"),
        count("[0-9]+"),
        count("[A-Za-z]"),
        flag(luhn(value)),
        flag(before.rlike(CALL)),
        flag(before.rlike(HOLDER)),
        flag(before.rlike(AGAINST)),
        flag(value.rlike(DATE)),
        *[flag(value.rlike(x)) for x in FORMATS],
        F.lit(float(kind)),
    ]


def plain_features(value: str, before: str, kind: int) -> list[float]:
    """The same of an example."""
    d = [int(x) for x in reversed(re.sub("[^0-9]", "", value))]
    check = bool(d) and sum(x if k % 2 == 0 else 2 * x - (9 if x >= 5 else 0) for k, x in enumerate(d)) % 10 == 0
    count = lambda pattern: len(re.findall(pattern, value))
    found = [count("[0-9]"), len(value), count("[0-9]+"), count("[A-Za-z]"), check]
    found += [re.search(x, before) is not None for x in (CALL, HOLDER, AGAINST)]
    return [float(x) for x in [*found, re.search(DATE, value) is not None, *[re.search(x, value) is not None for x in FORMATS], kind]]


def examples(n: int, seed: int, befores: list[str] = (), counts: list[int] | None = None) -> list[tuple[str, str, int, int]]:
    """(value, text before, generator, label) of written examples, half of them after words of the table if there are any, drawn by their counts."""
    rng = random.Random(seed)
    sums = list(accumulate(counts or [1] * len(befores)))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(3, 8)))
    plain = lambda: rng.choices(befores, cum_weights=sums)[0] if befores and rng.random() < 0.5 else f"{word()} {word()} "
    name = lambda: " ".join(word().capitalize() for _ in range(rng.randint(1, 2)))

    def checked(k: int) -> str:
        body = num(k - 1)
        return next(body + x for x in "0123456789" if plain_features(body + x, "", 0)[4])

    yes = [
        (lambda: f"{rng.choice(['', '('])}{num(3)}{rng.choice([') ', '-', '.', ' '])}{num(3)}{rng.choice('-. ')}{num(4)}".replace("(", "", 0), ["phone: ", "Tel. ", "call me at ", "mobile ", "fax ", "contact "], 1),
        (lambda: f"{num(3)}-{num(2)}-{num(4)}", ["SSN ", "social security number ", "passport ", None], 1),
        (lambda: f"0{num(2)}{rng.choice([' ', '/', '-'])}{num(rng.randint(6, 8))}", ["Telefon ", "tel: ", "phone ", "appelez ", "llame al "], 0),
        (lambda: checked(rng.choice([13, 14, 15])), ["card ", "credit card: ", "account ", "Karte, Konto "], 0),
        (lambda: num(rng.randint(8, 12)), ["account number ", "bank account ", "tax id ", "cuenta "], 0),
        (lambda: rng.choice(["DE", "FR", "ES", "GB"]) + num(2) + "".join(" " + num(4) for _ in range(4)) + " " + num(2), ["IBAN ", "account ", "Konto: ", None], 2),
        (lambda: rng.choice(["DE", "NL", "IT"]) + num(18), ["IBAN: ", "bank ", None], 2),
        (lambda: f"{word()}{rng.choice([' [at] ', ' (at) ', '(at)', '[at]'])}{word()}{rng.choice(['.', ' [dot] ', ' (dot) '])}com", ["mail ", "write to ", None], 3),
        (lambda: f"{word()} at {word()} dot {rng.choice(['com', 'org', 'net'])}", ["mail me: ", "e-mail ", "contact ", None], 3),
        (lambda: f"{rng.choice(['Mr.', 'Mrs', 'Dr.', 'Herr', 'Frau', 'Madame', 'Señora'])} {name()}", [None, "ask ", "dear "], 4),
        (lambda: f"{rng.randint(1, 28)}{rng.choice('./-')}{rng.randint(1, 12)}.{rng.randint(1930, 2010)}", ["born ", "date of birth: ", "geboren am "], 5),
        (lambda: f"{rng.randint(1, 999)} {name()} {rng.choice(['Street', 'Road', 'Avenue'])}", [None, "lives at ", "address: "], 6),
        (lambda: rng.choice([f"{num(8)}{rng.choice('TRWAG')}", f"QQ {num(2)} {num(2)} {num(2)} A", f"1 {num(2)} 05 {num(2)} {num(3)} {num(3)} {num(2)}"]), [None, "DNI ", "passport ", "social security "], 7),
    ]
    no = [
        (lambda: f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", ["date ", "since ", None], 0),
        (lambda: f"{rng.randint(10, 28)}/{rng.randint(10, 12)}/{rng.randint(1990, 2030)} {rng.randint(10, 23)}:{num(2)}:{num(2)}", [None, "on "], 0),
        (lambda: num(rng.randint(7, 25)), [None, "order ", "serial ", "build ", "total ", "#", "= "], 0),
        (lambda: ".".join(num(rng.randint(1, 4)) for _ in range(4)), ["version ", None, "page "], 0),
        (lambda: f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", ["ISBN ", None], 0),
        (lambda: f"{num(3)} {num(3)} {num(4)}", ["total ", "batch ", "order ", "invoice "], 1),
        (lambda: f"{num(3)}.{num(3)}.{num(4)}", ["price ", "version ", "$"], 1),
        (lambda: f"{num(3)}{num(3)} {num(4)}", [None, "between ", "order "], 1),
        (lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(2)) + num(2) + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(12)), [None, "build ", "serial "], 2),
        (lambda: f"{word()}(at){word()}.{word()}"[:30], ["figure ", "= ", "since "], 3),
        (lambda: f"{rng.choice(['Mr.', 'Sr', 'Dr.'])} {rng.choice(['President', 'Manager', 'Engineer', 'Pepper', 'Analyst', 'Director'])}", [None, "our "], 4),
        (lambda: rng.choice([f"{num(8)}{rng.choice('TRWAG')}", f"1{num(2)}05{num(8)}"]), ["order ", "serial ", "batch ", "version ", "build "], 7),
    ]
    out = []
    for label, group in ((1, yes), (0, no)):
        for make, contexts, kind in group:
            for _ in range(n):
                context = rng.choice(contexts)
                before = (plain() + (context if context else plain()))[-BEFORE:]
                out.append((make(), before, kind, label))
    rng.shuffle(out)
    return out


def grown(x: np.ndarray, residual: np.ndarray, hessian: np.ndarray, weight: np.ndarray, depth: int) -> tuple:
    """A regression tree: (value,) or (feature, cut, below or at, above); residual and hessian hold the weight."""
    best, total = (1e-6, 0, 0.0), residual.sum() ** 2 / (hessian.sum() + 1)
    if depth:
        for f in range(x.shape[1]):
            cuts = np.unique(x[:, f])[:-1]
            for cut in cuts[:: 1 + len(cuts) // CUTS]:
                low = x[:, f] <= cut
                if LEAST <= weight[low].sum() <= weight.sum() - LEAST:
                    gain = residual[low].sum() ** 2 / (hessian[low].sum() + 1) + residual[~low].sum() ** 2 / (hessian[~low].sum() + 1) - total
                    if gain > best[0]:
                        best = (gain, f, float(cut))
    if best[0] <= 1e-6:
        return (float(residual.sum() / (hessian.sum() + 1)),)
    low = x[:, best[1]] <= best[2]
    sides = [grown(x[side], residual[side], hessian[side], weight[side], depth - 1) for side in (low, ~low)]
    return best[1], best[2], *sides


def value_of(tree: tuple, x: np.ndarray) -> np.ndarray:
    """A tree's value for each row of features."""
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    return np.where(x[:, tree[0]] <= tree[1], value_of(tree[2], x), value_of(tree[3], x))


def coarse(x: np.ndarray) -> np.ndarray:
    return np.where(x > FINE, np.ceil(x / STEP) * STEP, x)


def tree_sql(tree: tuple) -> str:
    """A tree as a CASE expression over the features s.x; one text for all trees is parsed faster than columns are put together."""
    if len(tree) == 1:
        return f"{tree[0]!r}D"
    return f"CASE WHEN s.x[{tree[0]}] <= {tree[1]!r}D THEN {tree_sql(tree[2])} ELSE {tree_sql(tree[3])} END"


@dataclass(frozen=True)
class Learned:
    """Examples (features, text before, generator, label) of a table; rows has the distinct features, with their fold and number."""

    rows: tuple

    def __len__(self) -> int:
        return sum(n for *_, n in self.rows)

    def __iter__(self) -> Iterator[tuple]:
        return (r[:4] for r in self.rows for _ in range(r[-1]))


def learned(docs: DataFrame) -> Learned:
    """All base findings of the table written another way, and all candidates that are none, counted by their features."""
    df = base_spans(docs.where("text is not null").select("text"))
    known = F.concat("email", "ip", "card", "phone")
    for name, pattern, needs in GENERATORS[:2]:
        df = with_spans(df, name, pattern, F.col("text").rlike(needs))
        df = df.withColumn(name, F.filter(name, lambda s: ~F.exists(known, lambda b: over(s, b)) & ~s["before"].rlike(f"{CALL}|{HOLDER}")))
    v = F.col("value")
    masked = F.concat(F.substring_index(v, "@", 1), F.lit(" [at] "), F.replace(F.substring_index(v, "@", -1), F.lit("."), F.lit(" [dot] ")))
    as_new = {
        "email": (3, 1, masked),
        "phone": (1, 1, F.expr("if(instr(value, ' ') > 0, substring(value, instr(value, ' ') + 1), '')")),
        "card": (0, 1, F.regexp_replace(digits(v), "([0-9]{4})(?=[0-9])", "$1.")),
        "number": (0, 0, v),
        "grouped": (1, 0, v),
    }
    of = lambda kind: F.transform(kind, lambda s: F.struct(F.lit(kind).alias("found"), s["value"].alias("value"), s["before"].alias("before")))
    pick = lambda i: F.coalesce(*[F.when(F.col("found") == k, x[i] if isinstance(x[i], Column) else F.lit(x[i])) for k, x in as_new.items()])
    each = df.select(F.explode(F.concat(*map(of, as_new))).alias("x")).select("x.*")
    each = each.select("found", pick(2).alias("value"), "before").where((F.col("found") != "phone") | v.rlike(FORMATS[0])).distinct()
    x = F.transform(F.array(*features(F.struct("value", "before"), 0)[:-1]), lambda f: F.when(f > FINE, F.ceil(f / STEP) * STEP).otherwise(f).cast("int"))
    each = each.select(x.alias("x"), "before", pick(0).alias("kind"), pick(1).alias("label"), F.pmod(F.xxhash64("value", "before"), F.lit(2)).alias("fold"))
    found = each.groupBy("x", "kind", "label", "fold").agg(F.min("before").alias("before"), F.count("*").alias("n")).collect()  # as many rows as formats allow
    return Learned(tuple(sorted((tuple(r.x), r.before, r.kind, r.label, r.fold, r.n) for r in found)))


def model(docs: DataFrame) -> tuple[list[tuple], list[float]]:
    """The trees, and each generator's threshold: the lowest that keeps the precision on unseen examples."""
    return grown_from(learned(docs))


def weighed(own: Learned, fold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and weights of a fold of the table's examples and as many written ones; the table's of a generator and label weigh EXAMPLES at most."""
    rows = [r for r in own.rows if r[4] == fold]
    sums: dict = {}
    for _, _, kind, label, _, n in rows:
        sums[kind, label] = sums.get((kind, label), 0) + n
    made = examples(EXAMPLES // 4, SEED + fold, [r[1] for r in rows], [r[-1] for r in rows])
    x = [[*r[0], r[2]] for r in rows] + [plain_features(v, b, k) for v, b, k, _ in made]
    weight = [r[-1] * min(1, EXAMPLES / sums[r[2], r[3]]) for r in rows] + [1] * len(made)
    return coarse(np.array(x, float)), np.array([r[3] for r in rows] + [t for *_, t in made], float), np.array(weight, float)


@lru_cache(maxsize=4)
def grown_from(own: Learned) -> tuple[list[tuple], list[float]]:
    """The model of written examples and of the table's own, a fold of which is kept back for the thresholds."""
    x, y, weight = weighed(own, 0)
    z, trees = np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        tree = grown(x, weight * (y - p), weight * p * (1 - p), weight, DEPTH)
        trees.append(tree)
        z += RATE * value_of(tree, x)
    x, y, weight = weighed(own, 1)
    scores, cuts = RATE * sum(value_of(t, x) for t in trees), []
    for kind in range(len(GENERATORS)):
        of = np.flatnonzero(x[:, -1] == kind)
        of = of[np.argsort(-scores[of], kind="stable")]
        s, all_, hits = scores[of], np.cumsum(weight[of]), np.cumsum(weight[of] * y[of])
        good = (hits >= PRECISION * all_ - 1e-9) & (s > 0) & np.append(s[1:] < s[:-1], True)
        cuts.append(float(s[good][-1]) if good.any() else float("inf"))
    return trees, cuts


def base_spans(df: DataFrame) -> DataFrame:
    """df, with a text that is not null, and its base findings: email, ip, card, phone."""
    text = F.col("text")
    size = lambda s: F.length(digits(s["value"]))
    df = with_spans(df, "email", EMAIL, F.expr("contains(text, '@')"))
    df = with_spans(df, "ip", IP, text.rlike(r"[0-9]\.[0-9]"))
    df = with_spans(df, "card", CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"))
    df = with_spans(df, "phone", PHONE, F.expr("contains(text, '+')"))
    return df.withColumns(
        {
            "ip": F.filter("ip", lambda s: s["value"].rlike(IP_PARTS)),
            "card": F.filter("card", lambda s: size(s).between(16, 19) & luhn(s["value"])),
            "phone": F.filter("phone", lambda s: size(s).between(8, 15)),
        }
    )


def scanned(docs: DataFrame) -> DataFrame:
    """(row, email, ip, card, phone, candidates) of every row; candidates with their generator and score; row has the input's columns."""
    df, text = base_spans(nested(docs).withColumn("text", F.coalesce("text", F.lit("")))), F.col("text")
    trees, cuts = model(docs.select("text"))
    for kind, (name, pattern, needs) in enumerate(GENERATORS):
        df = with_spans(df, name, pattern, text.rlike(needs))
        df = df.withColumn(name, F.transform(name, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.array(*features(s, kind)).alias("x"))))
    score = f"({' + '.join(map(tree_sql, trees))}) * {RATE}D"
    cut = lambda kind: f"{cuts[kind]!r}D" if np.isfinite(cuts[kind]) else "double('Infinity')"
    chosen = [F.expr(f"filter(transform({name}, s -> struct({score} AS score, s.start AS start, s.end AS end, {kind} AS kind)), s -> s.score >= {cut(kind)})") for kind, (name, *_) in enumerate(GENERATORS)]
    return df.drop("text").withColumn("candidates", F.concat(*chosen)).drop(*[n for n, *_ in GENERATORS])


def over(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def apart(candidates: Column) -> Column:
    """Of candidates (score, start, end, kind), from the best on, those that overlap none taken before."""
    ranked = F.array_sort(F.transform(candidates, lambda c: F.struct((-c["score"]).alias("cost"), c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))))
    return F.aggregate(ranked, F.slice(ranked, 1, 0), lambda taken, c: F.when(F.exists(taken, lambda t: over(t, c)), taken).otherwise(F.concat(taken, F.array(c))))


def personal_data(docs: DataFrame) -> DataFrame:
    """(row, n_email, n_ip, n_card, n_phone, base, all_spans): the input's rows as structs, the base findings and all, as (number, start, end, kind)."""
    df = scanned(docs)
    kinds = ("email", "ip", "card", "phone")
    n = {f"n_{k}": F.size(k).cast("long") for k in kinds}
    df = df.withColumns(n | {"base": F.concat(*[tagged(k, k, i) for i, k in enumerate(kinds)])})
    df = df.withColumn("free", F.filter("candidates", lambda c: ~F.exists("base", lambda b: over(c, b))))
    df = df.withColumn("free", apart(F.col("free")))
    names = F.array(*[F.lit(name) for name, *_ in GENERATORS])
    more = F.transform("free", lambda c: F.struct((c["kind"] + len(kinds)).alias("number"), c["start"].alias("start"), c["end"].alias("end"), names[c["kind"]].alias("kind")))
    spans = F.array_sort(F.concat("base", more)).alias("all_spans")
    return df.select("row", *n, "base", spans)


def redacted(text: Column, spans: Column) -> Column:
    """text with every span replaced by its kind in brackets; of overlapping spans the first to start goes on to the end of all."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(x, s):
        new = F.concat(x["out"], F.substr(text, x["at"] + 1, s["start"] - x["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["start"] >= x["at"], F.struct(s["end"].alias("at"), new.alias("out"))).otherwise(F.struct(F.greatest(x["at"], s["end"]).alias("at"), x["out"].alias("out")))

    return F.aggregate(ordered, start, step, lambda x: F.concat(x["out"], F.substr(text, x["at"] + 1, F.greatest(F.length(text) - x["at"], F.lit(0)))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("all_spans")).alias("spans"))
