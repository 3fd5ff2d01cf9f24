"""Secret scan with multipart credential linking.

Strong findings stand by themselves: assignments to a secret's name, access keys, and long hexadecimal runs.
Weak candidates (shorter hexadecimal, and mixed tokens that could be anything) are taken from all texts, by length, classes of characters
and entropy. They are reported, as kind linked, only where complementary parts are near: an access identifier and an
endpoint, or either of them with a name that announces a secret; an address alone links nothing. The join is on intervals: parts are summed up for each scope cell of SCOPE
characters that they touch (first start, last end), and a weak candidate meets the cells that it touches and
those beside them, where the distance is verified. So a candidate meets a number of rows that its own length
bounds, however many parts a text holds.

All of it is DataFrame expressions. Null texts count as empty; repeated rows, ids and empty ids are scanned one by one. Long texts are
scanned whole. Candidates that tie for a part all get it. An empty table gives no rows. Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscribe.llm.common import materialise, table
from veriscribe.llm.native import entropy, tagged, with_spans, written

#: The strong findings.
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: The weak candidates, and the parts that make them worth reporting.
WEAK_HEX = r"(?<![0-9A-Za-z])[0-9a-f]{16,23}(?![0-9A-Za-z])"
#: Whole runs, also straight after = and : and of any length; a run before =value is a name. Which classes they mix is asked of the value.
WEAK_MIXED = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])"
MIXED = ("[0-9]", "[a-z]", "[A-Z]")
#: Bits that the characters of a weak candidate have together at least: hexadecimal, mixed.
LEAST_HEX, LEAST_MIXED = 40, 64
IDENTIFIER = r"""(?i)(?<![a-z0-9])(?:access[_-]?key(?:[_-]?id)?|client[_-]?id|account(?:[_-]?(?:id|name))?|tenant[_-]?id|user(?:name)?|login)["']?\x20{0,4}[:=]\x20{0,4}["']?[A-Za-z0-9._@-]{3,}"""
ENDPOINT = r"""(?i)(?<![a-z0-9])(?:[a-z][a-z0-9+]{1,9}://[^\s"'<>]{4,}|(?:endpoint(?:[_-]?suffix)?|host|server|region|base[_-]?url)["']?\x20{0,4}[:=]\x20{0,4}["']?[A-Za-z0-9.-]{3,})"""
ANNOUNCED = r"(?i)(?<![a-z0-9])(?:secret|credential|private[_-]?key|passphrase|auth(?:orization)?|bearer|signature)s?(?![a-z0-9])"
#: Characters between a candidate and its parts, at most.
SCOPE = 200


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, uid, assign, access, hex, weak, parts) of every row; uid tells rows apart."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    has = lambda *xs: F.expr(" or ".join(f"contains(text, '{x}')" for x in xs))
    df = with_spans(df, "assign", ASSIGN, has(":", "="), 1)
    df = df.withColumn("assign", F.filter("assign", lambda s: F.length(s["value"]) >= 6))
    df = with_spans(df, "access", ACCESS, has("AKIA"))
    df = with_spans(df, "hex", HEX, F.col("text").rlike("[0-9a-f]{24}"))
    all_of = lambda s, patterns, least: (F.rlike(s["value"], F.lit(patterns[0])) & F.rlike(s["value"], F.lit(patterns[1])) & F.rlike(s["value"], F.lit(patterns[-1]))) & (entropy(s["value"]) * F.length(s["value"]) >= least)
    df = with_spans(df, "weak_hex", WEAK_HEX, F.col("text").rlike("[0-9a-f]{16}"))
    df = with_spans(df, "weak_mixed", WEAK_MIXED, F.col("text").rlike("[A-Za-z0-9+/_-]{20}"))
    df = df.withColumns({"weak_hex": F.filter("weak_hex", lambda s: all_of(s, ("[0-9]", "[a-f]"), LEAST_HEX)), "weak_mixed": F.filter("weak_mixed", lambda s: all_of(s, MIXED, LEAST_MIXED))})
    # parts are assignments or addresses, so a text without : and = has none that could link; nor has one without a candidate
    near = (F.size("weak_hex") + F.size("weak_mixed") > 0) & has(":", "=")
    df = with_spans(df, "identifier", IDENTIFIER, near)
    df = with_spans(df, "endpoint", ENDPOINT, near)
    df = with_spans(df, "announced", ANNOUNCED, near)
    role = lambda name, kind: F.transform(name, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("role")))
    weak = F.array_distinct(F.concat(role("weak_hex", "weak"), role("weak_mixed", "weak")))
    found = F.concat(role("identifier", "identifier"), role("access", "identifier"), role("endpoint", "endpoint"), role("announced", "announced"))
    return df.select("doc_id", F.monotonically_increasing_id().alias("uid"), "assign", "access", "hex", weak.alias("weak"), F.when(F.size(weak) > 0, found).otherwise(F.slice(found, 1, 0)).alias("parts"))


def linked(scans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(uid, start, end) of weak candidates with complementary parts near."""
    weak = scans.select("uid", F.explode("weak").alias("w")).select("uid", F.col("w.start").alias("start"), F.col("w.end").alias("end"))
    part = scans.select("uid", F.explode("parts").alias("p")).select("uid", "p.*")
    # a part is in every cell from its start to its end, so that one longer than a cell is met from its middle too
    through = F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor((F.col("end") - 1) / scope))).alias("cell")
    cells = part.select("uid", "start", "end", "role", through).groupBy("uid", "cell", "role").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    near = F.explode(F.sequence(F.floor((F.col("start") - 1) / scope) - 1, F.floor(F.col("end") / scope) + 1)).alias("cell")
    meet = weak.select("uid", "start", "end", near).join(cells, ["uid", "cell"])
    meet = meet.where((F.col("first") <= F.col("end") + scope) & (F.col("last") >= F.col("start") - scope))
    role = lambda x: F.max((F.col("role") == x).cast("int"))
    roles = meet.groupBy("uid", "start", "end").agg((role("identifier") + role("endpoint") + role("announced")).alias("roles"))
    return roles.where("roles >= 2").select("uid", "start", "end")


def by_start(*spans: Column) -> Column:
    """Spans of all kinds in one array, by start, then kind."""
    return F.array_sort(F.transform(F.concat(*spans), lambda s: F.struct(s["start"].alias("start"), s["number"].alias("number"), s["end"].alias("end"), s["kind"].alias("kind"))))


def secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, all_spans, n_weak, n_linked): the strong findings and all, as (start, number, end, kind); how many weak candidates there were, and were linked."""
    scans = materialise(scanned(docs))
    more = linked(scans, scope).groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("linked"))
    base = [tagged("assign", "assign", 1), tagged("access", "access", 2), tagged("hex", "hex", 3)]
    strong = F.array_union(F.transform("access", lambda s: s["start"]), F.transform("hex", lambda s: s["start"]))
    weak = F.filter(F.coalesce("linked", F.expr("cast(array() as array<struct<start:int,end:int>>)")), lambda s: ~F.array_contains(strong, s["start"]))
    df = scans.join(more, "uid", "left").withColumn("linked", weak)
    return df.select(
        "doc_id",
        *[F.size(x).cast("long").alias(f"n_{x}") for x in ("assign", "access", "hex")],
        by_start(*base).alias("base"),
        by_start(*base, tagged("linked", "linked", 4)).alias("all_spans"),
        F.size("weak").cast("long").alias("n_weak"),
        F.size("linked").cast("long").alias("n_linked"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("all_spans")).alias("spans"), "n_weak", "n_linked")
