"""Spans of regular expressions as DataFrame columns, without Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string,before:string>>"
#: Characters of text before a match that come with it, if none of an earlier match.
BEFORE = 40


def with_spans(df: DataFrame, name: str, regex: str, when: Column | None = None, group: int = 0, text: str = "text") -> DataFrame:
    """df and the leftmost, non-overlapping matches of regex in a text column, which is not null, as (start, end, value, before).

    Positions are in code points, end exclusive; value is the given group. The text between matches comes from
    splitting by the same expression, and lengths add up to positions: in blocks of the square root of the
    number of matches, so that a text with very many of them is not quadratic. Where `when` is false there are none.
    """
    # asked once: a condition that two columns use stays in a projection of its own
    if when is not None:
        df = df.withColumn(f"__{name}_in", when)
    inside = F.col(f"__{name}_in") if when is not None else F.lit(True)
    none = F.expr("cast(array() as array<string>)")
    find = lambda g: F.when(inside, F.regexp_extract_all(text, F.lit(regex), F.lit(g))).otherwise(none)
    found, between, value, parts, made = (f"__{name}_{x}" for x in ("found", "between", "value", "parts", "made"))
    df = df.withColumns({found: find(0), between: F.when(inside, F.split(text, regex, -1)).otherwise(none)} | ({value: find(group)} if group else {}))
    # the rest as SQL text, which is parsed faster than columns are put together
    own = f"struct(length({between}[i]) AS gap, length(m) AS own, {value if group else found}[i] AS value, substring({between}[i], -{BEFORE}, {BEFORE}) AS before)"
    df = df.withColumn(parts, F.expr(f"transform({found}, (m, i) -> {own})")).drop(found, between, value, f"__{name}_in")
    size = f"greatest(cast(ceil(sqrt(size({parts}))) AS int), 1)"
    empty = f"struct(0 AS at, cast(array() AS {SPAN}) AS out)"
    span = "struct(x.at + p.gap AS start, x.at + p.gap + p.own AS end, p.value AS value, p.before AS before)"
    step = f"(x, p) -> struct(x.at + p.gap + p.own AS at, concat(x.out, array({span})) AS out)"
    blocks = f"transform(sequence(0, cast(floor((size({parts}) - 1) / {size}) AS int)), k -> aggregate(slice({parts}, k * {size} + 1, {size}), {empty}, {step}))"
    df = df.withColumn(made, F.expr(f"CASE WHEN size({parts}) > 0 THEN {blocks} ELSE cast(array() AS array<struct<at:int,out:{SPAN}>>) END")).drop(parts)
    moved = "transform(b.out, s -> struct(s.start + x.at AS start, s.end + x.at AS end, s.value AS value, s.before AS before))"
    joined = f"aggregate({made}, {empty}, (x, b) -> struct(x.at + b.at AS at, concat(x.out, {moved}) AS out), x -> x.out)"
    return df.withColumn(name, F.expr(joined)).drop(made)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a value pass the Luhn check; from the right, every other digit counts double, less 9 from 5 on."""
    d = F.reverse(digits(value))

    def own(k):
        x = F.ascii(F.substr(d, k, F.lit(1))) - 48
        return F.when(k % 2 == 1, x).otherwise(2 * x - F.when(x >= 5, 9).otherwise(0))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), own), F.lit(0), lambda a, x: a + x) % 10 == 0


def entropy(value: Column) -> Column:
    """Bits for each character of a value, by its own characters' shares; 0 of an empty one."""
    n = F.length(value)

    def part(c):
        share = (n - F.length(F.replace(value, c, F.lit("")))) / n
        return -share * F.log2(share)

    return F.aggregate(F.transform(F.array_distinct(F.array_remove(F.split(value, ""), "")), part), F.lit(0.0), lambda a, x: a + x)


def tagged(name: str, kind: str, number: int) -> Column:
    """Spans as (number, start, end, kind)."""
    return F.transform(name, lambda s: F.struct(F.lit(number).alias("number"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def written(spans: Column) -> Column:
    """kind:start:end of spans in their order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
