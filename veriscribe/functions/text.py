"""Text expressions: every function takes and returns Columns, so that Catalyst sees all of it.

White space and word characters follow Unicode, not Java's defaults; the classes below are used throughout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Character classes, in Java's syntax.
WS = r"\s\x1c-\x1f\x85\p{Z}"
WORD = r"\p{L}\p{N}_"
BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"
#: The markers that some recognisers put around their answer.
MARKERS = ("<|begin_of_box|>", "<|end_of_box|>")


def _lit(x: str) -> Column:
    return F.lit(x)


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^[{WS}]+|[{WS}]+\\z", "")


def rstrip(x: Column) -> Column:
    return F.regexp_replace(x, f"[{WS}]+\\z", "")


def without_markers(x: Column) -> Column:
    for marker in MARKERS:
        x = F.replace(x, _lit(marker), _lit(""))
    return x


def recognised(x: Column) -> Column:
    """An answer as it is stored: without markers and outer line feeds; null is empty."""
    return F.coalesce(F.regexp_replace(without_markers(x), "^\n+|\n+\\z", ""), _lit(""))


def normalize(x: Column) -> Column:
    """Line breaks as line feeds, tabs as four spaces, no white space at line ends, no blank lines around, one between."""
    x = F.regexp_replace(x, BREAK, "\n")
    x = F.replace(x, _lit("\t"), _lit("    "))
    x = F.regexp_replace(x, f"[{WS}&&[^\n]]+(?=\n|\\z)", "")
    x = F.regexp_replace(x, "\n{3,}", "\n\n")
    return F.regexp_replace(x, "^\n+|\n+\\z", "")


def lines(x: Column) -> Column:
    return F.split(x, "\n", -1)


def stripped_lines(x: Column) -> Column:
    """The lines that are not blank, stripped."""
    return F.filter(F.transform(lines(x), strip), lambda y: y != "")


def diff_lines(x: Column) -> Column:
    """Lines by any break, tabs as four spaces, right-stripped, without blank ones."""
    parts = F.transform(F.split(x, BREAK, -1), lambda y: rstrip(F.replace(y, _lit("\t"), _lit("    "))))
    return F.filter(parts, lambda y: y != "")


def tokens(x: Column) -> Column:
    """Runs of word characters, and single other characters."""
    return F.regexp_extract_all(x, _lit(f"[{WORD}]+|[^{WORD}{WS}]"), _lit(0))


def words(x: Column) -> Column:
    return F.filter(F.split(x, f"[{WS}]+", -1), lambda y: y != "")


def count_of(x: Column, pattern: str) -> Column:
    """Non-overlapping occurrences of a string."""
    return F.floor((F.length(x) - F.length(F.replace(x, _lit(pattern), _lit("")))) / len(pattern)).cast("int")


def indent(x: Column) -> Column:
    """Leading spaces and tabs, each as one."""
    return F.length(x) - F.length(F.regexp_replace(x, "^[ \t]+", ""))


def identifiers(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, _lit(f"(?<![{WORD}])[a-zA-Z_][a-zA-Z0-9_]*(?![{WORD}])"), _lit(0)))


def comments(x: Column) -> Column:
    """Of each line: itself, if it is a comment; and what follows its first number sign. A whole-line comment counts twice."""

    def of(line: Column) -> Column:
        own = strip(line)
        after = strip(F.regexp_extract(line, "(?s)^[^#]*#(.*)$", 1))
        return F.array_compact(F.array(F.when(own.startswith("#"), own), F.when(F.contains(line, _lit("#")) & (after != ""), F.concat(_lit("#"), after))))

    return F.flatten(F.transform(lines(x), of))


def for_rendering(x: Column, keep_breaks: Column | bool = True) -> Column:
    """Tabs as four spaces, breaks as a mark unless kept, dashes and ellipses in ASCII."""
    keep = keep_breaks if isinstance(keep_breaks, Column) else F.lit(keep_breaks)
    x = F.replace(x, _lit("\t"), _lit("    "))
    x = F.when(keep, x).otherwise(F.replace(x, _lit("\n"), _lit("⏎")))
    for old, new in (("–", "-"), ("—", "--"), ("…", "...")):
        x = F.replace(x, _lit(old), _lit(new))
    return x


def structure(x: Column) -> Column:
    """Number of lines, longest and mean length (1 at least), all characters; a tab counts as four."""
    own = F.transform(lines(F.replace(x, _lit("\t"), _lit("    "))), F.length)
    total = F.aggregate(own, F.lit(0).cast("bigint"), lambda a, y: a + y)
    return F.struct(
        F.size(own).alias("num_lines"),
        F.greatest(F.array_max(own), F.lit(1)).alias("max_line_chars"),
        F.greatest(total / F.size(own), F.lit(1.0)).alias("avg_line_chars"),
        total.alias("total_chars"),
    )


def safe_name(x: Column) -> Column:
    """A name that files may have, of 80 characters at most; model for an empty one."""
    own = F.regexp_replace(strip(F.coalesce(x, _lit(""))), "[^A-Za-z0-9._-]+", "_")
    return F.left(F.when(own == "", _lit("model")).otherwise(own), F.lit(80))


def flat_name(x: Column) -> Column:
    return F.coalesce(F.replace(x, _lit("/"), _lit("_")), _lit("unknown"))


def dataset_name(model: Column) -> Column:
    return F.concat(_lit("dataset_"), safe_name(model), _lit(".json"))


def masked_key(x: Column) -> Column:
    """A key with its middle hidden: two and two characters of a short one, six and six of others."""
    n = F.when(F.length(x) <= 12, 2).otherwise(6)
    return F.when(F.coalesce(x, _lit("")) == "", "").otherwise(F.concat(F.left(x, n), _lit("..."), F.right(x, n)))


def stem(path: Column) -> Column:
    name = F.element_at(F.split(F.replace(path, _lit("\\"), _lit("/")), "/", -1), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def ratio_of(path: Column) -> Column:
    """The ratio that a page's file name carries, 1 without one."""
    own = F.replace(strip(F.regexp_extract(stem(path), "(?s)_ratio(.*)$", 1)), _lit("_"), _lit("."))
    return F.coalesce(own.try_cast("double"), F.lit(1.0))


def page_of(path: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(stem(path), r"page_(\d+)", 1), _lit("")).try_cast("int"), F.lit(0))


def code_of(path: Column) -> Column:
    """The folder two above a page's file; null of a shorter path."""
    return F.try_element_at(F.split(F.replace(path, _lit("\\"), _lit("/")), "/", -1), F.lit(-3))


def is_image(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(png|jpg|jpeg|webp)$")


def data_url(path: Column, content: Column) -> Column:
    kind = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    mime = F.when(kind.isin("jpg", "jpeg"), "image/jpeg").when(kind == "webp", "image/webp").otherwise("image/png")
    return F.concat(_lit("data:"), mime, _lit(";base64,"), F.regexp_replace(F.base64(content), "[\r\n]", ""))


def ratio_label(x: Column) -> Column:
    """1x, 1.5x: no fraction where there is none."""
    return F.concat(_lit("ratio_"), F.regexp_replace(x.cast("string"), r"\.0$", ""), _lit("x"))
