"""The functions under names that SQL can call."""

from __future__ import annotations

from pyspark.sql import SparkSession

from veriscribe.functions import layout as L
from veriscribe.functions import metrics as M

#: Name, parameters and body of the SQL functions.
SQL_FUNCTIONS = [
    ("image_tokens", "w INT, h INT", "CAST(floor((w / 16 * (h / 16)) / 4) AS INT)"),
    ("token_ratio", "pages INT, tokens INT, target DOUBLE", "CASE WHEN target <= 0 THEN 999.0D ELSE pages * tokens / target END"),
    ("ratio_label", "r DOUBLE", r"concat('ratio_', regexp_replace(CAST(r AS STRING), r'\.0$', ''), 'x')"),
    ("count_of", "x STRING, p STRING", "CAST((length(x) - length(replace(x, p, ''))) / length(p) AS INT)"),
    ("short_cer", "a STRING, b STRING", "CASE WHEN length(a) = 0 THEN CASE WHEN length(b) = 0 THEN 0.0D ELSE 1.0D END ELSE levenshtein(a, b) / length(a) END"),
    ("text_tokens", "x STRING", r"regexp_extract_all(x, r'([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}])', 1)"),
]


def _band(bands: list[tuple[float | None, float]]) -> str:
    return "CASE " + " ".join(f"WHEN target < {bound} THEN {value}D" for bound, value in bands[:-1]) + f" ELSE {bands[-1][1]}D END"


#: Name, parameters, columns and body of the SQL table functions: a text's pages of wrapped rows, and the layouts in a token band.
TABLE_FUNCTIONS = [
    (
        "text_pages",
        "x STRING, across INT, down INT",
        "page INT, page_rows ARRAY<STRING>",
        "SELECT p, slice(r, (p - 1) * down + 1, down) FROM (SELECT r, explode(sequence(1, greatest(1, CAST(ceil(size(r) / down) AS INT)))) AS p FROM (SELECT flatten(transform(split(x, '\\n', -1),"
        " l -> transform(sequence(0, greatest(0, CAST(ceil(length(l) / across) AS INT) - 1)), i -> substr(l, i * across + 1, across)))) AS r))",
    ),
    (
        "layout_sizes",
        "target DOUBLE",
        "resolution INT, pages INT, tokens INT",
        "SELECT res, p, p * per FROM (SELECT res, per, explode(sequence(low, high)) AS p FROM (SELECT res, per,"
        f" CAST(greatest(1, ceil(target * {_band(L.LOWEST)} / per)) AS INT) AS low, CAST(least(100, floor(target * {_band(L.HIGHEST)} / per)) AS INT) AS high"
        " FROM (SELECT res, image_tokens(res, res) AS per FROM (SELECT explode(sequence(112, 4480, 112)) AS res))) WHERE low <= high)",
    ),
]


def register(spark: SparkSession) -> None:
    for name, parameters, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURN {body}")
    for name, parameters, columns, body in TABLE_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}")
    spark.udf.register("edit_distance", M._distance)
    spark.udf.register("wer", M.wer)
    spark.udf.register("token_scores", M.token_scores)
    spark.udf.register("line_diff", M.line_diff)
    spark.udf.register("ast_parsable", M.ast_parsable)
