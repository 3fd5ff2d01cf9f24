"""Deterministic pairs of references and flawed hypotheses made of a table of documents, for tests and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriscribe.functions.layout import RATIOS

#: Bytes for each core below which a table is dealt anew.
PART = 32 << 20
EXTRA_NAMES, EXTRA_LINE = "alpha_new = beta_new + gamma_new", "this_line_was_never_in_the_source = 12345"


def spread(docs: DataFrame) -> DataFrame:
    """(doc_id, text), dealt to all cores where the table is too small to be read in enough parts.

    A small Parquet file has one row group, which one task reads however many splits are asked for, and scoring costs far
    more than reading. Tables of more bytes than PART for each core are left as they are read: nothing is shuffled there.
    """
    narrow, cores = docs.select("doc_id", "text"), docs.sparkSession.sparkContext.defaultParallelism
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return narrow.repartition(2 * cores, F.xxhash64("doc_id", "text")) if size < PART * cores else narrow


def pairs(docs: DataFrame) -> DataFrame:
    """(code_id, doc_id, ratio, reference, hypothesis): the ratio and the flaw follow from the id; empty texts are left out."""
    docs = spread(docs)
    text, kind = F.col("text"), F.pmod("doc_id", F.lit(8))
    lines = F.split(text, "\n", -1)
    last = F.element_at(lines, -1)
    fifth = F.array_join(F.filter(lines, lambda x, i: (i + 1) % 5 != 0), "\n")
    hyp = (
        F.when(kind == 0, F.replace(text, F.lit("l"), F.lit("1")))
        .when(kind == 1, F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("")))
        .when(kind == 2, F.concat(F.lit("    "), F.replace(text, F.lit("\n"), F.lit("\n    "))))
        .when(kind == 3, fifth)
        .when(kind == 4, F.concat(text, F.lit("\n" + EXTRA_NAMES)))
        .when(kind == 5, F.concat(text, F.lit("\n" + EXTRA_LINE)))
        .when(kind == 6, F.concat_ws("\n", text, last, last, last))
        .otherwise(text)
    )
    ref = F.when(kind == 7, F.concat(text, F.lit("\n# note "), F.col("doc_id").cast("string"))).otherwise(text)
    ratio = F.array(*[F.lit(r) for r in RATIOS])[F.pmod("doc_id", F.lit(len(RATIOS))).cast("int")]
    return docs.where("text is not null and text <> ''").select(F.col("doc_id").cast("string").alias("code_id"), "doc_id", ratio.alias("ratio"), ref.alias("reference"), hyp.alias("hypothesis"))
