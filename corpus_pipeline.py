"""The corpus pipeline: each stage calls one of the corpus operators, and works on all that its predecessor kept.

Stages take any columns beside doc_id and text, whatever their names, and all but the last give them back. An empty table
gives an empty table. Null texts count as empty, and texts of any length are judged whole. Rows that repeat, or share an
id, or have none, are rows of their own; what a stage does with ties is said there. Each stage gives memory back that the driver
no longer uses.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscribe.llm import best_fit_packing, decontaminate, pii, simhash, toxicity
from veriscribe.llm.common import materialise, nested, shared_dir, table, tidy


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, scores under one half; a score of one half goes.

    Empty and null texts get the score of a text without words. Equal texts get one score, so repeated rows stay or go together.
    """
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    tidy(spark)
    return toxicity.with_score(nested(docs), model).where("score < 0.5").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints, the document with the smallest id.

    Of rows that share that id, the first written; rows without an id go for any that has one. All empty and null texts
    are one component, as their fingerprint is one.
    """
    tidy(spark)
    prints = simhash.with_fingerprint(nested(docs)).withColumn("n", F.monotonically_increasing_id())
    rows = materialise(prints.select("row", "fp", "n"))
    named = simhash.components(rows.select(F.col("row.doc_id").alias("doc_id"), "fp"))
    least = rows.groupBy("fp").agg(F.min(F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("id"), "n")).alias("first"))
    kept = least.join(named, "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.n").alias("n"))
    return rows.join(kept, "n", "left_semi").select("row.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; null and empty texts have none and stay."""
    tidy(spark)
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("spans") == 0).select("row.*")


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets; n_chars, if there is one, follows the text.

    Null texts stay null. Of spans that overlap, the first to start names the replacement.
    """
    tidy(spark)
    found = pii.personal_data(docs)
    tidy(spark)
    old = F.col("row").getField("text")
    text = F.when(F.size("all_spans") > 0, pii.redacted(old, F.col("all_spans"))).otherwise(old)
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document, with its place in a sequence; null and empty texts give a piece of the end token."""
    tidy(spark)
    return best_fit_packing.pack(docs)


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("personal_data", private),
    ("packing", packed),
]

#: A classifier decides, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    home = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{home}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
