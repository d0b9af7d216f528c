"""The corpus pipeline: toxicity, language, near duplicates, contamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; all but the last return the columns they were given. Null and empty
texts, null and repeated ids, repeated rows, very long texts and columns with
other names go through each stage as its operator's docstring says; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, langid, packing, similar, tokens, toxicity
from corpusloom.llm.common import fold, load, materialize, release


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more; learns from the labels of all but a fifth of the ids."""
    labels = load(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0).select("doc_id", F.col("toxic").alias("label"))
    return toxicity.keep_civil(docs, toxicity.train(docs, labels))


def reject_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those whose language is a toss-up or unknown, by a least score learnt from held-out documents; learns from the documents' own lang."""
    return langid.keep_identified(docs, langid.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) keeps the document of the smallest id.

    Candidates are SimHash fingerprints linked by Golay-code keys, and minima of shingle sets; each is verified exactly.
    """
    return similar.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.keep_uncontaminated(docs, load(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document, with its place in the packed sequences."""
    return packing.pack(docs, tokens.default_path())


STAGES = [
    ("toxicity", reject_toxic),
    ("language", reject_unidentified),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
#: SQL can't express the classifiers, the hashes and the tokenizer; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        release(before)
    return docs
