"""From raw documents to packed training sequences: quality rules, toxicity, near-duplicates, packing.

Each stage reads what the one before it wrote and judges only that.  `run` writes the tables between
the stages to the folder that ``spark.checkpoint.dir`` names.

Null and empty texts have too few words and go in the first stage; equal texts and repeated rows are one
group, of which the row with the smallest doc_id stays (nulls last; of equal rows one).  Rows with a null
doc_id, lang or source are judged like others.  Columns beside those of documents stay as they are until
packing, whatever their names.  Without labels no document is toxic; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagloom.llm import near, packing, quality, toxic
from tagloom.llm.staging import staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fences of their language and source."""
    return quality.keep_good(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a machine trained on the labelled ones among them does not call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxic.keep_clean(docs, toxic.learn(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    return near.first_of_each(docs, width=5, percent=80)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in training sequences."""
    return packing.packed(docs)


STAGES = [("quality_rules", quality_rules), ("toxicity", toxicity), ("near_dedup", near_dedup), ("best_fit_packing", best_fit_packing)]

#: scores of a trained machine are not expressible in SQL; tests/llm compares with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = staged(docs)
    return docs
