"""The corpus pipeline: rules, classifier, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns
of ``documents``.  Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import decision_list, mixing, ngram_join, packing, pu_quality
from quillgraph.session import shared_dir
from quillgraph.sources.tables import read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned decision list keeps."""
    rules = decision_list.fit(docs, read_table(spark, sf_dir, "labels"))
    judged = decision_list.apply_rules(_boxed(docs), rules)
    return judged.filter("kept").select("_row.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.7."""
    weights = pu_quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return pu_quality.scored(_boxed(docs), weights).filter("score >= 0.7").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.keep_first(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights; a document may be there up to three times."""
    return mixing.mix(docs).select(*docs.columns)


def length_buckets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their length bucket and batch."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", source_mix),
    ("packing", length_buckets),
]

#: learned rules and weights have no SQL form; tests hold the stages against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        rows = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return rows
        rows.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs


def _boxed(docs: DataFrame) -> DataFrame:
    """Rows kept whole beside the columns a stage reads, so that no column name can clash."""
    return docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text")
