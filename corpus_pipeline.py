"""A training-data pipeline over `documents`: judge, deduplicate, redact, mix, pack.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame; all but the last return
the columns of `documents`. Labels come from `labels` in `sf_dir`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sitefit.llm.base import table
from sitefit.llm.catalog import domain_labels, tokenizer_path
from sitefit.llm.jaccard_join import keep_first
from sitefit.llm.mixing import thinned
from sitefit.llm.packing import pack
from sitefit.llm.quality_rules import keep_good
from sitefit.llm.secret_scan import redacted
from sitefit.session import scratch_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their stratum's proven cutoff reject go."""
    return keep_good(docs, table(spark, sf_dir, "labels"), stratum="lang")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, a similarity of 0.8 or more."""
    return keep_first(docs, width=5, num=4, den=5)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; every document stays."""
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled at the rates that bring the languages' expected tokens to smoothed shares."""
    return thinned(docs, domain_labels(spark, sf_dir), power=0.8)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, in sequences of at most 1024 tokens."""
    return pack(docs, tokenizer_path())


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", jaccard_join), ("secret scans", secret_scan), ("mixing sources to target weights", mixing),
          ("packing", packing)]

#: SQL can express neither the joins' hashes nor the models; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in their order, each written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{scratch_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
