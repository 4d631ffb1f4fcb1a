"""The operators' registered queries, each over its whole table, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefit.llm.base import documents, table
from sitefit.llm.oracles import ORACLES as ORACLES


def tokenizer_path() -> str:
    """The tokenizer file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    from sitefit.llm.packing import pack

    return pack(documents(spark, folder), tokenizer_path())


def op1_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose 3-word shingle sets are at least 90 % alike, as connected components."""
    from sitefit.llm.jaccard_join import jaccard_components

    return jaccard_components(documents(spark, folder), width=3, num=9, den=10)


def op10_katz(spark: SparkSession, folder: str) -> DataFrame:
    """Log probabilities of all texts under a Katz back-off model of the training texts."""
    from sitefit.llm.katz import katz_scores

    return katz_scores(documents(spark, folder), divisor=7, held=2)


def op8_multiset_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all texts and edited texts, with their likeness."""
    from sitefit.llm.multiset_hash import edited_fingerprints

    return edited_fingerprints(documents(spark, folder))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base measures and the verdict of risk-controlled cutoffs for all documents."""
    from sitefit.llm.quality_rules import judged

    return judged(table(spark, folder, "documents"), table(spark, folder, "labels"), stratum="lang")


def op4_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and matched license templates of all documents."""
    from sitefit.llm.licenses import scan

    return scan(documents(spark, folder))


def op7_knn_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of all documents by votes of their nearest labelled neighbours."""
    from sitefit.llm.knn_quality import scores

    return scores(documents(spark, folder), table(spark, folder, "labels"), divisor=5, held=0)


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of all documents from a learned lexicon with misspellings."""
    from sitefit.llm.toxicity import scores

    return scores(documents(spark, folder), table(spark, folder, "labels"), divisor=4, held=2)


def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate strings and secrets of all documents, after a random forest."""
    from sitefit.llm.secret_scan import counted

    return counted(table(spark, folder, "documents").select("doc_id", "text", "source"))


def domain_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The labelled table for mixing: the language of the documents that `labels` covers."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return docs.select("doc_id", F.col("lang").alias("domain")).join(labels.select("doc_id"), "doc_id", "left_semi")


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Rates of all documents that bring the domains' expected tokens to smoothed shares."""
    from sitefit.llm.mixing import rates

    return rates(documents(spark, folder), domain_labels(spark, folder), power=0.8, most=1.0)


def op11_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five best inner products of every 50th vector, from vector-approximation files."""
    from sitefit.llm.exact_topk import top_k

    return top_k(table(spark, folder, "embeddings"), k=5, scale=256, every=50)


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Codes and errors of all vectors under four fitted codebooks."""
    from sitefit.llm.vector_codes import codes

    return codes(table(spark, folder, "embeddings"), scale=1024)


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """Each language's best-scoring phrases over all texts."""
    from sitefit.llm.collocations import collocations

    return collocations(table(spark, folder, "documents"), longest=5, least=100, top=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_jaccard_join, op2_secret_scan, op3_mixing, op4_licenses, op5_toxicity, op6_packing, op7_knn_quality, op8_multiset_hash, op9_quality_rules, op10_katz,
                                                                                          op11_exact_topk, op12_vector_codes, op13_collocations)}
