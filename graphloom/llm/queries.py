"""Queries of the text and vector problems."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..sources.tables import table
from . import bpe, mixing, provenance, similar, truncation

REGISTRY = Registry()
query = REGISTRY.query


@query("p1_found")
def p1_found(spark, d):
    """Pairs of the most similar vectors."""
    return similar.similar_pairs(table(spark, d, "nodes"))


@query("p1_recall")
def p1_recall(spark, d):
    """Recall of the index against brute force."""
    return similar.recall_report(table(spark, d, "nodes"))


@query("p4_found")
def p4_found(spark, d):
    """Files that nobody wrote by hand here."""
    return provenance.label_files(table(spark, d, "source_files")).where("label <> 'handwritten'").select("repo_id", "file_path")


@query("p7_ids")
def p7_ids(spark, d):
    return bpe.encode_documents(table(spark, d, "documents"))


@query("p7_tokens_by_source")
def p7_tokens_by_source(spark, d):
    """Documents, characters and tokens of each source."""
    docs = table(spark, d, "documents").select("source", F.length("text").alias("n"), bpe.token_count(F.col("text")).alias("t"))
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.coalesce("n", F.lit(0))).cast("long").alias("n_chars"), F.sum("t").alias("n_tokens"))


@query("p9_found")
def p9_found(spark, d):
    return truncation.cut_texts(table(spark, d, "documents")).select("doc_id")


@query("p9_rates")
def p9_rates(spark, d):
    return truncation.cut_rates(table(spark, d, "documents"))


@query("p8_selection")
def p8_selection(spark, d):
    """The documents of the mix and how often each is used."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@query("p8_shares")
def p8_shares(spark, d):
    """Target and reached share of each source."""
    return mixing.mix_shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))
