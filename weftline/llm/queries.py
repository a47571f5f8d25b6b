"""One query for each operator, over its whole table, and the DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import centroids, decontam, html_extract, jaccard_join, line_clean, mix, oracles, phrases, pii, quality, secrets, tool_calls, url_filter, whitening
from .common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = url_filter.url_filter(pages, url_filter.rule_table(spark, url_filter.RULES))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of each conversation as calls and results (``from_turns``), linked."""
    turns = tool_calls.from_turns(table(spark, sf_dir, "conversations"))
    return tool_calls.link_tool_calls(turns, tool_calls.tool_table(spark, tool_calls.TURN_TOOLS))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")).select("doc_id", "spans"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, percent=90)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_clean.line_clean(docs).drop("text")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings")).drop("scanned")


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_secret_scan, op3_url_filter, op4_tool_calls, op5_decontaminate, op6_pii, op7_mix_sources,
        op8_ngram_jaccard_join, op9_html_extraction, op10_quality_rules, op11_embedding_whitening, op12_centroid_clustering,
        op13_document_fingerprints,
    )
}
ORACLES = oracles.ORACLES
