"""A training corpus from ``documents`` in five stages, each written as Parquet and read again as the next one's input.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of documents:

1. quality classifier: documents that it rejects go;
2. n-gram Jaccard join: of each group of near duplicates (five-word shingles, similarity 0.8 or more) one document stays,
   the one with the smallest doc_id (those without come last, then the smallest hash of the text counts);
3. benchmark decontamination: documents that hold a benchmark item go;
4. PII: found spans are replaced by their kind in angle brackets, n_chars is counted anew;
5. mixing: each document, redacted text and all, with its size, its source's size and target, how many copies of it the corpus
   has (which may be none) and the words that are taken.

Every stage judges a row by its text, so doc_id may be null or shared by several texts. Ties: equal scores are judged alike, of
equal texts one stays, and documents at one place of the mix's order are told apart by their texts. Null and empty texts: the classifier
gives them the score of its bias; they are no near duplicates and hold no item or personal data, and repeated rows of them stay;
their size is 0. Of repeated rows with words the second stage leaves one. Very long texts are treated whole. A table without
rows gives one without rows. Columns other than those of documents are left out; null in lang, source or n_chars stays null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontam, jaccard_join, mix, pii, quality
from weftline.llm.common import stash, table, unstash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.kept(docs.select(*COLUMNS), model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if ids.isEmpty():  # every row has an id of its own: a document stays if it names its component
        groups = jaccard_join.jaccard_components(docs.select("doc_id", "text"), width=5, percent=80)
        first = groups.where("doc_id = component_id").select("doc_id")
        return docs.select(*COLUMNS).join(first, "doc_id", "left_semi").select(*COLUMNS)
    # otherwise rows are numbered, and written so that they keep their numbers
    rows = stash(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")))
    groups = jaccard_join.jaccard_components(rows.select(F.col("row").alias("doc_id"), "text"), width=5, percent=80)
    groups = groups.select(F.col("doc_id").alias("row"), F.col("component_id").alias("c"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "row")
    first = rows.join(groups, "row").groupBy("c").agg(F.min(order).alias("o")).select("o.row")
    return rows.join(first, "row", "left_semi").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs.select(*COLUMNS)).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix.mixed(docs, carry=["text", "lang", "n_chars"])


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: A trained model and BM25 retrieval are not SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        done = stash(stage(spark, docs, sf_dir))
        if k:
            unstash(docs)
        docs = done
    return docs
