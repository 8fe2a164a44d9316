"""Documents to training tokens in five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyhouse.llm import byte_bpe, decontaminate, line_dedup, ngram_join, quality
from tallyhouse.llm.common import Scratch, among, bundled, materialize, table, unbundled


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects.

    A null text is scored as an empty one; rows of one text stand or fall together, whatever their ids. All columns stay as they
    are, whatever they are called; the same holds for the stages below.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return unbundled(quality.scores(bundled(docs), model).where("predicted = 1"), docs.columns)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every line once, or nearly so: texts lose the lines that an earlier one repeats, and documents left without any go.

    Rows without id or text stay as they are, as do texts that had no words before; n_chars, where there is such a column,
    follows what is left.
    """
    rows = line_dedup.deduplicated(bundled(docs), min_words=line_dedup.SHORT_WORDS)
    rows = rows.where((F.col("n_removed") == 0) | F.coalesce(F.trim("text") != "", F.lit(True)))
    if "n_chars" in docs.columns:
        said = F.col("rest.n_chars")
        left = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(said)
        rows = rows.withColumn("rest", F.col("rest").withField("n_chars", left))
    return unbundled(rows, docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word shingles alike to 0.8 or more.

    Rows that repeat an id stay or go together; rows without id, and texts without words, stay.
    """
    scratch = Scratch(spark)
    groups = ngram_join.linked(docs.select("doc_id", "text"), n=5, num=4, den=5)
    gone = scratch.write(groups.where("component_id < doc_id").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    asked, stays = among(scratch, bundled(docs), "doc_id", gone)
    return unbundled(stays.unionByName(asked.join(gone, F.col("doc_id") == F.col("gone"), "left_anti")), docs.columns)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a test item. Null and empty texts hold none, and rows without id are judged like any other."""
    return decontaminate.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number and digest of each document's ids, and the digest of what they decode to: a row for each row, null and empty texts with no ids."""
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", distinct_lines),
    ("n-gram Jaccard join", distinct_documents),
    ("benchmark decontamination", clean_documents),
    ("byte-level BPE encoding and decoding", tokens),
]

#: The classifier and the rank queue have no SQL form; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, "stage")
    return docs
