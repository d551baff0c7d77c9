"""From raw documents to token files: five stages, each an operator of boxsift.llm on all that its predecessor kept.

run() writes what a stage returns as Parquet into the shared folder and reads it again as the next stage's input, so a
lost executor costs a task and never a stage.

Defined results, over all stages: a document with a null or empty text leaves in the first stage; rows with a null doc_id
that pass it stay through the second and third and are mixed each on its own; of rows that share a doc_id the one with the
smallest text goes on from the second stage, one of equals; a null source is a source; ties are broken as each operator
states; an empty table gives no rows. All stages but the last return the columns they were given, whatever their names;
the last returns doc_id, start, n_tokens and ids_crc32.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boxsift.llm import decontamination, mixing, ngram_join, quality_rules, token_output
from boxsift.llm.common import shared_dir, table, token_file

END_ID = 2


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; repeated rows are judged alike, each on its own."""
    return quality_rules.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, Jaccard of 0.8 or more, smallest doc_id. A document
    without a word is in no group."""
    return ngram_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark; with an empty benchmark all of them. Rows of one doc_id go together."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, 3 times at most; one without words is not taken."""
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending doc_id order, and what they hold of each document: doc_id, start, n_tokens, ids_crc32."""
    path = shared_dir(spark, "pipeline-tokens")
    token_output.write_tokens(docs, path, token_file("word_bpe_49k.json"), end_id=END_ID, by_word=True)
    return token_output.checksums(token_output.read_tokens(spark, path))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix),
    ("token output", tokens),
]
#: Latent semantic retrieval and tokenizing have no SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_dir(spark, f"pipeline-{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
