"""From raw documents to training windows: five stages, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm.common import release, written
from skarn.llm.decontamination import decontaminate
from skarn.llm.langid import UNKNOWN, identify, learn, least_cosine
from skarn.llm.line_dedup import dedup_lines
from skarn.llm.packing import pack_documents
from skarn.llm.simhash import first_rows

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Length of the language stage's vectors: wide enough for short texts of a language to stand out of the noise.
LANGUAGE_DIM = 2048


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in a language that the labelled ones teach; ``lang`` becomes what the text says.

    A text without a letter, or whose highest cosine with a language doesn't stand out of the noise, goes:
    other scripts, random letters, and single words too short or too rare to tell.
    """
    found = identify(docs, learn(docs, dim=LANGUAGE_DIM), dim=LANGUAGE_DIM, keep=("doc_id", "text", "lang", "source", "n_chars"))
    kept = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_cosine(LANGUAGE_DIM)))
    return kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps each near-duplicate line at its first place; documents left without text go."""
    out = dedup_lines(docs.select(COLUMNS))
    out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.where(F.trim("text") != "").select(COLUMNS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps exactly one row of each group of near-duplicates, that with the smallest doc_id.

    A null doc_id comes after all others; of rows with the same doc_id in a group that with the
    smallest hash stays.  Rows of different groups that share a doc_id, or have none, stay each.
    """
    return first_rows(docs.select(COLUMNS)).select(COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that leak no benchmark item."""
    return decontaminate(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training windows: a row for each piece of a document, with its token ids."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: No SQL expresses these stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written once to the shared folder, as it is read several times by the next."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if held is not None:
            release(held)
        held = docs
    return STAGES[-1][1](spark, docs, sf_dir)
