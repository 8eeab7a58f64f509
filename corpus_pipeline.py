"""A training corpus from raw documents: known language, one of each near-copy group, no benchmark text, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagekin.llm import decontaminate, jaccard_join, language_id
from stagekin.llm.common import written
from stagekin.llm.queries import byte_tokens, held_out

#: A document goes if it has no letters or its language's mean probability is below this.
LEAST_SCORE = 0.35
#: Near copies share this many hundredths of their sets of runs of so many words.
WORDS, SIMILAR = 5, 80


def known_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Columns of the documents pass unchanged, whatever their names are."""
    learned = language_id.fitted(docs.filter(~held_out(docs)))
    told = language_id.predicted(docs.select(F.struct("*").alias("row"), "text"), learned)
    return told.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, width=WORDS, similar=SIMILAR)


def without_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def tokenized(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, the ids (little-endian unsigned 32-bit) and digests of ids and decoded bytes."""
    return byte_tokens(docs).select(
        "doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", known_language), ("jaccard_join", one_of_each_group),
          ("decontamination", without_benchmark), ("byte_bpe", tokenized)]

#: SQL can express neither the network, nor the walks, nor the merges; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """Each stage is written as Parquet and reread as the documents of the next."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, folder), f"stage-{name}")
    return docs


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return run(spark, folder).drop("ids")
