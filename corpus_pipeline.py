"""Corpus pipeline: documents through five stages, each written as Parquet and read again by the next.

1. language: documents without a language (no letter, or no language above ``MIN_LANG_SCORE``) go;
2. duplicates: one document of each group of SimHash near-duplicates stays, that with the least id;
3. benchmark: documents that hold a copy or edited copy of a benchmark item go;
4. private: personal data and terms that disclose it are generalised or removed from the texts;
5. mix: every document is emitted as often as its source's repetition rate says, with its copy number.

Stages 1 to 4 return the columns of documents; the last adds ``copy`` (``copy_1`` and so on, if the documents have
that name).  Every stage packs the row it was given and hands on that row, so columns of any other names pass
unchanged, whatever the operators call their own.

Defined cases: null or empty texts have no language and go in the first stage, and stay in the others; repeated rows are
duplicates of each other, one of them stays; rows of one id with other texts are told apart by their texts; ties between
duplicates go to the least id, then to the least digest of the text; a null id comes last; very long texts are read whole;
a null or unknown source is a source of its own; empty documents or an empty benchmark give empty tables or change nothing.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import decontaminate, langid, mixing, sanitise, simhash
from tallyframe.session import scratch_path

MIN_LANG_SCORE = 0.3


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """The whole rows as ``row`` beside the columns that an operator reads."""
    return docs.select(F.struct("*").alias("row"), *names)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.identify(packed(docs, "doc_id", "text", "lang"))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANG_SCORE)).select("row.*")


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, words=3, radius=2)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = sanitise.sanitise(docs)
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taken = {c.lower() for c in docs.columns}
    name = next(n for k in itertools.count() if (n := f"copy_{k}" if k else "copy") not in taken)
    mixed = mixing.emit(mixing.mix(packed(docs, "doc_id", "text", "source")))
    return mixed.select("row.*", F.col("copy").alias(name))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("duplicates", duplicates), ("benchmark", benchmark), ("private", private), ("mix", mix)]

#: SQL cannot express the stages; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = scratch_path(spark, f"pipeline-{uuid.uuid4()}")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{root}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
