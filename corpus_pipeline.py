"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

1. language ID: documents without a language (null or no letter) or with a score below ``MIN_SCORE`` go.
2. SimHash near-dedup: of each component of fingerprints the document with the smallest id stays.
3. benchmark decontamination: passages of test items are cut out; documents that mostly consist of them go.
4. mixing: sources are repeated or thinned out to their target weights.
5. token-ID / binary output: the rest as framed records; the result is what the files hold.

A stage takes (spark, docs, sf_dir), works on all of ``docs`` and, but for the last, returns the columns of ``docs``. Empty input
passes every stage; null texts end in the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wastelens.llm import common, decontaminate, language, mixture, simhash, token_binary

MIN_SCORE = 0.4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(language.training_rows(docs))
    lang, score = common.fresh(docs.columns, "_lang"), common.fresh(docs.columns, "_score")
    found = language.identified(docs, model, lang, score)
    return found.filter((F.col(lang) != language.UNKNOWN) & (F.col(score) >= MIN_SCORE)).drop(lang, score)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.cleaned(docs, common.table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture.repeated(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_binary.token_records(docs)


STAGES = [
    ("language ID", language_stage), ("SimHash near-dedup", near_duplicate_stage), ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage), ("token-ID / binary output", token_stage)]
ORACLE_SQL = None  # a trained model, fingerprints and a tokenizer are not SQL; tests/llm/test_pipeline.py has the brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.cut_lineage(stage(spark, docs, sf_dir), name.split()[0].replace("/", "-"))
    return docs
