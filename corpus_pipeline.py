"""The corpus pipeline: stages over ``documents``, each an operator of tideframe.llm.

Documents without a recognisable language go; of each group of near copies the one with the smallest id stays; documents that
hold benchmark items go; the rest is mixed to target weights (by leaving out and repeating documents); what is left
becomes token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideframe.llm import decontam, jaccard, langid, mixing, tokens
from tideframe.llm.common import written
from tideframe.llm.queries import TOKENIZER, mixed

#: Score under which no learned language explains a text: of its n-grams, fewer than this part are known in any.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, or whose n-grams are mostly foreign to every language; the labels are for learning only."""
    found = langid.predict(docs, langid.train(docs), lang_out="__lang", score_out="__score")
    return found.where(f"__lang <> 'und' and __score >= {LEAST_SCORE}").drop("__lang", "__score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.taken(mixed(docs))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.tokenise(docs, TOKENIZER)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mixing),
    ("token-ID / binary output", token_files),
]
#: The learned filter, the Jaccard components and the tokenizer are beyond SQL: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0].lower()}")
    return STAGES[-1][1](spark, docs, sf_dir)
