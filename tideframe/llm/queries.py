"""Queries over the driver's tables that apply each operator with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.llm import decontam, jaccard, langid, mixing, pii, repeats, secret_scan, sharding, tokens, vectors

#: The tokenizer's file; a parameter of the operator.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: The mixture: weights by path in the tree, part of all tokens, epochs at most.
MIX_WEIGHTS = {("web",): 0.4, ("forum",): 0.2, ("books",): 0.25, ("code",): 0.15, **{(d, x): w for d in ("web", "forum", "books", "code") for x, w in (("en", 0.55), ("de", 0.15), ("fr", 0.15), ("es", 0.15))}}
#: Key of the pseudonyms over the test tables; real ones come from a secret store.
DEMO_KEY = "tideframe-demo-key"
MIX_FRACTION, MIX_EPOCHS, MIX_SEED = 0.6, 2, 17


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(_table(spark, sf_dir, "documents")))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokenise(_table(spark, sf_dir, "documents"), TOKENIZER)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents").select("doc_id"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"))


def mix_levels() -> list[tuple[str, Column]]:
    """Domain (five sources each; sources of another name are ``other``), language, source."""
    number = F.regexp_extract("source", r"^src(\d+)$", 1).try_cast("int")
    domain = F.when(number < 5, "web").when(number < 10, "forum").when(number < 15, "books").when(number < 20, "code").otherwise("other")
    return [("domain", domain), ("lang", F.col("lang")), ("source", F.col("source"))]


def mixed(docs: DataFrame) -> DataFrame:
    return mixing.mix(docs, mix_levels(), MIX_WEIGHTS, MIX_FRACTION, MIX_EPOCHS, MIX_SEED)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(_table(spark, sf_dir, "documents")).select("doc_id", "mix_leaf", "mix_tokens", "mix_copies")


def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.flag(docs, _table(spark, sf_dir, "benchmark")).drop("text")


def op7_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)


def _op3_sql() -> str:
    table = sharding.lookup_table([f"shard-{i}" for i in range(sharding.SHARDS)])
    return f"""
    WITH lookup AS (SELECT unnest([{",".join(map(str, table))}]) AS shard, generate_subscripts([{",".join(map(str, table))}], 1) - 1 AS slot),
    placed AS (SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT % {sharding.TABLE_SIZE} AS slot FROM documents)
    SELECT doc_id, CAST(slot AS BIGINT) AS slot, CAST(shard AS INTEGER) AS shard FROM placed JOIN lookup USING (slot)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_secret_scan, op2_token_files, op3_sharding, op4_ngram_jaccard, op5_source_mixing, op6_template_decontamination, op7_repeated_strings, op8_language_id, op9_embedding_near_dedup, op10_pii_pseudonyms)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op3_sharding": _op3_sql()}
