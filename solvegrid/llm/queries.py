"""The queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, dartminhash, linededup, mixing, packing, quality, substring, topk, toxicity
from .common import read

#: A parameter: the vocabulary file's path on driver and executors.
VOCABULARY, RANKS = "word_bpe_49k.json", "byte_bpe_50k.tiktoken"


def _vocabulary() -> str:
    return public_tokenizers.path(VOCABULARY)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.classes(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.annotate(docs, model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), F.col("__toxicity.score").alias("score"), F.when(F.col("__toxicity.score") >= toxicity.PREDICT_AT, 1).otherwise(0).alias("predicted"), F.col("__toxicity.segments").alias("segments"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", bpe.digests(_vocabulary())(F.col("text")).alias("d")).select("doc_id", "d.*")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.packed(read(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return rows.select("shard", "row", "n_tokens", "doc_ids", "doc_offsets", "cu_seqlens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op6_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digests(read(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(read(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digests(chat.conversations(turns.unionByName(own)))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.annotate(docs, quality.fit(docs, read(spark, sf_dir, "labels")))
    q = "__quality"
    return judged.select("doc_id", *[f"{q}.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept")])


QUERIES = {f.__name__: f for f in (op1_minhash, op2_toxicity, op3_bpe, op4_packing, op5_mixing, op6_linededup, op7_topk, op8_substring, op9_chat, op10_quality)}
ORACLES = {"op5_mixing": mixing.SQL, "op6_linededup": linededup.SQL, "op7_topk": topk.SQL, "op8_substring": substring.SQL}
