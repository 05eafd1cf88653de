"""A corpus pipeline: rules, line dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a
DataFrame that is written as Parquet and read again as the next one's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solvegrid.llm import bpe, common, dartminhash, linededup, mixing, quality, queries


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules or the model's threshold go."""
    return quality.keep_good(docs, quality.fit(docs, common.read(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go, and later copies of long single lines; n_chars follows."""
    return linededup.dedup(docs, alone=linededup.ALONE, length_col="n_chars")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document of smallest id stays."""
    return dartminhash.keep_one(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay as often as the mix takes them."""
    return mixing.apply_mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the token ids and their number, and a hash of the text that they decode to."""
    path = queries._vocabulary()
    ids = bpe.encode_column(docs.select("doc_id", "source", "text"), path)
    return ids.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(bpe.decoder(path)("ids").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality_stage), ("linededup", line_stage), ("minhash", near_stage), ("mixing", mix_stage), ("bpe", token_stage)]

#: The quality model and the merges can't be expressed in SQL; tests compare run() with a brute-force version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
