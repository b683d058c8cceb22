"""A corpus pipeline of five of the training-data operators, one DataFrame in and out of each stage.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir). The result of a stage is written as
Parquet and read again as the next one's documents; all but the last return the columns of ``documents``.

1. ``language_id``: drops documents without a language (no letters, null text) or unlike every profile
   (``MIN_LANGUAGE_SCORES``; below 20 letters chance and language scores overlap, so such texts stay).
2. ``near_dedup``: of each group of near duplicates (``NEAR_PERCENT`` of the five-word shingles) the smallest doc_id
   stays (documents that share an id stay or go together; documents without words or without an id stay).
3. ``decontaminate``: drops documents that hold a passage of the benchmark.
4. ``mix``: a document comes as often as the mix takes it (0 to 3 times, rounded to whole documents).
5. ``token_blocks``: the shards of token ids, read back: one row a document in the stream's order.

Columns that documents have beyond the known ones pass through; their names never clash with the stages' own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprep.llm.base import fresh, ship_package, stage
from tableprep.llm.decontaminate import find_leaks
from tableprep.llm.hyperminhash import near_duplicates
from tableprep.llm.langid import UNKNOWN, fold, learn_profiles, predict
from tableprep.llm.mixing import mix_sources
from tableprep.llm.token_blocks import encode_documents

MIN_LANGUAGE_SCORES = ((320, 0.32), (20, 0.40), (0, 0.02))  # (letters, least score): between chance and real texts
NEAR_PERCENT = 80          # shared of all shingles of two documents, of 100; the query op3 has 85 of its own
ORACLE_SQL = None          # profiles, sketches and the tokenizer are beyond SQL; tests compare with brute force


def _by_id(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on doc_id (null ids are equal), whatever other columns there are."""
    key = fresh(docs, "key")
    right = ids.select(F.col("doc_id").alias(key))
    return docs.join(right, F.col("doc_id").eqNullSafe(F.col(key)), how)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    profiles = learn_profiles(docs.where(fold("doc_id") != 0))
    p = fresh(docs, "prediction")
    known = docs.withColumn(p, predict(profiles, F.col("text")))
    least = F.lit(None)
    for letters, score in reversed(MIN_LANGUAGE_SCORES):
        least = F.when(F.col(f"{p}.letters") >= letters, F.lit(score)).otherwise(least)
    return known.where((F.col(f"{p}.lang") != UNKNOWN) & (F.col(f"{p}.score") >= least)).drop(p)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    gone = near_duplicates(docs, percent=NEAR_PERCENT).where("not kept").select("doc_id").distinct()
    return _by_id(docs, gone, "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    leaks = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _by_id(docs, leaks.select("doc_id").distinct(), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    table, _ = mix_sources(docs)
    key, n = fresh(docs, "key"), fresh(docs, "times")
    times = table.groupBy(F.col("doc_id").alias(key)).agg(
        F.round(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).cast("int").alias(n)).where(F.col(n) > 0)
    rows = docs.join(times, F.col("doc_id").eqNullSafe(F.col(key))).drop(key)
    return rows.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(n)


def token_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers
    ship_package(spark)
    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix),
          ("token_blocks", token_blocks)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
