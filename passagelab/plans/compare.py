"""Running strategies side by side over documents, with a cache of runs."""

from __future__ import annotations

import time
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagelab.functions import text as T
from passagelab.functions.judges import HeuristicJudge, Judge
from passagelab.operators.strategies import REGISTRY, Strategy
from passagelab.schema import CHUNKS

DEFAULTS = ("recursive_semantic", "late")
RUN_COLUMNS = ("doc_id", "strategy_id", "requested_strategy_id", "config_hash", "api_call_count", "estimated_cost", "duration_ms", "error", "chunks")


def run_one(docs: DataFrame, strategy: Strategy, judge: Judge | None = None) -> DataFrame:
    """One row for each document: RUN_COLUMNS. docs: (doc_id, text, structure)."""
    judge = judge or HeuristicJudge()
    done = strategy.apply(docs, judge)
    key = T.cache_key(strategy.id, strategy.config(), judge.name, F.col("text"), F.col("structure"))
    usd = T.tokens_to_usd(F.col("tokens_in"), F.col("tokens_out"), *judge.usd)
    return done.select("doc_id", "strategy_id", "requested_strategy_id", key.alias("config_hash"), F.col("api_calls").alias("api_call_count"), usd.alias("estimated_cost"), F.lit(None).cast("long").alias("duration_ms"), F.lit(None).cast("string").alias("error"), "chunks")


def run_all(docs: DataFrame, strategies: Sequence[Strategy], judge: Judge | None = None) -> DataFrame:
    """All strategies' runs in one table; the documents are read once for each."""
    return reduce(DataFrame.unionByName, [run_one(docs, s, judge) for s in strategies])


def run_cached(docs: DataFrame, strategy: Strategy, path: str, judge: Judge | None = None) -> DataFrame:
    """Runs of `run_one`, of which those that a table at `path` has are not made again; new ones are appended.

    Whatever decides a result is part of the key: text, structure, settings and judge. A run that fails as a whole
    gives a row with the error for each of its documents, which is not kept.
    """
    spark = docs.sparkSession
    judge = judge or HeuristicJudge()
    keyed = docs.withColumn("_key", T.cache_key(strategy.id, strategy.config(), judge.name, F.col("text"), F.col("structure")))
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)
    todo = keyed.join(spark.read.parquet(path).select(F.col("config_hash").alias("_key")), "_key", "left_anti") if exists else keyed
    began = time.time()
    try:
        fresh = run_one(todo.drop("_key"), strategy, judge)
        fresh.dropDuplicates(["config_hash"]).withColumn("duration_ms", F.lit(int((time.time() - began) * 1000)).cast("long")).write.mode("append").parquet(path)
    except Exception as error:
        failed = todo.select("doc_id", F.lit(strategy.id).alias("strategy_id"), F.lit(strategy.id).alias("requested_strategy_id"), F.col("_key").alias("config_hash"), F.lit(0).alias("api_call_count"), F.lit(0.0).alias("estimated_cost"))
        return failed.withColumn("duration_ms", F.lit(None).cast("long")).withColumn("error", F.lit(str(error)[:500])).withColumn("chunks", F.array().cast(CHUNKS))
    kept = spark.read.parquet(path).drop("doc_id")
    return keyed.select("doc_id", F.col("_key").alias("config_hash")).join(kept, "config_hash").select(*RUN_COLUMNS)


def unused(spark, used: DataFrame) -> DataFrame:
    """Registered strategies (strategy_id, label) that `used` (strategy_id) does not have."""
    known = spark.createDataFrame([(k, s.label) for k, s in REGISTRY.items()], "strategy_id string, label string")
    return known.join(used.select("strategy_id").distinct(), "strategy_id", "left_anti")


def run_profile(runs: DataFrame) -> DataFrame:
    """Chunks, calls, time and cost of each run."""
    return runs.select("doc_id", "strategy_id", F.size("chunks").alias("chunk_count"), "api_call_count", "duration_ms", F.round("estimated_cost", 4).alias("estimated_cost"))
