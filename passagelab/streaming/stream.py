"""Documents that arrive: the same strategies over a stream, and running statistics of their chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagelab.functions.judges import HeuristicJudge, Judge
from passagelab.operators.strategies import Strategy, chunk_rows
from passagelab.schema import STRUCTURE


def read_documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string", files_per_trigger: int | None = None) -> DataFrame:
    """A stream of Parquet files of documents, with an empty structure and the time of their arrival (`seen`)."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    docs = reader.parquet(path)
    return docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("structure", F.lit(None).cast(STRUCTURE)).withColumn("seen", F.current_timestamp())


def chunk_stream(docs: DataFrame, strategy: Strategy, judge: Judge | None = None) -> DataFrame:
    """(doc_id, seen, strategy_id, chunk fields) of a stream. Strategies work row by row, so there is no state; judges that join answers back need foreachBatch."""
    return chunk_rows(strategy.apply(docs, judge or HeuristicJudge()), "doc_id", "seen", "strategy_id")


def chunk_counts(chunks: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(window, strategy_id, chunks, avg_tokens) by time of arrival; windows close `late` after their end."""
    timed = chunks.withWatermark("seen", late)
    return timed.groupBy(F.window("seen", window), "strategy_id").agg(F.count("*").alias("chunks"), F.avg("tokens").alias("avg_tokens"))


def write_chunks(chunks: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends chunks to Parquet files, each exactly once, until all that is there is done."""
    return chunks.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
