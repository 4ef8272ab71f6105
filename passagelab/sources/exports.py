"""Results as JSON, CSV and Markdown lines.

CSV and JSON rows are made where the rows are; a report is a table of a few lines for each strategy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagelab.functions import text as T

CSV_HEADER = "strategy,chunk_index,tokens,self_containedness_score,boundary_score,text"


def csv_rows(chunks: DataFrame, metrics: DataFrame, key: tuple[str, ...] = ("doc_id", "strategy_id")) -> DataFrame:
    """Chunks with their run's scores (3 digits, empty if there are none) and their text on one line as a JSON string.

    metrics: one row for each key; the scores are rounded on that side, before the join.
    """
    score = lambda c: F.coalesce(T.to_fixed(F.col(c), 3), F.lit("")).alias(c)
    scored = metrics.select(*key, score("avg_self_containedness"), score("avg_boundary_coherence"))
    quoted = F.to_json(F.struct(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")).alias("t")))
    joined = chunks.join(scored, list(key), "left")
    empty = lambda c: F.coalesce(c, F.lit(""))
    return joined.select(*key, F.col("index").alias("chunk_index"), "tokens", empty("avg_self_containedness").alias("self_containedness_score"), empty("avg_boundary_coherence").alias("boundary_score"), _inside(quoted).alias("text"))


def _inside(quoted):
    """The string of {"t":"…"} with its quotes."""
    return F.substring(quoted, F.lit(6), F.length(quoted) - 6)


def csv_lines(rows: DataFrame) -> DataFrame:
    """One line for each row of csv_rows; the header is CSV_HEADER."""
    return rows.select(F.concat_ws(",", "strategy_id", "chunk_index", "tokens", "self_containedness_score", "boundary_score", "text").alias("value"))


def write_csv(rows: DataFrame, path: str) -> None:
    """A folder of files, each with the header line first."""
    import pyspark.sql.types as types

    schema = types.StructType([types.StructField("value", types.StringType())])

    def with_header(frames):
        import pandas as pd

        yield pd.DataFrame({"value": [CSV_HEADER]})
        yield from frames

    csv_lines(rows).mapInPandas(with_header, schema).write.text(path)


def json_object(chunk_results: DataFrame, eval_results: DataFrame, query_results: DataFrame) -> DataFrame:
    """One row with one object {chunkResults, evalResults, queryResults}, for a selection that is meant to be read by people.

    Fields that are null are left out. For whole corpora use write_json.
    """
    listed = lambda df, name: df.agg(F.collect_list(F.struct("*")).alias(name))
    one = listed(chunk_results, "chunkResults").join(listed(eval_results, "evalResults"), how="cross").join(listed(query_results, "queryResults"), how="cross")
    return one.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value"))


def json_lines(rows: DataFrame) -> DataFrame:
    """One JSON object for each row; fields that are null are left out."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def write_json(path: str, **tables: DataFrame) -> None:
    """Each table as JSON lines in a folder of its name."""
    for name, df in tables.items():
        df.write.json(f"{path}/{name}")


def held(metrics: DataFrame) -> DataFrame:
    """metrics, computed now and once. For tables of one row for each strategy only: they go through the driver."""
    return metrics.sparkSession.createDataFrame(metrics.collect(), metrics.schema)


def markdown_lines(metrics: DataFrame, runs: DataFrame) -> DataFrame:
    """(line, value) of a report: strategies by composite, the three best, and each run's chunks, time and cost.

    metrics: one row for each strategy. runs: (label, chunk_count, duration_ms, estimated_cost).
    """
    spark = metrics.sparkSession
    order = Window.partitionBy().orderBy(F.col("composite").desc(), "strategy_id")
    f = lambda c, n: T.to_fixed(F.col(c), n)
    ranked = metrics.withColumn("r", F.row_number().over(order))
    fixed = [(0, "# Chunking Strategy Report"), (1, ""), (2, "## Metric Comparison"), (3, ""), (4, "| Strategy | Self-Contained | Boundary | Token Eff. | Chunks | Composite |"), (5, "|---|---|---|---|---|---|")]
    fixed += [(1_000_000, ""), (1_000_001, "## Top 3 Recommendations"), (1_000_002, ""), (3_000_000, "## Chunk Stats"), (3_000_001, "")]
    rows = [spark.createDataFrame(fixed, "line long, value string")]
    cells = F.concat_ws(" | ", "strategy_id", f("avg_self_containedness", 2), f("avg_boundary_coherence", 2), f("token_efficiency", 2), F.col("chunk_count").cast("string"), f("composite", 2))
    rows.append(ranked.select((F.col("r") + 10).cast("long").alias("line"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("value")))
    best = F.array(
        F.concat(F.lit("### "), F.col("r"), F.lit(". "), F.translate("strategy_id", "_", " ")),
        F.concat(F.lit("- Composite score: **"), f("composite", 3), F.lit("**")),
        F.concat(F.lit("- Self-containedness: "), f("avg_self_containedness", 3)),
        F.concat(F.lit("- Boundary coherence: "), f("avg_boundary_coherence", 3)),
        F.concat(F.lit("- Chunk count: "), F.col("chunk_count"), F.lit(" · Avg tokens: "), f("avg_tokens", 0)),
        F.lit(""),
    )
    rows.append(ranked.where("r <= 3").select("r", F.posexplode(best).alias("k", "value")).select((F.lit(2_000_000) + F.col("r") * 10 + F.col("k")).cast("long").alias("line"), "value"))
    place = F.row_number().over(Window.partitionBy().orderBy("label"))
    stats = F.concat(F.lit("- **"), F.col("label"), F.lit("**: "), F.col("chunk_count"), F.lit(" chunks, "), F.col("duration_ms"), F.lit("ms, ~$"), f("estimated_cost", 4))
    rows.append(runs.select((F.lit(4_000_000) + place).cast("long").alias("line"), stats.alias("value")))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out
