"""The thin queries over whole tables, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagelab.llm.common import table
from passagelab.llm.decontamination import ORACLE


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated lines."""
    from passagelab.llm.line_dedup import dedup

    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op2_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passagelab.llm.media_chunks import media_column

    return media_column(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passagelab.llm.secret_scan import digest

    return digest(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passagelab.llm.decontamination import report

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passagelab.llm.token_records import read_records, write_records

    _, manifest = write_records(table(spark, sf_dir, "documents"))
    return read_records(spark, manifest)


def op6_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passagelab.llm.html_template import report

    return report(table(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passagelab.llm.language_id import identify

    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passagelab.llm.simhash_dedup import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"), "copies")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passagelab.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passagelab.llm.pii import digest

    return digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_media_chunks,
        op3_secret_scan,
        op4_decontamination,
        op5_token_records,
        op6_html_template,
        op7_language_id,
        op8_simhash_near_dedup,
        op9_packing,
        op10_pii,
    )
}

ORACLE_SQL: dict[str, str] = {"op4_decontamination": ORACLE}
