"""Documents and the passages that are cut out of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagelab.functions import text as T
from passagelab.schema import STRUCTURE

LARGE_CHARS = 6000


def as_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, structure) with an empty structure; null texts become empty."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.lit(None).cast(STRUCTURE).alias("structure"))


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores, if its files give fewer tasks: chunking is row-local and heavy, and one small file is one task. Larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def select_span(df: DataFrame, start: Column | int, end: Column | int, rebase: bool = False) -> DataFrame:
    """The characters from start to before end as `text`; an empty selection leaves the row unchanged.

    Offsets of headings stay those of the whole document unless `rebase` is asked for.
    """
    start, end = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    chosen = F.when(start < end, T.clip(F.col("text"), start, end)).otherwise(F.col("text"))
    if rebase and "structure" in df.columns:
        inside = F.filter("structure.headings", lambda h: (h["start"] >= start) & (h["start"] < end))
        moved = F.transform(inside, lambda h: F.struct(h["level"].alias("level"), h["text"].alias("text"), (h["start"] - start).cast("int").alias("start"), (h["end"] - start).cast("int").alias("end")))
        df = df.withColumn("structure", F.when(start < end, F.struct(moved.alias("headings"), F.col("structure.pages").alias("pages"))).otherwise(F.col("structure")))
    return df.withColumn("text", chosen)


def select_heading(df: DataFrame, i: int) -> DataFrame:
    """The section of heading i (from 0): up to the next heading of any level, or the end. Documents without it go."""
    own, following = F.get("structure.headings", F.lit(i)), F.get("structure.headings", F.lit(i + 1))
    return select_span(df.where(own.isNotNull()), own["start"], F.coalesce(following["start"], F.length("text")))


def select_page(df: DataFrame, number: int) -> DataFrame:
    """The page with this number. Documents without it go."""
    page = F.get(F.filter("structure.pages", lambda p: p["number"] == number), F.lit(0))
    return select_span(df.where(page.isNotNull()), page["start"], page["end"])


def selection_stats(df: DataFrame) -> DataFrame:
    return df.select("doc_id", T.word_count(F.col("text")).cast("long").alias("words"), F.length("text").cast("long").alias("chars"), T.estimate_tokens(F.col("text")).cast("long").alias("tokens"))


def large_passages(df: DataFrame, chars: int = LARGE_CHARS) -> DataFrame:
    """Passages that are costly to judge, with what their tokens cost to read."""
    tokens = T.estimate_tokens(F.col("text")).cast("long")
    return df.where(F.length("text") > chars).select("doc_id", F.length("text").cast("long").alias("chars"), tokens.alias("tokens"), (tokens * T.USD_IN / 1_000_000).alias("usd"))


def profile(df: DataFrame) -> DataFrame:
    """Characters, estimated tokens, pages (null if unknown) and headings of each document."""
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return df.select("doc_id", F.length("text").alias("chars"), T.estimate_tokens(F.col("text")).alias("tokens"), size("structure.pages").alias("pages"), F.coalesce(size("structure.headings"), F.lit(0)).alias("headings"))


def badges(chunks: DataFrame) -> DataFrame:
    """What a list of chunks shows of each: its number, tokens, parent and how many children it has. chunks: rows of chunk_rows."""
    return chunks.select("doc_id", "index", "tokens", "parent_index", F.coalesce(F.size("children"), F.lit(0)).alias("child_count"))
