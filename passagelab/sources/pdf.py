"""PDF layout: page items to text, page spans and headings that their heights tell.

Items are rows (doc_id, page, seq, str, height). What makes items of a file's bytes is an optional library; all after it is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagelab.functions import text as T
from passagelab.shipping import ship

ITEMS = "doc_id string, page int, seq int, str string, height double"
BODY_DEFAULT = 12.0


def extract_items(files: DataFrame) -> DataFrame:
    """Items of (doc_id, content) files, with pdfminer where it is installed; other installations raise when rows are read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            try:
                from pdfminer.high_level import extract_pages
                from pdfminer.layout import LTTextContainer, LTTextLine
            except ImportError as error:
                raise RuntimeError("reading PDF files needs pdfminer.six on the executors") from error
            import io

            rows = []
            for doc_id, content in zip(frame["doc_id"], frame["content"]):
                for page, layout in enumerate(extract_pages(io.BytesIO(content)), 1):
                    lines = [x for box in layout if isinstance(box, LTTextContainer) for x in box if isinstance(x, LTTextLine)]
                    rows += [(str(doc_id), page, k, x.get_text().rstrip("\n"), float(x.height)) for k, x in enumerate(lines)]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "seq", "str", "height"])

    ship(files.sparkSession)
    return files.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInPandas(run, ITEMS)


def page_texts(items: DataFrame) -> DataFrame:
    """(doc_id, page, page_text): a page's items in order, joined by spaces."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "str"))), lambda x: x["str"]), " ")
    return items.groupBy("doc_id", "page").agg(joined.alias("page_text"))


def page_spans(items: DataFrame) -> DataFrame:
    """(doc_id, number, start, end): where pages stand in the text; the end has the two line feeds that follow a page."""
    w = Window.partitionBy("doc_id").orderBy("page")
    size = F.length("page_text") + F.when(F.lead("page").over(w).isNull(), 0).otherwise(2)
    sized = page_texts(items).withColumn("size", size)
    end = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return sized.select("doc_id", F.col("page").alias("number"), (end - F.col("size")).cast("int").alias("start"), end.cast("int").alias("end"))


def body_size(items: DataFrame) -> DataFrame:
    """(doc_id, body): the upper median of the positive heights, or 12."""
    counted = items.where("height > 0").groupBy("doc_id", "height").agg(F.count("*").alias("n"))
    w = Window.partitionBy("doc_id").orderBy("height").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(Window.partitionBy("doc_id"))
    reached = counted.select("doc_id", "height", F.sum("n").over(w).alias("upto"), F.floor(total * 0.5).alias("middle"))
    middle = reached.where("upto > middle").groupBy("doc_id").agg(F.min("height").alias("body"))
    return items.select("doc_id").distinct().join(middle, "doc_id", "left").select("doc_id", F.coalesce("body", F.lit(BODY_DEFAULT)).alias("body"))


def headings(items: DataFrame) -> DataFrame:
    """(doc_id, level, text, start, end) of items that are high enough and of three characters or more.

    An item is at the lengths of all before it, one character for each, and one more for each page before.
    """
    w = Window.partitionBy("doc_id").orderBy("page", "seq").rowsBetween(Window.unboundedPreceding, -1)
    pages = Window.partitionBy("doc_id").orderBy("page")
    before = F.coalesce(F.sum(F.length("str") + 1).over(w), F.lit(0)) + F.dense_rank().over(pages) - 1
    placed = items.join(body_size(items), "doc_id").withColumn("start", before.cast("int")).withColumn("level", T.heading_level(F.col("height") / F.col("body")))
    text = T.trim(F.col("str"))
    return placed.where(F.col("level").isNotNull() & (F.length(text) > 2)).select("doc_id", "level", text.alias("text"), "start", (F.col("start") + F.length(text)).cast("int").alias("end"))


def assemble(items: DataFrame) -> DataFrame:
    """(doc_id, text, structure) of each document."""
    texts = page_texts(items).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "page_text"))), lambda p: p["page_text"]), "\n\n").alias("text"))
    spans = page_spans(items).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("number", "start", "end"))).alias("pages"))
    found = headings(items).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "level", "text", "end"))).alias("h"))
    ordered = F.transform(F.coalesce("h", F.array().cast("array<struct<start: int, level: int, text: string, end: int>>")), lambda h: F.struct(h["level"].alias("level"), h["text"].alias("text"), h["start"].alias("start"), h["end"].alias("end")))
    return texts.join(spans, "doc_id").join(found, "doc_id", "left").select("doc_id", "text", F.struct(ordered.alias("headings"), "pages").alias("structure"))
