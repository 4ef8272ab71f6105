"""Files as documents: PDF and HTML by their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ACCEPTED = "*.{pdf,html,htm,PDF,HTML,HTM}"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(filename, format, content) of the accepted files under a path."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", ACCEPTED).option("recursiveFileLookup", "true").load(path)
    return found.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"), "content").withColumn("format", file_format(F.col("filename")))


def file_format(name):
    """`pdf` by the ending, whatever its case; anything else is `html`."""
    return F.when(F.lower(F.element_at(F.split(name, r"\."), -1)) == "pdf", F.lit("pdf")).otherwise(F.lit("html"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(filename, text, structure) of all accepted files."""
    from passagelab.sources.html import with_structure
    from passagelab.sources.pdf import assemble, extract_items

    files = read_files(spark, path)
    pages = files.where("format = 'html'").select("filename", F.decode("content", "UTF-8").alias("html"))
    pdf = files.where("format = 'pdf'").select(F.col("filename").alias("doc_id"), "content")
    return with_structure(pages, "html").select("filename", "text", "structure").unionByName(assemble(extract_items(pdf)).select(F.col("doc_id").alias("filename"), "text", "structure"))
