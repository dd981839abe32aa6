"""Sources: files as bytes, checked, hashed and parsed to pages by a parser that the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.text import clean_text

#: bytes -> the text of each page; raises ValueError if it cannot be read
Parser = Callable[[bytes], list[str]]


def is_pdf(content: Column) -> Column:
    return F.coalesce(F.hex(F.substring(content, 1, 5)) == "255044462D", F.lit(False))


def scan_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """Files of a folder in the order of their paths, with hash and size; those without the PDF mark are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    named = files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "content", F.col("length").alias("file_size"), F.sha2("content", 256).alias("file_hash"))
    return named.filter(is_pdf(F.col("content")))


def flag_duplicates(documents: DataFrame) -> DataFrame:
    """documents with duplicate_of: the oldest document of the same content; duplicates are flagged, not dropped."""
    oldest = Window.partitionBy("file_hash").orderBy("created_at", "id")
    first = F.first("id").over(oldest)
    return documents.withColumn("duplicate_of", F.when(first != F.col("id"), first))


def parse_pages(files: DataFrame, parser: Parser) -> DataFrame:
    """(document_id, page_number, text, char_count, has_text, error): files (document_id, content) that the parser cannot
    read give one row with the error and no page."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, content in zip(*(batch.column(c).to_pylist() for c in ("document_id", "content"))):
                try:
                    rows += [(doc, n, text, None) for n, text in enumerate(parser(content), 1)]
                except ValueError as e:
                    rows.append((doc, None, None, str(e)))
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["document_id", "page_number", "text", "error"])

    out = files.select("document_id", "content").mapInArrow(parse, "document_id string, page_number int, text string, error string")
    stripped = F.length(F.trim("text"))
    return out.withColumn("text", F.when(F.col("text").isNotNull(), clean_text(F.col("text")))).withColumns({"char_count": stripped, "has_text": F.coalesce(stripped >= 10, F.lit(False))})


def document_totals(pages: DataFrame) -> DataFrame:
    """Pages and characters of each document; only pages with text count."""
    return pages.groupBy("document_id").agg(F.count("page_number").alias("page_count"), F.coalesce(F.sum(F.when(F.col("has_text"), F.col("char_count"))), F.lit(0)).alias("total_chars"), F.count_if(F.col("has_text")).alias("pages_with_text"))
