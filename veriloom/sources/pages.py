"""Where pages come from and where results go.

Page text comes as a table, or as files: one text file is one document, form feeds part its pages.  Formats that need a library of
their own (PDF, OCR) plug in as a function from bytes to pages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.functions.text import content_hash

PAGE_SCHEMA = "source_document string, content_sha16 string, source_page int, text string, text_source string, error string"
#: bytes of a document to its pages' texts, each with its source tag
PageReader = Callable[[bytes], list[tuple[str, str]]]


def text_pages(content: bytes) -> list[tuple[str, str]]:
    return [(page, "text") for page in content.decode("utf-8", "replace").split("\f")]


def documents(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """path, source_document (file name), content, content_sha16; a missing folder is an error of Spark's."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("source_document"), "content", content_hash(F.col("content")).alias("content_sha16"))


def read_pages(files: DataFrame, reader: PageReader = text_pages, ocr: PageReader | None = None) -> DataFrame:
    """Pages numbered from 1.  A page without text is tried with `ocr`, if given; a file that can't be read gives one row with the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, sha, content in zip(batch["source_document"], batch["content_sha16"], batch["content"], strict=True):
                try:
                    pages = reader(bytes(content))
                    if ocr and any(not text.strip() for text, _ in pages):
                        read = ocr(bytes(content))
                        pages = [page if page[0].strip() or i >= len(read) else (read[i][0], "ocr") for i, page in enumerate(pages)]
                    rows += [(name, sha, i, text, source, None) for i, (text, source) in enumerate(pages, 1)]
                except Exception as problem:  # one unreadable file doesn't stop the others
                    rows.append((name, sha, None, None, None, f"{type(problem).__name__}: {problem}"))
            yield pd.DataFrame(rows, columns=["source_document", "content_sha16", "source_page", "text", "text_source", "error"]).astype({"source_page": "Int32"})

    return files.select("source_document", "content_sha16", "content").mapInPandas(run, PAGE_SCHEMA)


def ingest_summary(pages: DataFrame) -> DataFrame:
    """documents, failed, pages."""
    return pages.agg(F.count_distinct("source_document").alias("documents"), F.count("error").alias("failed"), F.count("source_page").alias("pages"))


def preview(pages: DataFrame, first: int | None = 5, chars: int = 500, blank: str | None = "No text") -> DataFrame:
    """The beginning and length of each document's first pages, of all for first=None.  Blank texts are shown as `blank`, for None as they are."""
    text = F.coalesce("text", F.lit("")) if blank is not None else F.col("text")
    shown = F.substring(text, 1, chars)
    if blank is not None:
        shown = F.when(F.trim(text) == "", F.lit(blank)).otherwise(shown)
    if first is not None:
        pages = pages.where(F.col("source_page") <= first)
    return pages.select("source_document", "source_page", F.length(text).alias("length"), shown.alias("preview"))


def export(df: DataFrame, path: str, kind: str = "json") -> None:
    df.write.mode("overwrite").format(kind).save(path)
