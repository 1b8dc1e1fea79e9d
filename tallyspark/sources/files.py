"""Statement files, through a recogniser that the caller brings, to raw token rows.

No recogniser or rasteriser is part of this package. A reader is a function from a file's bytes and suffix to its pages,
each (width, height, [(text, confidence, x1, y1, x2, y2), ...]); it runs once per file within a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RAW_TOKENS

IMAGES = ("png", "jpg", "jpeg", "tiff", "tif", "bmp", "webp")
Pages = list[tuple[float, float, list[tuple[str, float, float, float, float, float]]]]


def statement_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """doc_id, source_file, kind (pdf or image; what is neither is tried as an image), content. Spark raises if there is
    no such path."""
    reader = spark.read.format("binaryFile")
    found = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return found.select(F.xxhash64("path").alias("doc_id"), F.col("path").alias("source_file"), F.when(suffix == "pdf", "pdf").otherwise("image").alias("kind"), suffix.alias("suffix"), "content")


def recognise(files: DataFrame, read: Callable[[bytes, str], Pages]) -> tuple[DataFrame, DataFrame]:
    """(raw token rows, files with total_pages and error). A file that can't be read gives no rows and its error."""
    schema = f"{RAW_TOKENS}, source_file STRING, total_pages INT, error STRING"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, source, suffix, content in zip(batch["doc_id"], batch["source_file"], batch["suffix"], batch["content"], strict=True):
                none = [None] * (len(names) - 4)
                try:
                    pages = read(bytes(content), suffix)
                except Exception as e:
                    yield pd.DataFrame([[doc_id, *none, source, 0, str(e)]], columns=names)
                    continue
                rows = [[doc_id, *none, source, len(pages), None]]
                for n, (width, height, lines) in enumerate(pages):
                    rows += [[doc_id, n, i, *line, width, height, None, None, None] for i, line in enumerate(lines)]
                yield pd.DataFrame(rows, columns=names)

    found = files.select("doc_id", "source_file", "suffix", "content").mapInPandas(run, schema)
    return found.filter("token_ord is not null").drop("source_file", "total_pages", "error"), found.filter("token_ord is null").select("doc_id", "source_file", "total_pages", "error")
