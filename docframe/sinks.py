"""Pages and files to folders, by Spark's own writers: each task commits its part, and a lost one is written again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _file(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.pdf$", "")


def save_svg(pages: DataFrame, folder: str) -> None:
    """One text file a page, under folder/file=.../page_no=...; pages without an SVG are left out."""
    rows = pages.where("svg is not null").select(_file(F.col("path")).alias("file"), "page_no", "svg")
    rows.write.mode("overwrite").partitionBy("file", "page_no").text(folder)


def save_parquet(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").parquet(folder)


def data_urls(images: DataFrame) -> DataFrame:
    """Images with their data: address; null where the content is unknown."""
    return images.withColumn("data_url", F.concat(F.lit("data:"), "content_type", F.lit(";base64,"), F.base64("content")))
