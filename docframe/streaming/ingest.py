"""Streaming ingestion: files that land in a folder are parsed once, with the batch reader's code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import parts, pdf

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream(spark: SparkSession, folder: str, kind: str, files_per_trigger: int = 100) -> DataFrame:
    """A streaming frame of a kind of rows (of ``pdf`` or of ``parts``); stateless, so that any sink and output mode append works."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return parts.read(files, kind) if kind in parts.KINDS else pdf.read(files, kind)
