"""Job script: PDF files to SVG pages.

    python -m docframe.convert INPUT_FOLDER OUTPUT_FOLDER [--pages 1..3,7] [--password P] [--no-links] [--no-annotations] [--hidden-text]

Exit codes: 0 done, 1 no files, 4 some pages failed (their status is printed by kind), 5 a password is needed.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from . import sinks
from .functions import strings
from .sources import parts, pdf


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="docframe.convert")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--pages", default="")
    p.add_argument("--password", default="")
    p.add_argument("--no-links", dest="links", action="store_false")
    p.add_argument("--no-annotations", dest="annotations", action="store_false")
    p.add_argument("--hidden-text", action="store_true")
    return p.parse_args(argv)


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(args.input)
    pages = parts.svg_pages(files, args.password, links=args.links, annotations=args.annotations, hidden_text=args.hidden_text)
    if args.pages:
        pages = pages.withColumn("_total", F.max("page_no").over(Window.partitionBy("path"))).where(F.array_contains(strings.page_numbers(F.lit(args.pages), F.col("_total")), F.col("page_no"))).drop("_total")
    sinks.save_svg(pages, args.output)
    locked = pdf.read(files, "documents", args.password).agg(F.count("*").alias("n"), F.sum(F.col("is_locked").cast("int")).alias("locked")).first()
    if not locked.n:
        return 1
    if locked.locked:
        return 5
    failed = pages.where("svg is null").groupBy("status").count().orderBy("status").collect()
    for row in failed:
        print(f"{row['count']} pages: {row.status}", file=sys.stderr)
    return 4 if failed else 0


if __name__ == "__main__":
    session = SparkSession.builder.appName("docframe-convert").getOrCreate()
    code = run(session, arguments())
    session.stop()
    sys.exit(code)
