"""Spark plumbing shared by the operators: shared scratch tables and bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of a few long columns is broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset (as in tests)."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = getattr(spark, "_docframe_dir", None) or f"file://{tempfile.mkdtemp(prefix='docframe-')}"
        spark._docframe_dir = found
    return f"{found.rstrip('/')}/docframe"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docframe_path = path
    return out


def drop(df: DataFrame | None) -> None:
    """Delete a table that materialize() wrote; only for tables that no returned plan reads."""
    path = getattr(df, "_docframe_path", None)
    if path:
        jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast df if its counted rows are within the bound; otherwise leave the join to the shuffle."""
    return F.broadcast(df) if rows <= most else df


def remainder(column: str, divisor: int):
    """crc32 of an id's decimal text, modulo divisor; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def bounded_sample(df: DataFrame, by: str, hashed: list[str], most: int) -> DataFrame:
    """Of each value of ``by`` about ``most`` distinct rows (all, if there are fewer): those with the least hash of the named columns.

    One aggregation counts distinct rows by bucket of the hash, in steps of about a hundredth, and the buckets that fit the
    bound are taken by a filter, so that only chosen rows are moved. Repeated rows count once; the rows have a column ``h``.
    The counts are estimates (standard error 5 %); a bucket that exceeds the bound alone is taken whole.
    """
    h = F.shiftrightunsigned(F.xxhash64(*hashed), 1)
    keyed = df.withColumn("h", h).withColumn("_bucket", F.floor(F.log2(F.col("h") + F.lit(1.0)) * 64).cast("int"))
    counts = keyed.groupBy(by, "_bucket").agg(F.approx_count_distinct("h").alias("n")).orderBy(by, "_bucket").collect()
    cuts, total = {}, {}
    for value, bucket, n in counts:
        total[value] = total.get(value, 0) + n
        if total[value] <= most or value not in cuts:
            cuts[value] = bucket
    cut = df.sparkSession.createDataFrame(list(cuts.items()), df.select(F.col(by).alias("_of"), F.lit(0).alias("_cut")).schema)
    chosen = keyed.join(F.broadcast(cut), F.col(by) == F.col("_of")).where("_bucket <= _cut")
    return chosen.drop("_of", "_cut", "_bucket").dropDuplicates([by, "h"])
