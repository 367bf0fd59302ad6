"""A lake of day partitions, checked files, and manifests of what was written.

Paths are in the shared folder or any store Spark can open. Pieces are appended
by day; where two hold the same key the later write wins; consolidation rewrites
a day as one file by dynamic partition overwrite.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def put(df: DataFrame, path: str, ts: str, version: int) -> None:
    """Append a piece of rows by the UTC day of ``ts`` (seconds)."""
    dated = df.withColumn("day", F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd")).withColumn("version", F.lit(version))
    dated.repartition("day").write.mode("append").partitionBy("day").parquet(path)


def read_latest(spark: SparkSession, path: str, keys: list[str], days: list[str] | None = None) -> DataFrame:
    """One row for each key, of the latest piece; ``days`` prunes partitions."""
    rows = spark.read.parquet(path)
    rows = rows.filter(F.col("day").isin(days)) if days else rows
    newest = F.row_number().over(Window.partitionBy("day", *keys).orderBy(F.desc("version")))
    return rows.withColumn("_n", newest).filter("_n = 1").drop("_n")


def consolidate(spark: SparkSession, path: str, keys: list[str], scratch: str) -> None:
    """Rewrite every day as one file of its latest rows, by way of ``scratch``."""
    read_latest(spark, path, keys).repartition("day").write.mode("overwrite").partitionBy("day").parquet(scratch)
    spark.read.parquet(scratch).repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Name (with its folder), size and SHA-256 of every file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.regexp_extract("path", "[^/]+/[^/]+$", 0).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """Files that are missing, unknown or changed against a manifest, each with a code."""
    now = manifest(spark, path).withColumnsRenamed({"bytes": "bytes_now", "sha256": "sha_now"})
    j = known.join(now, "file", "full_outer")
    code = F.when(F.col("sha_now").isNull(), "MISSING").when(F.col("sha256").isNull(), "UNKNOWN").when(F.col("sha256") != F.col("sha_now"), "CHANGED")
    return j.withColumn("code", code).filter("code is not null").select("file", "code")


OHLCV = "date string, open double, high double, low double, close double, volume double"


def read_ohlcv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Bars of one CSV for each asset, and the rows that break a rule: a bad date, prices out of order, a date given twice."""
    raw = spark.read.schema(OHLCV).option("header", "true").option("mode", "FAILFAST").option("enforceSchema", "false").csv(path)
    bars = raw.withColumn("asset", F.regexp_extract(F.col("_metadata.file_path"), "asset=([^/]+)", 1)).withColumn("d", F.expr("try_to_date(date, 'yyyy-MM-dd')"))
    twice = F.count(F.lit(1)).over(Window.partitionBy("asset", "date")) > 1
    body_low, body_high = F.least("open", "close"), F.greatest("open", "close")
    code = F.when(F.col("d").isNull(), "BAD_DATE").when(~((F.col("low") <= body_low) & (body_high <= F.col("high"))), "PRICE_ORDER").when(twice, "DUPLICATE_DATE")
    return bars, bars.withColumn("code", code).filter("code is not null").select("asset", "date", "code")


def parse_clock(text: Column) -> Column:
    """UTC seconds from ISO text with a zone, or an epoch in s, ms or µs by its length; anything else is null."""
    digits = text.rlike(r"^\d+$")
    n = F.length(text)
    whole = F.when(digits, text).cast("decimal(20,0)")
    epoch = F.when(n <= 11, whole).when(n <= 14, F.floor(whole / 1000)).otherwise(F.floor(whole / 1000000)).cast("long")
    zoned = F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), text)
    return F.when(digits, epoch).otherwise(F.unix_timestamp(F.try_to_timestamp(zoned)))
