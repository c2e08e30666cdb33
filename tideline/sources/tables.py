"""Reading and writing tables: declared schemas, tolerant reads, empty tables, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException


def conform(df: DataFrame, schema: T.StructType, fill: dict | None = None) -> DataFrame:
    """df with exactly the columns of schema: missing ones are null (or fill), others cast, null where a cast fails."""
    fill = fill or {}
    have = set(df.columns)
    cols = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in have else F.lit(fill.get(f.name)).cast(f.dataType)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV, JSON or Parquet table by suffix, conformed to schema; a path that doesn't exist is an empty table of it."""
    kind = "csv" if path.endswith(".csv") else "json" if path.endswith((".json", ".jsonl")) else "parquet"
    try:
        reader = spark.read.option("header", True) if kind == "csv" else spark.read
        df = reader.format(kind).load(path)
    except AnalysisException as e:
        if schema is None or "PATH_NOT_FOUND" not in str(e):
            raise
        return empty(spark, schema)
    return conform(df, schema) if schema else df


def read_validated_csv(spark: SparkSession, path: str, required: list[str]) -> tuple[DataFrame | None, dict]:
    """A CSV and its status: ok, missing_file or missing_columns."""
    try:
        df = spark.read.option("header", True).csv(path)
    except AnalysisException:
        return None, {"status": "missing_file", "missing_columns": []}
    lacking = sorted(set(required) - set(df.columns))
    return (None if lacking else df), {"status": "missing_columns" if lacking else "ok", "missing_columns": lacking}


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with a success or error status by whether their error field is filled."""
    df = spark.read.schema(schema).json(path)
    failed = F.col("error").isNotNull() & (F.trim("error") != "")
    return df.withColumn("status", F.when(failed, "error").otherwise("success"))


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").format(kind)
    writer = writer.option("header", True) if kind == "csv" else writer
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def save_as_table(df: DataFrame, name: str, bucket_by: list[str] | None = None, buckets: int = 32) -> None:
    """CTAS; buckets co-locate later joins on the same keys. Each bucket is one sorted file."""
    if bucket_by:
        df = df.repartition(buckets, *bucket_by)
    writer = df.write.mode("overwrite").format("parquet")
    (writer.bucketBy(buckets, *bucket_by).sortBy(*bucket_by) if bucket_by else writer).saveAsTable(name)


def store_by_time(df: DataFrame, name: str, keys: list[str], width_s: int, ts: str = "ts", buckets: int = 32) -> DataFrame:
    """Df as a table bucketed and sorted by unit and time bucket of width_s seconds (``time_bucket``), so that range joins don't shuffle it again.

    The name is the caller's to drop. Buckets should be no fewer than the session's shuffle partitions, or Spark may deal
    both sides of a join anew.
    """
    save_as_table(df.withColumn("time_bucket", F.floor(F.unix_micros(ts) / (width_s * 1_000_000))), name, [*keys, "time_bucket"], buckets)
    return df.sparkSession.table(name)
