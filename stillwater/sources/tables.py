"""Table files: CSV and Parquet sources and sinks, stage tables, registries and key-value reports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; only a local session may do without ``spark.checkpoint.dir``."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="work-")
    return f"{shared}/{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header row by a given schema (never inferred); columns are found by position, empty fields are null."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """CSV files with headers, range-sorted so that the files in name order are in row order."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """A Parquet table in one folder for each value of ``by``; each file holds one value, and a frequent one fills several."""
    df.repartitionByRange(*by, F.rand(1)).write.mode("overwrite").partitionBy(*by).parquet(path)


def stage_table(df: DataFrame, path: str) -> DataFrame:
    """Materialise an intermediate: written once, then read by all that follow."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def registry(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """A registry of scenarios or models, one JSON object a line; a repeated or missing key is an error."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    often = rows.groupBy(key).agg(F.count("*").alias("_n"))
    wrong = F.col("_n").isNull() | (F.col("_n") > 1)
    met = rows.join(often, key, "left").withColumn("_n", F.when(wrong, F.raise_error(F.lit(f"repeated or missing {key}"))).otherwise(F.col("_n")))
    return met.filter("_n = 1").drop("_n")


def write_report(df: DataFrame, path: str, key: str, value: str) -> None:
    """A bounded report as sorted lines ``key: value``."""
    lines = df.select(F.concat_ws(": ", F.col(key).cast("string"), F.col(value).cast("string")).alias("value"))
    lines.coalesce(1).sortWithinPartitions("value").write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a report as ``key, value``."""
    parts = F.split("value", ": ", 2)
    return spark.read.text(path).select(parts[0].alias("key"), parts[1].alias("value"))
