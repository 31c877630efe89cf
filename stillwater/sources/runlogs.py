"""Run logs: one JSON record a line, of several types, one file for each run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The union of all record types; fields that a type lacks are null.
LOG_SCHEMA = """
    type string, schema int,
    cell struct<index: int, deployment: string, backend: string, device: string, cpu_threads: int, remote: boolean, network_profile: string,
                model: string, scenario: string, repetition: int, seed: int>,
    config_hash string, git_hash string, git_dirty boolean, hostname string, platform string, gpu string, gpu_driver string, pid int,
    libs map<string, string>, wallclock_utc string, t_monotonic_at_header bigint, gpu_compute_apps array<struct<pid: int, used_mib: int>>,
    frame_idx bigint, t bigint, t_capture bigint, t_decode bigint, t_pre bigint, t_send bigint, t_recv_server bigint, t_resp_send bigint,
    t_resp_recv bigint, t_infer_start bigint, t_infer_end bigint, t_post bigint,
    detections array<struct<cls: string, conf: double, xyxy: array<double>>>,
    k int, reason string, n_received bigint, n_dropped bigint, n_unreadable bigint, _corrupt_record string
"""


def read_logs(spark: SparkSession, path: str, strict: bool = False, run_field: str | None = None) -> tuple[DataFrame, DataFrame]:
    """All records with ``run_id``, and the runs that have a line which can't be parsed.

    A run is a file, named by its stem; where files hold many runs, each line
    names its run in ``run_field``.  Strict reading fails at a line that can't
    be parsed; else the whole run is set aside and its records are left out.
    A broken line of a shared file belongs to the run that it still names; if
    it names none it is the run null, which has no records.
    """
    schema = StructType.fromDDL(LOG_SCHEMA)
    if run_field:
        schema = schema.add(run_field, "string")
    reader = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    records = reader.json(path)
    if run_field:
        named = F.nullif(F.regexp_extract("_corrupt_record", rf'"{re.escape(run_field)}"\s*:\s*"?([^",}}]+)', 1), F.lit(""))
        records = records.withColumn("run_id", F.coalesce(run_field, named))
        records = records if run_field == "run_id" else records.drop(run_field)
    else:
        records = records.withColumn("run_id", F.regexp_extract(F.col("_metadata.file_name"), r"(.*)\.jsonl$", 1))
    if strict:
        return records.drop("_corrupt_record"), records.select("run_id").limit(0)
    bad = records.filter(F.col("_corrupt_record").isNotNull() | F.col("type").isNull()).select("run_id").distinct()
    return records.filter("type is not null").join(bad, "run_id", "left_anti").drop("_corrupt_record"), bad


def headers(records: DataFrame) -> DataFrame:
    """One row a run from the last header: host, start and cell."""
    h = records.filter("type = 'header'").groupBy("run_id").agg(F.max_by(F.struct("hostname", "wallclock_utc", "git_hash", "config_hash", "cell", "libs", "gpu_compute_apps"), "t_monotonic_at_header").alias("h"))
    return h.select("run_id", "h.hostname", F.to_timestamp("h.wallclock_utc").alias("started"), "h.git_hash", "h.config_hash", "h.cell.*", "h.libs", "h.gpu_compute_apps")


def with_header(records: DataFrame, fields: dict[str, str], kind: str = "frame") -> DataFrame:
    """Records of a kind, each stamped with fields of its run's header (``{"clip": "cell.scenario"}``), whatever the order of the lines.

    The last header of a run counts; runs without one are left out.
    """
    stamps = F.struct(*(F.col(path).alias(name) for name, path in fields.items()))
    head = records.filter("type = 'header'").groupBy("run_id").agg(F.max_by(stamps, F.coalesce("t_monotonic_at_header", F.lit(0))).alias("_stamp"))
    return records.filter(F.col("type") == kind).join(head, "run_id").select("*", *(F.col("_stamp")[name].alias(name) for name in fields)).drop("_stamp")


def write_logs(records: DataFrame, path: str, run: str | None = None, files: int | None = None) -> None:
    """Append records as lines; earlier files stay.  With ``run`` the lines of a run stand together, in ``files`` files for all runs."""
    if run:
        files = files or int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        records = records.repartition(files, run).sortWithinPartitions(run)
    records.write.mode("append").json(path)


def text_lines(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """Lines of text logs as ``run_id, line``: a run is a file, named by its stem, or what the first group of ``run`` finds in the line (lines without one are left out)."""
    lines = spark.read.text(path)
    if run is None:
        return lines.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("run_id"), F.col("value").alias("line"))
    return lines.select(F.regexp_extract("value", run, 1).alias("run_id"), F.col("value").alias("line")).filter("run_id <> ''")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``<hash>  <path>`` as ``hash, path``."""
    parts = F.split("value", "  ", 2)
    return spark.read.text(path).filter(F.contains("value", F.lit("  "))).select(parts[0].alias("hash"), parts[1].alias("path"))


def annotations(spark: SparkSession, path: str, category: str) -> DataFrame:
    """White-space separated lines of four fields or more, one category: ``name, start, end``."""
    p = F.split(F.trim("value"), "\\s+")
    rows = spark.read.text(path).select(p.alias("p")).filter((F.size("p") >= 4) & (F.col("p")[1] == category))
    return rows.select(F.col("p")[0].alias("name"), F.col("p")[2].cast("int").alias("start"), F.col("p")[3].cast("int").alias("end"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder with size and MD5 of their content."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.md5("content").alias("md5"))


def write_ids(ids: DataFrame, col: str, path: str) -> None:
    """A sorted list of distinct ids as text."""
    ids.select(F.col(col).cast("long").alias("v")).distinct().orderBy("v").select(F.col("v").cast("string")).write.mode("overwrite").text(path)
