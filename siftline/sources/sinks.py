"""Sinks: reports as JSON lines, tables replaced as a whole, results split by outcome, forensic text on request only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def report(scans: DataFrame, findings: DataFrame, decisions: DataFrame, assessments: DataFrame) -> DataFrame:
    """(scan_id, report): one JSON document for each scan, without any raw text."""
    gather = lambda d, name: d.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in d.columns if c != "scan_id"]))).alias(name))
    by_order = findings.select("scan_id", "ord", *[c for c in findings.columns if c not in ("scan_id", "ord")])
    d = scans.select("scan_id").join(gather(by_order, "findings"), "scan_id", "left").join(gather(decisions, "decisions"), "scan_id", "left").join(gather(assessments, "assessments"), "scan_id", "left")
    return d.select("scan_id", F.to_json(F.struct("scan_id", "findings", "decisions", "assessments")).alias("report"))


def write_reports(reports: DataFrame, path: str) -> None:
    reports.select("report").write.mode("overwrite").text(path)


def write_split(results: DataFrame, failed: Column, path: str) -> None:
    """Results and failures as JSON lines, side by side."""
    bad = F.coalesce(failed, F.lit(False))
    results.where(~bad).write.mode("overwrite").json(f"{path}/results")
    results.where(bad).write.mode("overwrite").json(f"{path}/failures")


def write_csv(d: DataFrame, path: str) -> None:
    d.write.mode("overwrite").option("header", True).csv(path)


def write_content(stored: DataFrame, path: str) -> None:
    """Content-addressed files: Parquet by the first two digits of the hash; contents that are there already stay."""
    spark = stored.sparkSession
    new = stored.withColumn("prefix", F.substring("sha256", 1, 2))
    try:
        have = spark.read.parquet(path).select("sha256")
    except Exception as error:  # the folder isn't there before the first write
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER" not in str(error):
            raise
    else:
        new = new.join(have, "sha256", "left_anti")
    new.write.mode("append").partitionBy("prefix").parquet(path)


def forensic_text(observations: DataFrame, enabled: bool = False) -> DataFrame:
    """Raw texts for analysts: no rows unless asked for."""
    shown = T.text_evidence(F.col("raw_text"))
    return observations.where(F.lit(enabled)).select("scan_id", F.concat(F.lit("evidence:"), "observation_id").alias("evidence_id"), F.col("observation_id").alias("source_id"), F.lit("raw_text").alias("classification"), shown["text_sha256"].alias("text_sha256"), shown["text_length"].alias("text_length"), "raw_text")


def write_markdown(d: DataFrame, path: str, title: str) -> None:
    """A table of few rows (as reports are) as a Markdown file; a bar within a value is escaped."""
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"([|])", r"\\$1") for c in d.columns]
    rows = d.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
    spark = d.sparkSession
    head = spark.createDataFrame([(f"# {title}",), ("",), ("| " + " | ".join(d.columns) + " |",), ("|" + "-|" * len(d.columns),)], "value string")
    head.coalesce(1).unionAll(rows).coalesce(1).write.mode("overwrite").text(path)


def replace_table(d: DataFrame, path: str) -> str:
    """Writes a new version beside the others, then points to it: ``path/current`` holds the name of the folder that counts.

    The pointer is written aside and renamed over the old one, so a reader (``read_table``) sees the old rows or
    the new ones, whole, and a crash at any time leaves the table as it was. The version before the last is removed.
    """
    spark: SparkSession = d.sparkSession
    jvm, version = spark._jvm, f"v-{uuid.uuid4().hex}"
    d.write.parquet(f"{path}/{version}")
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at("x").toUri(), spark._jsc.hadoopConfiguration())
    old = _current(spark, path)
    flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE, jvm.org.apache.hadoop.fs.CreateFlag.OVERWRITE)
    out = files.create(at(f"{version}.pointer"), flags, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 0))
    out.write(bytearray(version.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(at(f"{version}.pointer"), at("current"), over)
    if old:
        files.delete(at(old), True)
    return version


def _current(spark: SparkSession, path: str) -> str | None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/current")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return stream.readLine()
    finally:
        stream.close()


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The version of a table that counts now."""
    version = _current(spark, path)
    if version is None:
        raise FileNotFoundError(f"no table at {path}")
    return spark.read.parquet(f"{path}/{version}")


def finalize(spark: SparkSession, reports: DataFrame, grants: DataFrame, path: str) -> str:
    """Reports and grants of a run together: both are written under one version, and one pointer makes them count."""
    both = reports.select(F.lit("report").alias("kind"), F.to_json(F.struct("*")).alias("row")).unionByName(grants.select(F.lit("grant").alias("kind"), F.to_json(F.struct("*")).alias("row")))
    return replace_table(both, path)
