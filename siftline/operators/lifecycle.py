"""Maintenance of the stored tables: retention, grants, quotas, orphans, deletion, upserts.

Every job takes the time of reference as a parameter and gives the tables' new rows, so a run that is
repeated gives the same. Tables written to disk are replaced by ``sinks.replace_table``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86400
#: Seconds: reports and artifacts, forensic evidence, quarantine, grants, grace before an orphan goes.
RETENTION = {"reports": 7 * DAY, "forensic": 30 * DAY, "quarantine": 90 * DAY, "artifacts": 7 * DAY, "grants": 3600, "orphan_grace": 300}
MOST_BYTES, MOST_BYTES_PER_SCAN = 10 << 30, 500 << 20


def expired(d: DataFrame, created: str, now: Column, age: int) -> DataFrame:
    return d.where(F.col(created) <= now - F.make_interval(secs=F.lit(age)))


def delete_scans(tables: dict[str, DataFrame], scans: DataFrame) -> dict[str, DataFrame]:
    """Every table without the scans' rows."""
    gone = scans.select("scan_id").distinct()
    return {name: t.join(gone, "scan_id", "left_anti") for name, t in tables.items()}


def expire_reports(tables: dict[str, DataFrame], now: Column, age: int = RETENTION["reports"]) -> dict[str, DataFrame]:
    return delete_scans(tables, expired(tables["reports"], "created_at", now, age))


def revoke_expired_grants(artifacts: DataFrame, grants: DataFrame, now: Column, age: int = RETENTION["grants"]) -> tuple[DataFrame, DataFrame]:
    """(artifacts whose eligibility follows the grants left, grants left)."""
    left = grants.where(F.col("created_at") > now - F.make_interval(secs=F.lit(age)))
    held = left.select("artifact_id").distinct().withColumn("__held", F.lit(True))
    kept = artifacts.join(held, "artifact_id", "left").withColumn("release_eligible", F.col("release_eligible") & F.col("__held").isNotNull()).select(*artifacts.columns)
    return kept, left


def revoke_grant(grants: DataFrame, grant_id: str) -> DataFrame:
    return grants.where(F.col("grant_id") != grant_id)


def orphans(files: DataFrame, artifacts: DataFrame, now: Column, grace: int = RETENTION["orphan_grace"]) -> DataFrame:
    """Files (storage_reference, size_bytes, modified_at) that no artifact refers to, older than the grace."""
    return expired(files, "modified_at", now, grace).join(artifacts.select("storage_reference").distinct(), "storage_reference", "left_anti")


def usage(files: DataFrame, areas: list[str], most: int = MOST_BYTES) -> DataFrame:
    """One row: bytes by area and in all, what remains, and whether the quota is passed."""
    parts = [F.coalesce(F.sum(F.when(F.col("area") == a, F.col("size_bytes"))), F.lit(0)).cast("long").alias(f"{a}_bytes") for a in areas]
    d = files.agg(*parts, F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("total_bytes"))
    return d.withColumn("remaining_bytes", F.greatest(F.lit(most) - F.col("total_bytes"), F.lit(0))).withColumn("over_quota", F.col("total_bytes") > most)


def preflight(files: DataFrame, incoming: int, most: int = MOST_BYTES) -> bool:
    """Whether ``incoming`` bytes still fit."""
    return (files.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0] or 0) + incoming <= most


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Both tables' rows; of each key a new row if there is one, else an old one, and of several the last by ``order``."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return both.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("__new"), F.desc(order)))).where("__n = 1").drop("__n", "__new")


def running_budget(d: DataFrame, scan: str, order: list[str], amount: Column, most: int) -> DataFrame:
    """Adds the running total of ``amount`` within each scan and whether it has passed ``most``."""
    w = Window.partitionBy(scan).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.withColumn("running_total", F.sum(amount).over(w).cast("long")).withColumn("over_budget", F.col("running_total") > most)


def content_addressed(files: DataFrame, content: str = "content") -> DataFrame:
    """One row for each distinct content: sha256, size_bytes and the path under which it is stored."""
    d = files.select(F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("long").alias("size_bytes"), F.col(content).alias("content")).dropDuplicates(["sha256"])
    return d.withColumn("storage_reference", F.concat_ws("/", F.substring("sha256", 1, 2), F.substring("sha256", 3, 2), "sha256"))


def verify_content(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """(sha256, problem) for artifacts (sha256, size_bytes) whose stored content is missing, or of another size or hash."""
    have = stored.select(F.col("sha256"), F.octet_length("content").alias("now_size"), F.sha2("content", 256).alias("now_sha"))
    problem = F.when(F.col("now_sha").isNull(), "missing").when(F.col("now_size") != F.col("size_bytes"), "size").when(F.col("now_sha") != F.col("sha256"), "hash")
    return expected.join(have, "sha256", "left").select("sha256", problem.alias("problem")).where("problem is not null")


def maintenance(tables: dict[str, DataFrame], files: DataFrame, now: Column) -> dict[str, DataFrame]:
    """The start-up sequence: reports, then grants, then forensic evidence expire; what no artifact refers to is listed."""
    t = expire_reports(tables, now)
    t["artifacts"], t["release_grants"] = revoke_expired_grants(t["artifacts"], t["release_grants"], now)
    if "forensic_evidence" in t:
        t["forensic_evidence"] = t["forensic_evidence"].where(F.col("created_at") > now - F.make_interval(secs=F.lit(RETENTION["forensic"])))
    t["orphaned_artifacts"] = orphans(files, t["artifacts"], now)
    return t

