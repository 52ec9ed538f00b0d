"""From findings to evidence: merging observations, folding findings, assessing categories, the graph.

Every grouping is keyed by the scan first, so a table partitioned by scan_id is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import CATEGORIES, SEVERITIES, rank, severity_rank, state_rank


def merge_observations(observations: DataFrame) -> DataFrame:
    """The first observation of each (scan, artifact, text without case and margins)."""
    key = F.lower(F.regexp_replace("normalized_text", r"(?U)^\s+|\s+$", ""))
    first = F.row_number().over(Window.partitionBy("scan_id", "source_artifact_id", F.xxhash64(key), F.sha2(key, 256)).orderBy("ord"))
    return observations.withColumn("__n", first).where("__n = 1").drop("__n")


def union_sorted(arrays: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(arrays)))


def support_key(d: DataFrame) -> Column:
    """What makes two findings of a category, type and reasons the same one."""
    marks = F.when(F.col("category").isin("phishing", "watermarks") & (F.coalesce(F.size("indicators"), F.lit(0)) > 0), F.concat_ws("\x1f", "category", "type", F.array_join(F.array_sort("indicators"), "\x1f")))
    return F.when(F.col("category") == "prompt_injection", "prompt-class").otherwise(F.coalesce(marks, F.nullif("text_sha256", F.lit("")), F.array_join(F.array_sort("observation_ids"), "\x1f")))


def deduplicate(findings: DataFrame) -> DataFrame:
    """One finding for each key: the strongest (of equals the first), where the first stood, with the others' support merged in."""
    rest = [c for c in findings.columns if c not in ("scan_id", "ord")]
    merged = ["observation_ids", "source_artifact_ids", "detector_ids", "reason_codes", "limitations", "transformations"]
    strength = F.struct(state_rank(F.col("state")).alias("a"), severity_rank(F.col("severity")).alias("b"), F.coalesce("evidence_quality", F.lit(0.0)).alias("c"), F.coalesce("attack_likelihood", F.lit(0.0)).alias("d"), (-F.col("ord")).alias("e"))
    keyed = findings.withColumn("__key", F.struct("category", "type", F.array_sort("reason_codes").alias("codes"), support_key(findings).alias("support")))
    got = keyed.groupBy("scan_id", "__key").agg(
        F.max_by(F.struct(*rest), strength).alias("best"),
        F.min("ord").alias("ord"),
        F.count("*").alias("n"),
        *(union_sorted(F.collect_list(c)).alias(f"m_{c}") for c in merged),
    )
    columns = {c: F.col(f"best.{c}") for c in rest} | {c: F.when((F.col("n") > 1) & (F.size(f"m_{c}") > 0), F.col(f"m_{c}")).otherwise(F.col(f"best.{c}")) for c in merged}
    return got.select("scan_id", *(columns[c].alias(c) if c in columns else F.col(c) for c in findings.columns if c != "scan_id"))


def execution_state(state: Column, status: Column) -> Column:
    """The aggregate state of a group of executions, by precedence."""
    every = lambda s: F.bool_and(state == s)
    some = lambda s: F.bool_or(state == s)
    return (
        F.when(F.count(state) == 0, "NOT_TESTED")
        .when(F.bool_or(status == "TIMEOUT") | some("ERROR"), "ERROR")
        .when(every("UNSUPPORTED"), "UNSUPPORTED")
        .when(every("NOT_TESTED"), "NOT_TESTED")
        .when(some("INCONCLUSIVE"), "INCONCLUSIVE")
        .when(some("NO_EVIDENCE_FOUND"), "NO_EVIDENCE_FOUND")
        .otherwise(F.max_by(state, state_rank(state)))
    )


def roll_up_executions(executions: DataFrame) -> DataFrame:
    return executions.groupBy("scan_id", "category").agg(execution_state(F.col("state"), F.col("status")).alias("state"), F.count("*").alias("n_executions"), F.bool_or(F.col("state").isin("ERROR", "UNSUPPORTED", "NOT_TESTED")).alias("partial"))


def assess(scans: DataFrame, findings: DataFrame, executions: DataFrame) -> DataFrame:
    """A row for each scan and each of the 13 categories, whether or not anything is known of it."""
    spark = scans.sparkSession
    cells = scans.select("scan_id").crossJoin(F.broadcast(spark.createDataFrame([(i, c) for i, c in enumerate(CATEGORIES)], "category_order int, category string")))
    own = findings.groupBy("scan_id", "category").agg(
        F.count("*").alias("n_findings"),
        F.max_by("state", state_rank(F.col("state"))).alias("f_state"),
        F.max(F.coalesce("attack_likelihood", F.lit(0.0))).alias("likelihood"),
        F.max_by("impact", F.struct(rank(F.col("impact"), SEVERITIES, 1), -F.col("ord"))).alias("f_impact"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "finding_id"))), lambda x: x["finding_id"]).alias("finding_ids"),
    )
    d = cells.join(own, ["scan_id", "category"], "left").join(roll_up_executions(executions).withColumnRenamed("state", "e_state"), ["scan_id", "category"], "left")
    n, found = F.coalesce("n_findings", F.lit(0)), F.col("n_findings").isNotNull()
    state = F.coalesce("f_state", "e_state", F.lit("NOT_TESTED"))
    base = F.when(~found & F.col("n_executions").isNull(), "not_tested").when(F.coalesce("partial", F.lit(False)), "partial").otherwise("medium")
    coverage = F.when(F.col("category").isin("steganography", "covert_channel"), F.when(found, "medium").otherwise("low")).when(F.col("category") == "watermarks", "low").when(F.col("category") == "adversarial_instability", "not_tested").otherwise(base)
    summary = F.when(found, F.format_string("%d finding(s)", n)).when(state == "NO_EVIDENCE_FOUND", "No evidence found in executed checks.").otherwise(F.format_string("Assessment limited by detector coverage: %s.", state))
    return d.select("scan_id", "category_order", "category", state.alias("state"), "likelihood", F.coalesce("f_impact", F.lit("low")).alias("impact"), coverage.alias("coverage"), n.cast("long").alias("n_findings"), F.coalesce("finding_ids", F.array().cast("array<string>")).alias("finding_ids"), summary.alias("summary"))


def families(findings: DataFrame) -> DataFrame:
    """Finding ids by the family that the first detector's name begins with."""
    family = F.element_at(F.split(F.element_at(F.split(F.get("detector_ids", 0), ":"), -1), "-"), 1)
    return findings.groupBy("scan_id", F.coalesce(family, F.lit("unknown")).alias("family")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "finding_id"))), lambda x: x["finding_id"]).alias("finding_ids"))


def representation_kind(label: Column) -> Column:
    return (
        F.when(label == "original", "original_container")
        .when(label == "canonical_lossy", "release_candidate")
        .when(label == "canonical_lossless", "canonical_lossless")
        .when(label.isin("flattened_white", "flattened_black"), "alpha_view")
        .when(label.startswith("frame-"), "animation_frame")
        .when(label.endswith("-channel"), "channel_view")
        .when(F.contains(label, F.lit("thumbnail")), "thumbnail")
        .otherwise("derived_view")
    )


def manifest(artifacts: DataFrame, analyzed: DataFrame) -> DataFrame:
    """(scan_id, coverage_complete, missing_required, n_entries): artifacts (scan_id, artifact_id, role) against the analyzed ids."""
    d = artifacts.join(analyzed.select("scan_id", "artifact_id").distinct().withColumn("analyzed", F.lit(True)), ["scan_id", "artifact_id"], "left").withColumn("missing", F.when(F.col("analyzed").isNull(), F.concat(F.lit("repr:"), "role")))
    return d.groupBy("scan_id").agg(F.bool_and("analyzed").alias("all"), F.array_sort(F.collect_list("missing")).alias("missing_required"), F.count("*").alias("n_entries")).select("scan_id", (F.size("missing_required") == 0).alias("coverage_complete"), "missing_required", "n_entries")


def graph_nodes(artifacts: DataFrame, observations: DataFrame, findings: DataFrame) -> DataFrame:
    node = lambda d, c, kind: d.select("scan_id", F.col(c).alias("id"), F.lit(kind).alias("kind"))
    return node(artifacts, "artifact_id", "Artifact").unionByName(node(observations, "observation_id", "Observation")).unionByName(node(findings, "finding_id", "Finding"))


def graph_edges(artifacts: DataFrame, observations: DataFrame, findings: DataFrame) -> DataFrame:
    edge = lambda d, a, b, kind: d.select("scan_id", a.alias("source"), b.alias("target"), F.lit(kind).alias("kind")).where("source is not null and target is not null")
    lineage = edge(artifacts, F.col("derived_from"), F.col("artifact_id"), "derived_from")
    seen = edge(observations, F.col("source_artifact_id"), F.col("observation_id"), "observed_in")
    backing = findings.select("scan_id", "finding_id", F.explode(F.concat("observation_ids", "source_artifact_ids")).alias("by"))
    return lineage.unionByName(seen).unionByName(edge(backing, F.col("by"), F.col("finding_id"), "supports"))
