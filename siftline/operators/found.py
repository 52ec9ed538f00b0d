"""Findings of detectors that look at files and at tools' results, in the schema that all findings share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import CATEGORIES, FINDING


def finding(rows: DataFrame, what: Column | str, detector: str, *, category: str, type: Column | str, state: Column | str, severity: Column | str, quality: float, impact: str, reasons: list[str] | Column, action: str, likelihood: float | None = None, observations: Column | None = None, sha: Column | None = None, length: Column | None = None, indicators: Column | None = None) -> DataFrame:
    """A finding for each of ``rows`` (scan_id, artifact_id, ord, k: the place within the row's result), numbered within scan and kind."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    number = F.row_number().over(Window.partitionBy("scan_id").orderBy("ord", "artifact_id", "k")) - 1
    none = F.array().cast("array<string>")
    values = {
        "scan_id": F.col("scan_id"), "finding_id": F.concat(F.lit("finding:"), F.col("scan_id"), F.lit(":"), lit(what), F.format_string(":%03d", number)), "ord": F.col("ord") * 100 + F.col("k"), "category": F.lit(category), "type": lit(type), "state": lit(state), "severity": lit(severity),
        "detector_confidence": F.lit(None), "evidence_quality": F.lit(quality), "attack_likelihood": F.lit(likelihood), "impact": F.lit(impact), "source_artifact_ids": F.array("artifact_id"), "observation_ids": none if observations is None else observations, "detector_ids": F.array(F.lit(detector)),
        "reason_codes": reasons if isinstance(reasons, Column) else F.array(*map(F.lit, reasons)), "recommended_action": F.lit(action), "limitations": none, "text_sha256": F.lit(None) if sha is None else sha, "text_length": F.lit(None) if length is None else length, "indicators": F.lit(None) if indicators is None else indicators, "transformations": F.lit(None),
    }
    assert category in CATEGORIES
    return rows.select(*(values[name].cast(kind).alias(name) for name, kind in (field.strip().split(" ", 1) for field in FINDING.split(", "))))


def trailing_findings(files: DataFrame) -> DataFrame:
    """Of (scan_id, artifact_id, ord, trailing): bytes behind the end of an image."""
    rows = files.where("trailing > 0").withColumn("k", F.lit(0))
    return finding(rows, "trailing-bytes", "detector:file-structure", category="embedded_payload", type="trailing_bytes", state="POSSIBLE", severity="medium", quality=0.6, impact="medium", reasons=["TRAILING_BYTES"], action="REVIEW", indicators=F.array(F.col("trailing").cast("string")))


DESCRIPTOR = ("width", "height", "channel_count", "alpha")


def decoder_differences(one: Column, two: Column) -> Column:
    """The fields in which two decoders' descriptors (structs) differ; null counts as a value."""
    return F.array_compact(F.array(*(F.when(~one[f].eqNullSafe(two[f]), f) for f in DESCRIPTOR)))


def decoder_findings(files: DataFrame, one: str, two: str) -> DataFrame:
    """Files (scan_id, artifact_id, ord and two descriptors) that two decoders see differently; a file that one of them didn't decode gives none."""
    rows = files.where(F.col(one).isNotNull() & F.col(two).isNotNull()).withColumn("d", decoder_differences(F.col(one), F.col(two))).where(F.size("d") > 0).withColumn("k", F.lit(0))
    return finding(rows, "decoder-differential", "detector:decoder-differential", category="file_security", type="decoder_differential", state="POSSIBLE", severity="medium", quality=0.7, impact="medium", reasons=["DECODER_DISAGREEMENT"], action="REVIEW", indicators=F.col("d"))


def hidden_canary_findings(files: DataFrame, canaries: list[bytes]) -> DataFrame:
    """Files (scan_id, artifact_id, ord, bits: the packed least significant bits) in which a known canary is hidden."""
    from ..sources.files import hidden_canary

    rows = files.withColumn("c", hidden_canary(F.col("bits"), canaries)).where("c is not null").withColumn("k", F.lit(0))
    return finding(rows, "lsb-canary", "detector:steganalysis-statistics", category="steganography", type="lsb_canary", state="CONFIRMED", severity="high", quality=0.9, likelihood=0.9, impact="high", reasons=["LSB_CANARY_DETECTED"], action="REVIEW", indicators=F.array("c"))


def early_findings(scans: DataFrame) -> DataFrame:
    """The one finding of a scan (scan_id, artifact_id, intake_rejected, over_budget) that ends before any detector."""
    rows = scans.withColumns({"ord": F.lit(0).cast("long"), "k": F.lit(0)})
    refused = finding(rows.where("intake_rejected"), "intake-rejected", "detector:intake-validation", category="file_security", type="intake_rejected", state="CONFIRMED", severity="high", quality=0.9, impact="high", reasons=["INTAKE_REJECTED"], action="QUARANTINE")
    spent = finding(rows.where("over_budget and not intake_rejected"), "resource-limit", "detector:resource-budget", category="file_security", type="resource_limit_exceeded", state="ERROR", severity="high", quality=1.0, impact="high", reasons=["RESOURCE_LIMIT_EXCEEDED"], action="UNSUPPORTED")
    return refused.unionByName(spent)


def early_executions(scans: DataFrame) -> DataFrame:
    """The one execution of such a scan; ``reason`` is the scan's."""
    refused = F.col("intake_rejected")
    return scans.where("intake_rejected or over_budget").select("scan_id", F.when(refused, "detector:intake-validation").otherwise("detector:resource-budget").alias("detector_id"), F.lit("ERROR").alias("status"), F.lit("ERROR").alias("state"), F.when(refused, "intake").otherwise("orchestration").alias("family"), F.lit("file_security").alias("category"), F.lit(True).alias("required"), "reason", F.lit(0).cast("long").alias("ord"))


#: Modules that only say of themselves that they didn't run: (name, state, reason).
STUBS = [
    ("learned-steganalysis", "UNSUPPORTED", "no model configured"),
    ("zsteg", "UNSUPPORTED", "tool_not_installed"),
    ("watermark-registry", "NOT_TESTED", "no detectors registered"),
    ("provenance", "UNSUPPORTED", "no verifier installed"),
    ("redaction-analysis", "NOT_TESTED", "not implemented"),
    ("paddleocr", "UNSUPPORTED", "not installed"),
    ("adversarial-stability", "NOT_TESTED", "not implemented"),
    ("redaction", "NOT_TESTED", "not implemented"),
]


def module_status(scans: DataFrame) -> DataFrame:
    """(scan_id, module, state, reason): the status of every module that doesn't run."""
    return scans.select("scan_id", F.explode(F.array(*(F.struct(F.lit(a).alias("module"), F.lit(b).alias("state"), F.lit(c).alias("reason")) for a, b, c in STUBS))).alias("m")).select("scan_id", "m.*")
