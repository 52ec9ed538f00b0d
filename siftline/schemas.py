"""Enumerations, their ranks, and the columns that findings and executions share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATES = ["NO_EVIDENCE_FOUND", "NOT_TESTED", "UNSUPPORTED", "ERROR", "INCONCLUSIVE", "POSSIBLE", "HIGHLY_LIKELY", "CONFIRMED"]
SEVERITIES = ["low", "medium", "high", "critical"]
ACTIONS = ["ALLOW_ORIGINAL", "ALLOW_RECONSTRUCTED_ONLY", "ALLOW_WITH_REDACTION", "REVIEW", "BLOCK", "QUARANTINE", "UNSUPPORTED"]
CATEGORIES = "file_security malware embedded_payload prompt_injection covert_channel steganography watermarks provenance phishing privacy redaction_failure adversarial_instability authenticity_indicators".split()
PROFILES = "AGENT_WITH_TOOLS ARCHIVE_ONLY HUMAN_VIEW OCR_EXTRACTION PUBLIC_REPUBLISHING RAG_INGESTION SECURITY_FORENSICS VLM_READ_ONLY".split()
STATUSES = "SUCCESS NO_EVIDENCE DETECTED NOT_TESTED UNSUPPORTED TOOL_NOT_INSTALLED ERROR TIMEOUT RESOURCE_LIMIT MISSING CANCELLED".split()

OBSERVATION = "scan_id string, observation_id string, ord bigint, source_artifact_id string, detector_id string, engine string, raw_text string, normalized_text string, zero_width_found boolean, bidi_found boolean"
FINDING = (
    "scan_id string, finding_id string, ord bigint, category string, type string, state string, severity string, detector_confidence double, evidence_quality double, attack_likelihood double, impact string, "
    "source_artifact_ids array<string>, observation_ids array<string>, detector_ids array<string>, reason_codes array<string>, recommended_action string, limitations array<string>, text_sha256 string, text_length bigint, indicators array<string>, transformations array<string>"
)
EXECUTION = "scan_id string, detector_id string, status string, state string, family string, category string, required boolean, reason string, ord bigint"


def rank(c: Column, values: list[str], first: int = 0) -> Column:
    """The place of an enumeration's value, from ``first``; 0 for others. Values are never compared as strings."""
    out = F.when(c == values[0], first)
    for i, v in enumerate(values[1:], first + 1):
        out = out.when(c == v, i)
    return out.otherwise(0)


def state_rank(c: Column) -> Column:
    return rank(c, STATES)


def severity_rank(c: Column) -> Column:
    return rank(c, SEVERITIES, 1)


def rank_sql(name: str, values: list[str], first: int = 0) -> str:
    return "case " + " ".join(f"when {name} = '{v}' then {i}" for i, v in enumerate(values, first)) + " else 0 end"
