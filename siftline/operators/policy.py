"""Policies: findings to one decision for each scan and profile, then coverage overrides and release grants.

A policy's conditions are compiled to columns; the policies and the registry are small fixed tables of
the package (``config``), so deciding needs one aggregation by scan for all profiles together.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import ACTIONS, CATEGORIES, PROFILES, SEVERITIES, STATES

STRICT = [p for p in PROFILES if p not in ("ARCHIVE_ONLY", "HUMAN_VIEW")]
COMPLETED, CONCLUSIVE = ("SUCCESS", "NO_EVIDENCE", "DETECTED"), ("CONFIRMED", "NO_EVIDENCE_FOUND")
_FIELDS = {"category", "type", "state", "state_in", "reason_code", "severity_in", "at_least"}


class PolicyError(ValueError):
    """A policy, rule or registry that breaks its schema."""


class Rule(NamedTuple):
    id: str
    priority: int
    action: str
    when: dict


class Policy(NamedTuple):
    profile: str
    default: str
    rules: list[Rule]


def check(policy: Policy) -> Policy:
    """The policy with its rules in deciding order, or PolicyError."""
    if policy.profile not in PROFILES or policy.default not in ACTIONS:
        raise PolicyError(f"unknown profile or action: {policy.profile}, {policy.default}")
    if len({r.id for r in policy.rules}) != len(policy.rules):
        raise PolicyError(f"{policy.profile}: a rule id is repeated")
    for r in policy.rules:
        w = r.when
        if not w or set(w) - _FIELDS or r.action not in ACTIONS:
            raise PolicyError(f"{r.id}: bad condition or action")
        if w.get("category", CATEGORIES[0]) not in CATEGORIES or not {*w.get("state_in", ()), *([w["state"]] if "state" in w else ())} <= {*STATES} or not {*w.get("severity_in", ())} <= {*SEVERITIES}:
            raise PolicyError(f"{r.id}: unknown value")
        if not all(f in ("attack_likelihood", "detector_confidence", "evidence_quality") and 0 <= v <= 1 for f, v in w.get("at_least", {}).items()):
            raise PolicyError(f"{r.id}: bad threshold")
    return policy._replace(rules=sorted(policy.rules, key=lambda r: (-r.priority, r.id)))


_ACTIVE, _ANY = ["CONFIRMED", "HIGHLY_LIKELY"], ["CONFIRMED", "HIGHLY_LIKELY", "POSSIBLE"]
_BUNDLE = """
AGENT_WITH_TOOLS ALLOW_RECONSTRUCTED_ONLY
  quarantine-known-malware 1000 QUARANTINE malware active
  quarantine-embedded-executable 950 QUARANTINE embedded_payload CONFIRMED type=executable
  block-confirmed-prompt-injection 900 BLOCK prompt_injection active
  review-possible-prompt-injection 700 REVIEW prompt_injection POSSIBLE
  review-embedded-payload 650 REVIEW embedded_payload any
  review-phishing-indicators 645 REVIEW phishing any
  review-steganography 640 REVIEW steganography active
  reconstructed-only-on-fragile-signal 600 ALLOW_RECONSTRUCTED_ONLY adversarial_instability likely
  public-redact-location 500 ALLOW_WITH_REDACTION privacy - reason=GPS_PRESENT
  review-privacy-sensitive-text 450 ALLOW_WITH_REDACTION privacy CONFIRMED
ARCHIVE_ONLY REVIEW
  archive-quarantine-malware 1000 QUARANTINE malware active
  archive-review-active-prompt 700 REVIEW prompt_injection active
SECURITY_FORENSICS REVIEW
  forensic-quarantine-malware 1000 QUARANTINE malware active
  forensic-review-any-confirmed 200 REVIEW * CONFIRMED
HUMAN_VIEW ALLOW_RECONSTRUCTED_ONLY
  human-quarantine-malware 1000 QUARANTINE malware active
  human-block-prompt 800 BLOCK prompt_injection active
  human-review-prompt 700 REVIEW prompt_injection POSSIBLE
  human-review-embedded-payload 650 REVIEW embedded_payload any
  human-redact-privacy 630 ALLOW_WITH_REDACTION privacy CONFIRMED
  human-review-phishing 620 REVIEW phishing any
  human-review-steganography 600 REVIEW steganography active
OCR_EXTRACTION ALLOW_RECONSTRUCTED_ONLY
  ocr-block-active-prompt 900 BLOCK prompt_injection active
  ocr-review-possible-prompt 700 REVIEW prompt_injection POSSIBLE
  ocr-review-phishing 675 REVIEW phishing any
  ocr-review-privacy 650 REVIEW privacy CONFIRMED
PUBLIC_REPUBLISHING REVIEW
  public-quarantine-malware 1000 QUARANTINE malware active
  public-block-prompt 900 BLOCK prompt_injection active
  public-review-possible-prompt 700 REVIEW prompt_injection POSSIBLE
  public-redact-privacy 650 ALLOW_WITH_REDACTION privacy CONFIRMED
RAG_INGESTION ALLOW_RECONSTRUCTED_ONLY
  rag-block-active-prompt 900 BLOCK prompt_injection active
  rag-review-phishing 675 REVIEW phishing any
  rag-review-privacy 650 REVIEW privacy CONFIRMED
VLM_READ_ONLY ALLOW_RECONSTRUCTED_ONLY
  vlm-block-active-prompt 900 BLOCK prompt_injection active
  vlm-review-possible-prompt 700 REVIEW prompt_injection POSSIBLE
"""


def parse(bundle: str) -> dict[str, Policy]:
    """Policies from lines 'profile default', each followed by indented lines 'id priority action category state [type=|reason=]'."""
    found: dict[str, Policy] = {}
    for line in filter(str.strip, bundle.splitlines()):
        words = line.split()
        if not line.startswith(" "):
            now = found[words[0]] = Policy(words[0], words[1], [])
            continue
        name, priority, action, category, state, *more = words
        when: dict = {} if category == "*" else {"category": category}
        if state in ("active", "any", "likely"):
            when["state_in"] = {"active": _ACTIVE, "any": _ANY, "likely": ["POSSIBLE", "HIGHLY_LIKELY"]}[state]
        elif state != "-":
            when["state"] = state
        for extra in more:
            key, value = extra.split("=")
            when[{"type": "type", "reason": "reason_code"}[key]] = value
        now.rules.append(Rule(name, int(priority), action, when))
    return {p: check(policy) for p, policy in found.items()}


POLICIES = parse(_BUNDLE)
#: (id, family, category, required, profiles that require it too)
_BASIC = ["AGENT_WITH_TOOLS", "RAG_INGESTION"]
_TOOLS = [*_BASIC, "SECURITY_FORENSICS"]
REGISTRY = [
    ("detector:metadata-builtin", "metadata", "privacy", True, []),
    ("detector:exiftool", "metadata", "privacy", False, []),
    ("detector:tesseract", "OCR", "prompt_injection", False, [*_BASIC, "OCR_EXTRACTION", "PUBLIC_REPUBLISHING"]),
    ("detector:qr-pyzbar", "QR/barcode", "embedded_payload", False, _BASIC),
    ("detector:prompt-rules", "prompt", "prompt_injection", True, []),
    ("detector:malware-clamav", "malware", "malware", False, _TOOLS),
    ("detector:malware-yara", "malware", "malware", False, _TOOLS),
    ("detector:embedded-binwalk", "embedded_payload", "embedded_payload", False, _TOOLS),
]


def condition(when: dict) -> Column:
    """The column of a rule's condition on a finding; a null never fulfils it."""
    tests = [F.lit(True)]
    for field, value in when.items():
        if field == "reason_code":
            tests.append(F.array_contains("reason_codes", value))
        elif field == "at_least":
            tests += [F.col(f) >= float(v) for f, v in value.items()]
        elif isinstance(value, list):
            tests.append(F.col(field.removesuffix("_in")).isin(value))
        else:
            tests.append(F.col(field) == value)
    out = tests[0]
    for t in tests[1:]:
        out &= t
    return F.coalesce(out, F.lit(False))


def decide(scans: DataFrame, findings: DataFrame, profiles: list[str] = PROFILES, policies: dict[str, Policy] = POLICIES) -> DataFrame:
    """A decision for each scan and profile: the first rule in order (priority, then id) that some finding fulfils, or the default."""
    hits = []
    for p in profiles:
        for i, r in enumerate(policies[p].rules):
            hits.append(F.when(condition(r.when), F.struct(F.lit(p).alias("profile"), F.lit(i).alias("place"), F.lit(r.id).alias("rule"), F.lit(r.priority).alias("priority"), F.lit(r.action).alias("action"))))
    matched = findings.withColumn("hit", F.explode(F.array_compact(F.array(*hits)))).select("scan_id", "hit.*", "ord", "finding_id", "reason_codes")
    by_rule = matched.groupBy("scan_id", "profile", "place", "rule", "priority", "action").agg(F.min_by(F.struct("finding_id", "reason_codes"), "ord").alias("first"))
    by_scan = by_rule.groupBy("scan_id", "profile").agg(F.array_sort(F.collect_list(F.struct("place", "rule", "priority", "action", F.col("first.finding_id").alias("finding_id"), F.col("first.reason_codes").alias("reason_codes")))).alias("m"))
    defaults = scans.sparkSession.createDataFrame([(p, policies[p].default) for p in profiles], "profile string, default_action string")
    d = scans.select("scan_id").crossJoin(F.broadcast(defaults)).join(by_scan, ["scan_id", "profile"], "left")
    win = F.get("m", 0)
    return d.select(
        "scan_id",
        "profile",
        F.coalesce(win["action"], "default_action").alias("action"),
        F.lit(False).alias("safe_claim"),
        F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform("m", lambda x: x["reason_codes"])))), F.array(F.lit("POLICY_DEFAULT_ACTION"))).alias("reason_codes"),
        F.coalesce(F.transform("m", lambda x: x["rule"]), F.array(F.lit("policy-default-action"))).alias("triggered_policy_rules"),
        F.coalesce(win["rule"], F.lit("policy-default-action")).alias("winning_rule_id"),
        F.coalesce(win["priority"], F.lit(-1)).alias("winning_rule_priority"),
        F.when(win.isNotNull(), F.concat(F.lit("Rule "), win["rule"], F.lit(" matched finding "), win["finding_id"], F.lit("."))).otherwise("The profile declares this action as its default.").alias("explanation"),
    )


# ---------------------------------------------------------------- coverage
def detected_without_finding(executions: DataFrame, findings: DataFrame) -> DataFrame:
    """(scan_id, detector_id, ord): executions that detected something of which there is no finding."""
    named = findings.select("scan_id", F.explode("detector_ids").alias("detector_id")).distinct()
    return executions.where("status = 'DETECTED'").select("scan_id", "detector_id", "ord").join(named, ["scan_id", "detector_id"], "left_anti")


def registry(spark) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(REGISTRY)], "registry_order int, detector_id string, family string, category string, required boolean, required_profiles array<string>")


def coverage_failures(scans: DataFrame, executions: DataFrame, findings: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """(scan_id, profile, failures): what a strict profile lacks, in order; rows only where something is lacking.

    The last execution of a detector counts. ``missing`` has (scan_id, missing_required).
    """
    last = executions.groupBy("scan_id", "detector_id").agg(F.max_by(F.struct("status", "state"), "ord").alias("x"))
    strict = [p for p in STRICT if p != "VLM_READ_ONLY"]
    need = registry(scans.sparkSession).withColumn("profile", F.explode(F.array(*map(F.lit, strict)))).where("required or array_contains(required_profiles, profile)")
    cells = scans.select("scan_id").crossJoin(F.broadcast(need.select("registry_order", "detector_id", "profile"))).join(last, ["scan_id", "detector_id"], "left")
    ok = F.col("x.status").isin(*COMPLETED) & F.col("x.state").isin(*CONCLUSIVE)
    text = F.when(F.col("x").isNull(), F.concat("detector_id", F.lit(":missing"))).otherwise(F.concat("detector_id", F.lit(":"), "x.status", F.lit("/"), "x.state"))
    entry = lambda a, b, t: F.struct(F.lit(a).alias("a"), b.cast("long").alias("b"), t.alias("t"))
    parts = cells.where(F.col("x").isNull() | ~ok).select("scan_id", "profile", entry(0, F.col("registry_order"), text).alias("e"))
    every = F.explode(F.array(*map(F.lit, strict))).alias("profile")
    orphans = detected_without_finding(executions, findings)
    parts = parts.unionByName(orphans.select("scan_id", every, entry(2, F.col("ord"), F.concat("detector_id", F.lit(":DETECTED_WITHOUT_FINDING"))).alias("e")))
    if missing is not None:
        parts = parts.unionByName(missing.select("scan_id", F.posexplode("missing_required").alias("pos", "item")).select("scan_id", every, entry(1, F.col("pos"), F.concat(F.lit("representation:"), "item", F.lit(":missing"))).alias("e")))
    return parts.groupBy("scan_id", "profile").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["t"]).alias("failures"))


def override(decisions: DataFrame, executions: DataFrame, findings: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """Decisions after coverage: a detection without a finding blocks; a strict profile with gaps, and the read-only one always, is unsupported."""
    scans = decisions.select("scan_id").distinct()
    gaps = coverage_failures(scans, executions, findings, missing)
    lost = detected_without_finding(executions, findings).groupBy("scan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "detector_id"))), lambda x: F.concat(x["detector_id"], F.lit(":DETECTED_WITHOUT_FINDING"))).alias("lost"))
    d = decisions.join(gaps, ["scan_id", "profile"], "left").join(lost, "scan_id", "left")
    branches = [
        (F.col("profile") == "VLM_READ_ONLY", "UNSUPPORTED", "VLM_ANALYZER_NOT_AVAILABLE", "vlm-read-only-unsupported", 25000, F.lit("No visual analyzer is there for this profile.")),
        (F.col("failures").isNotNull(), "UNSUPPORTED", "MANDATORY_ANALYSIS_NOT_RUN", "mandatory-detector-coverage", 20000, F.array_join("failures", "; ")),
        (F.col("lost").isNotNull(), "BLOCK", "DETECTED_WITHOUT_FINDING", "detected-without-finding", 19000, F.array_join("lost", "; ")),
    ]

    def pick(values: list[Column], kept: str) -> Column:
        out = F.when(branches[0][0], values[0])
        for (test, *_), v in zip(branches[1:], values[1:]):
            out = out.when(test, v)
        return out.otherwise(F.col(kept)).alias(kept)

    lits = lambda i: [F.lit(b[i]) for b in branches]
    return d.select("scan_id", "profile", pick(lits(1), "action"), "safe_claim", pick([F.array(x) for x in lits(2)], "reason_codes"), pick([F.array(x) for x in lits(3)], "triggered_policy_rules"), pick(lits(3), "winning_rule_id"), pick(lits(4), "winning_rule_priority"), pick([b[5] for b in branches], "explanation"))


def early_decision(scans: DataFrame) -> DataFrame:
    """Decisions of scans (scan_id, intake_rejected, over_budget, reason) that end before any detector: quarantined, or unsupported. ``found`` has their findings and executions."""
    d = scans.where("intake_rejected or over_budget").crossJoin(F.broadcast(scans.sparkSession.createDataFrame([(p,) for p in PROFILES], "profile string")))
    pick = lambda a, b: F.when(F.col("intake_rejected"), a).otherwise(b)
    rule, code = pick("quarantine-intake-rejected", "resource-budget"), pick("INTAKE_REJECTED", "RESOURCE_LIMIT_EXCEEDED")
    return d.select(
        "scan_id", "profile", pick("QUARANTINE", "UNSUPPORTED").alias("action"), F.lit(False).alias("safe_claim"), F.array(code).alias("reason_codes"), F.array(rule).alias("triggered_policy_rules"), rule.alias("winning_rule_id"), pick(10000, 20000).alias("winning_rule_priority"), F.col("reason").alias("explanation"),
    )


# ---------------------------------------------------------------- release
GRANTING = ("ALLOW_RECONSTRUCTED_ONLY", "ALLOW_WITH_REDACTION")


def release_grants(decisions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Grants of artifacts (scan_id, artifact_id, role, media_type, parameters) that a decision releases.

    A reconstruction must be a JPEG that says of itself that it is lossy, flattened and without metadata;
    a redacted artifact, that it is redacted and without metadata. Nothing else is ever granted.
    """
    true = lambda *names: [F.coalesce(F.col("parameters")[n], F.lit("false")) == "true" for n in names]
    a, b, c = true("lossy", "flattened", "metadata_stripped")
    x, y = true("redacted", "metadata_stripped")
    lossy = (F.col("action") == GRANTING[0]) & (F.col("role") == "canonical_lossy") & (F.col("media_type") == "image/jpeg") & a & b & c
    redacted = (F.col("action") == GRANTING[1]) & (F.col("role") == "redacted") & x & y
    return decisions.where(F.col("action").isin(*GRANTING)).join(artifacts, "scan_id").where(lossy | redacted).select("scan_id", "profile", F.concat(F.lit("grant:"), F.substring_index("artifact_id", ":", -1)).alias("grant_id"), "artifact_id", "action", "role")


def released(artifacts: DataFrame, grants: DataFrame) -> DataFrame:
    """The artifacts that may be served: granted, eligible and of a releasable role."""
    return artifacts.where("release_eligible and role in ('canonical_lossy', 'redacted')").join(grants.select("artifact_id").distinct(), "artifact_id", "left_semi")


def latest_by(d: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """The newest row of each key; of equals the one with the greatest tie-breaker."""
    return d.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc(tie)))).where("__n = 1").drop("__n")

