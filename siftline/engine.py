"""The engine's front: scan a table of texts under a profile and a mode, and say what the engine can do."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .operators import detectors as D
from .operators import evidence, found, policy, transforms
from .plans import modes
from .schemas import PROFILES
from .sources import sinks, tool_results


class Scan(NamedTuple):
    observations: DataFrame
    findings: DataFrame
    executions: DataFrame
    assessments: DataFrame
    decisions: DataFrame


def kept(d: DataFrame) -> DataFrame:
    """``d``, computed once and written to ``spark.checkpoint.dir`` (in local mode, where that is unset, to a folder of this machine)."""
    spark = d.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="siftline-")
        atexit.register(shutil.rmtree, at, True)
    path = f"{at.rstrip('/')}/scan-{uuid.uuid4().hex}"
    d.write.parquet(path)
    return spark.read.schema(d.schema).parquet(path)


def text_executions(scans: DataFrame, mode: modes.Mode = modes.FORENSIC) -> DataFrame:
    """The text detectors' executions: they always complete."""
    active = [d for d in D.TEXT_DETECTORS if {d.id, f"{d.id}-rules"} & mode.detectors] + D.REGISTERED
    rows = F.array(*(F.struct(F.lit(d.id + ("-rules" if d.id.endswith("watermark") else "")).alias("detector_id"), F.lit("SUCCESS").alias("status"), F.lit("CONFIRMED").alias("state"), F.lit(d.family).alias("family"), F.lit(d.category).alias("category"), F.lit(d.id == "detector:prompt-rules").alias("required"), F.lit(None).cast("string").alias("reason"), F.lit(i).cast("long").alias("ord")) for i, d in enumerate(active)))
    return scans.select("scan_id", F.explode(rows).alias("e")).select("scan_id", "e.*")


def observed(texts: DataFrame) -> DataFrame:
    """Observations of given texts (scan_id, artifact_id, ord, text, detector_id, engine): what readers of images, codes or metadata saw."""
    return D.observe(texts, F.col("scan_id"), F.col("ord"), F.col("text"), F.col("engine"), F.col("artifact_id"), F.col("detector_id"))


def scan(
    texts: DataFrame, scan_col: str, text_col: str, order_col: str | None = None, profiles: list[str] = PROFILES, mode: str = "forensic", tool_executions: DataFrame | None = None, check_coverage: bool = True,
    results: DataFrame | None = None, given: DataFrame | None = None, file_findings: DataFrame | None = None, policies: dict[str, policy.Policy] = policy.POLICIES, store: bool = False,
) -> Scan:
    """All stages over a table of texts.

    ``results`` are captured results of outside tools (``tool_results.RESULT``), ``given`` texts that other
    readers saw, ``file_findings`` findings about files. Without the outcomes of the outside tools that strict
    profiles require (those, or ``tool_executions`` in the executions' columns) such profiles end as
    unsupported: what was not looked at is never called clean. With ``store`` observations' findings are
    computed once and written to the shared folder; without it each result computes what it needs.
    """
    plan = modes.plan_for(mode)
    own = D.observe(texts, F.col(scan_col), F.col(order_col) if order_col else F.lit(0), F.col(text_col))
    scans = texts.where(F.col(scan_col).isNotNull()).select(F.col(scan_col).cast("string").alias("scan_id"))
    parts, files, ran = [own], [], []
    if results is not None:
        results = modes.active(results.withColumn("detector_id", reduce(lambda acc, t: acc.when(F.col("tool") == t, tool_results.TOOLS[t][0]), tool_results.TOOLS, F.when(F.lit(False), ""))), plan).drop("detector_id")
        fields = tool_results.metadata_rows(tool_results.tool_metadata(results), "fields", "detector:exiftool")
        parts.append(observed(tool_results.metadata_texts(fields, "detector:exiftool", "exiftool")))
        files += [tool_results.malware_findings(results), tool_results.embedded_findings(results), tool_results.metadata_findings(fields, "detector:exiftool")]
        ran.append(tool_results.executions(results))
    if given is not None:
        seen = observed(modes.active(given, plan))
        parts.append(seen)
        codes = seen.where("detector_id = 'detector:qr-pyzbar'").select("scan_id", F.col("source_artifact_id").alias("artifact_id"), "ord", "observation_id", F.col("raw_text").alias("text"))
        files.append(tool_results.code_findings(codes))
        # a reader whose texts are given has run
        ran.append(given.groupBy("scan_id", "detector_id").agg(F.lit("SUCCESS").alias("status"), F.lit("CONFIRMED").alias("state"), F.lit("reader").alias("family"), F.lit("prompt_injection").alias("category"), F.lit(False).alias("required"), F.lit(None).cast("string").alias("reason"), F.lit(0).cast("long").alias("ord")))
    if file_findings is not None:
        files.append(file_findings)
    for more in (results, given, file_findings):
        if more is not None:
            scans = scans.unionByName(more.where("scan_id is not null").select(F.col("scan_id").cast("string")))
    scans = scans.distinct()
    observations = evidence.merge_observations(reduce(DataFrame.unionByName, parts))
    findings = D.all_findings(observations, plan.detectors)
    for i, more in enumerate(files):
        findings = findings.unionByName(more.withColumn("ord", F.col("ord") + (100 + i) * 10**12))
    findings = evidence.deduplicate(findings)
    if store:
        findings = kept(findings)
    executions = text_executions(scans, plan)
    for more in (*ran, *([tool_executions] if tool_executions is not None else [])):
        executions = executions.unionByName(more.select(*executions.columns))
    decisions = policy.decide(scans, findings, profiles, policies)
    if check_coverage:
        decisions = policy.override(decisions, executions, findings)
    return Scan(observations, findings, executions, evidence.assess(scans, findings, executions), decisions)


def reports(got: Scan) -> DataFrame:
    """(scan_id, report): one JSON document for each scan."""
    return sinks.report(got.decisions.select("scan_id").distinct(), got.findings, got.decisions, got.assessments)


def capabilities() -> dict[str, object]:
    """What is built in, and what needs results from outside."""
    built_in = [d.id for d in (*D.TEXT_DETECTORS, *D.REGISTERED)]
    return {
        "profiles": PROFILES,
        "modes": {m.name: {"detectors": sorted(m.detectors), "transforms": sorted(m.transforms)} for m in modes.MODES.values()},
        "detectors": built_in,
        "views": sorted(transforms.VIEWS),
        "from_tool_results": [r[0] for r in policy.REGISTRY if r[0] not in built_in],
        "unsupported": [*transforms.UNSUPPORTED, *(name for name, _, _ in found.STUBS), "OCR and captions", "QR decoding"],
    }


def health() -> dict[str, object]:
    """Whether the configuration that is in force can be used; the hash tells which one it is."""
    try:
        settings, rules, registry, policies = config.load(), config.load_rules(), config.load_registry(), config.load_policies()
    except config.ConfigurationError as error:
        return {"status": "error", "reason": str(error)}
    return {"status": "ok", "configuration_hash": config.config_hash(settings), "rules": len(rules), "detectors": len(registry), "policies": len(policies)}


def attestation(spark: SparkSession) -> dict[str, object]:
    """What a verifier of results needs: versions, and the hash of the configuration."""
    import pyspark

    return {"engine": "siftline", "spark": spark.version, "pyspark": pyspark.__version__, "configuration_hash": config.config_hash(config.load()), "signed": False}
