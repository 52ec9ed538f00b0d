"""Captured results of outside tools as executions, findings and observations.

The tools themselves run elsewhere; a table of what they printed is the input: (scan_id, artifact_id, ord,
tool, returncode, stdout, stderr, timed_out, error). What can't be read as a result is an error or
inconclusive, never clean.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.found import finding

RESULT = "scan_id string, artifact_id string, ord bigint, tool string, returncode int, stdout string, stderr string, timed_out boolean, error string"
#: tool: (detector, family, category)
TOOLS = {
    "clamav": ("detector:malware-clamav", "malware", "malware"),
    "yara": ("detector:malware-yara", "malware", "malware"),
    "binwalk": ("detector:embedded-binwalk", "embedded_payload", "embedded_payload"),
    "exiftool": ("detector:exiftool", "metadata", "privacy"),
}
NOT_INSTALLED = "executable_not_found"
CONTAINERS = "bitmap bmp exif gif jfif jpeg png tiff webp".split() + ["image data"]
PROGRAMS = ("dos ", "elf", "executable", "mz ", "pe32", "script", "shell")


def _outcome(status: str, state: str, reason: Column) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(state).alias("state"), reason.cast("string").alias("reason"))


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), _trimmed), lambda x: x != "")


def _texts(*given: Column | None) -> list[Column]:
    return [F.lit(None).cast("string") if c is None else c for c in given]


def _said(out: Column, err: Column, code: Column, name: str) -> Column:
    """What a tool said of its failure."""
    return F.coalesce(F.nullif(_trimmed(err), F.lit("")), F.nullif(_trimmed(out), F.lit("")), F.concat(F.lit(f"{name} error: rc="), code))


def _failed(timed_out: Column, error: Column, name: str, late: str = "INCONCLUSIVE"):
    """Outcomes that all tools share: not installed, too late, not run."""
    return (
        F.when(error == NOT_INSTALLED, _outcome("UNSUPPORTED", "UNSUPPORTED", F.lit("tool_not_installed")))
        .when(F.coalesce(timed_out, F.lit(False)), _outcome("TIMEOUT", late, F.lit(f"{name} timed out")))
        .when(F.coalesce(error, F.lit("")) != "", _outcome("ERROR", "ERROR", error))
    )


# ---------------------------------------------------------------- what each tool printed
def antivirus(code: Column, out: Column, timed_out: Column, err: Column | None = None, error: Column | None = None) -> Column:
    """0 is clean, 1 a detection, everything else an error."""
    err, error = _texts(err, error)
    first = F.get(F.filter(_lines(out), lambda x: F.contains(x, F.lit("FOUND"))), 0)
    both = F.lower(F.concat_ws("\n", out, err))
    lost = F.contains(both, F.lit("database")) | F.contains(both, F.lit("no such file"))
    return (
        _failed(timed_out, error, "clamscan")
        .when(code == 0, _outcome("NO_EVIDENCE", "NO_EVIDENCE_FOUND", F.lit(None)))
        .when(code == 1, _outcome("DETECTED", "CONFIRMED", F.coalesce(first, F.lit("malware detected"))))
        .when(lost, _outcome("ERROR", "ERROR", F.lit("signature_database_missing")))
        .otherwise(_outcome("ERROR", "ERROR", _said(out, err, code, "clamscan")))
    )


def antivirus_name(out: Column) -> Column:
    """The signature's name on the first line that says FOUND."""
    first = F.get(F.filter(_lines(out), lambda x: F.contains(x, F.lit("FOUND"))), 0)
    return F.nullif(_trimmed(F.regexp_extract(first, r"^.*:(.*) FOUND$", 1)), F.lit(""))


def pattern_scanner(code: Column, out: Column, timed_out: Column, err: Column | None = None, error: Column | None = None) -> Column:
    err, error = _texts(err, error)
    n = F.size(_lines(out))
    return (
        _failed(timed_out, error, "yara")
        .when(code.isNull(), _outcome("ERROR", "ERROR", F.lit("yara did not complete")))
        .when(code != 0, _outcome("ERROR", "ERROR", _said(out, err, code, "yara")))
        .when(n > 0, _outcome("DETECTED", "CONFIRMED", F.concat(F.lit("yara: "), n, F.lit(" rule(s) matched"))))
        .otherwise(_outcome("NO_EVIDENCE", "NO_EVIDENCE_FOUND", F.lit(None)))
    )


def pattern_matches(out: Column) -> Column:
    """array<struct(rule, namespace, tags)> of lines 'namespace:rule [tag,tag] path'."""
    name = lambda x: F.substring_index(x, " ", 1)
    tags = lambda x: F.filter(F.transform(F.split(F.regexp_extract(x, r"^\S+ \[([^\]]*)\]", 1), ","), _trimmed), lambda t: t != "")
    return F.transform(
        _lines(out),
        lambda x: F.struct(
            F.when(F.contains(name(x), F.lit(":")), F.regexp_extract(name(x), "^[^:]*:(.*)$", 1)).otherwise(name(x)).alias("rule"),
            F.when(F.contains(name(x), F.lit(":")), F.substring_index(name(x), ":", 1)).otherwise("default").alias("namespace"),
            tags(x).alias("tags"),
        ),
    )


def carved(out: Column) -> Column:
    """array<struct(offset, description)> of a carver's table, without the outer container at offset 0."""
    rows = F.filter(_lines(out), lambda x: x.rlike(r"^[+-]?\d+(?:\s|$)"))
    parts = F.transform(rows, lambda x: F.struct(F.regexp_extract(x, r"^([+-]?\d+)", 1).try_cast("long").alias("offset"), F.when(F.size(F.split(x, r"\s+")) > 2, F.array_join(F.slice(F.split(x, r"\s+"), 3, F.size(F.split(x, r"\s+"))), " ")).otherwise(x).alias("description")))
    outer = lambda p: (p["offset"] == 0) & F.exists(F.array(*map(F.lit, CONTAINERS)), lambda w: F.contains(F.lower(p["description"]), w))
    return F.filter(parts, lambda p: p["offset"].isNotNull() & ~outer(p))


def carver(code: Column, out: Column, timed_out: Column, err: Column | None = None, error: Column | None = None) -> Column:
    err, error = _texts(err, error)
    first = F.get(carved(out), 0)
    return (
        _failed(timed_out, error, "binwalk")
        .when(code.isNull(), _outcome("ERROR", "ERROR", F.lit("binwalk did not complete")))
        .when(code != 0, _outcome("ERROR", "ERROR", _said(out, err, code, "binwalk")))
        .when(first.isNotNull(), _outcome("DETECTED", "CONFIRMED", F.concat(F.lit("embedded payload at offset "), first["offset"], F.lit(": "), F.substring(first["description"], 1, 100))))
        .otherwise(_outcome("NO_EVIDENCE", "NO_EVIDENCE_FOUND", F.lit(None)))
    )


def carved_type(description: Column) -> Column:
    low = F.lower(description)
    return F.when(F.exists(F.array(*map(F.lit, PROGRAMS)), lambda w: F.contains(low, w)), "embedded_executable").otherwise("embedded_payload")


def metadata_json(out: Column) -> Column:
    """The first object of a metadata tool's JSON, as a map; null if there is none."""
    return F.get(F.from_json(out, "array<map<string,string>>"), 0)


def metadata_tool(code: Column, out: Column, timed_out: Column, err: Column | None = None, error: Column | None = None) -> Column:
    err, error = _texts(err, error)
    fields = F.from_json(out, "array<map<string,string>>")
    named = F.exists(F.map_keys(F.get(fields, 0)), lambda k: T.is_text_class(T.metadata_class(k, F.get(fields, 0)[k])) | (T.metadata_class(k, F.get(fields, 0)[k]) == "location_data"))
    return (
        _failed(timed_out, error, "exiftool", "ERROR")
        .when(code.isNull() | (code != 0), _outcome("ERROR", "ERROR", F.substring(F.coalesce(F.nullif(err, F.lit("")), F.lit("exiftool_failed")), 1, 300)))
        .when(fields.isNull() | (_trimmed(out) == ""), _outcome("ERROR", "ERROR", F.lit("invalid_json")))
        .when(F.coalesce(named, F.lit(False)), _outcome("SUCCESS", "CONFIRMED", F.lit(None)))
        .otherwise(_outcome("NO_EVIDENCE", "NO_EVIDENCE_FOUND", F.lit(None)))
    )


_READERS = {"clamav": antivirus, "yara": pattern_scanner, "binwalk": carver, "exiftool": metadata_tool}


# ---------------------------------------------------------------- executions and findings
def outcomes(results: DataFrame) -> DataFrame:
    """``results`` with status, state and reason; rows of tools that aren't known are left out."""
    c = F.col
    said = reduce(lambda acc, item: acc.when(c("tool") == item[0], item[1](c("returncode"), c("stdout"), c("timed_out"), c("stderr"), c("error"))), _READERS.items(), F.when(F.lit(False), _outcome("", "", F.lit(None))))
    return results.where(c("tool").isin(*TOOLS)).withColumn("__o", said).select(*results.columns, "__o.*")


def executions(results: DataFrame) -> DataFrame:
    """A row for each result, in the executions' columns."""
    pick = lambda i: reduce(lambda acc, t: acc.when(F.col("tool") == t, TOOLS[t][i]), TOOLS, F.when(F.lit(False), ""))
    return outcomes(results).select("scan_id", pick(0).alias("detector_id"), "status", "state", pick(1).alias("family"), pick(2).alias("category"), F.lit(False).alias("required"), "reason", "ord")


def _detected(results: DataFrame, tool: str) -> DataFrame:
    return outcomes(results.where(F.col("tool") == tool)).where("status = 'DETECTED'")


def malware_findings(results: DataFrame) -> DataFrame:
    """One finding for each antivirus detection, one for each rule that a pattern scanner matched."""
    virus = _detected(results, "clamav").withColumns({"k": F.lit(0), "shown": F.array(F.coalesce(antivirus_name(F.col("stdout")), "reason"))})
    rules = _detected(results, "yara").select("*", F.posexplode(pattern_matches(F.col("stdout"))).alias("k", "m")).withColumn("shown", F.concat(F.array(F.concat_ws(":", "m.namespace", "m.rule")), F.col("m.tags")))
    one = finding(virus, "clamav-detected", "detector:malware-clamav", category="malware", type="malware_signature", state="CONFIRMED", severity="critical", quality=0.95, likelihood=0.9, impact="critical", reasons=["MALWARE_SIGNATURE_DETECTED"], action="QUARANTINE", indicators=F.col("shown"))
    two = finding(rules, "yara-match", "detector:malware-yara", category="malware", type="yara_rule_match", state="CONFIRMED", severity="high", quality=0.9, likelihood=0.8, impact="high", reasons=["YARA_RULE_MATCH"], action="QUARANTINE", indicators=F.col("shown"))
    return one.unionByName(two)


def embedded_findings(results: DataFrame) -> DataFrame:
    """One finding for each thing that a carver saw behind the container's head."""
    rows = _detected(results, "binwalk").select("*", F.posexplode(carved(F.col("stdout"))).alias("k", "m"))
    kind = carved_type(F.col("m.description"))
    return finding(
        rows, "binwalk", "detector:embedded-binwalk", category="embedded_payload", type=kind, state="CONFIRMED", severity=F.when(kind == "embedded_executable", "critical").otherwise("high"), quality=0.85, likelihood=0.85, impact="critical", reasons=["NESTED_PAYLOAD_DETECTED"], action="QUARANTINE",
        indicators=F.array(F.col("m.offset").cast("string"), F.substring("m.description", 1, 300)),
    )


# ---------------------------------------------------------------- metadata
def metadata_rows(files: DataFrame, fields_col: str, detector: str) -> DataFrame:
    """A row for each field of a map column of (scan_id, artifact_id, ord, fields): k, key, value, class, reason and observation_id (null where the field is no text)."""
    rows = files.where(F.col(fields_col).isNotNull()).select("scan_id", "artifact_id", "ord", F.explode(F.map_entries(F.map_filter(fields_col, lambda k, v: k != "SourceFile"))).alias("e"))
    kind = T.metadata_class(F.col("e.key"), F.col("e.value"))
    rows = rows.select("scan_id", "artifact_id", "ord", F.col("e.key").alias("key"), F.substring("e.value", 1, 100_000).alias("value"), kind.alias("class"), T.privacy_reason(kind).alias("reason"), (T.is_text_class(kind) & (F.coalesce("e.value", F.lit("")) != "")).alias("emits"))
    place = F.row_number().over(Window.partitionBy("scan_id", "emits").orderBy("ord", "artifact_id", "key")) - 1
    name = detector.split(":")[1]
    return rows.withColumn("k", place.cast("int")).withColumn("observation_id", F.when(F.col("emits"), F.format_string(f"observation:%s:{name}:%03d", "scan_id", "k")))


def tool_metadata(results: DataFrame) -> DataFrame:
    """(scan_id, artifact_id, ord, fields) of the metadata tool's results that could be read."""
    good = outcomes(results.where("tool = 'exiftool'")).where("status in ('SUCCESS', 'NO_EVIDENCE')")
    return good.select("scan_id", "artifact_id", "ord", metadata_json(F.col("stdout")).alias("fields"))


def metadata_texts(rows: DataFrame, detector: str, engine: str) -> DataFrame:
    """The fields that are texts, to be observed: (scan_id, artifact_id, ord, text, detector_id, engine, observation_id)."""
    return rows.where("emits").select("scan_id", "artifact_id", F.col("k").cast("long").alias("ord"), F.col("value").alias("text"), F.lit(detector).alias("detector_id"), F.lit(engine).alias("engine"), "observation_id")


def metadata_findings(rows: DataFrame, detector: str) -> DataFrame:
    """At most two findings for each artifact: a place, and an identity that some text shows."""
    name = detector.split(":")[1]
    own = rows.where("reason is not null").groupBy("scan_id", "artifact_id", "reason").agg(F.min("ord").alias("ord"), F.array_sort(F.collect_set("observation_id")).alias("observation_ids"))
    own = own.where("reason = 'GPS_PRESENT' or size(observation_ids) > 0").withColumn("k", F.when(F.col("reason") == "GPS_PRESENT", 0).otherwise(1))
    kind = F.when(F.col("reason") == "GPS_PRESENT", "gps_metadata").otherwise("identity_metadata")
    return finding(own, F.concat(F.lit(f"{name}:"), F.lower(F.translate("reason", "_", "-"))), detector, category="privacy", type=kind, state="CONFIRMED", severity="medium", quality=0.9, impact="medium", reasons=F.array("reason"), action="ALLOW_WITH_REDACTION", observations=F.col("observation_ids"))


# ---------------------------------------------------------------- results of readers of codes
def code_findings(payloads: DataFrame) -> DataFrame:
    """A finding for each decoded QR or bar code of (scan_id, artifact_id, ord, observation_id, text)."""
    shown = T.text_evidence(F.col("text"))
    rows = payloads.where("text is not null").withColumn("k", F.lit(0))
    return finding(rows, "qr", "detector:qr-pyzbar", category="embedded_payload", type="qr_payload", state="CONFIRMED", severity="medium", quality=0.9, impact="medium", reasons=["QR_PAYLOAD"], action="REVIEW", observations=F.array("observation_id"), sha=shown["text_sha256"], length=shown["text_length"])
