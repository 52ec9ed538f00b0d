"""The queries over files, pictures and tools' results, registered with those of ``catalogue``.

Events stand for captured results: an event's number says which tool ran and how it ended, its type what
the tool printed. Pictures are two by four pixels, from the hash of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.conditions import quoted
from ..operators import detectors as D
from ..operators import evaluation, found, policy, transforms
from ..schemas import PROFILES
from ..sources import files, tool_results
from .catalogue import _sql_pick, query, table
from .modes import FORENSIC

# ---------------------------------------------------------------- tools' results
_CASES = {
    "clamav": [(0, "", ""), (1, "/in/x: Sig-{0} FOUND", ""), (2, "", "LibClamAV Error: no such file")],
    "yara": [(0, "", ""), (0, "lab:rule_{0} [a, b] /in/x\nplain /in/x", ""), (1, "", "bad rules")],
    "binwalk": [(0, "DECIMAL HEX DESCRIPTION\n0 0x0 PNG image, 1 x 1", ""), (0, "0 0x0 PNG image\n77 0x4D ELF, 64-bit {0}\n900 0x384 Zip archive data", ""), (3, "", "")],
    "exiftool": [(0, '[{{"SourceFile":"x","File:ImageWidth":"100"}}]', ""), (0, '[{{"SourceFile":"x","GPS:GPSLatitude":"1","XMP:Author":"{0}","XMP:Description":"about {0}"}}]', ""), (1, "", "File not found")],
}
_TOOLS = list(_CASES)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, kind = F.col("event_id"), F.coalesce("event_type", F.lit("none"))
    case = F.floor(n / 4) % 5

    def pick(i: int, text: bool):
        out = F.when(F.lit(False), F.lit("" if text else 0))
        for t, tool in enumerate(_TOOLS):
            for c, row in enumerate(_CASES[tool]):
                value = F.replace(F.lit(row[i].format("\x00")), F.lit("\x00"), kind) if text else F.lit(row[i])
                out = out.when((n % 4 == t) & (case == c), value)
        return out

    return table(spark, sf_dir, "events").where("user_id is not null").select(
        F.concat(F.lit("u"), "user_id").alias("scan_id"), F.format_string("artifact:%d", n).alias("artifact_id"), n.alias("ord"), F.element_at(F.array(*map(F.lit, _TOOLS)), (n % 4 + 1).cast("int")).alias("tool"),
        pick(0, False).cast("int").alias("returncode"), pick(1, True).alias("stdout"), pick(2, True).alias("stderr"), (case == 3).alias("timed_out"), F.when(case == 4, tool_results.NOT_INSTALLED).alias("error"),
    )


_RES = f"res as (select 'u' || user_id as scan_id, 'artifact:' || event_id as artifact_id, event_id as ord, {_sql_pick(_TOOLS, 'event_id % 4')} as tool, (event_id // 4) % 5 as c, coalesce(event_type, 'none') as kind from events where user_id is not null)"
_DETECTORS = {t: tool_results.TOOLS[t][0] for t in _TOOLS}
_BY_TOOL = lambda values: "case tool " + " ".join(f"when '{t}' then {v}" for t, v in zip(_TOOLS, values)) + " end"


@query(
    f"with {_RES} select scan_id, {_BY_TOOL(map(quoted, _DETECTORS.values()))} as detector_id, case when c = 4 then 'UNSUPPORTED' when c = 3 then 'TIMEOUT' when c = 2 then 'ERROR' when c = 0 then 'NO_EVIDENCE' when tool = 'exiftool' then 'SUCCESS' else 'DETECTED' end as status, "
    "case when c = 4 then 'UNSUPPORTED' when c = 3 then case when tool = 'exiftool' then 'ERROR' else 'INCONCLUSIVE' end when c = 2 then 'ERROR' when c = 0 then 'NO_EVIDENCE_FOUND' else 'CONFIRMED' end as state, "
    "case when c = 4 then 'tool_not_installed' when c = 3 then case when tool = 'clamav' then 'clamscan' else tool end || ' timed out' "
    f"when c = 2 then {_BY_TOOL([quoted('signature_database_missing'), quoted('bad rules'), quoted('binwalk error: rc=3'), quoted('File not found')])} when c = 1 then {_BY_TOOL(['printf(chr(47) || ' + quoted('in/x: Sig-%s FOUND') + ', kind)', quoted('yara: 2 rule(s) matched'), quoted('embedded payload at offset 77: ELF, 64-bit ') + ' || kind', 'null'])} end as reason, ord from res"
)
def tool_executions(spark, sf_dir):
    return tool_results.executions(results(spark, sf_dir)).select("scan_id", "detector_id", "status", "state", "reason", "ord")


_SHOWN = ["scan_id", "finding_id", "ord", "type", "state", "severity", "attack_likelihood", "recommended_action"]


def _shown(d: DataFrame) -> DataFrame:
    return d.select(*_SHOWN, F.array_join("reason_codes", "|").alias("reason_codes"), F.array_join("indicators", "|").alias("indicators"))


_MALWARE = f"""{_RES}, hits as (select *, 0 as k, 'clamav-detected' as what, 'Sig-' || kind as indicators from res where tool = 'clamav' and c = 1
    union all select *, 0, 'yara-match', 'lab:rule_' || kind || '|a|b' from res where tool = 'yara' and c = 1 union all select *, 1, 'yara-match', 'default:plain' from res where tool = 'yara' and c = 1),
    malware as (select scan_id, printf('finding:%s:%s:%03d', scan_id, what, row_number() over (partition by scan_id, what order by ord, k) - 1) as finding_id, ord * 100 + k as ord, case tool when 'clamav' then 'malware_signature' else 'yara_rule_match' end as type, 'CONFIRMED' as state,
        case tool when 'clamav' then 'critical' else 'high' end as severity, case tool when 'clamav' then 0.9 else 0.8 end::double as attack_likelihood, 'QUARANTINE' as recommended_action, case tool when 'clamav' then 'MALWARE_SIGNATURE_DETECTED' else 'YARA_RULE_MATCH' end as reason_codes, indicators from hits)"""


@query(f"with {_MALWARE} select * from malware")
def malware_findings(spark, sf_dir):
    return _shown(tool_results.malware_findings(results(spark, sf_dir)))


_EMBEDDED = """parts as (select *, 0 as k, '77|ELF, 64-bit ' || kind as indicators from res where tool = 'binwalk' and c = 1 union all select *, 1, '900|Zip archive data' from res where tool = 'binwalk' and c = 1),
    embedded as (select scan_id, printf('finding:%s:binwalk:%03d', scan_id, row_number() over (partition by scan_id order by ord, k) - 1) as finding_id, ord * 100 + k as ord, case k when 0 then 'embedded_executable' else 'embedded_payload' end as type, 'CONFIRMED' as state,
        case k when 0 then 'critical' else 'high' end as severity, 0.85::double as attack_likelihood, 'QUARANTINE' as recommended_action, 'NESTED_PAYLOAD_DETECTED' as reason_codes, indicators from parts)"""


@query(f"with {_RES}, {_EMBEDDED} select * from embedded")
def embedded_findings(spark, sf_dir):
    return _shown(tool_results.embedded_findings(results(spark, sf_dir)))


@query(
    f"with {_RES}, seen as (select *, row_number() over (partition by scan_id order by ord) - 1 as n from res where tool = 'exiftool' and c = 1), two as (select *, 0 as k, 'gps_metadata' as type, 'GPS_PRESENT' as code from seen union all select *, 1, 'identity_metadata', 'IDENTITY_METADATA_PRESENT' from seen) "
    "select scan_id, printf('finding:%s:exiftool:%s:%03d', scan_id, lower(replace(code, '_', '-')), row_number() over (partition by scan_id order by ord, k) - 1) as finding_id, ord * 100 + k as ord, type, 'CONFIRMED' as state, 'medium' as severity, cast(null as double) as attack_likelihood, "
    "'ALLOW_WITH_REDACTION' as recommended_action, code as reason_codes, case k when 0 then '' else printf('observation:%s:exiftool:%03d', scan_id, 2 * n) end as observation_ids from two"
)
def metadata_findings(spark, sf_dir):
    """Author and description of a file are its scan's texts, in the order of their names."""
    rows = tool_results.metadata_rows(tool_results.tool_metadata(results(spark, sf_dir)), "fields", "detector:exiftool")
    d = tool_results.metadata_findings(rows, "detector:exiftool")
    return d.select(*_SHOWN, F.array_join("reason_codes", "|").alias("reason_codes"), F.array_join("observation_ids", "|").alias("observation_ids"))


@query(f"with {_MALWARE}, {_EMBEDDED}, s as (select distinct scan_id from res) select scan_id, case when scan_id in (select scan_id from malware) then 'QUARANTINE' when scan_id in (select scan_id from embedded) then 'REVIEW' else 'ALLOW_RECONSTRUCTED_ONLY' end as action from s")
def tool_decisions(spark, sf_dir):
    r = results(spark, sf_dir)
    both = tool_results.malware_findings(r).unionByName(tool_results.embedded_findings(r))
    return policy.decide(r.select("scan_id").distinct(), both, ["HUMAN_VIEW"]).select("scan_id", "action")


@query(
    "select 'p' || page_id as scan_id, printf('finding:p%d:qr:000', page_id) as finding_id, 'qr_payload' as type, 'sha256:' || sha256(url) as text_sha256, strlen(url) as text_length from pages where url is not null"
)
def code_findings(spark, sf_dir):
    """The pages' addresses as if read from codes in pictures."""
    scan = F.concat(F.lit("p"), "page_id")
    d = table(spark, sf_dir, "pages").select(scan.alias("scan_id"), F.concat(F.lit("artifact:"), scan).alias("artifact_id"), F.lit(0).cast("long").alias("ord"), F.concat(F.lit("observation:"), scan).alias("observation_id"), F.col("url").alias("text"))
    return tool_results.code_findings(d).select("scan_id", "finding_id", "type", "text_sha256", "text_length")


# ---------------------------------------------------------------- files
@query(
    "with d as (select event_id, event_id % 97 as width, coalesce(cast(user_id as bigint), 0) % 89 as height, event_id % 5 as frames from events) select event_id, case when width < 1 or height < 1 then 'undecodable' when width > 90 or height > 90 then 'side' when width * height > 4000 then 'pixels' when frames > 3 then 'frames' "
    "when greatest(width, height) > 20 * least(width, height) then 'aspect' when width * height * frames > 9000 then 'total_pixels' end as problem from d"
)
def image_validation(spark, sf_dir):
    """Events as pictures, under limits small enough for each to be met."""
    n = F.col("event_id")
    d = table(spark, sf_dir, "events").select("event_id", (n % 97).alias("w"), (F.coalesce(F.col("user_id").cast("long"), F.lit(0)) % 89).alias("h"), (n % 5).alias("f"))
    return d.select("event_id", files.image_problem(F.col("w"), F.col("h"), F.col("f"), 90, 4000, 20, 3, 9000).alias("problem"))


@query("select event_id, case event_id % 7 when 0 then 'JPEG' when 1 then 'PNG' when 2 then 'TIFF' when 3 then 'SVG' when 4 then 'UNKNOWN' when 5 then 'GIF' else 'UNKNOWN' end as format from events")
def extension_formats(spark, sf_dir):
    names = ["a.b.JPG", "x.png", "y.tif", "z.Svg", "noext", "dir.x/anim.gif", "w.exe"]
    return table(spark, sf_dir, "events").select("event_id", files.format_of_name(F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 7 + 1).cast("int"))).alias("format"))


@query(
    "with d as (select event_id, event_id % 4 as w, event_id % 3 as w2, event_type is null as a, user_id is null as a2 from events), x as (select event_id, list_filter([case when w is distinct from w2 then 'width' end, case when a <> a2 then 'alpha' end], lambda f: f is not null) as fields from d) "
    "select 'e' || event_id as scan_id, array_to_string(fields, '|') as fields from x where len(fields) > 0"
)
def decoder_differences(spark, sf_dir):
    n = F.col("event_id")
    one = lambda w, a: F.struct(w.alias("width"), F.lit(1).alias("height"), F.lit(3).alias("channel_count"), a.alias("alpha"))
    d = table(spark, sf_dir, "events").select(F.concat(F.lit("e"), n).alias("scan_id"), F.lit("artifact:e").alias("artifact_id"), n.alias("ord"), one(n % 4, F.col("event_type").isNull()).alias("one"), one(n % 3, F.col("user_id").isNull()).alias("two"))
    return found.decoder_findings(d, "one", "two").select("scan_id", F.array_join("indicators", "|").alias("fields"))


_CANARY = "SIFTLINE-STEG-CANARY"


@query(f"select 'd' || doc_id as scan_id, '{_CANARY}' as canary from documents where text is not null and doc_id % 3 < 2")
def hidden_canaries(spark, sf_dir):
    """The least bits of pictures whose first bytes hide a canary: framed, bare, or not at all."""
    framed = F.concat(F.unhex(F.lit(f"{len(_CANARY):08X}")), F.lit(_CANARY).cast("binary"))
    bits = F.when(F.col("doc_id") % 3 == 0, framed).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("some bytes ").cast("binary"), F.lit(_CANARY).cast("binary"))).otherwise(F.lit("nothing at all").cast("binary"))
    d = D.spread(table(spark, sf_dir, "documents").where("text is not null")).select(F.concat(F.lit("d"), "doc_id").alias("scan_id"), F.lit("artifact:x").alias("artifact_id"), F.lit(0).cast("long").alias("ord"), bits.alias("whole"))
    # a byte of the picture for each bit
    octets = F.transform(F.sequence(F.lit(1), F.octet_length("whole")), lambda i: F.unhex(F.regexp_replace(F.lpad(F.conv(F.hex(F.substring(F.col("whole"), i, F.lit(1))), 16, 2), 8, "0"), "(.)", "0$1")))
    picture = F.aggregate(octets, F.lit("").cast("binary"), lambda a, b: F.concat(a, b))
    d = d.select("scan_id", "artifact_id", "ord", files.least_bits(picture).alias("bits"))
    return found.hidden_canary_findings(d, [_CANARY.encode()]).select("scan_id", F.get("indicators", 0).alias("canary"))


# ---------------------------------------------------------------- pictures
_SIMPLE = ["red-channel", "green-channel", "blue-channel", "alpha-channel", "grayscale", "inverted-grayscale", "canonical_lossless"]


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.spread(table(spark, sf_dir, "documents").where("text is not null"))
    return d.select(F.concat(F.lit("d"), "doc_id").alias("scan_id"), F.concat(F.lit("artifact:d"), "doc_id").alias("artifact_id"), F.lit(4).alias("width"), F.lit(2).alias("height"), F.unhex(F.sha2("text", 256)).alias("pixels"))


_AT = lambda k: f"cast('0x' || h[8 * i + {2 * k + 1}:8 * i + {2 * k + 2}] as int)"
_LUMA = f"(({_AT(0)} * 19595 + {_AT(1)} * 38470 + {_AT(2)} * 7471 + 32768) >> 16)"
_VIEWS_SQL = [*(f"h[8 * i + {2 * k + 1}:8 * i + {2 * k + 2}]" for k in range(4)), f"printf('%02x', {_LUMA})", f"printf('%02x', 255 - {_LUMA})", "h[8 * i + 1:8 * i + 8]"]


@query("with p as (select doc_id, sha256(text) as h from documents where text is not null) " + " union all ".join(f"select 'd' || doc_id as scan_id, '{role}' as role, 4 as width, 2 as height, array_to_string(list_transform(range(8), lambda i: {v}), '') as pixels from p" for role, v in zip(_SIMPLE, _VIEWS_SQL)))
def image_views(spark, sf_dir):
    """The views of every picture that are a matter of each pixel alone."""
    d = transforms.views(pictures(spark, sf_dir), FORENSIC._replace(transforms=frozenset(_SIMPLE)))
    return d.select("scan_id", "role", "width", "height", F.lower(F.hex("pixels")).alias("pixels"))


# ---------------------------------------------------------------- early ends, evaluation
def _ended(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("e"), "event_id").alias("scan_id"), F.lit("artifact:x").alias("artifact_id"), F.coalesce(F.col("event_type") == "click", F.lit(False)).alias("intake_rejected"), (F.col("event_id") % 2 == 0).alias("over_budget"), F.lit("limit").alias("reason"))


@query(
    f"with s as (select 'e' || event_id as scan_id, coalesce(event_type = 'click', false) as r, event_id % 2 = 0 as b from events) select scan_id, profile, case when r then 'QUARANTINE' else 'UNSUPPORTED' end as action, case when r then 'INTAKE_REJECTED' else 'RESOURCE_LIMIT_EXCEEDED' end as reason_codes, "
    f"case when r then 'quarantine-intake-rejected' else 'resource-budget' end as winning_rule_id, case when r then 10000 else 20000 end as winning_rule_priority, case when r then 'finding:' || scan_id || ':intake-rejected:000' else 'finding:' || scan_id || ':resource-limit:000' end as finding_id from s cross join (values {', '.join(f'({quoted(p)})' for p in PROFILES)}) as p(profile) where r or b"
)
def early_decisions(spark, sf_dir):
    s = _ended(spark, sf_dir)
    d = policy.early_decision(s).join(found.early_findings(s).select("scan_id", "finding_id"), "scan_id")
    return d.select("scan_id", "profile", "action", F.array_join("reason_codes", "|").alias("reason_codes"), "winning_rule_id", "winning_rule_priority", "finding_id")


@query(
    """with r as (select event_id, ['BLOCK', 'ALLOW_RECONSTRUCTED_ONLY', 'REVIEW', 'ALLOW_WITH_REDACTION', 'UNSUPPORTED'][cast(event_id % 5 + 1 as int)] as action, case when event_id % 11 = 0 then 'VLM_READ_ONLY' else 'HUMAN_VIEW' end as profile, coalesce(event_type = 'purchase', false) as malware,
    ['original', 'canonical_lossy', 'redacted', 'frame-0'][cast(event_id % 4 + 1 as int)] as role, event_id % 3 as n_grants, event_id % 13 = 0 as orphan, event_id % 17 = 0 as told, event_id % 6 as critical from events)
    select event_id, array_to_string(list_concat(
        case when action in ('BLOCK', 'REVIEW', 'UNSUPPORTED') and n_grants > 0 then [action || ' has ' || n_grants || ' grant(s)'] else [] end,
        list_transform(list_filter(range(n_grants), lambda i: role = 'original'), lambda i: 'original has a grant: artifact:' || event_id),
        list_transform(list_filter(range(n_grants), lambda i: role not in ('canonical_lossy', 'redacted')), lambda i: 'analysis-only role has a grant: ' || role),
        case when orphan then ['detected without finding: detector:x'] else [] end, case when malware and n_grants > 0 then ['malware canary released'] else [] end,
        case when profile = 'VLM_READ_ONLY' and (action <> 'UNSUPPORTED' or n_grants > 0) then ['read-only profile isn''t unsupported'] else [] end, case when told then ['canary in explanation'] else [] end), ';') as safety,
      array_to_string(list_filter([case when action = 'BLOCK' then 'forbidden action BLOCK' end, case when event_id % 7 = 0 and n_grants > 0 then n_grants || ' grant(s) though nothing may be released' end, case when critical > 3 then critical || ' critical findings, at most 3 expected' end], lambda x: x is not null), ';') as gaps from r"""
)
def evaluation_invariants(spark, sf_dir):
    n = F.col("event_id")
    grant = F.struct(F.format_string("artifact:%d", n).alias("artifact_id"), F.element_at(F.array(*map(F.lit, ["original", "canonical_lossy", "redacted", "frame-0"])), (n % 4 + 1).cast("int")).alias("role"))
    d = table(spark, sf_dir, "events").select(
        "event_id", F.element_at(F.array(*map(F.lit, ["BLOCK", "ALLOW_RECONSTRUCTED_ONLY", "REVIEW", "ALLOW_WITH_REDACTION", "UNSUPPORTED"])), (n % 5 + 1).cast("int")).alias("action"), F.when(n % 11 == 0, "VLM_READ_ONLY").otherwise("HUMAN_VIEW").alias("profile"),
        F.array(F.when(F.col("event_type") == "purchase", "malware_canary").otherwise("clean")).alias("labels"), F.array_repeat(grant, (n % 3).cast("int")).alias("grants"), F.array(F.lit("detector:x")).alias("detected"), F.when(n % 13 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("detector:x"))).alias("found"),
        F.lit("fine").alias("summary"), F.when(n % 17 == 0, f"saw {evaluation.CANARIES[0]}").otherwise("fine").alias("explanation"), F.array(F.lit("BLOCK")).alias("forbidden_actions"), (n % 7 == 0).alias("must_not_release"), (n % 6).cast("int").alias("critical"), F.lit(3).alias("maximum_critical_findings"),
    )
    return d.select("event_id", F.array_join(evaluation.safety_violations(d), ";").alias("safety"), F.array_join(evaluation.detection_gaps(d), ";").alias("gaps"))


@query("select event_id, coalesce(c_mktsegment, 'anonymous') as segment from events left join (select c_custkey, min(c_mktsegment) as c_mktsegment from customer where c_custkey is not null group by 1) on c_custkey = user_id")
def attendees_by_directory(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    return evaluation.with_directory(table(spark, sf_dir, "events").select("event_id", "user_id"), people, "user_id", "segment").select("event_id", "segment")
