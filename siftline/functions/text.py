"""Scalar functions on texts: normalization, bounded decoding, context and intent, evidence, URLs, fields.

All are Spark's own expressions, but for the parts of ``normalize`` that Spark lacks (compatibility
composition, entities, percent escapes): rows that may need those, and only those, go through one
Arrow function.
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from .conditions import Condition, Has, Rx, case, holds, let, needed, once
from .patterns import CANARY

BLANKS = r"(?U)[\s\x1c-\x1f]+"


# ---------------------------------------------------------------- normalization
@F.pandas_udf(StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


#: Characters that composition leaves alone, whatever stands beside them: ASCII, precomposed letters, common punctuation, syllables, ideographs.
STABLE = r"\u00a1-\u00a7\u00a9\u00ab\u00ac\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481\u048a-\u04ff\u2012-\u2016\u2018-\u201f\u20ac\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3"
#: White space of ASCII other than the blank, with the four separators that Python counts as such.
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"


def composed(c: Column) -> Column:
    """NFKC; texts of characters that it leaves alone stay in the JVM."""
    same = c.rlike(rf"\A(?:[\x00-\x7f]++|[{STABLE}])*+\z")
    return F.when(same, c).otherwise(_compose(F.when(~same, c)))


def _blanks(c: Column) -> Column:
    return F.when(c.rlike(r"[\t-\r\x1c-\x1f]"), F.translate(c, _SPACES, " " * len(_SPACES))).otherwise(c)


def _single(c: Column) -> Column:
    return F.trim(F.when(F.contains(c, F.lit("  ")), F.regexp_replace(c, " {2,}", " ")).otherwise(c))


_NORMAL = StructType([StructField("normalized", StringType()), StructField("zero_width_found", BooleanType()), StructField("bidi_found", BooleanType())])
_BLANK_RUN = re.compile(r"\s+")
_ZERO, _BIDI = re.compile("[\u200b-\u200d\ufeff]"), re.compile("[\u202a-\u202e\u2066-\u2069]")


@F.pandas_udf(_NORMAL)
def _whole(texts: pd.Series) -> pd.DataFrame:
    def one(t: str | None) -> tuple[str | None, bool | None, bool | None]:
        if t is None:
            return None, None, None
        t = unicodedata.normalize("NFKC", t)
        zero, bidi = bool(_ZERO.search(t)), bool(_BIDI.search(t))
        return _BLANK_RUN.sub(" ", unquote(html.unescape(_BIDI.sub("", _ZERO.sub("", t))))).strip(), zero, bidi

    return pd.DataFrame([one(t) for t in texts], columns=["normalized", "zero_width_found", "bidi_found"])


#: Bytes of texts that a Python worker is given at once; it holds them several times over.
BATCH_BYTES = 8 << 20


def _modest_batches(rows: DataFrame) -> None:
    """Lets the session's Arrow batches grow to ``BATCH_BYTES``, unless it has a limit of its own."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", rows.sparkSession.conf
    if conf.get(key) in ("67108864b", "64MB", "67108864"):  # Spark's
        conf.set(key, f"{BATCH_BYTES}b")


def normalize(rows: DataFrame, text_col: str, into: str) -> DataFrame:
    """Adds ``into``, a struct(normalized, zero_width_found, bidi_found) of a text: composed, without invisible characters, entities and escapes decoded, white space collapsed.

    Only texts that may need what Spark lacks (composition, entities, escapes) go through Python, once and whole.
    """
    c, hard = F.col(text_col), F.col("__hard")
    _modest_batches(rows)
    d = rows.withColumn("__hard", once(~c.rlike(rf"\A(?:[\x00-\x7f]++|[{STABLE}])*+\z") | F.contains(c, F.lit("&")) | F.contains(c, F.lit("%"))))
    # what is left alone by composition has no invisible characters, and no white space beyond ASCII's
    d = d.withColumn("__blank", once(F.when(~hard, _blanks(c))))
    easy = F.struct(_single(F.col("__blank")).alias("normalized"), F.lit(False).alias("zero_width_found"), F.lit(False).alias("bidi_found"))
    return d.withColumn(into, once(F.when(hard, _whole(F.when(hard, c))).when(c.isNotNull(), easy))).drop("__hard", "__blank")


# ---------------------------------------------------------------- bounded decoding
def printable_ratio(c: Column) -> Column:
    """The share of characters that are printable ASCII or ASCII white space; 0 for an empty text."""
    kept = F.length(F.regexp_replace(c, r"[^\x09-\x0d\x20-\x7e]", ""))
    return F.when(F.length(c) > 0, kept / F.length(c)).otherwise(F.lit(0.0))


_TELLTALE = Has("ignore", "system", "password", "tool")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TURNED = _UPPER[13:] + _UPPER[:13]


_TURN = str.maketrans(_UPPER + _UPPER.lower(), _TURNED + _TURNED.lower())


def rot13(c: Column) -> Column:
    return F.translate(c, _UPPER + _UPPER.lower(), _TURNED + _TURNED.lower())


def _decoded(c: Column, pattern: str, guard, decode, kind: str, confidence: float) -> Column:
    raw = F.slice(F.regexp_extract_all(c, F.lit(pattern), 0), 1, 5)
    sound = F.filter(raw, guard)
    texts = F.transform(sound, lambda x: F.try_validate_utf8(decode(x).cast("string")))
    good = F.filter(texts, lambda t: t.isNotNull() & (printable_ratio(t) >= 0.8))
    return F.transform(good, lambda t: derived(kind, confidence, t))


def derived(kind: str, confidence: float, t: Column) -> Column:
    return F.struct(F.lit(kind).alias("transformation"), F.lit(1).alias("depth"), F.lit(confidence).alias("confidence"), F.octet_length(t).alias("decoded_bytes"), printable_ratio(t).alias("printable_ratio"), t.alias("text"))


def derive_candidates(c: Column) -> Column:
    """array<struct>: texts found by decoding (base64, hex, then ROT13 and reversal where telltale words appear), at most 20; none from over 100 000 bytes."""
    base64 = _decoded(c, "[A-Za-z0-9+/]{16,}={0,2}", lambda x: (F.length(x) % 4 == 0), lambda x: F.try_to_binary(x, F.lit("base64")), "base64", 0.8)
    hexes = _decoded(c, "[0-9a-fA-F]{24,}", lambda x: F.length(x) % 2 == 0, lambda x: F.unhex(x), "hex", 0.75)
    turned, backward = rot13(c), F.reverse(c)
    # the telltale words in the text as it is, turned or backward; what lower case does to a dotted capital I is left to the exact test
    hint = lambda words: holds(F.lower(c), (words,)) | F.contains(c, F.lit("\u0130"))
    single = lambda kind, words, t, extra: F.when(hint(words) & extra & let(F.lower(t), _TELLTALE.column), derived(kind, 0.5, t))
    words = _TELLTALE.words
    both = F.array_compact(F.array(single("rot13", tuple(w.translate(_TURN) for w in words), turned, turned != c), single("reversed", tuple(w[::-1] for w in words), backward, F.lit(True))))
    none = F.slice(both, 1, 0)
    return F.when(F.octet_length(c) > 100_000, none).otherwise(F.slice(F.concat(base64, hexes, both), 1, 20))


# ---------------------------------------------------------------- context and intent
_ORDERS = "(?:call tool|execute|ignore|override|run command|system prompt)".replace(" ", "␣")
ACTIVE = Rx(
    "~(?:ignore (?:all )?(?:above|previous|prior) instructions?|override (?:the )?(?:developer|system)|disregard (?:all )?(?:above|previous|prior) (?:context|instructions?)"
    "|(?:call|invoke|use) (?:the )?(?:simulated )?tool|run (?:this )?(?:command|python|shell)|execute (?:this )?command|(?:emit|output|print|return) " + CANARY + r"[-_\s]*canary)~"
)
WARNING = Has("dangerous example", "do not follow", "do not obey", "warning", "warns")
DISCUSSION = Has("article", "attackers may", "discuss", "example", "known as prompt injection", "quoted", "sample")
QUOTED = Rx("['\"`].{0,80}" + _ORDERS + ".{0,80}['\"`]")
DISCUSSED = Rx("~(?:attackers? may write|do not follow|do not obey)~".replace(" ", "␣") + ".{0,120}~" + _ORDERS + "~")
CONTEXTS: list[tuple[Condition, str]] = [(QUOTED, "quoted"), (DISCUSSED, "discussed"), (ACTIVE, "active"), (WARNING, "warning")]
ADDRESS = r"\S+@\S*"
DOMAIN = r"\b\w+\.(?:com|example|invalid|io|localhost|net|org)\b"


def context(c: Column) -> Column:
    """quoted, discussed, active or warning; what reads like none of them is active."""
    return let(F.lower(c), _context)


def _context(low: Column) -> Column:
    without = lambda t, x: F.when(holds(t, needed(x)), F.regexp_replace(t, "(?U)" + x, "")).otherwise(t)
    bare = F.when(DISCUSSION.column(low), let(without(low, ADDRESS), lambda t: without(t, DOMAIN))).otherwise(low)  # what is cut out can't bring words about but where it joins two parts
    return F.coalesce(case(CONTEXTS, None, low), let(bare, lambda b: F.when(DISCUSSION.column(b), "discussed").otherwise("active")))


TOOL_CALL = Has("call tool", "execute", "open file", "run command", "send_email", "simulated tool", "use tool")
CREDENTIALS = Has("api key", "api_key", "credential", "hidden value", "passphrase", "password", "private key", "secret", "seed phrase", "token")
EXTRACTION = Has("disclose", "expose", "mention", "only you know", "output", "print", "repeat", "report", "reveal", "say", "send", "show", "upload", "[value of")
OVERRIDE = Rx(
    "~(?:ignore (?:all|previous|prior) instructions?|disregard (?:all|previous|prior) (?:context|instructions?)|override (?:developer|system)|do not mention~"
    r"|instead\s*(?:,\s*)?(?:mention|output|print|report|reveal|say)|forget (?:all|previous|prior)|disregard|reset (?:your )?instructions?)~"
)
EXFILTRATION_WORDS = Has("exfiltrate", "post to", "send", "upload", f"{CANARY}-canary", f"{CANARY}_canary")
REQUESTS: list[tuple[Condition, str]] = [(TOOL_CALL, "tool_call"), (EXFILTRATION_WORDS, "data_exfiltration")]
SECRECY = Has("do not tell", "secretly", "without telling")
EXFILTRATES = Has("exfiltrate", "send to", "upload")


def intent(c: Column) -> Column:
    """What a text asks for, as a struct of eight fields."""
    return let(F.lower(c), _intent)


def _intent(low: Column) -> Column:
    noun = CREDENTIALS.column(low)
    return F.struct(
        F.when(F.contains(low, F.lit("system")), "system").alias("speaker_claim"),
        case(REQUESTS, None, low).alias("requested_action"),
        F.when(noun, "credential").alias("target"),
        OVERRIDE.column(low).alias("authority_override"),
        SECRECY.column(low).alias("secrecy_requested"),
        EXFILTRATES.column(low).alias("data_exfiltration"),
        (noun & EXTRACTION.column(low)).alias("credential_request"),
        _context(low).alias("quoted_or_active"),
    )


# ---------------------------------------------------------------- evidence
def text_sha256(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


def text_evidence(c: Column) -> Column:
    """Hash and UTF-8 length; never the text."""
    return F.struct(text_sha256(c).alias("text_sha256"), F.octet_length(c).cast("long").alias("text_length"))


EXCERPT_SECRET = r"(?i)(?:api[_-]?key|password|secret|token)\s*[:=]\s*[A-Za-z0-9_\-./+=]{6,}"
EXCERPT_KEY = "-----BEGIN [A-Z ]*PRIVATE KEY-----"


def safe_excerpt(c: Column, most: int = 80) -> Column:
    """One line with secrets redacted, cut to ``most`` characters."""
    t = F.translate(c, "\r\n", "  ")
    for secret in (EXCERPT_SECRET, EXCERPT_KEY):
        t = F.regexp_replace(t, "(?U)" + secret if secret is EXCERPT_SECRET else secret, "[redacted-sensitive-value]")
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)


_ODD = [*range(0x20), *range(0x7F, 0xA0), *range(0x202A, 0x202F), *range(0x2066, 0x206A)]


def sanitize_log(c: Column) -> Column:
    """Control and direction characters as escapes; at most 256 characters."""
    cut = F.substring(c, 1, 256)  # escapes are longer than what they stand for
    out = reduce(lambda t, code: F.replace(t, F.lit(chr(code)), F.lit(f"\\u{code:04x}")), _ODD, cut)
    return F.when(cut.rlike("[\\x00-\\x1f\\x7f-\\x9f\\u202a-\\u202e\\u2066-\\u2069]"), F.substring(out, 1, 256)).otherwise(cut)


def json_log(**fields: Column) -> Column:
    """One line of JSON, its keys sorted, its values fit for a log; nulls are kept."""
    return F.to_json(F.struct(*(sanitize_log(fields[k].cast("string")).alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def add_hash_prefix(c: Column) -> Column:
    return F.when(c.startswith("sha256:"), c).otherwise(F.concat(F.lit("sha256:"), c))


def strip_hash_prefix(c: Column) -> Column:
    return F.regexp_replace(c, "^sha256:", "")


def scan_of_artifact(c: Column) -> Column:
    """The middle of a colon-separated artifact id."""
    parts = F.split(c, ":")
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(1))), ":"))


def storage_reference(sha: Column) -> Column:
    bare = strip_hash_prefix(sha)
    return F.concat_ws("/", F.substring(bare, 1, 2), F.substring(bare, 3, 2), bare)


def grant_id(artifact: Column) -> Column:
    return F.concat(F.lit("grant:"), F.substring_index(artifact, ":", -1))


# ---------------------------------------------------------------- URLs
SUSPICIOUS_PATH = ("login", "verify", "password", "wallet", "update")
SCHEME = "^([A-Za-z][A-Za-z0-9+.-]*):"
AUTHORITY = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
PATH = "^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?([^?#]*)"


def url_analysis(c: Column) -> Column:
    """What a decoded URL shows without following it; expressions, as Java's parser refuses what others take."""
    scheme, authority = F.lower(F.regexp_extract(c, SCHEME, 1)), F.regexp_extract(c, AUTHORITY, 1)
    host = F.lower(F.regexp_extract(F.substring_index(authority, "@", -1), "^([^:]*)", 1))
    path = F.lower(F.regexp_extract(c, PATH, 1))
    terms = F.filter(F.array(*map(F.lit, SUSPICIOUS_PATH)), lambda w: F.contains(path, w))
    return F.struct(
        (scheme != "").alias("is_url"),
        F.nullif(scheme, F.lit("")).alias("scheme"),
        F.when(host != "", text_sha256(host)).alias("hostname_sha256"),
        authority.rlike("^[^@]+@").alias("has_embedded_credentials"),
        F.replace(host, F.lit("."), F.lit("")).rlike("^[0-9]+$").alias("ip_literal"),
        (scheme == "file").alias("file_url"),
        terms.alias("suspicious_terms"),
    )


# ---------------------------------------------------------------- numbers
def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(c: Column) -> Column:
    d = digits(c)
    return (F.length(d) >= 13) & F.call_function("luhn_check", d)


def phone_like(c: Column) -> Column:
    return (F.length(digits(c)) >= 8) & ~F.trim(c).rlike(r"^(?:\d+\.\s*){2,}\d*\.?$")


# ---------------------------------------------------------------- metadata fields
LOCATION = "gpsaltitude gpscoordinates gpslatitude gpslatituderef gpslongitude gpslongituderef gpsposition location".split()
IDENTITY = "artist author copyright creator ownername serialnumber".split()
WORKFLOW = ["history", "imagedescription", "processingsoftware", "software", "creator tool"]
PROVENANCE = "c2pa creatorworkurl iptc jumbf photoshop xmp".split()
FREE_TEXT = "caption comment credit description headline keywords label rights source subject title usercomment".split()


def canonical_key(c: Column) -> Column:
    return F.lower(F.translate(F.substring_index(c, ":", -1), " _-", ""))


def metadata_class(key: Column, value: Column) -> Column:
    """The class of a metadata field; the first that fits in the order of the lists above."""
    k = canonical_key(key)
    return (
        F.when(k.isin(LOCATION) | k.startswith("gps"), "location_data")
        .when(k.isin(IDENTITY), "identity_data")
        .when(k.isin(WORKFLOW), "workflow_data")
        .when(Has(*PROVENANCE).column(k), "provenance_data")
        .when(value.isNull(), "binary_blob")
        .when(k.isin(FREE_TEXT), "free_text")
        .when((F.length(value) > 40) & value.rlike(r"(?U)\s"), "free_text")
        .otherwise("ordinary_camera_data")
    )


def is_text_class(kind: Column) -> Column:
    return kind.isin("free_text", "identity_data", "workflow_data", "provenance_data")


def privacy_reason(kind: Column) -> Column:
    return F.when(kind == "identity_data", "IDENTITY_METADATA_PRESENT").when(kind == "location_data", "GPS_PRESENT")


def first_nonempty_line(c: Column) -> Column:
    return F.get(F.filter(F.transform(F.split(c, r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != ""), 0)
