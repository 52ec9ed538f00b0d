"""Secret scans: a keyword automaton, anchored expressions near its hits, checksums within the secrets.

An Aho-Corasick automaton runs once over the lower-case texts; only where it meets a rule's keyword is
that rule's expression tried, anchored at the keyword, if no letter, digit or ``_`` (for some rules, ``-``)
stands before it (assigned names may have any prefix). Secrets that carry a checksum are then checked:
``valid``, or ``invalid`` (dropped); ``none`` where the format has no checksum. Of overlapping finds
the rule that is earlier in ``RULES`` wins, then the earlier find. Each expression's work is bounded by
what no other try of its rule reads again, so crafted texts (a keyword repeated without end) take linear time.

Results carry positions and a SHA-256, never the secret. Whole texts are scanned, whatever their length.

Defined cases: null and empty texts give no finds; a null doc_id is carried along; repeated rows give
their finds again; tables without rows give none; other columns are never read by ``scan``; ``redact``
keeps every row and column, whatever their names. A header that is no JSON object, or nested beyond what the
parser takes, makes no token.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import code_points, pieces, utf8

_62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def base62_crc(body: str) -> str:
    """The CRC-32 of ``body`` in six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = _62[digit] + out
    return out


def _crc_tail(secret: str) -> bool:
    body = secret[secret.index("_") + 1 :]
    return base62_crc(body[:-6]) == body[-6:]


def _base58check(secret: str) -> bool:
    n = 0
    for c in secret:
        n = n * 58 + _58.index(c)
    raw = n.to_bytes(82, "big") if n < 1 << 656 else b""
    return bool(raw) and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def _json_header(secret: str) -> bool:
    head = secret.split(".")[0]
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4))), dict)
    except (ValueError, RecursionError):
        return False


class Rule(NamedTuple):
    kind: str
    keywords: tuple[str, ...]  # in lower case; the expression begins at the keyword
    expression: re.Pattern  # its group 1 is the secret
    check: Callable[[str], bool] | None
    before: str | None = "_"  # what may not stand before, beside letters and digits; None: anything may


#: A name, and what stands between it and its value. The value is the run of ``_VALUE`` behind it: in quotes it ends at the closing
#: quote; without quotes it begins and ends as a word does, and holds a digit, so that neither prose ("password: internationalization")
#: nor code ("token = function_of(x)") is one.
_ASSIGNED = re.compile(r"""(?:token|secret|password|passwd|api[_-]?key|(?:access|private)[_-]key)(?:[_-](?:access[_-])?key)?["']?\s{0,3}(?::=|=>?|:)\s{0,3}(["']?)""", re.IGNORECASE)
_VALUE = re.compile(r"[A-Za-z0-9+/_.=-]*")
_DIGIT_LAST = re.compile(r".*[0-9]", re.DOTALL)
LEAST_VALUE = 16

#: The headers that an encrypted key may have between its first line and its body.
_HEADERS = r"(?:\s*[\r\n]\s*[A-Za-z0-9-]{1,64}: [^\r\n]*){0,20}"

RULES = (
    Rule("code_host_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"(gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])"), _crc_tail),
    Rule("package_registry_token", ("npm_",), re.compile(r"(npm_[A-Za-z0-9]{36})(?![A-Za-z0-9])"), _crc_tail),
    Rule("extended_private_key", ("xprv",), re.compile(r"(xprv[1-9A-HJ-NP-Za-km-z]{107})(?![1-9A-HJ-NP-Za-km-z])"), _base58check),
    Rule("signed_web_token", ("eyj",), re.compile(r"(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,})"), _json_header, "_-"),
    Rule("cloud_access_key", ("akia", "asia"), re.compile(r"((?:AKIA|ASIA)[A-Z2-7]{16})(?![A-Za-z0-9_])"), None),
    Rule("payment_secret_key", ("sk_live_", "rk_live_"), re.compile(r"([sr]k_live_[A-Za-z0-9]{16,})"), None),
    Rule("chat_token", ("xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"), re.compile(r"(xox[abprs]-[A-Za-z0-9-]{10,})"), None, "_-"),
    Rule("private_key_block", ("-----begin ",), re.compile(r"(-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----" + _HEADERS + r"[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )?PRIVATE KEY-----)"), None, None),
    Rule("assigned_secret", ("token", "secret", "password", "passwd", "api_key", "api-key", "apikey", "access_key", "access-key", "private_key", "private-key"), _ASSIGNED, None, None),
)


class _Values:
    """The values behind assigned names of one text; asked for in order, each run of the text is read once."""

    def __init__(self, text: str):
        self.text, self.end, self.digit = text, -1, -1  # of the run that was read last: its end, its last digit's place

    def at(self, m: re.Match) -> tuple[int, int] | None:
        start, quote = m.end(), m[1]
        if start >= self.end:
            self.end = _VALUE.match(self.text, start).end()
            last = _DIGIT_LAST.match(self.text, start, self.end)
            self.digit = last.end() - 1 if last else -1
        behind = self.text[self.end : self.end + 1]
        if self.end - start < LEAST_VALUE or behind in ("(", "[") or (behind not in ("'", '"') if quote else self.digit < start):
            return None
        return start, self.end


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    owners: dict[str, list[int]] = {}
    for i, rule in enumerate(RULES):
        for word in rule.keywords:
            owners.setdefault(word, []).append(i)
    for word, rules in owners.items():
        found.add_word(word, (len(word), tuple(rules)))
    found.make_automaton()
    return found


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


class Find(NamedTuple):
    kind: str
    start: int
    end: int
    checksum: str
    secret: str


def _settle(text: str, tries: list[tuple[int, int]]) -> list[Find]:
    """The finds of one text, from (rule, keyword's place) pairs."""
    out: list[Find] = []
    starts: list[int] = []
    values = _Values(text)
    for i, at in sorted(set(tries)):
        rule = RULES[i]
        if rule.before is not None and at and (text[at - 1].isalnum() or text[at - 1] in rule.before):
            continue
        if not (m := rule.expression.match(text, at)):
            continue
        span = values.at(m) if rule.expression is _ASSIGNED else m.span(1)
        if span is None or rule.check and not rule.check(text[span[0] : span[1]]):
            continue
        k = bisect_left(starts, span[0])
        if (k == 0 or out[k - 1].end <= span[0]) and (k == len(out) or span[1] <= out[k].start):
            out.insert(k, Find(rule.kind, *span, "valid" if rule.check else "none", text[span[0] : span[1]]))
            starts.insert(k, span[0])
    return out


def scan_text(text: str | None) -> list[Find]:
    """The finds of one text."""
    if not text:
        return []
    return _settle(text, [(i, end - length + 1) for end, (length, rules) in _automaton().iter(_lower(text)) for i in rules])


def _finds(texts: pa.Array) -> dict[int, list[Find]]:
    """Finds by row; the automaton runs once over all texts put together, the expressions over single texts."""
    data, offsets = utf8(texts)
    joined = data.tobytes().decode("utf-8")
    _, bounds = code_points(data, offsets)
    hits = [(end - length + 1, rules) for end, (length, rules) in _automaton().iter(_lower(joined))]
    if not hits:
        return {}
    rows = np.searchsorted(bounds, np.array([h[0] for h in hits]), "right") - 1
    tries: dict[int, list[tuple[int, int]]] = {}
    for row, (at, rules) in zip(rows.tolist(), hits):
        tries.setdefault(row, []).extend((i, at - int(bounds[row])) for i in rules)
    found = {row: _settle(joined[bounds[row] : bounds[row + 1]], t) for row, t in tries.items()}
    return {row: f for row, f in found.items() if f}


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            flat = [(row, f) for row, finds in sorted(_finds(piece.column("text")).items()) for f in finds]
            ids = piece.column("doc_id").take(pa.array([row for row, _ in flat], pa.int64()))
            columns = [pa.array([f.kind for _, f in flat], pa.string()), pa.array([f.start for _, f in flat], pa.int64()), pa.array([f.end - f.start for _, f in flat], pa.int32()), pa.array([f.checksum for _, f in flat], pa.string())]
            yield pa.RecordBatch.from_arrays([ids, *columns, pa.array([hashlib.sha256(f.secret.encode()).hexdigest() for _, f in flat], pa.string())], ["doc_id", "kind", "start", "length", "checksum", "sha256"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, start, length, checksum, sha256): a row for each find; start counts characters from 0."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(_scan_batches, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, kind string, start long, length int, checksum string, sha256 string")


def _redact_batches(text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name = batch.schema.names[text_at]
            for piece in pieces(batch, name):
                finds = _finds(piece.column(name))
                columns = list(piece.columns)
                if finds:
                    texts = piece.column(name).to_pylist()
                    for row, own in finds.items():
                        for f in reversed(own):
                            texts[row] = f"{texts[row][: f.start]}[{f.kind}]{texts[row][f.end :]}"
                    columns[text_at] = pa.array(texts, piece.schema.field(text_at).type)
                yield pa.RecordBatch.from_arrays(columns, piece.schema.names)

    return run


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with each find replaced by its kind in brackets; ``length_col``, if there, follows the text."""
    names = [f"__k{i}" for i in range(len(docs.columns))]
    flat = docs.toDF(*names)
    at = docs.columns.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema)
    out = flat.mapInArrow(_redact_batches(at), schema).toDF(*docs.columns)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col(length_col).isNotNull(), F.length(text_col)).cast(docs.schema[length_col].dataType))
    return out
