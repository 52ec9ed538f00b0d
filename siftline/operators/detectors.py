"""Detectors: from observations (texts of scans) to findings. They never decide what is to be done.

Each detector is a column: an array of findings, from a text and what was prepared of it once for all of
them (lower case, a folded copy in which expressions' words are looked for first). Any number of detectors
are one projection over the texts, which are never shuffled; only findings are, for the "first wins" rules
(numbers within a scan, and the scorer's repeated texts).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..functions.conditions import Rx, folded, has_any, holds, let, literals, needed, once, plain, squeezed
from ..schemas import FINDING


def spread(d: DataFrame) -> DataFrame:
    """``d`` over all cores: a table read in fewer parts than there are cores is small, and is dealt out; others stay as they are."""
    if d.isStreaming or "Exchange" in d._jdf.queryExecution().executedPlan().toString():
        return d  # a shuffle has dealt them out already
    cores = d.sparkSession.sparkContext.defaultParallelism
    return d if d._jdf.rdd().getNumPartitions() >= cores else d.repartition(cores)


def observe(texts: DataFrame, scan: Column, order: Column, text: Column, engine: Column | str = "table", artifact: Column | None = None, detector: Column | str = "detector:text-table") -> DataFrame:
    """Observations of a table of texts: null texts give none; normalized once, for all detectors."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    rows = spread(texts.select(scan.cast("string").alias("scan_id"), order.cast("long").alias("ord"), text.alias("raw_text"), (artifact if artifact is not None else F.concat(F.lit("artifact:"), scan.cast("string"))).alias("source_artifact_id"), lit(detector).alias("detector_id"), lit(engine).alias("engine")).where("raw_text is not null and scan_id is not null"))
    rows = T.normalize(rows, "raw_text", "n")
    return rows.select(
        "scan_id",
        F.format_string("observation:%s:%06d", "scan_id", "ord").alias("observation_id"),
        "ord",
        "source_artifact_id",
        "detector_id",
        "engine",
        "raw_text",
        F.col("n.normalized").alias("normalized_text"),
        F.col("n.zero_width_found").alias("zero_width_found"),
        F.col("n.bidi_found").alias("bidi_found"),
    )


_ROW = "k int, what string, detector string, place int, category string, type string, state string, severity string, detector_confidence double, evidence_quality double, attack_likelihood double, impact string, reason_codes array<string>, recommended_action string, limitations array<string>, text_sha256 string, text_length bigint, indicators array<string>, once_key string"


class Text(NamedTuple):
    """What detectors see of an observation."""

    text: Column
    low: Column
    fold: Column
    composed: Column  # in lower case
    plain: Column
    squeezed: Column


def _prepared(c: Column, composed: bool = True) -> Column:
    return once(F.struct(F.lower(c).alias("low"), folded(c).alias("fold"), (_forms(c) if composed else F.lit(None).cast("struct<plain:string,squeezed:string>")).alias("forms"), (F.lower(T.composed(c)) if composed else F.lit(None).cast("string")).alias("composed")))


def _forms(c: Column) -> Column:
    return let(plain(c), lambda p: F.struct(p.alias("plain"), squeezed(p).alias("squeezed")))


def _text(c: Column, prepared: str) -> Text:
    return Text(c, *(F.col(f"{prepared}.{f}") for f in ("low", "fold", "composed", "forms.plain", "forms.squeezed")))


def _row(what: str, detector: str, place: int, *, k: Column | int, category: str, kind, state, severity, quality, impact, reasons: Column, action, confidence=None, likelihood=None, sha=None, length=None, indicators=None, limitations=(), once_key=None) -> Column:
    """A finding without what it takes from its observation; of those with the same ``once_key`` in a scan the first counts."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    values = [lit(k), lit(what), lit(detector), lit(place), lit(category), lit(kind), lit(state), lit(severity), lit(confidence), lit(quality), lit(likelihood), lit(impact), reasons, lit(action), F.array(*map(F.lit, limitations)) if limitations else F.array(), lit(sha), lit(length), lit(indicators), lit(once_key)]
    fields = (f.strip().split(" ", 1) for f in _ROW.split(","))
    return F.struct(*(v.cast(t).alias(n) for v, (n, t) in zip(values, fields)))


def find(observations: DataFrame, *detectors: Callable[[Text], Column], first_order: bool = True) -> DataFrame:
    """The findings of the detectors, in one pass over the texts; ordered by detector, then as the observations are."""
    plain = {privacy_rows, phishing_rows, watermark_rows, prompt_rows}  # these don't look at the composed text
    rows = observations.withColumn("__t", _prepared(F.col("normalized_text"), not set(detectors) <= plain))
    seen = _text(F.col("normalized_text"), "__t")
    rows = rows.select("scan_id", "observation_id", "source_artifact_id", F.col("ord").alias("__o"), F.explode(F.concat(*(d(seen) for d in detectors))).alias("f"))
    repeated = F.row_number().over(Window.partitionBy("scan_id", "f.what", "f.once_key").orderBy("__o"))
    rows = rows.withColumn("__n", F.when(F.col("f.once_key").isNotNull(), repeated).otherwise(1)).where("__n = 1")
    number = F.row_number().over(Window.partitionBy("scan_id", "f.what").orderBy("__o", "f.k")) - 1
    place = F.col("f.place") if first_order else F.lit(0)
    values = {
        "finding_id": F.format_string("finding:%s:%s:%03d", "scan_id", "f.what", number),
        "ord": place.cast("bigint") * 10**12 + F.col("__o") * 100 + F.col("f.k"),
        "source_artifact_ids": F.array("source_artifact_id"),
        "observation_ids": F.array("observation_id"),
        "detector_ids": F.array("f.detector"),
        "transformations": F.lit(None),
    }
    fields = (f.strip().split(" ", 1) for f in FINDING.split(", "))
    return rows.select(*((F.col("scan_id") if n == "scan_id" else values[n] if n in values else F.col(f"f.{n}")).cast(t).alias(n) for n, t in fields))


# ---------------------------------------------------------------- privacy
def privacy_matches(c: Column, fold: Column | None = None) -> Column:
    """array<struct(k, type, text)>: the first match of each check, and every card number that its check digit confirms."""
    fold = folded(c) if fold is None else fold
    found = []
    for k, (kind, pattern, cased) in enumerate(P.PRIVACY):
        first = F.regexp_extract(c, ("(?U)" if cased else "(?Ui)") + pattern, 0)
        if sets := needed(pattern):
            first = F.when(holds(fold, sets), first).otherwise("")
        found.append(let(first, _first_of(k, kind, c)))
    # thirteen digits stand within a card's number
    cards = F.filter(F.when(c.rlike(r"(?U)\d[ -]*\d[ -]*\d[ -]*\d[ -]*\d"), F.regexp_extract_all(c, F.lit("(?U)" + P.CARD), 0)).otherwise(F.array().cast("array<string>")), T.luhn)
    cards = F.transform(cards, lambda m, i: F.struct((i + len(P.PRIVACY)).alias("k"), F.lit("payment_card_like_number").alias("type"), m.alias("text")))
    return F.concat(F.array_compact(F.array(*found)), cards)


def _first_of(k: int, kind: str, c: Column) -> Callable[[Column], Column]:
    def of(first: Column) -> Column:
        ok = (first != "") & T.phone_like(first) if kind == "telephone_number" else first != ""
        return F.when(ok, F.struct(F.lit(k).alias("k"), F.lit(kind).alias("type"), c.alias("text")))

    return of


def privacy_rows(t: Text) -> Column:
    def row(m: Column) -> Column:
        card = m["type"] == "payment_card_like_number"
        shown = T.text_evidence(m["text"])
        return _row("privacy", "detector:privacy-rules", 2, k=m["k"], category="privacy", kind=m["type"], state="CONFIRMED", severity=F.when(card | F.contains(m["type"], F.lit("key")), "high").otherwise("medium"), quality=F.when(card, 0.85).otherwise(0.8), impact="high", reasons=F.array(F.upper(m["type"])), action="ALLOW_WITH_REDACTION", sha=shown["text_sha256"], length=shown["text_length"])

    return F.transform(privacy_matches(t.text, t.fold), row)


def privacy(observations: DataFrame) -> DataFrame:
    return find(observations, privacy_rows, first_order=False)


# ---------------------------------------------------------------- phishing and watermarks
def phishing_indicators(c: Column) -> Column:
    return let(F.lower(c), _indicators)


def _indicators(low: Column) -> Column:
    return F.array_sort(F.array_compact(F.array(*(F.when(condition.column(low), name) for name, condition in P.PHISHING))))


def phishing_rows(t: Text) -> Column:
    shown = T.text_evidence(t.text)
    row = lambda i: _row("phishing", "detector:phishing-rules", 3, k=0, category="phishing", kind="deceptive_interface_indicator", state="POSSIBLE", severity="medium", quality=0.5, likelihood=0.5, impact="high", reasons=F.array(F.lit("PHISHING_INDICATOR")), action="REVIEW", sha=shown["text_sha256"], length=shown["text_length"], indicators=i)
    return F.transform(F.filter(F.array(_indicators(t.low)), lambda i: F.size(i) > 0), row)


def phishing(observations: DataFrame) -> DataFrame:
    return find(observations, phishing_rows, first_order=False)


def watermark_indicators(c: Column) -> Column:
    return let(F.lower(c), _marks)


def _marks(low: Column) -> Column:
    return F.array_compact(F.array(*(F.when(F.contains(low, F.lit(w)), w) for w in P.WATERMARKS)))


def watermark_rows(t: Text) -> Column:
    row = lambda i: _row("watermark", "detector:visible-watermark", 4, k=0, category="watermarks", kind="visible_watermark_indicator", state="POSSIBLE", severity="low", quality=0.4, impact="low", reasons=F.array(F.lit("VISIBLE_WATERMARK_INDICATOR")), action="REVIEW", indicators=i)
    return F.transform(F.filter(F.array(_marks(t.low)), lambda i: F.size(i) > 0), row)


def watermarks(observations: DataFrame) -> DataFrame:
    return find(observations, watermark_rows, first_order=False)


# ---------------------------------------------------------------- prompt rules
def matching_rules(c: Column, fold: Column | None = None) -> Column:
    """The places of the rules that match, in order."""
    fold = folded(c) if fold is None else fold
    return F.array_compact(F.array(*(F.when(reduce(lambda a, b: a | b, (Rx(x, "i").within(c, fold) for x in expressions)), F.lit(i)) for i, (_, _, _, expressions) in enumerate(P.PROMPT_RULES))))


def _of_rule(i: int) -> Callable[[Column], Column]:
    table = literals(tuple(rule[i] for rule in P.PROMPT_RULES))
    return lambda place: F.element_at(table, place + 1)


def first_match(t: Text) -> Column:
    """struct(candidate, rules, text) of the first candidate (the text, then what decoding it gives) that any rule matches; null without one."""
    own = F.struct(F.lit(0).alias("candidate"), matching_rules(t.text, t.fold).alias("rules"), t.text.alias("text"))
    rest = F.filter(F.transform(T.derive_candidates(t.text), lambda d, i: F.struct((i + 1).alias("candidate"), matching_rules(d["text"]).alias("rules"), d["text"].alias("text"))), lambda s: F.size(s["rules"]) > 0)
    return let(own, lambda o: F.when(F.size(o["rules"]) > 0, o).otherwise(F.get(rest, 0)))


def _prompt_row(m: Column) -> Column:
    return let(T.intent(m["text"]), lambda intent: _prompt_row_of(m, intent))


def _prompt_row_of(m: Column, intent: Column) -> Column:
    active = intent["quoted_or_active"] == "active"
    categories = F.array_distinct(F.transform(m["rules"], _of_rule(1)))
    credential = intent["credential_request"] | F.array_contains(categories, "credential_request")
    reasons = F.array_sort(F.array_distinct(F.concat(F.array(F.lit("PROMPT_INJECTION")), F.transform(categories, F.upper))))
    reasons = F.when(intent["requested_action"] == "tool_call", F.concat(reasons, F.array(F.lit("TOOL_INVOCATION_REQUEST")))).otherwise(reasons)
    reasons = F.when(credential, F.array_sort(F.array_distinct(F.concat(reasons, F.array(F.lit("CREDENTIAL_REQUEST")))))).otherwise(reasons)
    critical = F.exists(F.transform(m["rules"], _of_rule(2)), lambda s: s == "critical")
    shown = T.text_evidence(m["text"])
    first = F.get(m["rules"], 0)
    return _row(
        "prompt", "detector:prompt-rules", 0, k=0, category="prompt_injection", kind=_of_rule(1)(first), state=F.when(active, "CONFIRMED").otherwise("POSSIBLE"), severity=F.when(active & critical, "critical").otherwise(_of_rule(2)(first)), quality=F.when(active, 0.85).otherwise(0.45),
        likelihood=F.when(active, 0.95).otherwise(0.35), impact=F.when(active, "critical").otherwise("medium"), reasons=reasons, action=F.when(active, "BLOCK").otherwise("REVIEW"), sha=shown["text_sha256"], length=shown["text_length"], limitations=["Context classification is deterministic and may misclassify quoted text."],
    )


def prompt_rows(t: Text) -> Column:
    return F.transform(F.array_compact(F.array(first_match(t))), _prompt_row)


def prompt_rules(observations: DataFrame) -> DataFrame:
    return find(observations, prompt_rows, first_order=False)


# ---------------------------------------------------------------- semantic scorer
BLOCK, REVIEW = 0.55, 0.35


def tokens(c: Column) -> Column:
    return tokens_of(F.lower(T.composed(c)))


def tokens_of(composed: Column) -> Column:
    return F.regexp_extract_all(composed, F.lit("[a-z0-9']+"), 0)


VOCABULARY = sorted({w for _, words in P.WORD_SETS for w in words})


def known(t: Column) -> Column:
    """The distinct tokens that some set has."""
    return F.array_distinct(F.filter(t, lambda w: w.isin(VOCABULARY)))


def overlap_of(have: Column) -> Column:
    total = sum((F.size(F.array_intersect(have, literals(tuple(words)))) * F.lit(weight / len(words)) for weight, words in P.WORD_SETS), F.lit(0.0))
    return F.least(total / 2, F.lit(1.0))


def token_overlap(t: Column) -> Column:
    """The sets' weights by the share of their words that occur, halved."""
    return let(known(t), overlap_of)


FIRSTS = sorted({p.split(">")[0] for pairs in P.PAIRS.values() for p in pairs})


def pair_score(t: Column) -> Column:
    """The greatest weight of a pair whose second word is one of the four after its first."""
    table = F.from_json(F.lit(json.dumps({pair: weight for weight, pairs in P.PAIRS.items() for pair in pairs})), "map<string,double>")
    starts = F.filter(F.transform(t, lambda x, i: F.when(x.isin(FIRSTS), i)), lambda i: i.isNotNull())
    near = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.slice(t, i + 2, F.lit(4)), lambda y: F.concat(F.get(t, i), F.lit(">"), y)))))
    return F.coalesce(F.array_max(F.transform(near, lambda p: table[p])), F.lit(0.0))


def structure(c: Column, low: Column, leave_out: list[int] = ()) -> Column:
    """struct(score, label) of the greatest structural score; of equals the first; (0, '') without one. ``low`` is the text in lower case."""
    return let(_forms(c), lambda f: _structure(low, f["plain"], f["squeezed"], leave_out))


def _structure(low: Column, p: Column, q: Column, leave_out: list[int] = ()) -> Column:
    hits = []
    for i, (score, label, expression, flags, need) in enumerate(P.STRUCTURES):
        if i in leave_out:
            continue
        ok = Rx(expression, "i" + flags).plainly(p, q)
        if need and not needed(Rx(expression).pattern):
            ok = has_any(low, tuple(need.split("|"))) & ok
        hits.append(F.when(ok, F.struct(F.lit(score).alias("score"), F.lit(-i).alias("place"), F.lit(label).alias("label"))))
    return let(F.array_max(F.array_compact(F.array(*hits))), lambda best: F.struct(F.coalesce(best["score"], F.lit(0.0)).alias("score"), F.coalesce(best["label"], F.lit("")).alias("label")))


def stripped(c: Column) -> Column:
    ends = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1)).rlike(r"(?U)[\s\x1c-\x1f]")
    return F.lower(F.when(ends, F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")).otherwise(c))


def misleading_label(low: Column) -> Column:
    """Of a stripped text in lower case: .30 or .25 for a known label, .30 for a short topic."""
    count = F.when(low == "", 0).otherwise(F.size(F.split(low, T.BLANKS)))
    named = has_any(low, tuple(P.LABELS))
    # a short topic has eight words at most, so its text is cut before it's split
    topic = Rx(P.SHORT_TOPIC, "i").column(low) & (F.size(F.split(F.substring(low, 1, 4000), T.BLANKS, 10)) <= 8)
    return F.when(named, F.when(count <= 10, 0.30).otherwise(0.25)).when(topic, 0.30).otherwise(F.lit(0.0))


def score(t: Text) -> Column:
    """struct(token_overlap, bigram, structural, misleading_label, matched, score)."""
    signal = literals(tuple(P.SIGNAL))
    parts = let(tokens_of(t.composed), lambda w: F.struct(token_overlap(w).alias("o"), pair_score(w).alias("b"), let(known(w), lambda have: F.arrays_overlap(have, signal)).alias("g"), F.size(w).alias("n"), _structure(t.low, t.plain, t.squeezed).alias("s"), let(stripped(t.text), misleading_label).alias("m")))
    return let(parts, _combined)


def _combined(p: Column) -> Column:
    label, raw, named = p["s"]["label"], p["s"]["score"], p["m"]
    structural = F.when(label.isin("indirect_query_phrase", "process_caption"), F.least(raw, F.lit(0.30))).when((label == "figstep_colon_topic") & ~p["g"], F.least(raw, F.lit(REVIEW))).otherwise(raw)
    pair, words = p["b"] * 0.9, p["o"] * 0.6
    matched = F.when((label != "") & (structural >= F.greatest(pair, named)), label).when(named >= F.greatest(structural, pair), "misleading_label").when(pair >= words, "bigram").otherwise("token_overlap")
    nothing = (p["n"] < 2) & ~p["g"] & (named == 0.0)
    total = F.when(nothing, 0.0).otherwise(F.greatest(structural, pair, words, named))
    return F.struct(p["o"].alias("token_overlap"), p["b"].alias("bigram"), structural.alias("structural"), named.alias("misleading_label"), F.when(nothing, "none").otherwise(matched).alias("matched"), total.alias("score"))


def with_score(rows: DataFrame, text_col: str) -> DataFrame:
    """Adds token_overlap, bigram, structural, misleading_label, matched and score."""
    c = F.col(text_col)
    d = rows.withColumn("__b", _prepared(c)).withColumn("__s", once(score(_text(c, "__b"))))
    return d.select(*rows.columns, "__s.*")


def semantic_row(s: Column, text: Column) -> Column:
    active = s["score"] >= BLOCK
    reasons = F.array_compact(F.array(F.lit("PROMPT_INJECTION"), *(F.when(s["matched"].isin(labels), code) for labels, code in P.LABEL_REASONS)))
    return _row(
        "semantic", "detector:semantic-scorer", 1, k=0, category="prompt_injection", kind="semantic_injection", state=F.when(active, "HIGHLY_LIKELY").otherwise("POSSIBLE"), severity=F.when(active, "critical").otherwise("medium"), confidence=s["score"], quality=F.when(active, 0.70).otherwise(0.45),
        likelihood=F.round(F.least(s["score"], F.lit(0.9)), 3), impact=F.when(active, "critical").otherwise("medium"), reasons=reasons, action=F.when(active, "BLOCK").otherwise("REVIEW"), limitations=["A heuristic over words and pairs; texts that teach about attacks may be found.", "The score is no probability."], once_key=F.sha2(text, 256),
    )


def _scored_rows(t: Text, unless: Column) -> Column:
    """The scorer's finding where the text is active and ``unless`` doesn't hold; the first of equal texts of a scan counts."""
    scored = F.when((t.text != "") & ~unless & (T._context(t.low) == "active"), score(t))
    return F.transform(F.filter(F.array(scored), lambda s: s["score"] >= REVIEW), lambda s: semantic_row(s, t.text))


def semantic_rows(t: Text) -> Column:
    return _scored_rows(t, F.lit(False))


def injection_rows(t: Text) -> Column:
    """The rules' finding, and the scorer's where the rules confirm none."""
    return let(prompt_rows(t), lambda rules: F.concat(rules, _scored_rows(t, F.exists(rules, lambda r: r["state"] == "CONFIRMED"))))


def semantic(observations: DataFrame, covered: bool = False) -> DataFrame:
    """The scorer's findings; with ``covered`` without observations of which the rules confirm a finding."""
    if covered:
        return find(observations, injection_rows, first_order=False).where("type = 'semantic_injection'")
    return find(observations, semantic_rows, first_order=False)


# ---------------------------------------------------------------- metadata and other inputs
def metadata_fields(files: DataFrame, id_col: str, fields_col: str) -> DataFrame:
    """(id, key, value, class, emits_text, reason): a row for each field of a map column; values are cut at 100 000 characters."""
    rows = files.select(F.col(id_col), F.explode_outer(F.map_entries(fields_col)).alias("e")).where("e is not null")
    kind = T.metadata_class(F.col("e.key"), F.col("e.value"))
    return rows.select(id_col, F.col("e.key").alias("key"), F.substring("e.value", 1, 100_000).alias("value"), kind.alias("class"), T.is_text_class(kind).alias("emits_text"), T.privacy_reason(kind).alias("reason"))


def mock_classifier(c: Column) -> Column:
    """The stand-in classifier's likelihood."""
    low = F.lower(c)
    return F.when(F.contains(low, F.lit("ignore previous instructions")), 0.95).when(F.contains(low, F.lit("prompt injection")), 0.4).otherwise(F.lit(0.0))


class Detector(NamedTuple):
    id: str
    family: str
    category: str
    rows: Callable[[Text], Column]


TEXT_DETECTORS = [
    Detector("detector:prompt-rules", "prompt", "prompt_injection", prompt_rows),
    Detector("detector:semantic-scorer", "prompt", "prompt_injection", semantic_rows),
    Detector("detector:privacy-rules", "privacy", "privacy", privacy_rows),
    Detector("detector:phishing-rules", "phishing", "phishing", phishing_rows),
    Detector("detector:visible-watermark", "watermarks", "watermarks", watermark_rows),
]
#: Detectors that a user has registered; they run behind the package's own.
REGISTERED: list[Detector] = []


def register(detector: Detector) -> None:
    """Adds a detector of one's own; its id must be new."""
    if any(d.id == detector.id for d in (*TEXT_DETECTORS, *REGISTERED)):
        raise ValueError(f"there is a detector {detector.id} already")
    REGISTERED.append(detector)


def all_findings(observations: DataFrame, detectors: frozenset[str] | None = None) -> DataFrame:
    """The findings of every text detector (or of those named), ordered as the detectors are, in one pass over the texts."""
    on = lambda name: detectors is None or name in detectors or f"{name}-rules" in detectors
    prompt, scorer = on("detector:prompt-rules"), on("detector:semantic-scorer")
    chosen = [injection_rows] if prompt and scorer else [prompt_rows] if prompt else [semantic_rows] if scorer else []
    chosen += [d.rows for d in (*TEXT_DETECTORS[2:], *REGISTERED) if on(d.id) or d in REGISTERED]
    return find(observations, *chosen)
