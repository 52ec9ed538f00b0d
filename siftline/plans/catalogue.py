"""The queries of the content-security engine by name, and the SQL that each is held against.

Texts come from the tables ``documents`` (a scan for each doc_id), ``conversations`` (a scan for each
conv_id, an observation for each turn) and the probe texts, so that every detector has something to find.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..functions.conditions import Rx, case_sql, once, quoted
from ..operators import detectors as D
from ..operators import evaluation, evidence, lifecycle, policy
from ..schemas import CATEGORIES, PROFILES, SEVERITIES, STATES, rank_sql
from ..sources import files

FLAGSHIP = "privacy_action_counts"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL if there is any."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def probes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(P.PROBES)), "n long, text string")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scan, ord, text) of all sources."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("scan"), F.lit(0).cast("long").alias("ord"), "text")
    talks = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id").alias("scan"), F.col("turn").cast("long").alias("ord"), "text")
    return docs.unionByName(talks).unionByName(probes(spark).select(F.concat(F.lit("p"), "n").alias("scan"), F.lit(0).cast("long").alias("ord"), "text"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.observe(texts(spark, sf_dir), F.col("scan"), F.col("ord"), F.col("text"))


_PROBES_SQL = "(values " + ", ".join(f"({i}, {quoted(t)})" for i, t in enumerate(P.PROBES)) + ") as probes(n, text)"
OBSERVATIONS_SQL = f"""
    texts as (
        select 'd' || doc_id as scan_id, 0 as ord, text from documents where text is not null and doc_id is not null
        union all select 'c' || conv_id, turn, text from conversations where text is not null and conv_id is not null
        union all select 'p' || n, 0, text from {_PROBES_SQL}),
    obs as (select scan_id, ord, text as raw, trim(regexp_replace(text, '\\s+', ' ', 'g')) as t, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as low from texts)
"""
_with = f"with {OBSERVATIONS_SQL}"
_MATCH = lambda x, flags="": f"regexp_matches(t, {quoted((f'(?{flags})' if flags else '') + x)})"

# ---------------------------------------------------------------- privacy
_LUHN = """(len({d}) >= 13 and list_sum(list_transform(range(1, len({d}) + 1), lambda i: case when (len({d}) - i) % 2 = 1
    then (case when 2 * cast({d}[i] as int) > 9 then 2 * cast({d}[i] as int) - 9 else 2 * cast({d}[i] as int) end) else cast({d}[i] as int) end)) % 10 = 0)"""


def _privacy_sql() -> str:
    parts = []
    for k, (kind, pattern, cased) in enumerate(P.PRIVACY):
        flagged = quoted(("" if cased else "(?i)") + pattern)
        test = f"regexp_extract(t, {flagged}) <> ''"
        if kind == "telephone_number":
            x = f"regexp_extract(t, {flagged})"
            test = rf"{x} <> '' and length(regexp_replace({x}, '[^0-9]', '', 'g')) >= 8 and not regexp_full_match(trim({x}), '(?:\d+\.\s*){{2,}}\d*\.?')"
        parts.append(f"select scan_id, ord, {k} as k, '{kind}' as type, t as shown from obs where {test}")
    cards = f"""select scan_id, ord, {len(P.PRIVACY)} + i as k, 'payment_card_like_number' as type, m as shown from
        (select scan_id, ord, unnest(range(len(ms))) as i, unnest(ms) as m from
            (select scan_id, ord, list_filter(regexp_extract_all(t, {quoted(P.CARD)}), lambda x: {_LUHN.format(d="regexp_replace(x, '[^0-9]', '', 'g')")}) as ms from obs))"""
    return " union all ".join([*parts, cards])


_PRIVACY = f"{_with}, found as ({_privacy_sql()})"


@query(f"{_PRIVACY} select scan_id, ord, k, type, case when type like '%key%' or type = 'payment_card_like_number' then 'high' else 'medium' end as severity, 'sha256:' || sha256(shown) as text_sha256, strlen(shown) as text_length from found")
def privacy_findings(spark, sf_dir):
    d = D.privacy(observations(spark, sf_dir))
    return d.select("scan_id", F.expr("ord div 100").alias("ord"), F.expr("cast(ord % 100 as int)").alias("k"), "type", "severity", "text_sha256", "text_length")


@query(f"{_PRIVACY}, hit as (select distinct scan_id from found) select case when hit.scan_id is not null then 'REVIEW' else 'ALLOW_RECONSTRUCTED_ONLY' end as action, count(*) as n from (select distinct scan_id from obs) s left join hit using (scan_id) group by 1")
def privacy_action_counts(spark, sf_dir):
    got = evidence.deduplicate(D.privacy(observations(spark, sf_dir)))
    seen = texts(spark, sf_dir).where("text is not null and scan is not null").select(F.col("scan").alias("scan_id")).distinct()
    return policy.decide(seen, got, ["RAG_INGESTION"]).groupBy("action").agg(F.count("*").alias("n"))


@query(f"{_PRIVACY} select scan_id, count(*) as n_cards, count(distinct shown) as n_distinct from found where type = 'payment_card_like_number' group by 1")
def payment_cards_luhn(spark, sf_dir):
    d = D.privacy(observations(spark, sf_dir)).where("type = 'payment_card_like_number'")
    return d.groupBy("scan_id").agg(F.count("*").alias("n_cards"), F.countDistinct("text_sha256").alias("n_distinct"))


# ---------------------------------------------------------------- phishing, watermarks
_INDICATORS = "list_sort(list_filter([" + ", ".join(f"case when {c.sql('low')} then {quoted(n)} end" for n, c in P.PHISHING) + "], lambda x: x is not null))"


@query(f"{_with} select scan_id, ord, list_aggregate(i, 'string_agg', '|') as indicators from (select scan_id, ord, {_INDICATORS} as i from obs) where len(i) > 0")
def phishing_indicators(spark, sf_dir):
    d = D.phishing(observations(spark, sf_dir))
    return d.select("scan_id", F.expr("ord div 100").alias("ord"), F.array_join("indicators", "|").alias("indicators"))


@query(f"{_with} select scan_id, ord, list_aggregate(i, 'string_agg', '|') as indicators from (select scan_id, ord, list_filter([{', '.join(map(quoted, P.WATERMARKS))}], lambda w: contains(low, w)) as i from obs) where len(i) > 0")
def watermark_indicators(spark, sf_dir):
    d = D.watermarks(observations(spark, sf_dir))
    return d.select("scan_id", F.expr("ord div 100").alias("ord"), F.array_join("indicators", "|").alias("indicators"))


# ---------------------------------------------------------------- context, intent, rules
_BARE = f"regexp_replace(regexp_replace(low, {quoted(T.ADDRESS)}, '', 'g'), {quoted(T.DOMAIN)}, '', 'g')"


def _context_sql(low: str = "low") -> str:
    bare = _BARE.replace("low", low) if low != "low" else _BARE
    return f"coalesce({case_sql(T.CONTEXTS, None, low)}, case when {T.DISCUSSION.sql(bare)} then 'discussed' else 'active' end)"


@query(f"{_with} select scan_id, ord, {_context_sql()} as context from obs")
def text_context(spark, sf_dir):
    return observations(spark, sf_dir).select("scan_id", "ord", T.context(F.col("normalized_text")).alias("context"))


@query(
    f"{_with} select scan_id, ord, case when contains(low, 'system') then 'system' end as speaker_claim, {case_sql(T.REQUESTS, None, 'low')} as requested_action, case when {T.CREDENTIALS.sql('low')} then 'credential' end as target, "
    f"{T.OVERRIDE.sql('low')} as authority_override, {T.SECRECY.sql('low')} as secrecy_requested, {T.EXFILTRATES.sql('low')} as data_exfiltration, ({T.CREDENTIALS.sql('low')} and {T.EXTRACTION.sql('low')}) as credential_request, {_context_sql()} as quoted_or_active from obs"
)
def text_intent(spark, sf_dir):
    return observations(spark, sf_dir).select("scan_id", "ord", T.intent(F.col("normalized_text")).alias("i")).select("scan_id", "ord", "i.*")


_RULES = "list_filter([" + ", ".join(f"case when {' or '.join(Rx(x, 'i').sql('t') for x in xs)} then {i} end" for i, (_, _, _, xs) in enumerate(P.PROMPT_RULES)) + "], lambda x: x is not null)"


@query(f"{_with} select scan_id, ord, list_aggregate(list_transform(r, lambda i: [{', '.join(quoted(p[0]) for p in P.PROMPT_RULES)}][i + 1]), 'string_agg', '|') as rules from (select scan_id, ord, {_RULES} as r from obs) where len(r) > 0")
def prompt_rule_matches(spark, sf_dir):
    d = observations(spark, sf_dir).select("scan_id", "ord", once(D.matching_rules(F.col("normalized_text"))).alias("r")).where(F.size("r") > 0)
    return d.select("scan_id", "ord", F.array_join(F.transform("r", D._of_rule(0)), "|").alias("rules"))




# ---------------------------------------------------------------- derived texts and evidence
_ROT = f"translate(t, '{T._UPPER}{T._UPPER.lower()}', '{T._TURNED}{T._TURNED.lower()}')"


def _telltale(x: str) -> str:
    return T._TELLTALE.sql(f"lower({x})")


@query(f"{_with} select scan_id, ord, {_ROT} as turned, strlen(t) <= 100000 and {_ROT} <> t and {_telltale(_ROT)} as kept from obs")
def derived_rot13(spark, sf_dir):
    """Every text turned; ``kept`` says whether it is a candidate, which texts over 100 000 bytes never are."""
    t = F.col("normalized_text")
    return observations(spark, sf_dir).select("scan_id", "ord", T.rot13(t).alias("turned"), ((F.octet_length(t) <= 100_000) & (T.rot13(t) != t) & T._TELLTALE.column(F.lower(T.rot13(t)))).alias("kept"))


def _printable(x: str) -> str:
    return f"(case when length({x}) > 0 then length(regexp_replace({x}, '[^\\x09-\\x0d\\x20-\\x7e]', '', 'g')) / length({x}) else 0.0 end)"


def _decoded_sql(pattern: str, guard: str, decode: str, kind: str, confidence: float) -> str:
    found = f"list_filter(list_transform(list_filter(regexp_extract_all(t, '{pattern}')[1:5], lambda x: {guard}), lambda x: {decode}), lambda y: y is not null and {_printable('y')} >= 0.8)"
    return f"list_transform({found}, lambda y: {{'kind': '{kind}', 'confidence': {confidence}::double, 'text': y}})"


_SINGLE = "case when {0} <> t and {1} then [{{'kind': '{2}', 'confidence': 0.5::double, 'text': {0}}}] else [] end"
_CANDIDATES = f"""cand as (select scan_id, ord, case when strlen(t) > 100000 then [] else list_concat(
    {_decoded_sql('[A-Za-z0-9+/]{16,}={0,2}', 'length(x) % 4 = 0', 'try(decode(from_base64(x)))', 'base64', 0.8)},
    {_decoded_sql('[0-9a-fA-F]{24,}', 'length(x) % 2 = 0', 'try(decode(unhex(x)))', 'hex', 0.75)},
    {_SINGLE.format(_ROT, _telltale(_ROT), 'rot13')}, case when {_telltale('reverse(t)')} then [{{'kind': 'reversed', 'confidence': 0.5::double, 'text': reverse(t)}}] else [] end)[1:20] end as cs from obs)"""
_PLACED = "placed as (select scan_id, ord, i as place, cs[i + 1] as c from (select scan_id, ord, cs, unnest(range(len(cs))) as i from cand))"


@query(f"{_with}, {_CANDIDATES}, {_PLACED} select scan_id, ord, place, c.kind as transformation, c.confidence as confidence, strlen(c.text) as decoded_bytes, round({_printable('c.text')}, 6) as printable_ratio, c.text as text from placed")
def derived_texts(spark, sf_dir):
    d = observations(spark, sf_dir).select("scan_id", "ord", F.posexplode(T.derive_candidates(F.col("normalized_text"))).alias("place", "c"))
    return d.select("scan_id", "ord", "place", F.col("c.transformation").alias("transformation"), F.col("c.confidence").alias("confidence"), F.col("c.decoded_bytes").alias("decoded_bytes"), F.round("c.printable_ratio", 6).alias("printable_ratio"), F.col("c.text").alias("text"))


def _rule_findings_sql() -> str:
    pick = lambda i: "[" + ", ".join(quoted(p[i]) for p in P.PROMPT_RULES) + "]"
    rules = _RULES.replace("regexp_matches(t,", "regexp_matches(text,")
    return f"""{_CANDIDATES}, {_PLACED}, texts_of as (select scan_id, ord, -1 as place, t as text from obs union all select scan_id, ord, place, c.text from placed),
        matched as (select scan_id, ord, place, text, lower(text) as l, {rules} as r from texts_of), best as (select scan_id, ord, min(place) as place from matched where len(r) > 0 group by 1, 2),
        hit as (select m.*, {_context_sql('l')} = 'active' as active, {case_sql(T.REQUESTS, None, 'l')} as request, list_distinct(list_transform(r, lambda i: {pick(1)}[i + 1])) as cats, list_bool_or(list_transform(r, lambda i: {pick(2)}[i + 1] = 'critical')) as critical,
            ({T.CREDENTIALS.sql('l')} and {T.EXTRACTION.sql('l')}) as asks from matched m join best using (scan_id, ord, place)),
        coded as (select *, asks or list_contains(cats, 'credential_request') as credential, list_concat(list_sort(list_distinct(list_concat(['PROMPT_INJECTION'], list_transform(cats, lambda c: upper(c))))), case when request = 'tool_call' then ['TOOL_INVOCATION_REQUEST'] else [] end) as codes from hit),
        ruled as (select scan_id, ord, printf('finding:%s:prompt:%03d', scan_id, row_number() over (partition by scan_id order by ord) - 1) as finding_id, {pick(1)}[r[1] + 1] as type, case when active then 'CONFIRMED' else 'POSSIBLE' end as state, case when active and critical then 'critical' else {pick(2)}[r[1] + 1] end as severity,
            case when active then 0.95 else 0.35 end::double as attack_likelihood, case when active then 'BLOCK' else 'REVIEW' end as recommended_action, array_to_string(case when credential then list_sort(list_distinct(list_concat(codes, ['CREDENTIAL_REQUEST']))) else codes end, '|') as reason_codes, 'sha256:' || sha256(text) as text_sha256, strlen(text) as text_length from coded)"""


_RULE_FINDINGS = f"{_with}, {_rule_findings_sql()}"


@query(f"{_RULE_FINDINGS} select * exclude (ord) from ruled")
def prompt_rule_findings(spark, sf_dir):
    d = D.prompt_rules(observations(spark, sf_dir))
    return d.select("scan_id", "finding_id", "type", "state", "severity", "attack_likelihood", "recommended_action", F.array_join("reason_codes", "|").alias("reason_codes"), "text_sha256", "text_length")


@query(f"{_with} select scan_id, ord, 'sha256:' || sha256(t) as text_sha256, strlen(t) as text_length from obs")
def text_evidence(spark, sf_dir):
    return observations(spark, sf_dir).select("scan_id", "ord", T.text_evidence(F.col("normalized_text")).alias("e")).select("scan_id", "ord", "e.*")


_EXCERPT = f"regexp_replace(regexp_replace(translate(raw, chr(13) || chr(10), '  '), {quoted(T.EXCERPT_SECRET)}, '[redacted-sensitive-value]', 'g'), {quoted(T.EXCERPT_KEY)}, '[redacted-sensitive-value]', 'g')"


@query(f"{_with} select scan_id, ord, case when length({_EXCERPT}) > 80 then substring({_EXCERPT}, 1, 80) || '...' else {_EXCERPT} end as excerpt from obs")
def safe_excerpt(spark, sf_dir):
    return observations(spark, sf_dir).select("scan_id", "ord", T.safe_excerpt(F.col("raw_text")).alias("excerpt"))


@query(f"{_with} select scan_id, ord, case when length(t) > 0 then round(length(regexp_replace(t, '[^\\x09-\\x0d\\x20-\\x7e]', '', 'g')) / length(t), 6) else 0.0 end as ratio from obs")
def printable_ratio(spark, sf_dir):
    return observations(spark, sf_dir).select("scan_id", "ord", F.round(T.printable_ratio(F.col("normalized_text")), 6).alias("ratio"))


@query(f"{_with} select scan_id, ord, t as normalized, false as zero_width_found, false as bidi_found from obs")
def normalized_texts(spark, sf_dir):
    return observations(spark, sf_dir).select("scan_id", "ord", F.col("normalized_text").alias("normalized"), "zero_width_found", "bidi_found")


@query()
def normalized_pages(spark, sf_dir):
    """Pages have entities and escapes, which SQL can't undo."""
    return T.normalize(D.spread(table(spark, sf_dir, "pages")), "html", "n").select("page_id", "n.*")


# ---------------------------------------------------------------- semantic scorer
_TOKENS = f"{_with}, tok as (select *, regexp_extract_all(low, '[a-z0-9'']+') as ts from obs)"
_OVERLAP = " + ".join(f"len(list_intersect(list_distinct(ts), [{', '.join(map(quoted, w))}])) * {weight / len(w)!r}" for weight, w in P.WORD_SETS)


@query(f"{_TOKENS} select scan_id, ord, round(least(({_OVERLAP}) / 2, 1.0), 9) as overlap from tok")
def semantic_token_overlap(spark, sf_dir):
    return observations(spark, sf_dir).select("scan_id", "ord", F.round(D.token_overlap(D.tokens(F.col("normalized_text"))), 9).alias("overlap"))


_PAIR_TABLE = ", ".join(f"({quoted(p.split('>')[0])}, {quoted(p.split('>')[1])}, {w})" for w, ps in P.PAIRS.items() for p in ps)


@query(
    f"{_TOKENS}, pos as (select scan_id, ord, unnest(ts) as w, unnest(range(len(ts))) as i from tok), "
    f"hit as (select a.scan_id, a.ord, max(p.s) as s from (values {_PAIR_TABLE}) as p(x, y, s) join pos a on a.w = p.x join pos b on b.w = p.y and b.scan_id = a.scan_id and b.ord = a.ord and b.i between a.i + 1 and a.i + 4 group by 1, 2) "
    "select tok.scan_id, tok.ord, cast(coalesce(hit.s, 0) as double) as score from tok left join hit using (scan_id, ord)"
)
def semantic_bigram(spark, sf_dir):
    d = observations(spark, sf_dir).withColumn("ts", once(D.tokens(F.col("normalized_text"))))
    return d.select("scan_id", "ord", D.pair_score(F.col("ts")).alias("score"))


def _looking_ahead_sql(short: str) -> str:
    """The look-ahead expression for texts of one line: each alternative that forbids words is a match without, and none with them."""
    from ..functions.conditions import expand

    def parts(text: str) -> list[str]:
        out, depth, last = [], 0, ""
        for c in text:
            depth += (c == "(") - (c == ")")
            out, last = ([*out, last], "") if c == "|" and not depth else (out, last + c)
        return [*out, last]

    tests, plain = [], []
    for alternative in parts(short.removeprefix("^(?:").removesuffix(")")):
        if "(?!" not in alternative:
            plain.append(alternative)
            continue
        # "(?:of NOT|that can be)x": two alternatives
        head, rest = alternative.split("(?!", 1)
        words, tail = rest.split(")~)", 1)
        words = words.removeprefix("(?:")
        if head.endswith("(?:of "):
            other, tail = tail.split(")", 1)
            plain.append(head.removesuffix("(?:of ") + other.removeprefix("|") + tail)
            head = head.removesuffix("(?:of ") + "of "
        # an optional article before the forbidden words may be skipped
        heads = [head]
        for article in ("(?:the |a )?", "(?:the )?"):
            if head.endswith(article):
                heads = [head.removesuffix(article), head.removesuffix("?")]
        m = lambda x: f"regexp_matches(t, {quoted('(?im)^(?:' + expand(x) + ')')})"
        tests += [f"({m(h + tail)} and not {m(h + '(?:' + words + ')~')})" for h in heads]
    tests.append(f"regexp_matches(t, {quoted('(?im)^(?:' + expand('|'.join(plain)) + ')')})")
    return "(" + " or ".join(tests) + ")"


def _structure_sql() -> str:
    test = lambda i, x, f: _looking_ahead_sql(x) if i in P.LOOKING_AHEAD else Rx(x, "i" + f).sql("t")
    hits = [f"case when {test(i, x, f)} then {{'score': {s:.2f}::double, 'place': {-i}, 'label': {quoted(label)}}} end" for i, (s, label, x, f, _) in enumerate(P.STRUCTURES)]
    return "list_max(list_filter([" + ", ".join(hits) + "], lambda x: x is not null))"


@query(f"{_with} select scan_id, ord, s.score as score, s.label as label from (select scan_id, ord, {_structure_sql()} as s from obs) where s is not null")
def semantic_structural(spark, sf_dir):
    d = observations(spark, sf_dir).withColumn("low", once(F.lower("normalized_text"))).select("scan_id", "ord", once(D.structure(F.col("normalized_text"), F.col("low"))).alias("s")).where("s.score > 0")
    return d.select("scan_id", "ord", F.col("s.score").alias("score"), F.col("s.label").alias("label"))


_NAMED = " or ".join(f"contains(low, {quoted(w)})" for w in P.LABELS)
_SCORED = f"""{_TOKENS}, pos as (select scan_id, ord, unnest(ts) as w, unnest(range(len(ts))) as i from tok),
    pair as (select a.scan_id, a.ord, max(p.s) as s from (values {_PAIR_TABLE}) as p(x, y, s) join pos a on a.w = p.x join pos b on b.w = p.y and b.scan_id = a.scan_id and b.ord = a.ord and b.i between a.i + 1 and a.i + 4 group by 1, 2),
    part as (select tok.scan_id, tok.ord, tok.t, tok.low, least(({_OVERLAP}) / 2, 1.0)::double as o, coalesce(pair.s, 0)::double as b, len(list_intersect(ts, [{', '.join(map(quoted, P.SIGNAL))}])) > 0 as g, len(ts) as n, {_structure_sql()} as st, case when low = '' then 0 else len(string_split(low, ' ')) end as words from tok left join pair using (scan_id, ord)),
    named as (select *, coalesce(st.score, 0)::double as raw, coalesce(st.label, '') as label, case when {_NAMED} then case when words <= 10 then 0.30 else 0.25 end when words <= 8 and {Rx(P.SHORT_TOPIC, 'i').sql('low')} then 0.30 else 0.0 end::double as m from part),
    shaped as (select *, case when label in ('indirect_query_phrase', 'process_caption') then least(raw, 0.30) when label = 'figstep_colon_topic' and not g then least(raw, 0.35) else raw end::double as structural, n < 2 and not g and m = 0 as nothing from named),
    scored as (select scan_id, ord, t, low, o as token_overlap, b as bigram, structural, m as misleading_label, case when nothing then 0.0 else greatest(structural, b * 0.9, o * 0.6, m) end::double as score,
        case when nothing then 'none' when label <> '' and structural >= greatest(b * 0.9, m) then label when m >= greatest(structural, b * 0.9) then 'misleading_label' when b * 0.9 >= o * 0.6 then 'bigram' else 'token_overlap' end as matched from shaped)"""


@query(f"{_SCORED} select scan_id, ord, round(token_overlap, 9) as token_overlap, bigram, structural, misleading_label, round(score, 9) as score, matched from scored")
def semantic_score(spark, sf_dir):
    d = D.with_score(observations(spark, sf_dir), "normalized_text")
    return d.select("scan_id", "ord", F.round("token_overlap", 9).alias("token_overlap"), "bigram", "structural", "misleading_label", F.round("score", 9).alias("score"), "matched")


_REASONS = "list_concat(['PROMPT_INJECTION'], list_filter([" + ", ".join(f"case when matched in ({', '.join(map(quoted, labels))}) then {quoted(code)} end" for labels, code in P.LABEL_REASONS) + "], lambda x: x is not null))"


@query(
    f"{_SCORED}, {_rule_findings_sql()}, fresh as (select *, row_number() over (partition by scan_id, t order by ord) as k from scored where t <> '' and not exists (select 1 from ruled r where r.scan_id = scored.scan_id and r.ord = scored.ord and r.state = 'CONFIRMED')), "
    f"kept as (select * from fresh where k = 1 and score >= 0.35 and {_context_sql()} = 'active') "
    f"select scan_id, printf('finding:%s:semantic:%03d', scan_id, row_number() over (partition by scan_id order by ord) - 1) as finding_id, case when score >= 0.55 then 'HIGHLY_LIKELY' else 'POSSIBLE' end as state, case when score >= 0.55 then 'critical' else 'medium' end as severity, round(score, 9) as detector_confidence, round(least(score, 0.9), 3) as attack_likelihood, array_to_string({_REASONS}, '|') as reason_codes from kept"
)
def semantic_findings(spark, sf_dir):
    d = D.semantic(observations(spark, sf_dir), covered=True)
    return d.select("scan_id", "finding_id", "state", "severity", F.round("detector_confidence", 9).alias("detector_confidence"), "attack_likelihood", F.array_join("reason_codes", "|").alias("reason_codes"))


# ---------------------------------------------------------------- URLs, metadata
_U = {"scheme": f"lower(regexp_extract(url, '{T.SCHEME}', 1))", "authority": f"regexp_extract(url, '{T.AUTHORITY}', 1)", "path": f"lower(regexp_extract(url, '{T.PATH}', 1))"}
_HOST = f"lower(regexp_extract(split_part({_U['authority']}, '@', -1), '^([^:]*)', 1))"


@query(
    f"select page_id, {_U['scheme']} <> '' as is_url, nullif({_U['scheme']}, '') as scheme, case when {_HOST} <> '' then 'sha256:' || sha256({_HOST}) end as hostname_sha256, regexp_matches({_U['authority']}, '^[^@]+@') as has_embedded_credentials, "
    f"regexp_matches(replace({_HOST}, '.', ''), '^[0-9]+$') as ip_literal, {_U['scheme']} = 'file' as file_url, array_to_string(list_filter([{', '.join(map(quoted, T.SUSPICIOUS_PATH))}], lambda w: contains({_U['path']}, w)), '|') as suspicious_terms from pages where url is not null"
)
def url_analysis(spark, sf_dir):
    d = table(spark, sf_dir, "pages").where("url is not null").select("page_id", T.url_analysis(F.col("url")).alias("u")).select("page_id", "u.*")
    return d.withColumn("suspicious_terms", F.array_join("suspicious_terms", "|"))


_FIELD_NAMES = ["GPS:GPSLatitude", "XMP:Author", "XMP:History", "XMP:Description", "File:ImageWidth", "XMP:CreatorWorkURL", "EXIF:Serial Number", "IFD0:Note"]


_FIELD_VALUE = "event_type || ' ' || props"


def _metadata_sql() -> str:
    """The classes of the fixed names, and of values, by the rules' own words."""
    low = {n: n.rsplit(":", 1)[-1].translate(str.maketrans("", "", " _-")).lower() for n in _FIELD_NAMES}

    def kind(name: str) -> str:
        k = low[name]
        fixed = "location_data" if k in T.LOCATION or k.startswith("gps") else "identity_data" if k in T.IDENTITY else "workflow_data" if k in T.WORKFLOW else "provenance_data" if any(p in k for p in T.PROVENANCE) else None
        if fixed:
            return quoted(fixed)
        text = quoted("free_text") if k in T.FREE_TEXT else r"case when length(value) > 40 and regexp_matches(value, '\s') then 'free_text' else 'ordinary_camera_data' end"
        return f"case when value is null then 'binary_blob' else {text} end"

    cases = " ".join(f"when {quoted(n)} then {kind(n)}" for n in _FIELD_NAMES)
    rows = f"select event_id, unnest([{', '.join(map(quoted, _FIELD_NAMES))}]) as key, unnest(range({len(_FIELD_NAMES)})) as i, concat_ws(' ', event_type, props) as v from events"
    return f"select event_id, key, value[1:100000] as value, class, class in ('free_text', 'identity_data', 'workflow_data', 'provenance_data') as emits_text, case class when 'identity_data' then 'IDENTITY_METADATA_PRESENT' when 'location_data' then 'GPS_PRESENT' end as reason from (select *, case key {cases} end as class from (select event_id, key, case when event_id % {len(_FIELD_NAMES)} <> i then v end as value from ({rows})))"


@query(_metadata_sql())
def metadata_fields(spark, sf_dir):
    """Each event as a record whose properties stand for a file's metadata."""
    pairs = [x for i, n in enumerate(_FIELD_NAMES) for x in (F.lit(n), F.when(F.col("event_id") % len(_FIELD_NAMES) != i, F.concat_ws(" ", "event_type", "props")))]
    return D.metadata_fields(table(spark, sf_dir, "events").withColumn("fields", F.create_map(*pairs)), "event_id", "fields")


# ---------------------------------------------------------------- evidence
@query(f"{_with}, n as (select scan_id, ord, low, row_number() over (partition by scan_id, low order by ord) as k from obs) select scan_id, ord, 'sha256:' || sha256(low) as text_sha256 from n where k = 1")
def merge_observations(spark, sf_dir):
    return evidence.merge_observations(observations(spark, sf_dir)).select("scan_id", "ord", T.text_sha256(F.lower("normalized_text")).alias("text_sha256"))


@query(
    f"{_PRIVACY}, g as (select scan_id, type, 'sha256:' || sha256(shown) as support, count(*) as n, count(distinct ord) as n_observations, min(ord * 100 + k) as place from found group by 1, 2, 3) select scan_id, type, support, n_observations, place from g"
)
def dedup_findings(spark, sf_dir):
    d = evidence.deduplicate(D.privacy(observations(spark, sf_dir)))
    return d.select("scan_id", "type", F.col("text_sha256").alias("support"), F.size("observation_ids").cast("long").alias("n_observations"), F.col("ord").alias("place"))


@query()
def dedup_all_findings(spark, sf_dir):
    d = evidence.deduplicate(D.all_findings(observations(spark, sf_dir)))
    return d.select("scan_id", "finding_id", "category", "type", "state", "severity", F.array_join("observation_ids", "|").alias("observation_ids"), F.array_join("detector_ids", "|").alias("detector_ids"), F.array_join("reason_codes", "|").alias("reason_codes"))


_STATE_LIST = "[" + ", ".join(map(quoted, ["CONFIRMED", "NO_EVIDENCE_FOUND", "UNSUPPORTED", "ERROR", "NOT_TESTED", "INCONCLUSIVE", "NO_EVIDENCE_FOUND"])) + "]"
_EXEC_STATES = ["CONFIRMED", "NO_EVIDENCE_FOUND", "UNSUPPORTED", "ERROR", "NOT_TESTED", "INCONCLUSIVE", "NO_EVIDENCE_FOUND"]
_EXEC_STATUS = ["SUCCESS", "NO_EVIDENCE", "DETECTED", "SUCCESS", "TIMEOUT", "SUCCESS", "NO_EVIDENCE", "SUCCESS", "DETECTED", "NO_EVIDENCE", "SUCCESS"]
_DETECTOR_IDS = [r[0] for r in policy.REGISTRY]
_pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as executions: the user is the scan, the remaining columns choose detector, state and status."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    hits = F.element_at(F.array(*(F.lit(r[2]) for r in policy.REGISTRY)), (n % len(_DETECTOR_IDS) + 1).cast("int"))
    return e.select(F.concat(F.lit("u"), "user_id").alias("scan_id"), _pick(_DETECTOR_IDS, n % len(_DETECTOR_IDS)).alias("detector_id"), _pick(_EXEC_STATUS, (n * 7) % len(_EXEC_STATUS)).alias("status"), _pick(_EXEC_STATES, (n * 5) % len(_EXEC_STATES)).alias("state"), hits.alias("category"), n.alias("ord")).where("scan_id is not null")


def _sql_pick(names: list[str], n: str) -> str:
    return "[" + ", ".join(map(quoted, names)) + f"][cast({n} + 1 as int)]"


EXECUTIONS_SQL = f"""exec as (select 'u' || user_id as scan_id, {_sql_pick(_DETECTOR_IDS, f'event_id % {len(_DETECTOR_IDS)}')} as detector_id, {_sql_pick(_EXEC_STATUS, f'(event_id * 7) % {len(_EXEC_STATUS)}')} as status,
    {_sql_pick(_EXEC_STATES, f'(event_id * 5) % {len(_EXEC_STATES)}')} as state, {_sql_pick([r[2] for r in policy.REGISTRY], f'event_id % {len(_DETECTOR_IDS)}')} as category, event_id as ord from events where user_id is not null)"""
_ROLL = f"""case when bool_or(status = 'TIMEOUT') or bool_or(state = 'ERROR') then 'ERROR' when bool_and(state = 'UNSUPPORTED') then 'UNSUPPORTED' when bool_and(state = 'NOT_TESTED') then 'NOT_TESTED'
    when bool_or(state = 'INCONCLUSIVE') then 'INCONCLUSIVE' when bool_or(state = 'NO_EVIDENCE_FOUND') then 'NO_EVIDENCE_FOUND' else arg_max(state, {rank_sql('state', STATES)}) end"""


@query(f"with {EXECUTIONS_SQL} select scan_id, category, {_ROLL} as state, count(*) as n_executions from exec group by 1, 2")
def execution_rollup(spark, sf_dir):
    return evidence.roll_up_executions(executions(spark, sf_dir)).select("scan_id", "category", "state", "n_executions")


def event_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event read as a finding of its user, for the decision queries. Detectors are chosen by the finding's number, so some have executions but no finding in a scan."""
    e, n = table(spark, sf_dir, "events").where("user_id is not null"), F.col("event_id")
    none = F.lit(None)
    return e.select(
        F.concat(F.lit("u"), "user_id").alias("scan_id"), F.format_string("finding:%09d", n).alias("finding_id"), n.alias("ord"), _pick(CATEGORIES, n % 13).alias("category"), F.when(n % 2 == 0, "executable").otherwise("other").alias("type"),
        _pick(STATES, (n * 3) % 8).alias("state"), _pick(SEVERITIES, n % 4).alias("severity"), none.cast("double").alias("detector_confidence"), F.lit(0.5).alias("evidence_quality"), F.when(n % 5 != 0, (n % 10) / 10.0).alias("attack_likelihood"), _pick(SEVERITIES, (n * 3) % 4).alias("impact"),
        F.array().cast("array<string>").alias("source_artifact_ids"), F.array(F.format_string("observation:%d", n % 7)).alias("observation_ids"), F.array(_pick(_DETECTOR_IDS, (n * 3) % len(_DETECTOR_IDS))).alias("detector_ids"), F.array(F.when(n % 2 == 0, "GPS_PRESENT").otherwise("OTHER_REASON")).alias("reason_codes"),
        none.cast("string").alias("recommended_action"), F.array().cast("array<string>").alias("limitations"), none.cast("string").alias("text_sha256"), none.cast("long").alias("text_length"), none.cast("array<string>").alias("indicators"), none.cast("array<string>").alias("transformations"),
    )


FINDINGS_SQL = f"""find as (select 'u' || user_id as scan_id, printf('finding:%09d', event_id) as finding_id, event_id as ord, {_sql_pick(CATEGORIES, 'event_id % 13')} as category, case when event_id % 2 = 0 then 'executable' else 'other' end as type,
    {_sql_pick(STATES, '(event_id * 3) % 8')} as state, {_sql_pick(SEVERITIES, 'event_id % 4')} as severity, case when event_id % 5 <> 0 then (event_id % 10) / 10.0 end as attack_likelihood, {_sql_pick(SEVERITIES, '(event_id * 3) % 4')} as impact,
    {_sql_pick(_DETECTOR_IDS, f'(event_id * 3) % {len(_DETECTOR_IDS)}')} as detector_id, case when event_id % 2 = 0 then 'GPS_PRESENT' else 'OTHER_REASON' end as reason_code from events where user_id is not null),
    scans as (select distinct 'u' || user_id as scan_id from events where user_id is not null)"""


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("user_id is not null").select(F.concat(F.lit("u"), "user_id").alias("scan_id")).distinct()


_CATEGORY_TABLE = "(values " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(CATEGORIES)) + ") as cat(category_order, category)"


@query(
    f"""with {EXECUTIONS_SQL}, {FINDINGS_SQL},
    f as (select scan_id, category, count(*) as n, arg_max(state, {rank_sql('state', STATES)}) as state, max(coalesce(attack_likelihood, 0.0)) as likelihood, arg_max(impact, {rank_sql('impact', SEVERITIES, 1)}) as impact, string_agg(finding_id, '|' order by ord) as ids from find group by 1, 2),
    e as (select scan_id, category, {_ROLL} as state, bool_or(state in ('ERROR', 'UNSUPPORTED', 'NOT_TESTED')) as partial from exec group by 1, 2)
    select scan_id, category, coalesce(f.state, e.state, 'NOT_TESTED') as state, cast(f.likelihood as double) as likelihood, coalesce(f.impact, 'low') as impact,
        case when category in ('steganography', 'covert_channel') then (case when f.n is null then 'low' else 'medium' end) when category = 'watermarks' then 'low' when category = 'adversarial_instability' then 'not_tested'
             when f.n is null and e.state is null then 'not_tested' when e.partial then 'partial' else 'medium' end as coverage, coalesce(f.n, 0) as n_findings, coalesce(f.ids, '') as finding_ids
    from scans cross join {_CATEGORY_TABLE} left join f using (scan_id, category) left join e using (scan_id, category)"""
)
def category_assessments(spark, sf_dir):
    d = evidence.assess(scans(spark, sf_dir), event_findings(spark, sf_dir), executions(spark, sf_dir))
    return d.select("scan_id", "category", "state", "likelihood", "impact", "coverage", "n_findings", F.array_join("finding_ids", "|").alias("finding_ids"))


# ---------------------------------------------------------------- policy
def _rule_sql(when: dict) -> str:
    tests = ["true"]
    for field, value in when.items():
        if field == "reason_code":
            tests.append(f"reason_code = '{value}'")
        elif isinstance(value, list):
            tests.append(f"{field.removesuffix('_in')} in ({', '.join(map(quoted, value))})")
        else:
            tests.append(f"{field} = '{value}'")
    return " and ".join(tests)


def _decisions_sql(profiles: list[str]) -> str:
    rules = " union all ".join(f"select scan_id, '{p}' as profile, {i} as place, '{r.id}' as rule, {r.priority} as priority, '{r.action}' as action, ord, finding_id, reason_code from find where {_rule_sql(r.when)}" for p in profiles for i, r in enumerate(policy.POLICIES[p].rules))
    defaults = ", ".join(f"('{p}', '{policy.POLICIES[p].default}')" for p in profiles)
    return f"""hits as ({rules}), per_rule as (select scan_id, profile, place, rule, priority, action, arg_min(finding_id, ord) as finding_id, arg_min(reason_code, ord) as reason_code from hits group by all),
        won as (select scan_id, profile, arg_min(action, place) as action, arg_min(rule, place) as rule, arg_min(priority, place) as priority, arg_min(finding_id, place) as finding_id, string_agg(rule, '|' order by place) as triggered, array_to_string(list_sort(list_distinct(list(reason_code))), '|') as reasons from per_rule group by 1, 2),
        decided as (select scan_id, profile, coalesce(won.action, d.action) as action, coalesce(reasons, 'POLICY_DEFAULT_ACTION') as reason_codes, coalesce(triggered, 'policy-default-action') as triggered_policy_rules, coalesce(rule, 'policy-default-action') as winning_rule_id, coalesce(priority, -1) as winning_rule_priority,
            case when rule is null then 'The profile declares this action as its default.' else 'Rule ' || rule || ' matched finding ' || finding_id || '.' end as explanation
            from scans cross join (values {defaults}) as d(profile, action) left join won using (scan_id, profile))"""


def _flat(d: DataFrame) -> DataFrame:
    return d.select("scan_id", "profile", "action", F.array_join("reason_codes", "|").alias("reason_codes"), F.array_join("triggered_policy_rules", "|").alias("triggered_policy_rules"), "winning_rule_id", "winning_rule_priority", "explanation")


def _policy_query(profile: str):
    def run(spark, sf_dir):
        return _flat(policy.decide(scans(spark, sf_dir), event_findings(spark, sf_dir), [profile]))

    run.__name__ = f"policy_decision_{profile.lower()}"
    return query(f"with {FINDINGS_SQL}, {_decisions_sql([profile])} select * from decided")(run)


for _profile in PROFILES:
    _policy_query(_profile)

_ORPHANS_SQL = "lost as (select scan_id, detector_id, ord from exec where status = 'DETECTED' and not exists (select 1 from find f where f.scan_id = exec.scan_id and f.detector_id = exec.detector_id))"


@query(f"with {EXECUTIONS_SQL}, {FINDINGS_SQL}, {_ORPHANS_SQL} select * from lost")
def detected_without_finding(spark, sf_dir):
    return policy.detected_without_finding(executions(spark, sf_dir), event_findings(spark, sf_dir))


def _coverage_sql() -> str:
    strict = [p for p in policy.STRICT if p != "VLM_READ_ONLY"]
    need = ", ".join(f"('{p}', {i}, '{r[0]}')" for p in strict for i, r in enumerate(policy.REGISTRY) if r[3] or p in r[4])
    names = ", ".join(f"('{p}')" for p in strict)
    good = "x.status in ('SUCCESS', 'NO_EVIDENCE', 'DETECTED') and x.state in ('CONFIRMED', 'NO_EVIDENCE_FOUND')"
    return f"""{_ORPHANS_SQL}, x as (select scan_id, detector_id, arg_max(status, ord) as status, arg_max(state, ord) as state from exec group by 1, 2), need as (select * from (values {need}) as t(profile, n, detector_id)),
        gap as (select scan_id, profile, 0 as a, n as b, need.detector_id || case when x.status is null then ':missing' else ':' || x.status || '/' || x.state end as t from scans cross join need left join x using (scan_id, detector_id) where x.status is null or not ({good})
                union all select scan_id, profile, 2, ord, detector_id || ':DETECTED_WITHOUT_FINDING' from lost cross join (values {names}) as s(profile)),
        gaps as (select scan_id, profile, string_agg(t, '; ' order by a, b, t) as failures from gap group by 1, 2),
        losses as (select scan_id, string_agg(detector_id || ':DETECTED_WITHOUT_FINDING', '; ' order by ord) as lost from lost group by 1)"""


@query(f"with {EXECUTIONS_SQL}, {FINDINGS_SQL}, {_coverage_sql()} select * from gaps")
def coverage_gate(spark, sf_dir):
    d = policy.coverage_failures(scans(spark, sf_dir), executions(spark, sf_dir), event_findings(spark, sf_dir))
    return d.select("scan_id", "profile", F.array_join("failures", "; ").alias("failures"))


_FINAL = f"""{_decisions_sql(PROFILES)}, {_coverage_sql()}, final as (select scan_id, profile,
    case when profile = 'VLM_READ_ONLY' then 'UNSUPPORTED' when failures is not null then 'UNSUPPORTED' when lost is not null then 'BLOCK' else action end as action,
    case when profile = 'VLM_READ_ONLY' then 25000 when failures is not null then 20000 when lost is not null then 19000 else winning_rule_priority end as winning_rule_priority
    from decided left join gaps using (scan_id, profile) left join losses using (scan_id))"""


def final_decisions(spark, sf_dir) -> DataFrame:
    found = event_findings(spark, sf_dir)
    return policy.override(policy.decide(scans(spark, sf_dir), found), executions(spark, sf_dir), found)


@query(f"with {EXECUTIONS_SQL}, {FINDINGS_SQL}, {_FINAL} select * from final")
def final_decision(spark, sf_dir):
    return final_decisions(spark, sf_dir).select("scan_id", "profile", "action", "winning_rule_priority")


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as artifacts of their user's scan."""
    n = F.col("event_id")
    flags = F.create_map(F.lit("lossy"), F.lit("true"), F.lit("flattened"), F.lit("true"), F.lit("metadata_stripped"), F.when(n % 3 == 0, "false").otherwise("true"), F.lit("redacted"), F.lit("true"))
    return table(spark, sf_dir, "events").where("user_id is not null").select(
        F.concat(F.lit("u"), "user_id").alias("scan_id"), F.format_string("artifact:%d", n).alias("artifact_id"), _pick(["original", "canonical_lossy", "redacted", "frame-0", "red-channel"], n % 5).alias("role"), F.lit("image/jpeg").alias("media_type"), flags.alias("parameters"),
        (n % 2 == 0).alias("release_eligible"), F.col("ts").alias("created_at"), F.when(n % 5 != 0, F.format_string("artifact:%d", n - n % 5)).alias("derived_from"), F.format_string("ref:%d", n % 997).alias("storage_reference"), F.round(F.coalesce("value", F.lit(0.0))).cast("long").alias("size_bytes"), F.col("event_type").alias("area"), n.alias("ord"),
    )


ARTIFACTS_SQL = f"art as (select 'u' || user_id as scan_id, 'artifact:' || event_id as artifact_id, {_sql_pick(['original', 'canonical_lossy', 'redacted', 'frame-0', 'red-channel'], 'event_id % 5')} as role, event_id % 3 <> 0 as stripped, event_id % 2 = 0 as release_eligible, ts as created_at, case when event_id % 5 <> 0 then 'artifact:' || (event_id - event_id % 5) end as derived_from, 'ref:' || (event_id % 997) as storage_reference, cast(round(coalesce(value, 0.0)) as bigint) as size_bytes, event_type as area, event_id as ord from events where user_id is not null)"
_GRANTS_SQL = "grants as (select scan_id, profile, 'grant:' || split_part(artifact_id, ':', 2) as grant_id, artifact_id, action, role from final join art using (scan_id) where stripped and ((action = 'ALLOW_RECONSTRUCTED_ONLY' and role = 'canonical_lossy') or (action = 'ALLOW_WITH_REDACTION' and role = 'redacted')))"


@query(f"with {EXECUTIONS_SQL}, {FINDINGS_SQL}, {_FINAL}, {ARTIFACTS_SQL}, {_GRANTS_SQL} select * from grants")
def release_grants(spark, sf_dir):
    return policy.release_grants(final_decisions(spark, sf_dir), artifacts(spark, sf_dir))


@query(f"with {EXECUTIONS_SQL}, {FINDINGS_SQL}, {_FINAL}, {ARTIFACTS_SQL}, {_GRANTS_SQL} select scan_id, artifact_id, role from art where release_eligible and role in ('canonical_lossy', 'redacted') and artifact_id in (select artifact_id from grants)")
def released_artifacts(spark, sf_dir):
    a = artifacts(spark, sf_dir)
    return policy.released(a, policy.release_grants(final_decisions(spark, sf_dir), a)).select("scan_id", "artifact_id", "role")


_KIND = "case role when 'original' then 'original_container' when 'canonical_lossy' then 'release_candidate' when 'frame-0' then 'animation_frame' when 'red-channel' then 'channel_view' else 'derived_view' end"


@query(f"with {ARTIFACTS_SQL} select {_KIND} as kind, count(*) as n from art group by 1")
def representation_kinds(spark, sf_dir):
    return artifacts(spark, sf_dir).groupBy(evidence.representation_kind(F.col("role")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"with {ARTIFACTS_SQL} select scan_id, count(*) filter (where area = 'purchase') = 0 as coverage_complete, coalesce(string_agg('repr:' || role, '|' order by 'repr:' || role) filter (where area = 'purchase'), '') as missing_required, count(*) as n_entries from art group by 1")
def representation_manifest(spark, sf_dir):
    a = artifacts(spark, sf_dir)
    return evidence.manifest(a, a.where("area <> 'purchase'")).withColumn("missing_required", F.array_join("missing_required", "|"))


# ---------------------------------------------------------------- graph
def _graph(spark, sf_dir):
    return artifacts(spark, sf_dir), observations(spark, sf_dir), D.phishing(observations(spark, sf_dir))


_PHISHED = f"phished as (select scan_id, ord, printf('observation:%s:%06d', scan_id, ord) as obs, printf('finding:%s:phishing:%03d', scan_id, row_number() over (partition by scan_id order by ord) - 1) as finding from (select scan_id, ord, {_INDICATORS} as i from obs) where len(i) > 0)"


@query(f"{_with}, {ARTIFACTS_SQL}, {_PHISHED} select scan_id, artifact_id as id, 'Artifact' as kind from art union all select scan_id, printf('observation:%s:%06d', scan_id, ord), 'Observation' from obs union all select scan_id, finding, 'Finding' from phished")
def evidence_graph_nodes(spark, sf_dir):
    return evidence.graph_nodes(*_graph(spark, sf_dir))


@query(
    f"{_with}, {ARTIFACTS_SQL}, {_PHISHED} select scan_id, derived_from as source, artifact_id as target, 'derived_from' as kind from art where derived_from is not null union all select scan_id, 'artifact:' || scan_id, printf('observation:%s:%06d', scan_id, ord), 'observed_in' from obs "
    "union all select scan_id, obs, finding, 'supports' from phished union all select scan_id, 'artifact:' || scan_id, finding, 'supports' from phished"
)
def evidence_graph_edges(spark, sf_dir):
    return evidence.graph_edges(*_graph(spark, sf_dir))


@query(f"with {FINDINGS_SQL} select scan_id, case when position('-' in split_part(detector_id, ':', 2)) > 0 then split_part(split_part(detector_id, ':', 2), '-', 1) else split_part(detector_id, ':', 2) end as family, string_agg(finding_id, '|' order by ord) as finding_ids from find group by 1, 2")
def evidence_families(spark, sf_dir):
    return evidence.families(event_findings(spark, sf_dir)).withColumn("finding_ids", F.array_join("finding_ids", "|"))


# ---------------------------------------------------------------- budgets, lifecycle
@query(f"{_with} select scan_id, ord, cast(sum(strlen(t)) over (partition by scan_id order by ord rows unbounded preceding) as bigint) as running_total, sum(strlen(t)) over (partition by scan_id order by ord rows unbounded preceding) > 1500 as over_budget from obs")
def text_budget_running_sum(spark, sf_dir):
    d = lifecycle.running_budget(observations(spark, sf_dir), "scan_id", ["ord"], F.octet_length("normalized_text"), 1500)
    return d.select("scan_id", "ord", "running_total", "over_budget")


_NOW_SQL = "timestamp '2024-01-20 00:00:00'"


def _now() -> Column:
    return F.lit("2024-01-20 00:00:00").cast("timestamp")




@query(f"with {ARTIFACTS_SQL} select artifact_id from art where created_at <= {_NOW_SQL} - interval 7 day")
def retention_expired(spark, sf_dir):
    return lifecycle.expired(artifacts(spark, sf_dir), "created_at", _now(), lifecycle.RETENTION["artifacts"]).select("artifact_id")


@query(f"with {ARTIFACTS_SQL}, gone as (select distinct scan_id from art where created_at <= {_NOW_SQL} - interval 7 day and area = 'purchase') select scan_id, artifact_id from art where scan_id not in (select scan_id from gone)")
def delete_scan_cascade(spark, sf_dir):
    """Purchases stand for the reports whose age decides."""
    a = artifacts(spark, sf_dir)
    return lifecycle.expire_reports({"reports": a.where("area = 'purchase'"), "artifacts": a}, _now())["artifacts"].select("scan_id", "artifact_id")


@query(f"with {ARTIFACTS_SQL}, held as (select distinct artifact_id from art where area <> 'view' and created_at > {_NOW_SQL} - interval 1 hour) select artifact_id, release_eligible and h.artifact_id is not null as release_eligible from art left join held h using (artifact_id)")
def revoke_expired_grants(spark, sf_dir):
    """Every event but a view stands for a grant of its artifact."""
    a = artifacts(spark, sf_dir)
    grants = a.where("area <> 'view'").select("artifact_id", "created_at")
    return lifecycle.revoke_expired_grants(a, grants, _now())[0].select("artifact_id", "release_eligible")


@query(f"with {ARTIFACTS_SQL} select storage_reference, artifact_id, created_at from (select *, row_number() over (partition by storage_reference order by created_at desc, ord desc) as k from art) where k = 1")
def latest_grant_per_artifact(spark, sf_dir):
    return policy.latest_by(artifacts(spark, sf_dir), "storage_reference", "created_at", "ord").select("storage_reference", "artifact_id", "created_at")


_AREAS = ["click", "view", "purchase"]


@query(f"with {ARTIFACTS_SQL} select " + ", ".join(f"coalesce(cast(sum(size_bytes) filter (where area = '{a}') as bigint), 0) as {a}_bytes" for a in _AREAS) + ", cast(sum(size_bytes) as bigint) as total_bytes, greatest(10000000 - cast(sum(size_bytes) as bigint), 0) as remaining_bytes, sum(size_bytes) > 10000000 as over_quota from art")
def storage_usage_by_area(spark, sf_dir):
    return lifecycle.usage(artifacts(spark, sf_dir), _AREAS, 10_000_000)


@query(f"with {ARTIFACTS_SQL} select storage_reference, size_bytes from art where created_at <= {_NOW_SQL} - interval 300 second and storage_reference not in (select storage_reference from art where area = 'purchase')")
def orphan_files(spark, sf_dir):
    a = artifacts(spark, sf_dir)
    found = a.select("storage_reference", "size_bytes", F.col("created_at").alias("modified_at"))
    return lifecycle.orphans(found, a.where("area = 'purchase'"), _now()).select("storage_reference", "size_bytes")


@query(f"with {ARTIFACTS_SQL}, r as (select storage_reference, size_bytes, ord, 0 as fresh from art where area = 'view' union all select storage_reference, size_bytes + 1, ord, 1 from art where area <> 'view') select storage_reference, size_bytes from (select *, row_number() over (partition by storage_reference order by fresh desc, ord desc) as k from r) where k = 1")
def upsert_last_write(spark, sf_dir):
    a = artifacts(spark, sf_dir).select("storage_reference", "size_bytes", "ord", "area")
    return lifecycle.upsert(a.where("area = 'view'").drop("area"), a.where("area <> 'view'").drop("area").withColumn("size_bytes", F.col("size_bytes") + 1), ["storage_reference"], "ord").select("storage_reference", "size_bytes")


@query("select sha256(text) as sha256, any_value(strlen(text)) as size_bytes, sha256(text)[1:2] || '/' || sha256(text)[3:4] || '/' || sha256(text) as storage_reference from documents where text is not null group by sha256(text)")
def content_addressed_store(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.col("text").cast("binary").alias("content"))
    return lifecycle.content_addressed(d).select("sha256", "size_bytes", "storage_reference")


# ---------------------------------------------------------------- evaluation
@query(
    """select event_type, count(*) as n, round(avg(value), 6) as mean, min(value) as min, max(value) as max, list_sort(list(value))[least(cast(floor(count(*) * 50 / 100) as bigint), count(*) - 1) + 1] as median,
    list_sort(list(value))[least(cast(floor(count(*) * 95 / 100) as bigint), count(*) - 1) + 1] as p95 from events where value is not null group by 1"""
)
def runtime_percentiles_index(spark, sf_dir):
    return evaluation.runtime_stats(table(spark, sf_dir, "events"), "value", ["event_type"])


def labelled_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as expectations; actions by what the privacy detector says of the document."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    obs = D.observe(docs, F.concat(F.lit("d"), "doc_id"), F.lit(0), F.col("text"))
    decided = policy.decide(docs.select(F.concat(F.lit("d"), "doc_id").alias("scan_id")).distinct(), D.privacy(obs), ["OCR_EXTRACTION"]).select("scan_id", "action")
    lab = table(spark, sf_dir, "labels").where("quality is not null and toxic is not null")
    names = F.array(F.when(F.col("quality") == 1, "good").otherwise("poor"), F.when(F.col("toxic") == 1, "toxic").otherwise("clean"))
    d = lab.select(F.concat(F.lit("d"), "doc_id").alias("scan_id"), names.alias("labels"), (F.col("toxic") == 1).alias("must_not_release")).join(decided, "scan_id")
    return d.select("*", F.array(F.lit("QUARANTINE")).alias("forbidden_actions"), F.lit(0).alias("grant_count"), F.lit(0).alias("unknown_gaps"))


_RESULTS_SQL = f"{_PRIVACY}, res as (select 'd' || l.doc_id as scan_id, [case when quality = 1 then 'good' else 'poor' end, case when toxic = 1 then 'toxic' else 'clean' end] as labels, toxic = 1 as must_not_release, case when exists (select 1 from found where found.scan_id = 'd' || l.doc_id) then 'REVIEW' else 'ALLOW_RECONSTRUCTED_ONLY' end as action from labels l join (select distinct doc_id from documents where text is not null) d on d.doc_id = l.doc_id where quality is not null and toxic is not null)"


@query(
    f"""{_RESULTS_SQL} select label, count(*) as n, count(*) filter (where action in ('BLOCK', 'QUARANTINE')) as blocked, count(*) filter (where action = 'REVIEW') as reviewed, count(*) filter (where action like 'ALLOW%') as allowed, count(*) filter (where action = 'UNSUPPORTED') as unsupported,
    round(count(*) filter (where action in ('BLOCK', 'QUARANTINE', 'REVIEW')) / count(*), 4) as detection_rate from (select unnest(labels) as label, action from res) group by 1"""
)
def detection_metrics_by_label(spark, sf_dir):
    return evaluation.label_metrics(labelled_results(spark, sf_dir))


@query(f"{_RESULTS_SQL} select count(*) as n, count(*) filter (where must_not_release and action like 'ALLOW%') as violations, cast(0 as bigint) as unknown_gaps, case when count(*) filter (where must_not_release and action like 'ALLOW%') = 0 then 'PASS' else 'FAIL' end as verdict from res")
def acceptance_gate(spark, sf_dir):
    return evaluation.gate(labelled_results(spark, sf_dir))


@query(
    """with a as (select cast(ts as date) as day, user_id, arg_max(event_type, (ts, event_type)) as c from events where user_id is not null group by 1, 2)
    select strftime(day, '%Y-%m-%d') as day, count(*) filter (where c = 'click') as click, count(*) filter (where c = 'view') as view, count(*) filter (where c = 'purchase') as purchase, count(*) as unique_attendees, case when count(*) filter (where c = 'purchase') > 0 then 'yes' else 'no' end as has_external from a group by 1"""
)
def attendance_pivot(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("user_id is not null").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return evaluation.attendance(e, "day", "user_id", "event_type", "ts", _AREAS, ["purchase"])


# ---------------------------------------------------------------- bytes
_HEADS = ["89504e470d0a1a0a", "ffd8ff", "474946383961", "52494646000000005745425056", "49492a00", "424d", "255044462d", "3c73766720", "252150532d", "00"]
_NAMES = ["PNG", "JPEG", "GIF", "WEBP", "TIFF", "BMP", "PDF", "SVG", "POSTSCRIPT", "UNKNOWN"]


def _blobs(spark, sf_dir, ends: dict[str, str] | None = None) -> DataFrame:
    """Documents behind the heads of all formats (and their ends, where given), as stand-ins for files."""
    d = D.spread(table(spark, sf_dir, "documents").where("text is not null"))
    head = F.element_at(F.array(*(F.lit(h + (ends or {}).get(n, "")) for h, n in zip(_HEADS, _NAMES))), (F.col("doc_id") % 10 + 1).cast("int"))
    return d.select("doc_id", F.concat(F.unhex(head), F.col("text").cast("binary")).alias("content"))


@query(f"select doc_id, {_sql_pick(_NAMES, 'doc_id % 10')} as format, doc_id % 10 < 6 as allowed from documents where text is not null")
def magic_bytes(spark, sf_dir):
    fmt = files.format_of(F.col("content"))
    return _blobs(spark, sf_dir).select("doc_id", fmt.alias("format"), files.allowed(fmt).alias("allowed"))


_TAILS = {"PNG": "0000000049454E44AE426082", "JPEG": "FFD9", "GIF": "3B"}


@query("select doc_id, case doc_id % 10 when 0 then strlen(text) when 1 then strlen(text) when 2 then strlen(split_part(';' || text, ';', -1)) end as trailing from documents where text is not null")
def trailing_bytes(spark, sf_dir):
    """Each document behind the head and the end of its format; a text's own semicolon ends a GIF once more."""
    blobs = _blobs(spark, sf_dir, _TAILS)
    return blobs.select("doc_id", files.trailing_bytes(F.col("content"), files.format_of(F.col("content"))).alias("trailing"))


@query("select doc_id, case when doc_id % 3 = 0 then 'test_string' when doc_id % 3 = 1 then 'embedded_script' else '' end as rules from documents where text is not null")
def byte_signatures(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    kind = F.col("doc_id") % 3
    content = F.concat(F.unhex(F.when(kind == 1, "FFD8").otherwise("00")), F.when(kind == 0, "x eicar-standard-antivirus-TEST-FILE").when(kind == 1, "<SCRIPT >").otherwise("").cast("binary"), F.col("text").cast("binary"))
    return d.select("doc_id", F.array_join(files.signatures(content), "|").alias("rules"))


@query(
    f"with b as (select doc_id, {_sql_pick(_HEADS, 'doc_id % 10')} || lower(hex(encode(text))) as h from documents where text is not null), c as (select doc_id, len(h) // 2 as n, unnest(list_transform(range(len(h) // 2), lambda i: h[2 * i + 1 : 2 * i + 2])) as x from b), "
    "k as (select doc_id, any_value(n) as n, x, count(*) as m from c group by doc_id, x) select doc_id, round(-sum(m / n * log2(m / n)), 6) + 0.0 as bits from k group by doc_id"
)
def byte_entropy(spark, sf_dir):
    return _blobs(spark, sf_dir).select("doc_id", F.round(files.byte_entropy("content"), 6).alias("bits"))
