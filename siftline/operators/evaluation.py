"""Evaluation of decisions against labels, runtimes, gates, and the attendance report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


CUTS = 100


def runtime_stats(d: DataFrame, value: str, by: list[str], percents: tuple[int, int] = (50, 95)) -> DataFrame:
    """n, mean, least, greatest, median and 95th index percentile (the element at floor(n * p / 100), the last at most) for each group.

    Exact, without a group's values in one place: approximate quantiles part each group into ranges, the
    ranges are counted, and only the range that holds a wanted place is sorted.
    """
    rows = d.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("v"))
    base = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.percentile_approx("v", F.array(*(F.lit(i / CUTS) for i in range(1, CUTS))), 10 * CUTS).alias("cuts"))
    names = [f"__b{i}" for i in range(len(by))]
    same = lambda left, right: reduce(lambda a, b: a & b, (left[n].eqNullSafe(right[c]) for n, c in zip(names, by)), F.lit(True))
    marked = rows.select(*(F.col(c).alias(n) for c, n in zip(by, names)), "v")
    marked = marked.join(base.select(*by, "cuts"), same(marked, base)).select(*by, "v", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("range"))
    upto = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = marked.groupBy(*by, "range").agg(F.count("*").alias("own")).withColumn("upto", F.sum("own").over(upto)).withColumn("n", F.sum("own").over(Window.partitionBy(*by)))
    place = F.least(F.floor(F.col("n") * F.col("percent") / 100).cast("long"), F.col("n") - 1)
    wanted = counts.withColumn("percent", F.explode(F.array(*map(F.lit, percents)))).withColumn("place", place).where("place < upto and place >= upto - own")
    wanted = wanted.select(*(F.col(c).alias(n) for c, n in zip(by, names)), F.col("range").alias("__r"), "percent", (F.col("place") - F.col("upto") + F.col("own") + 1).alias("nth"))
    near = marked.join(wanted, same(wanted, marked) & (marked["range"] == wanted["__r"])).withColumn("k", F.row_number().over(Window.partitionBy(*by, "percent").orderBy("v"))).where("k = nth")
    picked = near.groupBy(*by).agg(*(F.max(F.when(F.col("percent") == p, F.col("v"))).alias(f"p{p}") for p in percents)).select(*(F.col(c).alias(n) for c, n in zip(by, names)), *(f"p{p}" for p in percents))
    out = base.join(picked, same(picked, base))
    return out.select(*by, F.col("n").cast("long").alias("n"), F.round("mean", 6).alias("mean"), "min", "max", F.col(f"p{percents[0]}").alias("median"), F.col(f"p{percents[1]}"))


def rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(part, whole), 4), F.lit(0.0))


def label_metrics(results: DataFrame) -> DataFrame:
    """Per label: how many results were blocked, reviewed, allowed or unsupported. ``results`` has labels array<string> and action."""
    d = results.withColumn("label", F.explode("labels"))
    count = lambda test: F.count_if(test).cast("long")
    a = F.col("action")
    return d.groupBy("label").agg(F.count("*").alias("n"), count(a.isin("BLOCK", "QUARANTINE")).alias("blocked"), count(a == "REVIEW").alias("reviewed"), count(a.startswith("ALLOW")).alias("allowed"), count(a == "UNSUPPORTED").alias("unsupported")).withColumn("detection_rate", rate(F.col("blocked") + F.col("reviewed"), F.col("n")))


BLOCKING = ("BLOCK", "QUARANTINE", "REVIEW", "UNSUPPORTED", "ERROR")
RELEASABLE = ("canonical_lossy", "redacted")
CANARIES = ("SIFTLINE-CANARY-7F91",)


def safety_violations(results: DataFrame, canaries: tuple[str, ...] = CANARIES) -> Column:
    """The invariants of release that a result breaks.

    ``results`` has action, profile, labels, grants (array of struct(artifact_id, role)), detected and found (the
    detectors that detected something, and those of which there are findings), summary and explanation.
    """
    n = F.coalesce(F.size("grants"), F.lit(0))
    blocked = F.col("action").isin(*BLOCKING)
    each = lambda test, text: F.transform(F.filter(F.coalesce("grants", F.array().cast("array<struct<artifact_id: string, role: string>>")), test), text)
    whole = lambda test, text: F.when(F.coalesce(test, F.lit(False)), F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.concat(
        whole(blocked & (n > 0), F.concat("action", F.lit(" has "), n, F.lit(" grant(s)"))),
        each(lambda g: (g["role"] == "original") | F.contains(g["artifact_id"], F.lit("original")), lambda g: F.concat(F.lit("original has a grant: "), g["artifact_id"])),
        each(lambda g: ~g["role"].isin(*RELEASABLE), lambda g: F.concat(F.lit("analysis-only role has a grant: "), g["role"])),
        F.transform(F.array_except(F.coalesce("detected", F.array().cast("array<string>")), F.coalesce("found", F.array().cast("array<string>"))), lambda d: F.concat(F.lit("detected without finding: "), d)),
        whole(F.array_contains("labels", "malware_canary") & (n > 0), F.lit("malware canary released")),
        whole((F.col("profile") == "VLM_READ_ONLY") & ((F.col("action") != "UNSUPPORTED") | (n > 0)), F.lit("read-only profile isn't unsupported")),
        *(whole(F.contains(F.col(f), F.lit(c)), F.lit(f"canary in {f}")) for c in canaries for f in ("summary", "explanation")),
    )


def detection_gaps(results: DataFrame) -> Column:
    """What a result falls short of: a forbidden action, a grant that must not be, more critical findings than expected (``critical``: how many there are)."""
    n = F.coalesce(F.size("grants"), F.lit(0))
    return F.array_compact(F.array(
        F.when(F.array_contains("forbidden_actions", F.col("action")), F.concat(F.lit("forbidden action "), "action")),
        F.when(F.col("must_not_release") & (n > 0), F.concat(n, F.lit(" grant(s) though nothing may be released"))),
        F.when(F.col("critical") > F.col("maximum_critical_findings"), F.concat("critical", F.lit(" critical findings, at most "), "maximum_critical_findings", F.lit(" expected"))),
    ))


def first_violations(results: DataFrame, id_col: str, most: int = 200) -> DataFrame:
    """(id, violation): the first ``most`` by id and text, as a report lists them."""
    return results.select(id_col, F.explode("violations").alias("violation")).orderBy(id_col, "violation").limit(most)


def violations(results: DataFrame) -> Column:
    """The invariants in short: forbidden action, release that must not be, a grant with a non-releasing action."""
    releases = F.col("action").startswith("ALLOW")
    return F.array_compact(F.array(
        F.when(F.array_contains("forbidden_actions", F.col("action")), F.concat(F.lit("forbidden action "), "action")),
        F.when(F.col("must_not_release") & releases, "released what must not be"),
        F.when(~releases & (F.col("grant_count") > 0), "grant without release"),
    ))


def gate(results: DataFrame) -> DataFrame:
    """One row: counts of results, violations and unexplained gaps, and PASS only without either."""
    d = results.withColumn("v", violations(results))
    got = d.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).cast("long").alias("violations"), F.coalesce(F.sum("unknown_gaps"), F.lit(0)).cast("long").alias("unknown_gaps"))
    return got.withColumn("verdict", F.when((F.col("violations") == 0) & (F.col("unknown_gaps") == 0), "PASS").otherwise("FAIL"))


def missing_labels(manifest: DataFrame, wanted: list[str]) -> DataFrame:
    """One row: which of the wanted labels no record has."""
    have = manifest.agg(F.array_distinct(F.flatten(F.collect_set("labels"))).alias("have"))
    return have.select(F.array_sort(F.array_except(F.array(*map(F.lit, wanted)), "have")).alias("missing"))


def scan_matrix(manifest: DataFrame, matrix: dict[str, list[tuple[str, str]]], default: str = "default") -> DataFrame:
    """(id, mode, profile): the distinct pairs of a record's labels, the default's where none of its labels has any."""
    rows = [(label, m, p) for label, pairs in matrix.items() for m, p in pairs]
    table = F.broadcast(manifest.sparkSession.createDataFrame(rows, "label string, mode string, profile string"))
    named = manifest.select("id", F.explode("labels").alias("label")).join(table, "label").select("id", "mode", "profile")
    rest = manifest.select("id").join(named.select("id").distinct(), "id", "left_anti").crossJoin(table.where(F.col("label") == default).select("mode", "profile"))
    return named.unionByName(rest).distinct()


def attendance(d: DataFrame, meeting: str, attendee: str, category: str, order: str, categories: list[str], external: list[str]) -> DataFrame:
    """Per meeting: attendees by their last category, all of them, and whether any is external."""
    last = d.groupBy(meeting, attendee).agg(F.max_by(category, F.struct(order, category)).alias("c"))
    got = last.groupBy(meeting).agg(*(F.count_if(F.col("c") == c).cast("long").alias(c) for c in categories), F.count("*").alias("unique_attendees"))
    return got.withColumn("has_external", F.when(sum((F.col(c) for c in external), F.lit(0)) > 0, "yes").otherwise("no"))


def with_directory(attendees: DataFrame, directory: DataFrame, key: str, category: str, unknown: str = "anonymous") -> DataFrame:
    """Attendees with their ``category`` of the directory (key, category); ``unknown`` for those that aren't in it.

    Of repeated keys the least category counts. The directory grows with the users, so how it is joined is left to adaptive execution.
    """
    one = directory.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(category).alias(category))
    return attendees.join(one, key, "left").withColumn(category, F.coalesce(category, F.lit(unknown)))
