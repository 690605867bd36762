"""Validation gates as predicates over relations; every gate gives findings of one shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
DRIFT_MS = 2000
COVERAGE_BLOCK, COVERAGE_WARN = 0.70, 0.90
LOUDNESS, PEAK = (-16.5, -15.5), (-2.0, -1.0)
DEGRADED = "均分|模糊匹配|无处安放|不足以|超出预留区"


def judge(rows: DataFrame, keys: list[str], rules: list[tuple[str, str, Column]]) -> DataFrame:
    """keys, ``code``, ``severity``: one row per rule (code, severity, condition) that a row breaks; null conditions are not broken."""
    said = [F.when(c, F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"))) for code, sev, c in rules]
    return rows.select(*keys, F.explode(F.filter(F.array(*said), lambda f: f.isNotNull())).alias("f")).select(*keys, "f.code", "f.severity")


def missing(expected: DataFrame, present: DataFrame, keys: list[str], code: str, severity: str = "blocking") -> DataFrame:
    """Findings for what is expected and not there; null keys never match."""
    return expected.select(*keys).distinct().join(present.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit(code).alias("code"), F.lit(severity).alias("severity"))


def union(*findings: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, findings)


def summary(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: blocking and warning findings, and whether it passes."""
    return findings.groupBy(*keys).agg(F.count_if(F.col("severity") == "blocking").alias("n_blocking"), F.count_if(F.col("severity") == "warning").alias("n_warning")).withColumn("passed", F.col("n_blocking") == 0)


def first_offenders(rows: DataFrame, keys: list[str], order: list[str], shown: str, n: int = 3) -> DataFrame:
    """Per key: how many offend and the first ``n`` of them in order, joined by commas.

    The ranking keeps ``n`` rows before anything is gathered.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = rows.withColumn("_i", F.row_number().over(w))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n_offenders"))
    heads = ranked.where(F.col("_i") <= n).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", F.col(shown).cast("string").alias("s")))), lambda x: x["s"]), ",").alias("first"))
    return counts.join(heads, keys)


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand more than once, with the number of extra rows."""
    return rows.groupBy(*keys).agg((F.count("*") - 1).alias("n_extra")).where("n_extra > 0")


def word_table(units: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, ``code``, ``severity``, ``n``: bad numbers, negative lengths, disorder and sentence granularity of word timelines."""
    w = Window.partitionBy(*keys).orderBy(*order)
    valid = F.col("end_ms") >= F.col("start_ms")
    before = F.last(F.when(valid, F.col("start_ms")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = units.withColumn("_before", before)
    found = judge(rows, keys, [
        ("bad_number", "blocking", F.col("start_ms").isNull() | F.col("end_ms").isNull()),
        ("negative_duration", "blocking", F.col("end_ms") < F.col("start_ms")),
        ("out_of_order", "blocking", valid & (F.col("start_ms") < F.col("_before"))),
        ("sentence_granularity", "warning", F.lower(F.trim("granularity")) == "sentence"),
    ])
    return found.groupBy(*keys, "code", "severity").agg(F.count("*").alias("n"))


def media(info: DataFrame, keys: list[str]) -> DataFrame:
    """Findings over one row per deliverable with durations (``final_ms``, ``narration_ms``), streams, codecs, atoms, loudness, peak and silences."""
    moov, mdat = F.array_position("atoms", "moov"), F.array_position("atoms", "mdat")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    return judge(info, keys, [
        ("no_duration", "blocking", F.col("final_ms").isNull() | (F.col("final_ms") <= 0)),
        ("no_video", "blocking", no("has_video")), ("no_audio", "blocking", no("has_audio") & (F.col("narration_ms") > 0)),
        ("duration_drift", "warning", F.abs(F.col("final_ms") - F.col("narration_ms")) > DRIFT_MS),
        ("codec", "blocking", ~F.col("codecs").contains("h264")), ("pixel_format", "blocking", ~F.col("codecs").contains("yuv420p")),
        ("sample_rate", "blocking", ~F.col("codecs").contains("44100")),
        ("faststart", "blocking", ~F.coalesce((moov > 0) & (mdat > 0) & (moov < mdat), F.lit(False))), ("silence", "blocking", F.col("n_silences") > 0),
        ("loudness", "blocking", ~F.col("lufs").between(*LOUDNESS)), ("peak", "blocking", ~F.col("peak_db").between(*PEAK)),
    ])


def degraded(annotations: DataFrame, keys: list[str]) -> DataFrame:
    """Findings over annotations with ``schedule``, ``matched`` (k/n) and ``warnings`` (array)."""
    k, n = F.split("matched", "/")[0].try_cast("int"), F.split("matched", "/")[1].try_cast("int")
    return judge(annotations, keys, [
        ("schedule_not_words", "blocking", ~F.col("schedule").eqNullSafe("words")), ("unmatched", "blocking", k != n),
        ("degraded", "blocking", F.exists("warnings", lambda w: w.rlike(DEGRADED))),
    ])


def coverage(rows: DataFrame, keys: list[str], ratio: str) -> DataFrame:
    return judge(rows, keys, [("coverage_block", "blocking", F.col(ratio) < COVERAGE_BLOCK), ("coverage_warn", "warning", (F.col(ratio) >= COVERAGE_BLOCK) & (F.col(ratio) < COVERAGE_WARN))])


def contract(required: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Palette values (``colours``, a map) that a theme's text does not name, upper and lower case alike."""
    values = required.select(key, F.explode(F.map_values("colours")).alias("value"))
    return values.join(texts.select(key, F.upper("text").alias("_t")), key, "left").where(~F.coalesce(F.contains(F.col("_t"), F.upper("value")), F.lit(False))).select(key, "value")


def merged(layers: DataFrame, key: str, priority: str, settings: str) -> DataFrame:
    """(key, name, value): of each setting the value of the first layer that has one, by ``priority``; nulls and empty texts are no value."""
    rows = layers.select(key, priority, F.explode(settings).alias("name", "value")).where("value is not null and value <> ''")
    return rows.groupBy(key, "name").agg(F.min_by("value", priority).alias("value"))
