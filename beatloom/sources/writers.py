"""Writers: subtitles, word tables, annotations, fingerprints, prompts, reports.

Texts are assembled in the JVM, one row per file, and written partitioned by
their key; writing again replaces what is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

LEAST_SHOWN = 400  # fixed value, milliseconds
# Header of a subtitle file.
ASS_HEADER = "[Script Info]\nScriptType: v4.00+\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"


def _joined(df: DataFrame, key: str, order: list[str], line: Column, between: str) -> DataFrame:
    return df.select(key, *order, line.alias("_l")).groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "_l"))), lambda x: x["_l"]), between).alias("text"))


def srt(cues: DataFrame, key: str) -> DataFrame:
    """(key, text): numbered cues of ``start_ms``, ``end_ms``, ``text`` by start."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("start_ms", "end_ms", "text"))
    line = F.concat_ws("\n", F.col("_n").cast("string"), F.concat(T.ms_to_srt(F.col("start_ms")), F.lit(" --> "), T.ms_to_srt(F.col("end_ms"))), "text", F.lit(""))
    return _joined(cues.withColumn("_n", n), key, ["_n"], line, "\n")


def ass(lines: DataFrame, key: str, order: list[str], style: str = "Default") -> DataFrame:
    """(key, text): karaoke events from words with ``line_no``, ``gap_cs``, ``k_cs``."""
    word = F.concat(F.when(F.col("gap_cs") > 0, F.format_string("{\\k%d}", "gap_cs")).otherwise(""), F.format_string("{\\k%d}", "k_cs"), "text")
    ws = lines.withColumn("_w", word).groupBy(key, *[o for o in order if o == "scene_index"], "line_no").agg(
        F.min("start_ms").alias("_s"), F.max("end_ms").alias("_e"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*[o for o in order if o != "scene_index"], "_w"))), lambda x: x["_w"]), "").alias("_t"))
    event = F.concat(F.lit("Dialogue: 0,"), T.ms_to_ass(F.col("_s")), F.lit(","), T.ms_to_ass(F.col("_e")), F.lit(f",{style},,0,0,0,,"), "_t")
    body = _joined(ws, key, ["_s", "_e", "_t"], event, "\n")
    return body.select(key, F.concat(F.lit(ASS_HEADER + "\n"), "text").alias("text"))


def plain_ass(cues: DataFrame, key: str, style: str = "Default") -> DataFrame:
    """(key, text): whole sentences as events, by start, each shown for 400 ms at least; line breaks are escaped."""
    end = F.greatest(F.col("start_ms") + LEAST_SHOWN, F.col("end_ms"))
    event = F.concat(F.lit("Dialogue: 0,"), T.ms_to_ass(F.col("start_ms")), F.lit(","), T.ms_to_ass(end), F.lit(f",{style},,0,0,0,,"), T.newline_to_ass(F.coalesce("text", F.lit(""))))
    body = _joined(cues, key, ["start_ms", "end_ms", "text"], event, "\n")
    return body.select(key, F.concat(F.lit(ASS_HEADER + "\n"), "text").alias("text"))


def words_document(words: DataFrame, windows: DataFrame, key: str, spans: DataFrame | None = None) -> DataFrame:
    """(key, text): the version 1 word table of an episode as JSON.

    With ``spans`` (key, ``scene_id``, ``sentence_no``, ``sentence``, bounds) it
    holds their map by scene as ``narration_spans``: a function of its inputs,
    so that writing again changes nothing.
    """
    w = words.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "scene_index", "text"))).alias("words"))
    s = windows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("scene_index", "start_ms", "end_ms"))).alias("scenes"), F.max("end_ms").alias("duration_ms"))
    fields = [F.lit(1).alias("version"), F.lit("word").alias("granularity"), "duration_ms", "scenes", "words"]
    rows = w.join(s, key)
    if spans is not None:
        item = F.struct(F.col("sentence_no").alias("index"), F.col("sentence").alias("text"), "start_ms", "end_ms")
        by_scene = spans.groupBy(key, "scene_id").agg(F.array_sort(F.collect_list(item)).alias("_l"))
        held = by_scene.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("scene_id", "_l")))).alias("narration_spans"))
        rows, fields = rows.join(held, key, "left"), [*fields, "narration_spans"]
    return rows.select(key, F.to_json(F.struct(*fields)).alias("text"))


def prompt(blocks: DataFrame, key: str, order: str, block: str) -> DataFrame:
    """(key, text): ordered blocks, null ones skipped."""
    return _joined(blocks.where(F.col(block).isNotNull()), key, [order], F.col(block), "\n")


def report(findings: DataFrame, key: str) -> DataFrame:
    """(key, text): a list of findings, blocking ones first."""
    line = F.concat(F.lit("- ["), "severity", F.lit("] "), "code")
    body = _joined(findings, key, ["severity", "code"], line, "\n")
    return body.select(key, F.concat(F.lit("# Findings\n\n"), "text").alias("text"))


def move_element(durations: DataFrame, key: str, out: bool) -> DataFrame:
    """The element that moves an object out at the end, or in at the start."""
    start = F.greatest(F.col("duration_ms") - 900, F.lit(0)) if out else F.lit(400)
    return durations.select(key, F.lit(900 if out else 1).alias("sequence"), start.cast("bigint").alias("start_ms"), F.lit(700).alias("element_ms"), F.lit("MOVE").alias("op"))


def save_texts(texts: DataFrame, key: str, path: str) -> None:
    """One text file per key under ``path``, what was there for these keys replaced."""
    texts.select(key, "text").write.mode("overwrite").option("lineSep", "\n").partitionBy(key).text(path)


def save_table(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
