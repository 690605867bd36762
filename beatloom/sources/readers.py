"""Readers of episode files: JSON documents, subtitles, layouts, images, media headers and logs.

Every reader takes a path or glob that Spark lists itself, keeps one row per
malformed file instead of failing, and gives ``path`` with each row.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import UserDefinedTableFunction

from ..functions import text as T
from ..operators.gates import judge

RECT = "struct<x:int,y:int,w:int,h:int,width:int,height:int,color:string>"
LABEL = "struct<text:string,cx:int,cy:int,size:int,font:string,panel:int>"
LAYOUT = f"struct<panels:array<{RECT}>,texts:array<{LABEL}>,canvasWidth:int,canvasHeight:int>"
WORDS = ("version int, voice string, granularity string, duration_ms bigint, scenes array<struct<scene_index:int,start_ms:bigint,end_ms:bigint>>, "
         "words array<struct<scene_index:int,text:string,start_ms:bigint,end_ms:bigint>>")
ANNOTATION = ("canvas struct<width:int,height:int>, sceneDurationMs bigint, elements array<struct<id:string,sequence:int,region:struct<x:int,y:int,width:int,height:int>,"
              "reveal:struct<startMs:bigint,durationMs:bigint,protectedRegions:array<struct<x:int,y:int,width:int,height:int>>>,kind:string,ops:array<struct<op:string,target:string,bound_span:int>>>>, "
              "meta struct<schedule:string,granularity:string,matched:string,warnings:array<string>>")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of each file, a byte-order mark removed."""
    df = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return df.select("path", F.regexp_replace("value", "^\ufeff", "").alias("text"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, body, doc): JSON files as text and variant; ``doc`` is null for a malformed one."""
    return whole_texts(spark, path).select("path", F.col("text").alias("body"), F.try_parse_json("text").alias("doc"))


def words_json(spark: SparkSession, path: str) -> DataFrame:
    """Word timelines: path, header columns, ``words``; malformed files keep ``corrupt`` true."""
    df = whole_texts(spark, path).withColumn("j", F.from_json("text", WORDS + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    return df.select("path", "j.version", "j.voice", "j.granularity", "j.duration_ms", "j.scenes", "j.words", (F.col("j._corrupt").isNotNull() | F.col("j").isNull()).alias("corrupt"))


def _layouts(texts: DataFrame) -> DataFrame:
    top = F.from_json("text", f"map<string,{LAYOUT}>")
    under = F.from_json(F.get_json_object("text", "$.scenes"), f"map<string,{LAYOUT}>")
    both = texts.select("path", F.explode(F.array(top, under)).alias("m")).select("path", F.explode("m").alias("scene_id", "l"))
    return both.where("l.panels is not null or l.texts is not null").dropDuplicates(["path", "scene_id"])


def layouts(texts: DataFrame) -> DataFrame:
    """(path, scene_id, panel_no, x, y, w, h, color) from layout texts, scenes at the top or under ``scenes``.

    ``texts`` has ``path`` and ``text``.  ``width`` and ``height`` stand in for
    ``w`` and ``h``; the colour defaults to blue.
    """
    first = _layouts(texts).where("l.panels is not null")
    p = first.select("path", "scene_id", F.posexplode("l.panels").alias("i", "p"))
    return p.select("path", "scene_id", (F.col("i") + 1).alias("panel_no"), F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.coalesce("p.w", "p.width").alias("w"),
                    F.coalesce("p.h", "p.height").alias("h"), F.coalesce("p.color", F.lit("blue")).alias("color"))


def annotations(texts: DataFrame) -> DataFrame:
    """(path, position by sequence, id, region, start_ms, duration_ms, n_ops, protected) from annotation texts; a missing sequence is 0."""
    a = texts.select("path", F.from_json("text", ANNOTATION).alias("a")).select("path", F.posexplode("a.elements").alias("i", "e"))
    return a.select("path", F.coalesce("e.sequence", F.lit(0)).alias("sequence"), "i", F.col("e.id").alias("id"), F.col("e.region").alias("region"), F.col("e.reveal.startMs").alias("start_ms"),
                    F.col("e.reveal.durationMs").alias("duration_ms"), F.greatest(F.lit(1), F.size(F.coalesce("e.ops", F.array().cast("array<struct<op:string,target:string,bound_span:int>>")))).alias("n_ops"),
                    F.filter(F.col("e.reveal.protectedRegions"), lambda r: r.isNotNull()).alias("protected"))


def srt_cues(texts: DataFrame) -> DataFrame:
    """(path, cue_no, text, start_ms, end_ms) from subtitle texts, ordered by start; markup and empty cues are dropped."""
    clean = F.replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    blocks = texts.select("path", F.posexplode(F.split(F.trim(clean), r"\n\s*\n")).alias("pos", "block"))
    time = r"(\d{2}:\d{2}:\d{2}[,.]\d{3})"
    arrow = rf"{time}\s*-->\s*{time}"
    body = F.trim(T.strip_markup(F.regexp_replace(F.regexp_replace("block", rf"(?s)\A.*?{arrow}[^\n]*\n?", ""), r"\s*\n\s*", "\n")))
    cues = blocks.where(F.col("block").rlike(arrow)).select("path", "pos", body.alias("text"), T.srt_to_ms(F.regexp_extract("block", arrow, 1)).alias("start_ms"), T.srt_to_ms(F.regexp_extract("block", arrow, 2)).alias("end_ms"))
    w = Window.partitionBy("path").orderBy("start_ms", "pos")
    return cues.where(T.nonempty(F.col("text"))).withColumn("cue_no", F.row_number().over(w)).drop("pos")


def durations(texts: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """(key, scene_id, duration_ms): the legacy map of seconds where there is one, else the word windows' length."""
    flat = F.from_json(F.coalesce(F.get_json_object("text", "$.scenes"), F.col("text")), "map<string,double>")
    legacy = texts.select(key, F.explode(flat).alias("scene_id", "s")).select(key, "scene_id", F.round(F.col("s") * 1000).cast("bigint").alias("_legacy"))
    derived = windows.select(key, "scene_id", (F.col("end_ms") - F.col("start_ms")).alias("_derived"))
    return legacy.join(derived, [key, "scene_id"], "full_outer").select(key, "scene_id", F.coalesce("_legacy", "_derived").alias("duration_ms"))


def confirmations(v: Column) -> Column:
    """Gate flags as a map: those of an object, null where one is neither true nor false; an old list of names is a log and confirms nothing."""
    flags = F.transform_values(F.from_json(v, "map<string,string>"), lambda _, x: F.when(x.isin("true", "false"), x == "true"))
    return F.when(v.isNotNull(), F.coalesce(F.when(F.ltrim(v).startswith("{"), flags), F.expr("map()").cast("map<string,boolean>")))


def migrated_states(texts: DataFrame, key: str) -> DataFrame:
    """(key, confirmations, confirmation_log) of state texts: a list of confirmations becomes the log.

    An object keeps its flags and the log beside it, anything else confirms
    nothing; log entries are texts, or JSON text for others.  Malformed states
    give no row.
    """
    state = texts.select(key, F.try_parse_json("text").alias("_s")).where("_s is not null")
    part = lambda name, t: F.expr(f"try_variant_get(_s, '$.{name}', '{t}')")
    said = F.to_json(part("confirmations", "variant"))
    listed = lambda name: part(name, "array<string>")
    log = F.coalesce(F.when(said.startswith("["), listed("confirmations")), listed("confirmation_log"), F.array().cast("array<string>"))
    return state.select(key, confirmations(F.coalesce(said, F.lit("{}"))).alias("confirmations"), log.alias("confirmation_log"))


def script_refusals(docs: DataFrame, key: str) -> DataFrame:
    """(key, code, severity): scripts without scenes, or with a scene of blank narration; ``docs`` has ``doc``, a variant."""
    scenes = F.expr("try_variant_get(doc, '$.scenes', 'array<variant>')")
    told = F.transform(scenes, lambda s: F.try_variant_get(s, "$.narration", "string"))
    rows = docs.where("doc is not null").select(key, F.coalesce(F.size(scenes), F.lit(0)).alias("_n"), F.coalesce(F.exists(told, T.is_blank), F.lit(False)).alias("_blank"))
    return judge(rows, [key], [("scenes_missing", "blocking", F.col("_n") <= 0), ("narration_blank", "blocking", F.col("_blank"))])


def word_file_findings(files: DataFrame, key: str) -> DataFrame:
    """(key, code, severity): word files (:func:`words_json`) that do not parse or lack their lists."""
    ok = ~F.col("corrupt")
    return judge(files, [key], [("words_malformed", "blocking", F.col("corrupt")), ("words_missing", "blocking", ok & F.col("words").isNull()), ("scenes_missing", "blocking", ok & F.col("scenes").isNull())])


def layout_texts(texts: DataFrame) -> DataFrame:
    """(path, scene_id, text_no, text, cx, cy, size, font, panel) of the labels in layout texts, read like :func:`layouts`."""
    t = _layouts(texts).where("l.texts is not null").select("path", "scene_id", F.posexplode("l.texts").alias("i", "t"))
    return t.select("path", "scene_id", (F.col("i") + 1).alias("text_no"), "t.*")


def labels(texts: DataFrame) -> DataFrame:
    """(path, label_no, text, panel, x0, y0, x1, y1) of label sidecars, ``[{text, bbox, panel}]``; entries without a box are left out."""
    t = texts.select("path", F.posexplode(F.from_json("text", "array<struct<text:string,bbox:array<int>,panel:int>>")).alias("i", "t")).where("size(t.bbox) = 4")
    box = [F.get("t.bbox", F.lit(n)).alias(c) for n, c in enumerate(("x0", "y0", "x1", "y1"))]
    return t.select("path", (F.col("i") + 1).alias("label_no"), "t.text", "t.panel", *box)


def characters(texts: DataFrame) -> DataFrame:
    """(path, id, name, immutable, allowed_variations, reference_images) of character files; plain text becomes one legacy character."""
    schema = "characters array<struct<id:string,name:string,immutable:map<string,string>,allowed_variations:array<string>,reference_images:array<string>>>"
    parsed = texts.withColumn("c", F.from_json("text", schema)["characters"])
    legacy = F.array(F.struct(F.lit("legacy").alias("id"), F.lit("legacy").alias("name"), F.create_map(F.lit("description"), F.col("text")).alias("immutable"),
                              F.array().cast("array<string>").alias("allowed_variations"), F.array().cast("array<string>").alias("reference_images")))
    rows = parsed.select("path", F.explode(F.when(F.col("path").endswith(".txt"), legacy).otherwise(F.filter("c", lambda x: x.isNotNull()))).alias("x"))
    return rows.select("path", "x.*")


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, channels, data) of images; channels are blue, green, red."""
    i = spark.read.format("image").option("dropInvalid", True).load(path)
    return i.select(F.col("image.origin").alias("path"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")


def pixels(boards: DataFrame) -> DataFrame:
    """(path, x, y, b, g, r, grey) of images, split in Arrow batches."""
    names = ["path", "x", "y", "b", "g", "r", "grey"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, w, h, n, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                a = np.frombuffer(data, np.uint8).reshape(h, w, n)
                b, g, r = (a[..., 0], a[..., 1 if n > 2 else 0], a[..., 2 if n > 2 else 0])
                grey = np.rint(0.114 * b + 0.587 * g + 0.299 * r).astype(np.int32)
                y, x = np.indices((h, w), np.int32)
                one = pa.DictionaryArray.from_arrays(pa.array(np.zeros(w * h, np.int32)), pa.array([path])).dictionary_decode()
                yield pa.RecordBatch.from_arrays([one, *(pa.array(c.ravel().astype(np.int32)) for c in (x, y, b, g, r, grey))], names)

    return boards.select("path", "width", "height", "channels", "data").mapInArrow(spread, "path string, x int, y int, b int, g int, r int, grey int")


def binary_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, size, modified) of files."""
    f = spark.read.format("binaryFile").load(path)
    return f.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


class _Atoms:
    def eval(self, content: bytes):
        at = 0
        for n in range(8):
            if content is None or at + 8 > len(content):
                return
            size, name = struct.unpack(">I4s", content[at:at + 8])
            if size < 8:
                return
            yield n, name.decode("latin-1"), size
            at += size


def atoms() -> UserDefinedTableFunction:
    """Table function over MP4 bytes: (no, name, size) of at most eight top-level atoms, up to the first of size under 8."""
    return F.udtf(_Atoms, returnType=StructType([StructField("no", IntegerType()), StructField("name", StringType()), StructField("size", LongType())]))


def loudness(log: Column) -> Column:
    """(lufs, peak_db, n_silences) from a measuring log: its last loudness and peak, and the silences of 2 s or more."""
    last = lambda p: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(log, F.lit(p), F.lit(1))), -1).try_cast("double")
    long = F.filter(F.regexp_extract_all(log, F.lit(r"silence_duration:\s*([\d.]+)"), F.lit(1)), lambda d: d.try_cast("double") >= 2)
    return F.struct(last(r"I:\s*(-?[\d.]+)\s*LUFS").alias("lufs"), last(r"Peak:\s*(-?[\d.]+)\s*dBFS").alias("peak_db"), F.size(long).alias("n_silences"))


def resolve(candidates: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """(key, path): the first existing of the ordered ``candidates`` (array of paths)."""
    c = candidates.select(key, F.posexplode("candidates").alias("pos", "path")).join(existing.select("path").distinct(), "path")
    return c.groupBy(key).agg(F.min_by("path", "pos").alias("path"))
