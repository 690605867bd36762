"""The supplied tables as timelines, narrations, tasks, rectangles, strokes and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import next_row
from ..sources import load

SCENE = ["episode_id", "scene_index"]
ORDER = ["start_ms", "word_id"]

TL = """tl AS (SELECT episode_id, scene_index, text, start_ms, end_ms, min(word_id) AS word_id FROM words
 WHERE scene_index IS NOT NULL AND start_ms IS NOT NULL AND end_ms IS NOT NULL AND text IS NOT NULL AND lower(trim(granularity)) = 'word'
 GROUP BY episode_id, scene_index, text, start_ms, end_ms)"""
NAR = """nar AS (SELECT * FROM (SELECT episode_id, scene_index, scene_key, scene_id, lang, narration,
 row_number() OVER (PARTITION BY episode_id, scene_index ORDER BY saved_at DESC NULLS LAST, scene_key DESC) AS rn
 FROM scenes WHERE scene_index IS NOT NULL) WHERE rn = 1)"""
TASKS = """tasks AS (SELECT user_id, event_id, kind, start_ms, coalesce(lead(start_ms) OVER (PARTITION BY user_id ORDER BY start_ms, event_id), start_ms) AS end_ms, length FROM (
 SELECT user_id, event_id, CASE WHEN event_type IN ('click', 'view') THEN 'draw' WHEN event_type = 'error' THEN 'travel' ELSE 'gaze' END AS kind,
 (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // 60000000 AS start_ms, coalesce(value, 0.0) AS length FROM events))"""
RECTS = """rects AS (SELECT CAST(p_partkey % 50 AS INTEGER) AS scene, p_partkey, CAST((p_partkey * 37) % 1500 AS INTEGER) AS x, CAST((p_partkey * 53) % 800 AS INTEGER) AS y,
 CAST(60 + (p_partkey * 7) % 400 AS INTEGER) AS w, CAST(40 + (p_partkey * 11) % 300 AS INTEGER) AS h FROM part)"""
POINTS = """points AS (SELECT vec_id, CAST(i AS INTEGER) AS i, floor(embedding[2 * i + 1] * 1000) AS x, floor(embedding[2 * i + 2] * 1000) AS y FROM embeddings, range(32) AS r(i))"""
FRAMES = """frames AS (SELECT label, vec_id, CAST(i AS INTEGER) AS i, CAST(floor(embedding[i + 1] * 100) AS INTEGER) AS v FROM embeddings, range(64) AS r(i))"""
SLOTS = """slots AS (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DOUBLE) AS len, CAST(4000 + l_orderkey % 5000 AS BIGINT) AS dur FROM lineitem)"""


def timeline(spark: SparkSession, d: str) -> DataFrame:
    """Word units: valid bounds, repeated rows once."""
    w = load(spark, d, "words", "word_id", "episode_id", "scene_index", "text", "start_ms", "end_ms", "granularity")
    w = w.where("scene_index is not null and start_ms is not null and end_ms is not null and text is not null and lower(trim(granularity)) = 'word'")
    return w.groupBy("episode_id", "scene_index", "text", "start_ms", "end_ms").agg(F.min("word_id").alias("word_id"))


def narrations(spark: SparkSession, d: str) -> DataFrame:
    """The latest narration of each scene."""
    s = load(spark, d, "scenes", "scene_key", "episode_id", "scene_index", "scene_id", "lang", "narration", "saved_at").where("scene_index is not null")
    best = s.groupBy(*SCENE).agg(F.max_by(F.struct("scene_key", "scene_id", "lang", "narration"), F.struct("saved_at", "scene_key")).alias("b"))
    return best.select(*SCENE, "b.*")


def tasks(spark: SparkSession, d: str) -> DataFrame:
    """Events as drawing, travelling and gazing tasks of a user's timeline, a minute of time as a millisecond."""
    e = load(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    first = e.agg(F.min(us)).scalar()
    kind = F.when(F.col("event_type").isin("click", "view"), "draw").when(F.col("event_type") == "error", "travel").otherwise("gaze")
    rows = e.select("user_id", "event_id", kind.alias("kind"), F.floor((us - first) / 60_000_000).cast("bigint").alias("start_ms"), F.coalesce("value", F.lit(0.0)).alias("length"))
    nxt = next_row(rows, ["user_id"], ["start_ms", "event_id"], F.col("start_ms"), "_next")
    return nxt.withColumn("end_ms", F.coalesce("_next", "start_ms")).drop("_next")


def rects(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return load(spark, d, "part", "p_partkey").select(
        (k % 50).cast("int").alias("scene"), "p_partkey", (k * 37 % 1500).cast("int").alias("x"), (k * 53 % 800).cast("int").alias("y"),
        (60 + k * 7 % 400).cast("int").alias("w"), (40 + k * 11 % 300).cast("int").alias("h"))


def points(spark: SparkSession, d: str) -> DataFrame:
    """Each vector as a polyline of 32 points."""
    at = lambda j: F.floor(F.element_at("embedding", F.col("i") * 2 + j).cast("double") * 1000).cast("double")
    return load(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i")).select("vec_id", "i", at(1).alias("x"), at(2).alias("y"))


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Each vector as an 8 by 8 grey frame of its label's clip."""
    return load(spark, d, "embeddings", "label", "vec_id", "embedding").select("label", "vec_id", F.transform("embedding", lambda v: F.floor(v.cast("double") * 100).cast("int")).alias("v"))


def slots(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("double").alias("len"), (4000 + F.col("l_orderkey") % 5000).cast("bigint").alias("dur"))
