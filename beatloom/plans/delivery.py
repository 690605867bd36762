"""Queries of the checks before delivery, on stand-ins drawn from the supplied tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import align, delivery, fingerprint, gates, lint, raster, schedule, spatial, timeline
from ..operators.ordered import next_row
from ..sources import load, readers, writers
from . import adapters as A
from .reference import _EXACT, _HAY, SCENE, _panels, _phrases, _planned

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f
    return register


def _found(rules: list[tuple[str, str, str]], keys: str, src: str, with_: str = "") -> str:
    """SQL of findings: (code, severity, condition) over ``src``."""
    parts = [f"SELECT {keys}, '{c}' AS code, '{s}' AS severity FROM {src} WHERE {cond}" for c, s, cond in rules]
    return (f"WITH {with_} " if with_ else "") + " UNION ALL ".join(parts)


# deliverables

_MEDIA = """media AS (SELECT o_orderkey, o_orderkey * 37 % 100000 AS final_ms, o_orderkey * 37 % 100000 + o_custkey * 13 % 5000 - 2500 AS narration_ms, o_orderkey % 50 <> 0 AS has_video, o_orderkey % 40 <> 0 AS has_audio,
 CASE o_orderkey % 5 WHEN 0 THEN 'vp9 yuv420p 44100' WHEN 1 THEN 'h264 yuv444p 44100' WHEN 2 THEN 'h264 yuv420p 48000' ELSE 'h264 yuv420p 44100' END AS codecs,
 (o_orderkey % 20 - 170) / 10.0::DOUBLE AS lufs, (o_custkey % 20 - 25) / 10.0::DOUBLE AS peak_db, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS n_silences, o_orderkey % 3 AS layout FROM orders)"""


@query(_found([("no_duration", "blocking", "final_ms <= 0"), ("no_video", "blocking", "NOT has_video"), ("no_audio", "blocking", "NOT has_audio AND narration_ms > 0"),
               ("duration_drift", "warning", "abs(final_ms - narration_ms) > 2000"), ("codec", "blocking", "NOT contains(codecs, 'h264')"), ("pixel_format", "blocking", "NOT contains(codecs, 'yuv420p')"),
               ("sample_rate", "blocking", "NOT contains(codecs, '44100')"), ("faststart", "blocking", "layout <> 0"), ("silence", "blocking", "n_silences > 0"),
               ("loudness", "blocking", "NOT lufs BETWEEN -16.5 AND -15.5"), ("peak", "blocking", "NOT peak_db BETWEEN -2 AND -1")], "o_orderkey", "media", _MEDIA))
def media_gate(spark: SparkSession, d: str) -> DataFrame:
    o, k, c = load(spark, d, "orders", "o_orderkey", "o_custkey"), F.col("o_orderkey"), F.col("o_custkey")
    names = lambda *x: F.array(*map(F.lit, x))
    media = o.select("o_orderkey", (k * 37 % 100000).alias("final_ms"), (k * 37 % 100000 + c * 13 % 5000 - 2500).alias("narration_ms"), (k % 50 != 0).alias("has_video"), (k % 40 != 0).alias("has_audio"),
                     F.when(k % 5 == 0, "vp9 yuv420p 44100").when(k % 5 == 1, "h264 yuv444p 44100").when(k % 5 == 2, "h264 yuv420p 48000").otherwise("h264 yuv420p 44100").alias("codecs"),
                     ((k % 20 - 170) / 10).alias("lufs"), ((c % 20 - 25) / 10).alias("peak_db"), F.when(k % 7 == 0, 1).otherwise(0).alias("n_silences"),
                     F.when(k % 3 == 0, names("ftyp", "moov", "mdat")).when(k % 3 == 1, names("ftyp", "mdat", "moov")).otherwise(names("ftyp", "mdat")).alias("atoms"))
    return gates.media(media, ["o_orderkey"])


_TAKES = f"""{A.TL}, takes AS (SELECT episode_id, scene_index, max(end_ms) - min(start_ms) AS audio_ms, max(end_ms) - min(start_ms) + scene_index * 97 % 600 - 250 AS video_ms, max(end_ms) AS e FROM tl GROUP BY 1, 2)"""


@query(_found([("scene_audio", "blocking", "abs(video_ms - audio_ms) > 200"), ("tail", "blocking", "d - last_ms < 500")], "episode_id, scene_index", "t",
              f"RECURSIVE {_planned(_EXACT)}, l AS (SELECT episode_id, scene_index, max(end_ms) AS last_ms FROM planned GROUP BY 1, 2), t AS (SELECT win.episode_id, win.scene_index, d, last_ms, d AS audio_ms, d + win.scene_index * 97 % 600 - 250 AS video_ms FROM win LEFT JOIN l ON l.episode_id = win.episode_id AND l.scene_index = win.scene_index)"))
def duration_gate(spark: SparkSession, d: str) -> DataFrame:
    w = timeline.scene_windows(A.timeline(spark, d), SCENE).withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))
    planned = schedule.schedule_windows(_panels(spark, d), SCENE, "element_key", "duration")
    last = planned.groupBy(*SCENE).agg(F.max(F.col("start_ms") + F.col("duration_ms")).alias("last_ms"))
    takes = w.join(last, SCENE, "left").withColumn("audio_ms", F.col("duration_ms")).withColumn("video_ms", F.col("duration_ms") + F.col("scene_index") * 97 % 600 - 250)
    return delivery.scene_durations(takes, SCENE)


@query(_found([("concat", "blocking", "abs(s + length(episode_id) * 37 % 400 - 150 - s) > 150"), ("track", "blocking", "abs(s - total) > 500")], "episode_id", "t",
              f"{_TAKES}, t AS (SELECT episode_id, sum(audio_ms) AS s, max(e) AS total FROM takes GROUP BY 1)"))
def track_gate(spark: SparkSession, d: str) -> DataFrame:
    w = timeline.scene_windows(A.timeline(spark, d), SCENE).withColumn("audio_ms", F.col("end_ms") - F.col("start_ms"))
    tracks = w.groupBy("episode_id").agg(F.sum("audio_ms").alias("track_ms"), F.max("end_ms").alias("total_ms")).withColumn("concat_ms", F.col("track_ms") + F.length("episode_id") * 37 % 400 - 150)
    return delivery.track_durations(w, tracks, ["episode_id"])


@query(_found([("annotation_missing", "blocking", "c IS NULL"), ("annotation_empty", "blocking", "c IS NOT NULL AND (c = 0 OR coalesce(dur, 0) = 0)")], "episode_id, scene_index", "t",
              f"""{A.TL}, {A.NAR}, w AS (SELECT episode_id, scene_index, max(end_ms) - min(start_ms) AS dur FROM tl GROUP BY 1, 2), e AS (SELECT episode_id, scene_index, count(*) FILTER (trim(phrase) <> '') AS c FROM elements JOIN scenes USING (scene_key) WHERE scene_index IS NOT NULL GROUP BY 1, 2),
t AS (SELECT nar.episode_id, nar.scene_index, c, dur FROM nar LEFT JOIN e ON e.episode_id = nar.episode_id AND e.scene_index = nar.scene_index LEFT JOIN w ON w.episode_id = nar.episode_id AND w.scene_index = nar.scene_index)"""))
def annotation_presence(spark: SparkSession, d: str) -> DataFrame:
    w = timeline.scene_windows(A.timeline(spark, d), SCENE).select(*SCENE, (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))
    e = _phrases(spark, d).groupBy(*SCENE).agg(F.count_if(F.trim("phrase") != "").alias("n_elements"))
    return delivery.annotation_presence(A.narrations(spark, d), e.join(w, SCENE, "left"), SCENE)


def _files(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return load(spark, d, "raw_files", "file_id", "episode_id", "file_kind", "written_at", "payload").where(F.col("file_kind") == kind)


def _latest(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """The last valid file of each episode."""
    valid = _files(spark, d, kind).where(F.try_parse_json("payload").isNotNull())
    return delivery.latest_state(valid, ["episode_id"], ["written_at", "file_id"], "payload", "written_at")


_LAST = """{0} AS (SELECT episode_id, arg_max(payload, epoch_us(written_at) * 1000000::HUGEINT + file_id) AS payload, max(written_at) AS updated FROM raw_files WHERE file_kind = '{1}' AND payload IS NOT NULL AND json_valid(payload) GROUP BY 1)"""


@query(f"WITH {_LAST.format('s', 'state')} SELECT episode_id, sha256(payload) AS state, updated FROM s")
def latest_states(spark: SparkSession, d: str) -> DataFrame:
    return _latest(spark, d, "state").select("episode_id", F.sha2("state", 256).alias("state"), "updated")


@query("""SELECT file_id FROM (SELECT file_id, payload, lag(payload) OVER w AS before, row_number() OVER w AS i FROM raw_files WHERE file_kind = 'state' WINDOW w AS (PARTITION BY episode_id ORDER BY written_at, file_id)) WHERE i = 1 OR payload IS DISTINCT FROM before""")
def state_log(spark: SparkSession, d: str) -> DataFrame:
    """The states that changed something."""
    return delivery.state_log(_files(spark, d, "state"), ["episode_id"], ["written_at", "file_id"], "payload").select("file_id")


@query(_found([("voice_drift", "warning", "u <> '' AND e <> '' AND u <> e")], "episode_id", "t", f"{_LAST.format('s', 'words')}, t AS (SELECT episode_id, json_extract_string(payload, '$.voice') AS u, voice AS e FROM s JOIN episodes USING (episode_id))"))
def voice_drift(spark: SparkSession, d: str) -> DataFrame:
    used = _latest(spark, d, "words").select("episode_id", F.get_json_object("state", "$.voice").alias("voice"))
    return delivery.voice_drift(used, load(spark, d, "episodes", "episode_id", "voice"), ["episode_id"])


@query(_found([(n, "warning", f"coalesce(CAST(json_extract(payload, '$.confirmations.{n}') AS VARCHAR), '') <> 'true'") for n in ("content_confirmed", "visual_confirmed")], "episode_id", "s", _LAST.format("s", "state")))
def unconfirmed_gates(spark: SparkSession, d: str) -> DataFrame:
    flags = F.create_map(*[x for n in ("content_confirmed", "visual_confirmed") for x in (F.lit(n), F.expr(f"try_variant_get(try_parse_json(state), '$.confirmations.{n}', 'variant')::string") == "true")])
    return delivery.unconfirmed(_latest(spark, d, "state"), ["episode_id"], flags)


@query(_found([("subtitles_stale", "warning", "d < s")], "episode_id", "t", "t AS (SELECT episode_id, max(written_at) FILTER (file_kind = 'state') AS d, max(written_at) FILTER (file_kind = 'words') AS s FROM raw_files GROUP BY 1)"))
def stale_subtitles(spark: SparkSession, d: str) -> DataFrame:
    return delivery.stale(_files(spark, d, "state"), _files(spark, d, "words"), ["episode_id"], "written_at", "subtitles_stale")


# images

_SIZES = "sizes AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 1920 WHEN 1 THEN 1792 WHEN 2 THEN 1280 ELSE 1900 + p_partkey % 60 END AS w, CASE p_partkey % 4 WHEN 0 THEN 1080 WHEN 1 THEN 1024 WHEN 2 THEN 720 ELSE 1040 + p_partkey % 50 END AS h FROM part)"


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda a, b, c, e: F.when(k % 4 == 0, a).when(k % 4 == 1, b).when(k % 4 == 2, c).otherwise(e).cast("int")
    return load(spark, d, "part", "p_partkey").select("p_partkey", pick(1920, 1792, 1280, 1900 + k % 60).alias("width"), pick(1080, 1024, 720, 1040 + k % 50).alias("height"))


@query(_found([("aspect", "blocking", "abs(w / h::DOUBLE - 16 / 9::DOUBLE) > 0.02::DOUBLE"), ("long_edge", "blocking", "greatest(w, h) < 1920")], "p_partkey", "sizes", _SIZES))
def image_sizes(spark: SparkSession, d: str) -> DataFrame:
    return delivery.image_size(_sizes(spark, d), ["p_partkey"])


@query(f"""WITH {_SIZES}, r AS (SELECT *, w / h::DOUBLE AS ratio, 16 / 9::DOUBLE AS goal FROM sizes), t AS (SELECT *, CASE WHEN w = 1920 AND h = 1080 THEN 'keep' WHEN abs(ratio - goal) > 0.03::DOUBLE THEN 'refuse' WHEN abs(ratio - goal) <= 1e-6 THEN 'scale' ELSE 'crop' END AS decision FROM r),
b AS (SELECT *, CASE WHEN decision = 'crop' AND ratio > goal THEN CAST(round_even(h * goal, 0) AS BIGINT) ELSE w END AS bw, CASE WHEN decision = 'crop' AND ratio <= goal THEN CAST(round_even(w / goal, 0) AS BIGINT) ELSE h END AS bh FROM t)
SELECT p_partkey, decision, CASE WHEN decision IN ('scale', 'crop') THEN (w - bw) // 2 END AS x, CASE WHEN decision IN ('scale', 'crop') THEN (h - bh) // 2 END AS y, CASE WHEN decision IN ('scale', 'crop') THEN bw END AS box_w, CASE WHEN decision IN ('scale', 'crop') THEN bh END AS box_h FROM b""")
def size_decisions(spark: SparkSession, d: str) -> DataFrame:
    return delivery.size_decision(_sizes(spark, d)).select("p_partkey", "decision", "box.x", "box.y", F.col("box.w").alias("box_w"), F.col("box.h").alias("box_h"))


_CORNERS = f"""{A.FRAMES}, corners AS (SELECT vec_id, CAST(i // 3 AS INTEGER) AS corner, avg(v + 150) AS luma, max(abs(v + 150 - [30, 40, 50][CAST(i % 3 AS INTEGER) + 1])) AS off, CASE WHEN vec_id % 2 = 0 THEN 'chalk' ELSE 'paper' END AS mode FROM frames WHERE i < 12 GROUP BY 1, 2)"""


@query(_found([("corner_light", "blocking", "mode = 'chalk' AND luma > 130"), ("corner_colour", "blocking", "mode = 'chalk' AND off > 60"), ("corner_dark", "blocking", "mode = 'paper' AND luma < 185")], "vec_id, corner", "corners", _CORNERS))
def corner_colours(spark: SparkSession, d: str) -> DataFrame:
    shifted = F.transform("v", lambda v: (v + 150).cast("double"))
    corners = F.array(*[F.slice(shifted, 3 * i + 1, 3) for i in range(4)])
    mode = F.when(F.col("vec_id") % 2 == 0, "chalk").otherwise("paper")
    return delivery.corner_findings(A.frames(spark, d), ["vec_id"], corners, mode, F.array(*map(F.lit, (30.0, 40.0, 50.0))))


_HUED = f"{A.POINTS}, hued AS (SELECT vec_id, CAST(i // 8 AS INTEGER) AS s, abs(x) % 200 AS r, abs(y) % 200 + 40 AS g, abs(x + y) % 200 AS b FROM points)"


@query(f"WITH {_HUED}, m AS (SELECT vec_id, s, floor(median(r)) AS r, floor(median(g)) AS g, floor(median(b)) AS b FROM hued GROUP BY 1, 2) SELECT vec_id, s, r, g, b FROM m WHERE NOT (g >= r AND g >= b AND r + g + b - 150 > 120)")
def fog_free_strokes(spark: SparkSession, d: str) -> DataFrame:
    p = A.points(spark, d)
    hued = p.select("vec_id", F.floor(F.col("i") / 8).cast("int").alias("s"), (F.abs("x") % 200).alias("r"), (F.abs("y") % 200 + 40).alias("g"), (F.abs(F.col("x") + F.col("y")) % 200).alias("b"))
    return delivery.without_fog(hued, ["vec_id", "s"], F.lit(150)).select("vec_id", "s", *[F.col(c).cast("double").alias(c) for c in "rgb"])


@query(f"WITH {A.FRAMES} SELECT label, round(count(*) FILTER (v > 45 AND v <= 140) / count(*)::DOUBLE, 9) AS residual_ratio, count(*) FILTER (v > 45 AND v <= 140) / count(*)::DOUBLE < 0.01::DOUBLE AS removed FROM frames GROUP BY 1")
def watermark_residual(spark: SparkSession, d: str) -> DataFrame:
    p = A.frames(spark, d).select("label", F.explode("v").alias("v"))
    return delivery.residual(p, ["label"], "v").withColumn("residual_ratio", F.round("residual_ratio", 9))


@query("""WITH t AS (SELECT CAST(p_partkey % 50 AS INTEGER) AS scene, p_partkey, p_partkey % 7 = 0 AS fill, CAST(p_partkey % 140 AS DOUBLE) AS len, p_partkey * 7 % 90 AS w, p_partkey * 11 % 90 AS h, p_partkey % 13 = 0 AS inner_ FROM part)
SELECT scene, p_partkey, CASE WHEN fill THEN 1 WHEN inner_ OR (len < 70 AND w < 50 AND h < 50) THEN 2 ELSE 0 END AS slot FROM t""")
def stroke_slots(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    strokes = load(spark, d, "part", "p_partkey").select((k % 50).cast("int").alias("scene"), "p_partkey", (k % 7 == 0).alias("is_fill"), (k % 140).cast("double").alias("length"), (k * 7 % 90).alias("w"), (k * 11 % 90).alias("h"))
    return delivery.stroke_slots(strokes, strokes.where(k % 13 == 0), ["scene"], "p_partkey").select("scene", "p_partkey", "slot")


_HANDS = "hands AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'RGB' WHEN p_partkey % 9 = 0 THEN NULL ELSE 'RGBA' END AS mode, 204 + p_partkey % 3 AS w, 317 AS h, CASE WHEN p_partkey % 5 > 0 THEN p_partkey * 3 % 230 END AS tx, p_partkey * 5 % 350 - 10 AS ty FROM part)"


@query(_found([("hand_mode", "blocking", "mode IS DISTINCT FROM 'RGBA'"), ("hand_size", "blocking", "w <> 204 OR h <> 317"), ("hand_tip", "blocking", "NOT coalesce(tx >= 0 AND tx < w AND ty >= 0 AND ty < h, false)")], "p_partkey", "hands", _HANDS))
def hand_contract(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    hands = load(spark, d, "part", "p_partkey").select(
        "p_partkey", F.when(k % 4 == 0, "RGB").when(k % 9 != 0, "RGBA").alias("mode"), (204 + k % 3).alias("width"), F.lit(317).alias("height"), F.lit(204).alias("want_width"), F.lit(317).alias("want_height"),
        F.when(k % 5 > 0, k * 3 % 230).alias("tip_x"), (k * 5 % 350 - 10).alias("tip_y"))
    return delivery.hand_contract(hands, ["p_partkey"])


# characters

_CAST = "cast_ AS (SELECT CAST(c_nationkey AS INTEGER) AS list, c_custkey, CASE WHEN c_custkey % 17 = 0 THEN ' ' WHEN c_custkey % 29 = 0 THEN NULL ELSE 'ch-' || c_custkey % 300 END AS id, c_custkey % 11 AS n_immutable FROM customer)"


@query(_found([("id_missing", "blocking", "no"), ("id_repeated", "blocking", "NOT no AND rn > 1"), ("immutable_missing", "blocking", "NOT no AND n_immutable = 0")], "list, c_custkey", "t",
              f"{_CAST}, t AS (SELECT *, trim(coalesce(id, '')) = '' AS no, row_number() OVER (PARTITION BY list, trim(coalesce(id, '')) ORDER BY c_custkey) AS rn FROM cast_)"))
def character_gate(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    cast = load(spark, d, "customer", "c_custkey", "c_nationkey").select(F.col("c_nationkey").cast("int").alias("list"), "c_custkey", F.when(k % 17 == 0, " ").when(k % 29 != 0, F.concat(F.lit("ch-"), (k % 300).cast("string"))).alias("id"), (k % 11).alias("n_immutable"))
    return delivery.character_findings(cast, ["list"], ["c_custkey"])


@query(_found([("reference_missing", "blocking", "NOT there"), ("reference_format", "blocking", "there AND c_custkey % 6 > 3"), ("sheet_small", "blocking", "500 + c_custkey % 40 < 512 OR 600 < 512")], "c_custkey", "t", "t AS (SELECT c_custkey, c_custkey % 10 > 0 AS there FROM customer)"))
def character_pictures(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    c = load(spark, d, "customer", "c_custkey")
    endings = F.array(*map(F.lit, ("a/b.png", "c.JPG", "d.jpeg", "e.webp", "f.gif", "no_ending")))
    refs = c.select("c_custkey", F.element_at(endings, (k % 6 + 1).cast("int")).alias("path"), (k % 10 > 0).alias("is_there"))
    sheets = c.select("c_custkey", (500 + k % 40).alias("width"), F.lit(600).alias("height"))
    return gates.union(delivery.reference_findings(refs, ["c_custkey"], "path"), delivery.sheet_findings(sheets, ["c_custkey"]))


@query("""SELECT CAST(c_nationkey AS INTEGER) AS list, '[' || string_agg('{"character_id":"ch-' || c_custkey || '","name":"' || CASE WHEN c_custkey % 2 = 0 THEN 'ch-' || c_custkey ELSE 'N' || c_custkey END || '","reference_images":["' || c_custkey || '.png"],"canonical_sheet":' || CASE WHEN c_nationkey % 2 = 0 THEN '"sheet.png"' ELSE 'null' END || ',"reference_priority":["canonical_sheet","reference_images"]}', ',' ORDER BY c_custkey) || ']' AS text FROM customer GROUP BY c_nationkey""")
def character_manifest(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    cast = load(spark, d, "customer", "c_custkey", "c_nationkey").select(F.col("c_nationkey").cast("int").alias("list"), k.alias("position"), F.concat(F.lit("ch-"), k.cast("string")).alias("id"),
                                                                         F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("N"), k.cast("string"))).alias("name"), F.array(F.concat(k.cast("string"), F.lit(".png"))).alias("reference_images"))
    return delivery.character_manifest(cast, "list", F.when(F.col("list") % 2 == 0, "sheet.png"))


# boards


@query(f"WITH {A.TL}, {A.NAR}, b AS (SELECT DISTINCT episode_id, scene_index FROM tl) SELECT nar.episode_id, nar.scene_index, CASE WHEN b.episode_id IS NOT NULL THEN 'b-' || nar.scene_index || '.png' END AS file, CASE WHEN b.episode_id IS NOT NULL THEN 'ok' ELSE 'pending' END AS status FROM nar LEFT JOIN b ON b.episode_id = nar.episode_id AND b.scene_index = nar.scene_index")
def synced_boards(spark: SparkSession, d: str) -> DataFrame:
    boards = A.timeline(spark, d).select(*SCENE).distinct().select(*SCENE, F.format_string("b-%d.png", "scene_index").alias("file"), F.lit("ok").alias("status"))
    return delivery.synced(A.narrations(spark, d).select(*SCENE), boards, SCENE)


@query(f"WITH {A.NAR}, r AS (SELECT *, printf('scene-%02d', row_number() OVER (PARTITION BY episode_id ORDER BY scene_index)) AS new_id FROM nar) SELECT episode_id, scene_index, new_id, coalesce(scene_id, '') <> new_id AS renamed FROM r")
def renumbered_scenes(spark: SparkSession, d: str) -> DataFrame:
    return delivery.renumbered(A.narrations(spark, d), ["episode_id"], ["scene_index"], "scene_id").select(*SCENE, "new_id", "renamed")


_STATUS = f"""{_SIZES}, st AS (SELECT CAST(p_partkey % 50 AS INTEGER) AS scene, p_partkey, CASE WHEN p_partkey % 23 = 0 THEN 'missing' WHEN abs(w / h::DOUBLE - 16 / 9::DOUBLE) > 0.02::DOUBLE OR greatest(w, h) < 1920 THEN 'failed' ELSE 'ok' END AS status FROM sizes)"""


def _statuses(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    boards = _sizes(spark, d).withColumn("scene", (k % 50).cast("int"))
    found = delivery.image_size(boards, ["scene", "p_partkey"])
    return delivery.import_gate(boards.select("scene", "p_partkey", (k % 23 != 0).alias("is_there")), found, ["scene"], "p_partkey")


@query(f"WITH {_STATUS} SELECT scene, p_partkey, status FROM st")
def board_imports(spark: SparkSession, d: str) -> DataFrame:
    return _statuses(spark, d)


@query(f"WITH {_STATUS} SELECT scene, CASE WHEN bool_and(status = 'ok') THEN 0 ELSE 2 END AS exit_code FROM st GROUP BY 1")
def import_exit_codes(spark: SparkSession, d: str) -> DataFrame:
    return delivery.exit_codes(_statuses(spark, d), ["scene"])


@query(f"""WITH {A.FRAMES}, n AS (SELECT label, vec_id, i, v, lead(v) OVER (PARTITION BY label, i ORDER BY vec_id) AS nv FROM frames), c AS (SELECT label, vec_id, avg(abs(nv - v)) AS m FROM n WHERE nv IS NOT NULL GROUP BY 1, 2),
b AS (SELECT vec_id, median(v) AS g FROM (SELECT vec_id, v, i % 8 AS x, i // 8 AS y FROM frames) WHERE x < 1 OR x >= 7 OR y < 1 OR y >= 7 GROUP BY 1), h AS (SELECT f.vec_id, avg(abs(v - g)) AS ghost FROM frames f JOIN b USING (vec_id) WHERE i // 8 BETWEEN 2 AND 5 GROUP BY 1)
SELECT label, vec_id, unnest(list_filter([CASE WHEN m >= 12 THEN 'hard_cut' END, CASE WHEN m < 8 THEN 'no_change' END, CASE WHEN ghost >= 24 THEN 'ghost' END], lambda x: x IS NOT NULL)) AS code, 'blocking' AS severity FROM c JOIN h USING (vec_id)""")
def boundary_findings(spark: SparkSession, d: str) -> DataFrame:
    """Each frame's going over into the clip's next: a hard cut, no change, or remains of what was there."""
    frames = A.frames(spark, d)
    pairs = next_row(frames, ["label"], ["vec_id"], F.col("v"), "nxt").where("nxt is not null")
    measured = raster.board_stats(frames, "vec_id", "v", 8, 8, 2, edge=1, ink=8, band=(2, 6)).select("vec_id", "ghost")
    rows = pairs.select("label", "vec_id", raster.mean_abs_diff(F.col("nxt"), F.col("v")).alias("m")).join(measured, "vec_id")
    return gates.judge(rows, ["label", "vec_id"], [("hard_cut", "blocking", F.col("m") >= raster.WIPE_STEP), ("no_change", "blocking", F.col("m") < raster.WIPE_TOTAL),
                                                   ("ghost", "blocking", F.col("ghost") >= raster.GHOST)])


_RGB = f"{A.FRAMES}, px AS (SELECT vec_id, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y, abs(v) * 9 % 256 AS r, abs(v) * 5 % 256 + vec_id % 2 * 60 AS g, abs(v) * 7 % 256 AS b FROM frames)"


def _rgb(spark: SparkSession, d: str) -> DataFrame:
    p = A.frames(spark, d).select("vec_id", F.posexplode("v").alias("i", "v"))
    v = F.abs("v")
    return p.select("vec_id", (F.col("i") % 8).cast("int").alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), (v * 9 % 256).alias("r"), (v * 5 % 256 + F.col("vec_id") % 2 * 60).alias("g"), (v * 7 % 256).alias("b"))


_GROUND = """c AS (SELECT vec_id, median(r) AS bg_r, median(g) AS bg_g, median(b) AS bg_b FROM px WHERE (x < 2 OR x >= 6) AND (y < 2 OR y >= 6) GROUP BY 1), d AS (SELECT px.*, bg_r, bg_g, bg_b, abs(r - bg_r) + abs(g - bg_g) + abs(b - bg_b) AS far FROM px JOIN c USING (vec_id)),
pl AS (SELECT vec_id, bg_r, bg_g, bg_b, avg(CASE WHEN far < 120 THEN 1.0 ELSE 0.0 END) AS dominance FROM d GROUP BY ALL),
pd AS (SELECT *, CASE WHEN greatest(abs(90 - bg_r), abs(80 - bg_g), abs(60 - bg_b)) < 12 THEN 'near' WHEN dominance < 0.05 THEN 'not_dominant' ELSE 'move' END AS decision FROM pl)"""


@query(f"WITH {_RGB}, {_GROUND} SELECT vec_id, bg_r, bg_g, bg_b, round(dominance, 6) AS dominance, decision FROM pd")
def background_plans(spark: SparkSession, d: str) -> DataFrame:
    return raster.background_plan(_rgb(spark, d), "vec_id", "x", "y", 8, 8, 2, (90, 80, 60)).withColumn("dominance", F.round("dominance", 6))


@query(f"""WITH {_RGB}, {_GROUND}, w AS (SELECT d.*, 1 - least(greatest(far / 120.0::DOUBLE, 0), 1) AS k, decision FROM d JOIN pd USING (vec_id))
SELECT vec_id, x, y, CAST(CASE WHEN decision = 'move' THEN floor(least(greatest(r + (90 - bg_r) * k, 0), 255)) ELSE r END AS INTEGER) AS r, CAST(CASE WHEN decision = 'move' THEN floor(least(greatest(g + (80 - bg_g) * k, 0), 255)) ELSE g END AS INTEGER) AS g,
CAST(CASE WHEN decision = 'move' THEN floor(least(greatest(b + (60 - bg_b) * k, 0), 255)) ELSE b END AS INTEGER) AS b FROM w""")
def moved_backgrounds(spark: SparkSession, d: str) -> DataFrame:
    p = _rgb(spark, d)
    return raster.moved_background(p, raster.background_plan(p, "vec_id", "x", "y", 8, 8, 2, (90, 80, 60)), "vec_id", (90, 80, 60))


@query(f"""WITH {_RGB}, m AS (SELECT vec_id, median(r) AS mr, median(g) AS mg, median(b) AS mb FROM px WHERE x < 1 OR x >= 7 OR y < 1 OR y >= 7 GROUP BY 1), f AS (SELECT vec_id, y, abs(r - mr) + abs(g - mg) + abs(b - mb) AS far FROM px JOIN m USING (vec_id))
SELECT vec_id, count(*) FILTER (far > 180) AS n_ink, round(avg(far / 3) FILTER (y >= 2 AND y < 6), 6) AS deviation FROM f GROUP BY 1""")
def coloured_ink(spark: SparkSession, d: str) -> DataFrame:
    """Ink and remains against the border's colour, over three channels."""
    p, channels = _rgb(spark, d), ["r", "g", "b"]
    ground = raster.border_median(p, "vec_id", channels, "x", "y", 8, 8, 1)
    inked = raster.ink(p, ground, "vec_id", channels).groupBy("vec_id").agg(F.count_if("is_ink").alias("n_ink"))
    return inked.join(raster.ghost(p, ground, "vec_id", channels, "y", (2, 6)), "vec_id").select("vec_id", "n_ink", F.round("deviation", 6).alias("deviation"))


_KEYED = f"{_RGB}, ky AS (SELECT *, CAST(floor(least(greatest((least(greatest((sqrt(pow(r - 30, 2) + pow(g - 200, 2) + pow(b - 30, 2)) - 30) / 110.0::DOUBLE, 0), 1) * 255 - 60) * (255.0::DOUBLE / 195.0::DOUBLE), 0), 255)) AS INTEGER) AS alpha, least(r, b) - g > 24 AS spill FROM px)"


@query(f"WITH {_KEYED} SELECT vec_id, x, y, alpha, CAST(floor(CASE WHEN spill THEN r * 0.55::DOUBLE + g * 0.45::DOUBLE ELSE r END) AS INTEGER) AS r, CAST(floor(CASE WHEN spill THEN b * 0.55::DOUBLE + g * 0.45::DOUBLE ELSE b END) AS INTEGER) AS b FROM ky")
def keyed_pixels(spark: SparkSession, d: str) -> DataFrame:
    return _alpha(spark, d).select("vec_id", "x", "y", "alpha", raster.despilled(F.col("r"), F.col("g"), F.col("b")).alias("c")).select("vec_id", "x", "y", "alpha", "c.r", "c.b")


def _alpha(spark: SparkSession, d: str) -> DataFrame:
    far = F.sqrt(F.pow(F.col("r") - 30, 2) + F.pow(F.col("g") - 200, 2) + F.pow(F.col("b") - 30, 2))
    return _rgb(spark, d).withColumn("alpha", raster.key_alpha(far, F.lit(10.0)))


@query(f"""WITH {_KEYED}, t AS (SELECT vec_id, x, y, y - x AS s FROM ky WHERE least(r, g, b) > 175 AND abs(r - b) < 55 AND alpha > 200), o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, y, x) AS n FROM t), m AS (SELECT vec_id, x AS mx, y AS my, s AS ms FROM o WHERE n = 1)
SELECT vec_id, CAST(round_even(avg(x), 0) AS INTEGER) AS tip_x, CAST(round_even(avg(y), 0) AS INTEGER) AS tip_y FROM t JOIN m USING (vec_id) WHERE abs(y - my) < 8 AND abs(x - mx) < 8 AND s >= ms - 16 GROUP BY 1""")
def chalk_tips(spark: SparkSession, d: str) -> DataFrame:
    return raster.chalk_tips(_alpha(spark, d), "vec_id", "x", "y")


_CROSS = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"


@query(f"""WITH {A.RECTS}, i AS (SELECT a.scene, CAST({_CROSS} AS DOUBLE) AS i, a.w * a.h + b.w * b.h - {_CROSS} AS u FROM rects a JOIN rects b ON a.scene = b.scene AND a.p_partkey < b.p_partkey)
SELECT scene, 'overlap' AS code, 'warning' AS severity, count(*) AS n FROM i WHERE i / greatest(u, 1) > 0.10 GROUP BY 1 UNION ALL SELECT scene, 'crowded', 'warning', count(*) FROM rects GROUP BY 1 HAVING sum(w * h) / 2073600.0::DOUBLE > 0.55""")
def layout_findings(spark: SparkSession, d: str) -> DataFrame:
    return spatial.layout_findings(A.rects(spark, d), ["scene"], "p_partkey")


@query("SELECT file_id, 'blocking' AS severity, 'IR.BAD_LAYOUT' AS code, '/' AS path FROM raw_files WHERE payload IS NOT NULL AND NOT json_valid(payload)")
def bad_layouts(spark: SparkSession, d: str) -> DataFrame:
    return lint.layout_files(load(spark, d, "raw_files", "file_id", "payload"), ["file_id"], "payload")


@query("""WITH s AS (SELECT script_id, json_extract_string(body, '$.knowledge_model.task_type') AS t, body FROM scripts WHERE body IS NOT NULL AND json_valid(body))
SELECT script_id, CASE WHEN upper(t) IN ('C', 'MECHANISM') THEN 'technical' WHEN upper(t) IN ('B', 'CONCEPT') THEN 'educational' WHEN upper(t) IN ('A', 'CORRECTION') THEN 'opinion'
 WHEN regexp_matches(body, '故事|人物|经历|历史|传说|案例') THEN 'story' WHEN regexp_matches(body, '算法|代码|技术|架构|系统|原理|机制|模型') THEN 'technical' WHEN regexp_matches(body, '应该|必须|观点|认为|批判|反思') THEN 'opinion' ELSE 'educational' END AS knowledge_type FROM s""")
def script_knowledge_types(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "scripts", "script_id", "body").where(F.try_parse_json("body").isNotNull())
    task = F.expr("try_variant_get(try_parse_json(body), '$.knowledge_model.task_type', 'string')")
    return s.select("script_id", T.knowledge_type(task, F.col("body")).alias("knowledge_type"))


@query(f"""WITH {A.TL}, {A.NAR}, w AS (SELECT episode_id, scene_index, max(end_ms) - min(start_ms) AS derived FROM tl GROUP BY 1, 2), l AS (SELECT episode_id, scene_index, CAST(scene_index * 1234 + 500 AS BIGINT) AS legacy FROM nar WHERE scene_index % 3 = 0)
SELECT coalesce(w.episode_id, l.episode_id) AS episode_id, printf('scene-%02d', coalesce(w.scene_index, l.scene_index) + 1) AS scene_id, coalesce(legacy, derived) AS duration_ms FROM w FULL JOIN l ON l.episode_id = w.episode_id AND l.scene_index = w.scene_index""")
def scene_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Lengths from the old map of seconds where there is one, else from the words."""
    sid = F.format_string("scene-%02d", F.col("scene_index") + 1).alias("scene_id")
    windows = timeline.scene_windows(A.timeline(spark, d), SCENE).select("episode_id", sid, "start_ms", "end_ms")
    old = A.narrations(spark, d).where("scene_index % 3 = 0").select("episode_id", sid, ((F.col("scene_index") * 1234 + 500) / 1000).alias("s"))
    texts = old.groupBy("episode_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("scene_id", "s")))).alias("text"))
    return readers.durations(texts, windows, "episode_id")


@query(f"WITH {A.TL}, {_HAY} SELECT episode_id, scene_index, length(hay) AS n_chars, sha256(hay) AS digest FROM hay")
def haystacks(spark: SparkSession, d: str) -> DataFrame:
    """Each scene's spoken letters and digits."""
    return align.haystacks(A.timeline(spark, d), SCENE, A.ORDER).select(*SCENE, F.length("hay").alias("n_chars"), F.sha2("hay", 256).alias("digest"))


# readers and writers


@query("""WITH s AS (SELECT file_id, CAST(payload AS JSON) AS j FROM raw_files WHERE file_kind = 'state' AND payload IS NOT NULL AND json_valid(payload)), c AS (SELECT file_id, json_extract(j, '$.confirmations') AS c, json_extract(j, '$.confirmation_log') AS l FROM s)
SELECT file_id, CASE WHEN json_type(c) = 'OBJECT' THEN len(json_keys(c)) ELSE 0 END AS n_flags, CASE WHEN json_type(c) = 'ARRAY' THEN json_array_length(c) WHEN json_type(l) = 'ARRAY' THEN json_array_length(l) ELSE 0 END AS n_log FROM c""")
def migrated_states(spark: SparkSession, d: str) -> DataFrame:
    texts = _files(spark, d, "state").withColumnRenamed("payload", "text")
    return readers.migrated_states(texts, "file_id").select("file_id", F.size("confirmations").alias("n_flags"), F.size("confirmation_log").alias("n_log"))


@query("""WITH s AS (SELECT script_id, CAST(body AS JSON) AS j FROM scripts WHERE body IS NOT NULL AND json_valid(body)), t AS (SELECT script_id, CASE WHEN json_type(json_extract(j, '$.scenes')) = 'ARRAY' THEN CAST(json_extract(j, '$.scenes') AS JSON[]) ELSE [] END AS l FROM s),
b AS (SELECT script_id, len(l) AS n, len(list_filter(l, lambda x: regexp_full_match(coalesce(json_extract_string(x, '$.narration'), ''), '[\\s\\p{Z}]*'))) > 0 AS blank FROM t)
SELECT script_id, 'scenes_missing' AS code, 'blocking' AS severity FROM b WHERE n = 0 UNION ALL SELECT script_id, 'narration_blank', 'blocking' FROM b WHERE blank""")
def script_refusals(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "scripts", "script_id", "body").select("script_id", F.try_parse_json("body").alias("doc"))
    return readers.script_refusals(docs, "script_id")


_ASS = "printf('%d:%02d:%02d.%02d', {0} // 360000, {0} // 6000 % 60, {0} // 100 % 60, {0} % 100)"
_HEADER = "'" + writers.ASS_HEADER.replace("\n", "' || chr(10) || '") + "' || chr(10) || "


@query(f"""WITH c AS (SELECT episode_id, start_ms, end_ms, text, CAST(round_even(greatest(start_ms, 0) / 10.0, 0) AS BIGINT) AS a, CAST(round_even(greatest(greatest(start_ms + 400, end_ms), 0) / 10.0, 0) AS BIGINT) AS z FROM words WHERE lower(trim(granularity)) = 'sentence' AND start_ms IS NOT NULL AND end_ms IS NOT NULL)
SELECT episode_id, {_HEADER}string_agg('Dialogue: 0,' || {_ASS.format('a')} || ',' || {_ASS.format('z')} || ',Default,,0,0,0,,' || replace(coalesce(text, ''), chr(10), '\\N'), chr(10) ORDER BY start_ms, end_ms, text NULLS FIRST) AS text FROM c GROUP BY 1""")
def plain_subtitles(spark: SparkSession, d: str) -> DataFrame:
    w = load(spark, d, "words", "episode_id", "text", "start_ms", "end_ms", "granularity").where("lower(trim(granularity)) = 'sentence' and start_ms is not null and end_ms is not null")
    return writers.plain_ass(w, "episode_id")


@query(f"""WITH {A.TL}, c AS (SELECT episode_id, text, start_ms, end_ms, row_number() OVER (PARTITION BY episode_id ORDER BY start_ms, end_ms, text) AS n FROM tl WHERE scene_index = 0)
SELECT episode_id, string_agg(n || chr(10) || printf('%02d:%02d:%02d,%03d', greatest(start_ms, 0) // 3600000, greatest(start_ms, 0) // 60000 % 60, greatest(start_ms, 0) // 1000 % 60, greatest(start_ms, 0) % 1000) || ' --> '
 || printf('%02d:%02d:%02d,%03d', greatest(end_ms, 0) // 3600000, greatest(end_ms, 0) // 60000 % 60, greatest(end_ms, 0) // 1000 % 60, greatest(end_ms, 0) % 1000) || chr(10) || text || chr(10), chr(10) ORDER BY n) AS text FROM c GROUP BY 1""")
def srt_documents(spark: SparkSession, d: str) -> DataFrame:
    return writers.srt(A.timeline(spark, d).where("scene_index = 0"), "episode_id")


@query(f"""WITH {A.TL}, w AS (SELECT episode_id, string_agg(CAST(to_json({{'start_ms': start_ms, 'end_ms': end_ms, 'scene_index': scene_index, 'text': text}}) AS VARCHAR), ',' ORDER BY start_ms, end_ms, scene_index, text) AS ws FROM tl GROUP BY 1),
s AS (SELECT episode_id, scene_index, min(start_ms) AS a, max(end_ms) AS z FROM tl GROUP BY 1, 2), t AS (SELECT episode_id, string_agg(CAST(to_json({{'scene_index': scene_index, 'start_ms': a, 'end_ms': z}}) AS VARCHAR), ',' ORDER BY scene_index) AS ss, max(z) AS dur FROM s GROUP BY 1)
SELECT episode_id, sha256('{{"version":1,"granularity":"word","duration_ms":' || dur || ',"scenes":[' || ss || '],"words":[' || ws || ']}}') AS digest FROM w JOIN t USING (episode_id)""")
def word_documents(spark: SparkSession, d: str) -> DataFrame:
    units = A.timeline(spark, d)
    return writers.words_document(units, timeline.scene_windows(units, SCENE), "episode_id").select("episode_id", F.sha2("text", 256).alias("digest"))


@query("""SELECT episode_id, 'fingerprint_unrecorded' AS code, 'warning' AS severity FROM raw_files GROUP BY 1 HAVING count(*) >= 2 AND count(*) FILTER (file_id % 3 = 0) = 0""")
def unrecorded_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Episodes of two files or more of which none has a number that three divides."""
    f = load(spark, d, "raw_files", "file_id", "episode_id", "file_kind", "payload")
    whole = fingerprint.manifest(f, ["episode_id"], "file_id", "payload")
    return fingerprint.unrecorded(whole, f.where("file_id % 3 = 0"), ["episode_id"], 2)
