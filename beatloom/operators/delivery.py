"""Checks before delivery, and the relations they rest on: durations, files, images, characters, boards and states.

Findings are keys, ``code`` and ``severity`` (:func:`gates.judge`).  A null that
a rule compares is no finding unless a rule is about its absence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .gates import judge
from .ordered import previous_row

# Fixed values.
SCENE_AUDIO_MS, TAIL_MS, CONCAT_MS, TRACK_MS = 200, 500, 150, 500
WIDTH, HEIGHT, ASPECT_LEAST_OFF, ASPECT_FAMILY, LONG_EDGE = 1920, 1080, 0.02, 0.03, 1920
CHALK_LUMA, PAPER_LUMA, CORNER_OFF = 130.0, 185.0, 60.0
SHEET_EDGE, PICTURES = 512, ("png", "jpg", "jpeg", "webp")
FOG = 120
GLYPH_AREA, GLYPH_H, GLYPH_W, GLYPH_ASPECT, GLYPH_DIST, FAINT = 25, (8, 70), (4, 90), 3.0, 140, 45
ROW_CENTRE, ROW_BOTTOMS, ROW_SPAN, ROW_GLYPHS, ROW_COVER = 45, 20, 60, 4, 0.30
JOINED_W, JOINED_H, JOINED_EDGE, RESIDUAL = 300, 40, 60, 0.010
DETAIL_LEN, DETAIL_BOX = 70, 50


# scenes and tracks


def annotation_presence(scenes: DataFrame, annotations: DataFrame, keys: list[str]) -> DataFrame:
    """Scenes without an annotation, or with one of no elements or no duration.

    ``annotations`` has keys, ``n_elements`` and ``duration_ms``.
    """
    a = annotations.select(*keys, "n_elements", "duration_ms", F.lit(True).alias("_there"))
    rows = scenes.select(*keys).distinct().join(a, keys, "left")
    there = F.coalesce("_there", F.lit(False))
    bare = (F.coalesce("n_elements", F.lit(0)) == 0) | (F.coalesce("duration_ms", F.lit(0)) == 0)
    return judge(rows, keys, [("annotation_missing", "blocking", ~there), ("annotation_empty", "blocking", there & bare)])


def scene_durations(scenes: DataFrame, keys: list[str]) -> DataFrame:
    """Scenes whose picture (``video_ms``) and sound (``audio_ms``) differ by more than 200 ms, or whose last
    element (``last_ms``) leaves less than 500 ms of the scene (``duration_ms``)."""
    return judge(scenes, keys, [("scene_audio", "blocking", F.abs(F.col("video_ms") - F.col("audio_ms")) > SCENE_AUDIO_MS),
                                ("tail", "blocking", F.col("duration_ms") - F.col("last_ms") < TAIL_MS)])


def track_durations(scenes: DataFrame, tracks: DataFrame, keys: list[str]) -> DataFrame:
    """Episodes whose joined track (``concat_ms``) is off the sum of its scenes by more than 150 ms, or whose narration
    (``track_ms``) is off the table's total (``total_ms``) by more than 500 ms."""
    rows = tracks.join(scenes.groupBy(*keys).agg(F.sum("audio_ms").alias("_sum")), keys, "left")
    return judge(rows, keys, [("concat", "blocking", F.abs(F.col("concat_ms") - F.coalesce("_sum", F.lit(0))) > CONCAT_MS),
                              ("track", "blocking", F.abs(F.col("track_ms") - F.col("total_ms")) > TRACK_MS)])


def voice_drift(used: DataFrame, expected: DataFrame, keys: list[str], voice: str = "voice") -> DataFrame:
    """Episodes told by another voice than expected; where either is unknown there is nothing to say."""
    rows = used.select(*keys, F.col(voice).alias("_u")).join(expected.select(*keys, F.col(voice).alias("_e")), keys)
    return judge(rows, keys, [("voice_drift", "warning", (F.col("_u") != "") & (F.col("_e") != "") & (F.col("_u") != F.col("_e")))])


def unconfirmed(states: DataFrame, keys: list[str], flags: Column, names: tuple[str, ...] = ("content_confirmed", "visual_confirmed")) -> DataFrame:
    """Gates that a state's map of ``flags`` does not have as true; a null map confirms nothing."""
    return judge(states, keys, [(n, "warning", ~F.coalesce(F.try_element_at(flags, F.lit(n)), F.lit(False))) for n in names])


def stale(derived: DataFrame, sources: DataFrame, keys: list[str], time: str, code: str = "stale") -> DataFrame:
    """What was derived before its source was last changed; what lacks either is passed over."""
    rows = derived.groupBy(*keys).agg(F.max(time).alias("_d")).join(sources.groupBy(*keys).agg(F.max(time).alias("_s")), keys)
    return judge(rows, keys, [(code, "warning", F.col("_d") < F.col("_s"))])


# images


def image_size(images: DataFrame, keys: list[str]) -> DataFrame:
    """Images that are not 16 to 9, or short of 1920 pixels on the longer side."""
    off = F.abs(F.col("width") / F.nullif(F.col("height"), F.lit(0)) - WIDTH / HEIGHT)
    return judge(images, keys, [("aspect", "blocking", F.coalesce(off > ASPECT_LEAST_OFF, F.lit(True))), ("long_edge", "blocking", F.greatest("width", "height") < LONG_EDGE)])


def size_decision(images: DataFrame) -> DataFrame:
    """Add ``decision`` (``keep``, ``refuse``, ``scale``, ``crop``) and the box to cut out before scaling.

    Images near 16 to 9 are cut about their middle to it, the wide ones at the
    sides and the high ones above and below; others are left as they are.
    """
    w, h, goal = F.col("width"), F.col("height"), WIDTH / HEIGHT
    ratio = w / F.greatest(h, F.lit(1))
    exact, wide = F.abs(ratio - goal) <= 1e-6, ratio > goal
    decision = (F.when((w == WIDTH) & (h == HEIGHT), "keep").when(F.abs(ratio - goal) > ASPECT_FAMILY, "refuse").when(exact, "scale").otherwise("crop"))
    keep_w = F.when(wide & ~exact, T.half_even(h * goal)).otherwise(w.cast("bigint"))
    keep_h = F.when(~wide & ~exact, T.half_even(w / goal)).otherwise(h.cast("bigint"))
    cut = F.col("decision").isin("scale", "crop")
    rows = images.withColumn("decision", decision)
    return rows.withColumn("box", F.when(cut, F.struct(F.floor((w - keep_w) / 2).alias("x"), F.floor((h - keep_h) / 2).alias("y"), keep_w.alias("w"), keep_h.alias("h"))))


def corner_findings(images: DataFrame, keys: list[str], corners: Column, mode: Column, board: Column) -> DataFrame:
    """One finding for each corner that is too light or off the board's colour (chalk), or too dark (paper).

    ``corners`` is an array of mean colours, each an array of channels; ``board``
    the theme's colour in the same order, null if it has none.
    """
    rows = images.select(*keys, mode.alias("_mode"), board.alias("_board"), F.posexplode(corners).alias("corner", "_c"))
    luma = F.aggregate("_c", F.lit(0.0), lambda s, v: s + v) / F.size("_c")
    off = F.array_max(F.zip_with("_c", "_board", lambda a, b: F.abs(a - b)))
    chalk = F.col("_mode") == "chalk"
    return judge(rows, [*keys, "corner"], [("corner_light", "blocking", chalk & (luma > CHALK_LUMA)), ("corner_colour", "blocking", chalk & (off > CORNER_OFF)),
                                           ("corner_dark", "blocking", ~chalk & (luma < PAPER_LUMA))])


def likely_text(lines: DataFrame, keys: list[str], least: int = 8) -> DataFrame:
    """Images whose lines of text hold ``least`` components together; ``lines`` has keys and ``n_parts``."""
    return judge(lines.groupBy(*keys).agg(F.sum("n_parts").alias("_n")), keys, [("likely_text", "warning", F.col("_n") >= least)])


def watermark_glyphs(parts: DataFrame, keys: list[str], width: int, height: int, right: bool = True, bottom: bool = True) -> DataFrame:
    """(keys, x, y, w, h, row_no) of the components of a band that make a line of faint, small letters.

    ``parts`` has ``x, y, w, h, area, contrast``; the band is ``width`` by
    ``height`` and lies at the outer corner told by ``right`` and ``bottom``.
    Letters are gathered into rows about the middle of a row's first; the row
    of the most letters that is evenly set, wide enough and no picture is taken
    (``row_no`` 1), else single pieces that hug the corner (``row_no`` 0).
    """
    faint = (F.col("area") >= GLYPH_AREA) & F.col("h").between(*GLYPH_H) & (F.col("contrast") <= GLYPH_DIST)
    letter = F.col("w").between(*GLYPH_W) & (F.col("w") / F.greatest("h", F.lit(1)) <= GLYPH_ASPECT)
    at_side = F.col("x") + F.col("w") >= width - JOINED_EDGE if right else F.col("x") <= JOINED_EDGE
    at_end = F.col("y") + F.col("h") >= height - JOINED_EDGE if bottom else F.col("y") <= JOINED_EDGE
    hugging = (F.col("h") <= JOINED_H) & (F.col("w") > GLYPH_W[1]) & (F.col("w") <= JOINED_W) & at_side & at_end
    box = F.struct("x", "y", "w", "h")
    item = F.struct((F.col("y") + F.col("h") / 2).alias("cy"), box.alias("b"))
    seen = parts.where(faint).withColumn("_letter", letter)
    packed = seen.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("_letter"), item))).alias("_g"), F.collect_list(F.when(~F.col("_letter") & hugging, box)).alias("_hug"))

    def step(acc: Column, g: Column) -> Column:
        opens = F.abs(g["cy"] - acc["middle"]) > ROW_CENTRE
        no = F.when(opens, acc["no"] + 1).otherwise(acc["no"])
        return F.struct(F.when(opens, g["cy"]).otherwise(acc["middle"]).alias("middle"), no.alias("no"), F.concat(acc["nos"], F.array(no)).alias("nos"))

    begin = F.struct(F.lit(-1e18).alias("middle"), F.lit(0).alias("no"), F.array().cast("array<int>").alias("nos"))
    rows = packed.withColumn("_nos", F.aggregate("_g", begin, step, lambda a: a["nos"]))
    members = lambda no: F.transform(F.filter(F.arrays_zip("_g", "_nos"), lambda z: z["_nos"] == no), lambda z: z["_g"]["b"])
    listed = F.transform(F.array_distinct("_nos"), members)
    least = lambda bs, f: F.array_min(F.transform(bs, f))
    most = lambda bs, f: F.array_max(F.transform(bs, f))

    def is_text(bs: Column) -> Column:
        low = lambda b: b["y"] + b["h"]
        cover = F.aggregate(bs, F.lit(0.0), lambda s, b: s + b["w"] * b["h"])
        return ((F.size(bs) >= ROW_GLYPHS) & (cover <= ROW_COVER * width * height) & (most(bs, low) - least(bs, low) <= ROW_BOTTOMS)
                & (most(bs, lambda b: b["x"] + b["w"]) - least(bs, lambda b: b["x"]) >= ROW_SPAN))

    texts = rows.withColumn("_rows", F.filter(listed, is_text))
    longest = F.array_max(F.transform("_rows", lambda bs: F.size(bs)))
    best = F.get(F.filter("_rows", lambda bs: F.size(bs) == longest), F.lit(0))
    picked = texts.select(*keys, F.coalesce(best, F.col("_hug")).alias("_b"), F.when(best.isNotNull(), 1).otherwise(0).alias("row_no"))
    return picked.select(*keys, "row_no", F.explode("_b").alias("b")).select(*keys, "b.x", "b.y", "b.w", "b.h", "row_no")


def residual(pixels: DataFrame, keys: list[str], contrast: str) -> DataFrame:
    """keys, ``residual_ratio``, ``removed``: the share of the cleaned pixels that still have a watermark's contrast, under one in a hundred when it is gone."""
    left = (F.col(contrast) > FAINT) & (F.col(contrast) <= GLYPH_DIST)
    ratio = F.count_if(left) / F.greatest(F.count("*"), F.lit(1))
    return pixels.groupBy(*keys).agg(ratio.alias("residual_ratio")).withColumn("removed", F.col("residual_ratio") < RESIDUAL)


def without_fog(points: DataFrame, keys: list[str], background: Column) -> DataFrame:
    """The strokes (keys) whose median colour is no grey-green haze: green the strongest and the sum 120 above the background's.

    ``points`` has ``r``, ``g``, ``b`` of the board under the stroke; medians
    are cut to whole numbers.
    """
    middle = points.groupBy(*keys).agg(*[F.floor(F.median(c)).alias(c) for c in ("r", "g", "b")])
    haze = (F.col("g") >= F.col("r")) & (F.col("g") >= F.col("b")) & (F.col("r") + F.col("g") + F.col("b") - background > FOG)
    return middle.where(~haze)


def stroke_slots(strokes: DataFrame, nested: DataFrame, keys: list[str], stroke_id: str) -> DataFrame:
    """Add ``slot``: 0 for outlines, 1 for fills, 2 for details, which are small or lie within another outline.

    ``strokes`` has ``is_fill``, ``length``, ``w`` and ``h``; ``nested`` the keys
    and ids of the outlines within others.
    """
    inner = nested.select(*keys, stroke_id).distinct().withColumn("_in", F.lit(True))
    small = (F.col("length") < DETAIL_LEN) & (F.col("w") < DETAIL_BOX) & (F.col("h") < DETAIL_BOX)
    rows = strokes.join(inner, [*keys, stroke_id], "left")
    return rows.withColumn("slot", F.when(F.col("is_fill"), 1).when(small | F.coalesce("_in", F.lit(False)), 2).otherwise(0)).drop("_in")


def hand_contract(hands: DataFrame, keys: list[str]) -> DataFrame:
    """Hands without alpha, of another size than declared, or whose tip lies outside the picture or is unknown."""
    inside = (F.col("tip_x") >= 0) & (F.col("tip_x") < F.col("width")) & (F.col("tip_y") >= 0) & (F.col("tip_y") < F.col("height"))
    return judge(hands, keys, [("hand_mode", "blocking", ~F.col("mode").eqNullSafe("RGBA")),
                               ("hand_size", "blocking", (F.col("width") != F.col("want_width")) | (F.col("height") != F.col("want_height"))),
                               ("hand_tip", "blocking", ~F.coalesce(inside, F.lit(False)))])


# characters


def character_findings(characters: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """(group, order, code, severity): characters without an id, with one that stands before in the list, or without fixed traits.

    ``characters`` has ``id`` and ``n_immutable``; the first of several equal
    ids is the character, the others repeat it.
    """
    named = characters.withColumn("_id", F.trim(F.coalesce(F.col("id").cast("string"), F.lit(""))))
    first = named.where("_id <> ''").groupBy(*group, "_id").agg(F.min(F.struct(*order)).alias("_first"))
    rows = named.join(first, [*group, "_id"], "left")
    has_id = F.col("_id") != ""
    return judge(rows, [*group, *order], [("id_missing", "blocking", ~has_id), ("id_repeated", "blocking", has_id & (F.struct(*order) != F.col("_first"))),
                                          ("immutable_missing", "blocking", has_id & (F.coalesce("n_immutable", F.lit(0)) == 0))])


def reference_findings(references: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Reference pictures that are not there (``is_there``) or of no picture format."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    there = F.coalesce("is_there", F.lit(False))
    return judge(references, keys, [("reference_missing", "blocking", ~there), ("reference_format", "blocking", there & ~ending.isin(*PICTURES))])


def sheet_findings(sheets: DataFrame, keys: list[str]) -> DataFrame:
    """Character sheets under 512 pixels on either side."""
    return judge(sheets, keys, [("sheet_small", "blocking", (F.col("width") < SHEET_EDGE) | (F.col("height") < SHEET_EDGE))])


def character_manifest(characters: DataFrame, key: str, sheet: Column) -> DataFrame:
    """(key, text): the characters of each episode with their pictures, in order of ``position``, as JSON."""
    item = F.struct(F.col("id").alias("character_id"), T.first_nonempty(F.col("name"), F.col("id")).alias("name"), F.col("reference_images").alias("reference_images"),
                    sheet.alias("canonical_sheet"), F.array(F.lit("canonical_sheet"), F.lit("reference_images")).alias("reference_priority"))
    rows = characters.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", item.alias("i")))).alias("_c"))
    return rows.select(key, T.canonical_json(F.transform("_c", lambda c: c["i"])).alias("text"))


# boards and states


def synced(scenes: DataFrame, boards: DataFrame, keys: list[str]) -> DataFrame:
    """A board row for each scene: the one it has, else a pending stub; boards of other scenes are dropped.

    ``boards`` has keys, ``file`` and ``status``.
    """
    known = boards.select(*keys, F.struct("file", "status").alias("_b"))
    rows = scenes.join(known, keys, "left")
    return rows.select(*scenes.columns, "_b.file", F.coalesce("_b.status", F.lit("pending")).alias("status"))


def renumbered(scenes: DataFrame, keys: list[str], order: list[str], id_col: str) -> DataFrame:
    """Add ``new_id``, the scene's number in order, and ``renamed``."""
    no = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    rows = scenes.withColumn("new_id", F.format_string("scene-%02d", no))
    return rows.withColumn("renamed", ~F.coalesce(F.col(id_col), F.lit("")).eqNullSafe(F.col("new_id")))


def state_log(states: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """The states that say something else than the one before: what a writer that writes only changes would have written."""
    before = previous_row(states, keys, order, F.struct(F.col(state).alias("s")), "_before")
    return before.where(F.col("_before").isNull() | ~F.col("_before.s").eqNullSafe(F.col(state))).drop("_before")


def latest_state(log: DataFrame, keys: list[str], order: list[str], state: str, time: str) -> DataFrame:
    """keys, ``state``, ``updated``: the last of each."""
    return log.groupBy(*keys).agg(F.max_by(F.struct(F.col(state).alias("state"), F.col(time).alias("updated")), F.struct(*order)).alias("_s")).select(*keys, "_s.*")


def import_gate(boards: DataFrame, findings: DataFrame, keys: list[str], board: str) -> DataFrame:
    """(keys, board, status): ``missing`` without a file, ``failed`` with a blocking finding, else ``ok``.

    ``boards`` has ``is_there``; ``findings`` keys, board and ``severity``.
    """
    bad = findings.where("severity = 'blocking'").select(*keys, board).distinct().withColumn("_bad", F.lit(True))
    rows = boards.join(bad, [*keys, board], "left")
    status = F.when(~F.coalesce("is_there", F.lit(False)), "missing").when(F.col("_bad"), "failed").otherwise("ok")
    return rows.select(*keys, board, status.alias("status"))


def exit_codes(statuses: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ``exit_code``: 0 where every board is ok, else 2."""
    return statuses.groupBy(*keys).agg(F.when(F.bool_and(F.col("status") == "ok"), 0).otherwise(2).alias("exit_code"))
