"""Checks before delivery on small frames: nulls, ties, repeated rows, empty tables."""

from pyspark.sql import functions as F

from beatloom.operators import delivery as D
from beatloom.operators import lint, raster, spatial, timeline


def codes(df, *keys):
    return sorted((*(r[k] for k in keys), r.code) for r in df.collect())


def test_scenes_and_tracks(spark):
    scenes = spark.createDataFrame([("e", 0), ("e", 1), ("e", 2), ("e", 3), ("e", 3)], "e string, s int")
    notes = spark.createDataFrame([("e", 0, 2, 900), ("e", 1, 0, 900), ("e", 2, 2, None)], "e string, s int, n_elements int, duration_ms int")
    assert codes(D.annotation_presence(scenes, notes, ["e", "s"]), "s") == [(1, "annotation_empty"), (2, "annotation_empty"), (3, "annotation_missing")]
    takes = spark.createDataFrame([("e", 0, 1000, 1200, 5000, 4500), ("e", 1, 1000, 1201, 5000, 4501), ("e", 2, None, 5, None, 9)], "e string, s int, video_ms int, audio_ms int, duration_ms int, last_ms int")
    assert codes(D.scene_durations(takes, ["e", "s"]), "s") == [(1, "scene_audio"), (1, "tail")]
    tracks = spark.createDataFrame([("e", 2406 + 150, 900, 400), ("f", 151, 0, 501), ("g", None, None, 1)], "e string, concat_ms int, track_ms int, total_ms int")
    assert codes(D.track_durations(takes, tracks, ["e"]), "e") == [("f", "concat"), ("f", "track")]
    assert D.scene_durations(takes.limit(0), ["e"]).count() == 0


def test_voices_confirmations_and_age(spark):
    used = spark.createDataFrame([("a", "v1"), ("b", "v1"), ("c", None), ("d", "")], "e string, voice string")
    want = spark.createDataFrame([("a", "v1"), ("b", "v2"), ("c", "v2"), ("d", "v2")], "e string, voice string")
    assert codes(D.voice_drift(used, want, ["e"]), "e") == [("b", "voice_drift")]
    states = spark.createDataFrame([("a", {"content_confirmed": True, "visual_confirmed": False}), ("b", None)], "e string, m map<string,boolean>")
    assert codes(D.unconfirmed(states, ["e"], F.col("m")), "e") == [("a", "visual_confirmed"), ("b", "content_confirmed"), ("b", "visual_confirmed")]
    old, new = (spark.createDataFrame(r, "e string, t int") for r in ([("a", 1), ("a", 5), ("b", 1), ("c", None)], [("a", 5), ("b", 2), ("c", 1), ("d", 9)]))
    assert codes(D.stale(old, new, ["e"], "t"), "e") == [("b", "stale")]


def test_image_sizes(spark):
    images = spark.createDataFrame([(1, 1920, 1080), (2, 1792, 1024), (3, 1280, 720), (4, 1000, 1000), (5, 1900, 1069), (6, 10, 0), (7, 1921, 1080)], "id int, width int, height int")
    assert codes(D.image_size(images, ["id"]), "id") == [(2, "aspect"), (2, "long_edge"), (3, "long_edge"), (4, "aspect"), (4, "long_edge"), (5, "long_edge"), (6, "aspect"), (6, "long_edge")]
    got = {r.id: (r.decision, tuple(r.box) if r.box else None) for r in D.size_decision(images).collect()}
    assert got == {1: ("keep", None), 2: ("crop", (0, 8, 1792, 1008)), 3: ("scale", (0, 0, 1280, 720)), 4: ("refuse", None), 5: ("crop", (0, 0, 1900, 1069)), 6: ("refuse", None), 7: ("crop", (0, 0, 1920, 1080))}


def test_corners_and_text(spark):
    df = spark.createDataFrame([("k", "chalk", [[20.0, 30.0, 40.0], [200.0, 200.0, 200.0], [20.0, 30.0, 101.0]]), ("p", "paper", [[200.0, 190.0, 180.0], [100.0, 100.0, 100.0]])], "id string, mode string, c array<array<double>>")
    got = D.corner_findings(df, ["id"], F.col("c"), F.col("mode"), F.when(F.col("id") == "k", F.array(F.lit(20.0), F.lit(30.0), F.lit(40.0))))
    assert codes(got, "id", "corner") == [("k", 1, "corner_colour"), ("k", 1, "corner_light"), ("k", 2, "corner_colour"), ("p", 1, "corner_dark")]
    lines = spark.createDataFrame([("a", 5), ("a", 3), ("b", 7)], "id string, n_parts int")
    assert codes(D.likely_text(lines, ["id"]), "id") == [("a", "likely_text")]


def test_watermark_letters(spark):
    word = lambda i, x, y: (i, x, y, 20, 30, 400, 80.0)
    rows = [word("a", 400 + 25 * k, 150 + k % 2) for k in range(5)] + [word("a", 10, 20), ("a", 300, 150, 100, 20, 900, 80.0), ("a", 520, 150, 20, 30, 400, 170.0)]
    rows += [word("b", 400 + 10 * k, 150) for k in range(4)]  # not wide enough
    rows += [("c", 380, 175, 200, 25, 4000, 90.0), ("c", 0, 175, 200, 25, 4000, 90.0)]  # run together, in the corner and not
    rows += [word("d", 100 * k, 100 + 22 * (k % 2)) for k in range(5)]  # bottoms apart
    rows += [word("e", 30 * k, 100) for k in range(4)] + [word("e", 30 * k, 20) for k in range(5)]  # the longer row
    parts = spark.createDataFrame(rows, "id string, x int, y int, w int, h int, area int, contrast double")
    got = sorted((r.id, r.row_no, r.x, r.y) for r in D.watermark_glyphs(parts, ["id"], 600, 200).collect())
    assert got == [*(("a", 1, 400 + 25 * k, 150 + k % 2) for k in range(5)), ("c", 0, 380, 175), *(("e", 1, 30 * k, 20) for k in range(5))]
    assert D.watermark_glyphs(parts.limit(0), ["id"], 600, 200).count() == 0
    left = spark.createDataFrame([("a", 46), ("a", 45), ("a", 141), ("b", 0)], "id string, c int")
    assert {r.id: (round(r.residual_ratio, 3), r.removed) for r in D.residual(left, ["id"], "c").collect()} == {"a": (0.333, False), "b": (0.0, True)}


def test_strokes_and_hands(spark):
    points = spark.createDataFrame([("s", 1, 50, 200, 60)] * 3 + [("s", 2, 250, 200, 60), ("s", 3, 10, 90, 20)], "k string, s int, r int, g int, b int")
    assert sorted(r.s for r in D.without_fog(points, ["k", "s"], F.lit(30)).collect()) == [2, 3]
    strokes = spark.createDataFrame([("s", 1, False, 69.0, 49, 49), ("s", 2, False, 70.0, 9, 9), ("s", 3, True, 5.0, 5, 5), ("s", 4, False, 900.0, 90, 90), ("s", 5, False, 900.0, 90, 90)], "k string, s int, is_fill boolean, length double, w int, h int")
    nested = spark.createDataFrame([("s", 4), ("s", 4), ("t", 5)], "k string, s int")
    assert {r.s: r.slot for r in D.stroke_slots(strokes, nested, ["k"], "s").collect()} == {1: 2, 2: 0, 3: 1, 4: 2, 5: 0}
    hands = spark.createDataFrame([(1, "RGBA", 204, 317, 204, 317, 6, 8), (2, "RGB", 204, 300, 204, 317, 204, 8), (3, None, 5, 5, None, None, None, 1)], "id int, mode string, width int, height int, want_width int, want_height int, tip_x int, tip_y int")
    assert codes(D.hand_contract(hands, ["id"]), "id") == [(2, "hand_mode"), (2, "hand_size"), (2, "hand_tip"), (3, "hand_mode"), (3, "hand_tip")]


def test_characters(spark):
    rows = [("e", 0, "a", 2), ("e", 1, " ", 2), ("e", 2, None, 0), ("e", 3, "a ", 1), ("e", 4, "b", 0), ("e", 5, "a", None), ("f", 0, "a", 1)]
    cast = spark.createDataFrame(rows, "e string, i int, id string, n_immutable int").withColumn("code", F.lit("x"))
    assert codes(D.character_findings(cast, ["e"], ["i"]), "e", "i") == [("e", 1, "id_missing"), ("e", 2, "id_missing"), ("e", 3, "id_repeated"), ("e", 4, "immutable_missing"), ("e", 5, "id_repeated"), ("e", 5, "immutable_missing")]
    refs = spark.createDataFrame([(1, "x/a.PNG", True), (2, "a.gif", True), (3, "a.png", False), (4, "png", True), (5, "a.png", None)], "k int, p string, is_there boolean")
    assert codes(D.reference_findings(refs, ["k"], "p"), "k") == [(2, "reference_format"), (3, "reference_missing"), (4, "reference_format"), (5, "reference_missing")]
    assert codes(D.sheet_findings(spark.createDataFrame([(1, 512, 512), (2, 511, 900)], "k int, width int, height int"), ["k"]), "k") == [(2, "sheet_small")]


def test_boards_and_states(spark):
    scenes = spark.createDataFrame([("e", "scene-01"), ("e", "scene-02")], "e string, scene string")
    boards = spark.createDataFrame([("e", "scene-02", "b.png", "ok"), ("e", "scene-09", "z.png", "ok")], "e string, scene string, file string, status string")
    assert sorted(tuple(r) for r in D.synced(scenes, boards, ["e", "scene"]).collect()) == [("e", "scene-01", None, "pending"), ("e", "scene-02", "b.png", "ok")]
    named = spark.createDataFrame([("e", 0, "scene-01"), ("e", 4, "scene-03b"), ("e", 9, None)], "e string, i int, id string")
    assert sorted((r.i, r.new_id, r.renamed) for r in D.renumbered(named, ["e"], ["i"], "id").collect()) == [(0, "scene-01", False), (4, "scene-02", True), (9, "scene-03", True)]
    log = spark.createDataFrame([("e", 1, "a"), ("e", 2, "a"), ("e", 3, None), ("e", 4, None), ("e", 5, "a"), ("f", 1, None)], "e string, t int, s string")
    assert sorted((r.e, r.t) for r in D.state_log(log, ["e"], ["t"], "s").collect()) == [("e", 1), ("e", 3), ("e", 5), ("f", 1)]
    assert sorted(tuple(r) for r in D.latest_state(log, ["e"], ["t"], "s", "t").collect()) == [("e", "a", 5), ("f", None, 1)]
    found = spark.createDataFrame([("e", "scene-01", "warning"), ("e", "scene-02", "blocking"), ("e", "scene-02", "blocking")], "e string, scene string, severity string")
    there = scenes.unionByName(spark.createDataFrame([("e", "scene-03"), ("f", "scene-01")], "e string, scene string")).withColumn("is_there", F.col("scene") != "scene-03")
    statuses = D.import_gate(there, found, ["e"], "scene")
    assert sorted((r.e, r.scene, r.status) for r in statuses.collect()) == [("e", "scene-01", "ok"), ("e", "scene-02", "failed"), ("e", "scene-03", "missing"), ("f", "scene-01", "ok")]
    assert sorted(tuple(r) for r in D.exit_codes(statuses, ["e"]).collect()) == [("e", 2), ("f", 0)]


def test_hand_and_labels(spark):
    tasks = spark.createDataFrame([("a", "draw", 1000, 2000), ("a", "move", 3000, 3500), ("a", "draw", 3600, 4000), ("a", "gaze", 4000, 6000), ("b", "gaze", 0, 900), ("c", "draw", 500, 400)], "k string, kind string, start_ms bigint, end_ms bigint")
    got = sorted((r.k, r.frame_no) for r in timeline.hand_frames(tasks, "k", 10).collect() if r.k != "c")
    assert got == [("a", n) for n in [*range(7, 21), 36, 37, 38, 39, 40, 41]]
    flags = spark.createDataFrame([([True, True, True, False, False, True],), ([],)], "f array<boolean>")
    alphas = [[round(a, 3) for a in r.a] for r in flags.select(timeline.faded(F.col("f"), 10).alias("a")).collect()]
    assert alphas == [[0.417, 0.833, 1.0, 0.583, 0.167, 0.583], []]
    at = spark.createDataFrame([(0, 100), (250, 100), (900, 100), (5, None)], "t int, r int").select(timeline.label_alpha(F.col("t"), F.col("r")).alias("a"))
    assert [r.a for r in at.collect()] == [0.0, 0.5, 1.0, 0.0]


def test_grounds_keys_and_tips(spark):
    rows = [("m", x, y, *((60, 60, 60) if (x + y) % 3 else (200, 10, 10))) for x in range(8) for y in range(8)]
    rows += [("near", x, y, 85, 75, 60) for x in range(8) for y in range(8)] + [("few", x, y, *((0, 0, 0) if (x in (0, 7) and y in (0, 7)) else (250, 250, 250))) for x in range(8) for y in range(8)]
    px = spark.createDataFrame(rows, "i string, x int, y int, r int, g int, b int")
    plan = raster.background_plan(px, "i", "x", "y", 8, 8, 1, (90, 80, 60))
    assert {r.i: r.decision for r in plan.collect()} == {"m": "move", "near": "near", "few": "move"}
    moved = {(r.i, r.x, r.y): (r.r, r.g, r.b) for r in raster.moved_background(px, plan, "i", (90, 80, 60)).collect()}
    assert moved["m", 0, 1] == (90, 80, 60) and moved["m", 0, 0] == (200, 10, 10) and moved["near", 3, 3] == (85, 75, 60)
    k = spark.createDataFrame([(0.0, 0.0), (500.0, 0.0), (85.0, 0.0), (None, 1.0)], "d double, s double").select(raster.key_alpha(F.col("d"), F.col("s")).alias("a"))
    assert [r.a for r in k.collect()] == [0, 255, 88, 0]
    tips = spark.createDataFrame([("a", 5, 50, 200, 200, 200, 255), ("a", 6, 50, 200, 200, 200, 255), ("a", 90, 50, 200, 200, 200, 255), ("a", 0, 99, 200, 200, 200, 100), ("b", 1, 1, 9, 9, 9, 255)], "i string, x int, y int, r int, g int, b int, alpha int")
    assert [tuple(r) for r in raster.chalk_tips(tips, "i", "x", "y").collect()] == [("a", 6, 50)]


def test_layout_findings(spark):
    rects = spark.createDataFrame([("s", 1, 0, 0, 1900, 1000), ("s", 2, 10, 10, 1900, 1000), ("t", 1, 0, 0, 10, 10)], "scene string, id int, x int, y int, w int, h int")
    assert sorted((r.scene, r.code, r.n) for r in spatial.layout_findings(rects, ["scene"], "id").collect()) == [("s", "crowded", 2), ("s", "overlap", 1)]
    texts = spark.createDataFrame([(1, "{"), (2, "{}"), (3, None)], "k int, t string")
    assert [(r.k, r.code) for r in lint.layout_files(texts, ["k"], "t").collect()] == [(1, "IR.BAD_LAYOUT")]
