"""Layouts, strokes, rasters, rules, gates, readers, writers, streams."""

import json
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from beatloom.operators import fingerprint, gates, lint, raster, spatial
from beatloom.sources import readers, writers
from beatloom.streaming import sliding_activity, speech_sessions


def rects(spark, rows):
    return spark.createDataFrame([(s, i, *r) for s, i, r in rows], "scene string, id int, x int, y int, w int, h int")


def test_overlaps_and_assignment_equal_brute_force(spark):
    rng = random.Random(10)
    rows = [(rng.choice("ab"), i, (rng.randrange(1500), rng.randrange(900), rng.randrange(1, 600), rng.randrange(1, 500))) for i in range(80)] + [("a", 99, (5, 5, 0, 9))]

    def iou(p, q):
        w, h = min(p[0] + p[2], q[0] + q[2]) - max(p[0], q[0]), min(p[1] + p[3], q[1] + q[3]) - max(p[1], q[1])
        i = max(w, 0) * max(h, 0)
        return i / max(p[2] * p[3] + q[2] * q[3] - i, 1)

    df = rects(spark, rows)
    want = sorted((s, i, j) for s, i, p in rows for t, j, q in rows if s == t and i < j and iou(p, q) > 0.10)
    assert sorted((r.scene, r.id_a, r.id_b) for r in spatial.overlaps(df, ["scene"], "id").collect()) == want
    points = [(rng.choice("abc"), i, rng.randrange(1900), rng.randrange(1200)) for i in range(200)]
    pts = spark.createDataFrame(points, "scene string, p int, px int, py int")
    hit = {}
    for s, i, x, y in points:
        inside = [(r[2] * r[3], j) for t, j, r in rows if t == s and r[0] <= x < r[0] + r[2] and r[1] <= y < r[1] + r[3]]
        if inside:
            hit[i] = min(inside)[1]
    got = spatial.assign_points(pts, df.withColumn("o", F.col("id")), ["scene"], "p", "id", "o").collect()
    assert {r.p: r.id for r in got} == hit


REPEATED = [("a", 100 * k + i, r) for k, r in enumerate([(0, 0, 300, 300), (10, 10, 300, 300), (20, 20, 40, 40)]) for i in range(60)]  # three boxes, 60 times each
#: An id twice in one box, an id in three boxes of which two cross, a row without an id, a box of no size.
ODD = [("a", 1, (0, 0, 9, 9)), ("a", 1, (0, 0, 9, 9)), ("a", 2, (0, 0, 9, 9)), ("a", 3, (1, 1, 9, 9)), ("a", 3, (2, 1, 9, 9)), ("a", 3, (500, 1, 9, 9)), ("a", None, (1, 1, 9, 9)),
       ("a", 4, (1, 1, 0, 9)), ("b", 1, (0, 0, 9, 9)), ("b", 3, (250, 250, 20, 20)), ("b", 5, (250, 250, 20, 20)), ("b", 6, (255, 255, 4, 4)), ("b", 6, (255, 255, 4, 4)), ("b", 7, (257, 257, 4, 4))]


def crossing(rows):
    """(scene, i, j) for every two rows, i < j, that cross by more than a tenth."""
    def iou(p, q):
        i = max(min(p[0] + p[2], q[0] + q[2]) - max(p[0], q[0]), 0) * max(min(p[1] + p[3], q[1] + q[3]) - max(p[1], q[1]), 0)
        return i / max(p[2] * p[3] + q[2] * q[3] - i, 1)

    return sorted((s, i, j) for s, i, p in rows for t, j, q in rows if s == t and None not in (i, j) and i < j and iou(p, q) > 0.10)


def most_joined(df):
    """The most rows that a join of ``df``, which has run, has given."""
    most, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        p = plans.pop()
        kind = p.getClass().getSimpleName()
        if "Join" in kind:
            most = max(most, p.metrics().apply("numOutputRows").value())
        if kind == "AdaptiveSparkPlanExec":
            plans.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            plans.append(p.plan())
        else:
            plans += [p.children().apply(i) for i in range(p.children().size())]
    return most


def test_layout_findings_count_pairs_of_equal_rectangles_once(spark):
    for rows in (ODD, REPEATED):
        found = spatial.layout_findings(rects(spark, rows), ["scene"], "id")
        pairs = crossing(rows)
        assert {r.scene: r.n for r in found.collect() if r.code == "overlap"} == {s: sum(t == s for t, _, _ in pairs) for s in {t for t, _, _ in pairs}}
    assert 0 < most_joined(found) <= len(REPEATED) < len(pairs)


def test_nested_asks_equal_rectangles_once_and_keeps_every_row(spark):
    found = spatial.nested(rects(spark, ODD), ["scene"], "id")
    assert sorted((r.scene, r.id) for r in found.collect()) == [("b", 6), ("b", 6), ("b", 7)]
    found = spatial.nested(rects(spark, REPEATED), ["scene"], "id")
    assert sorted(r.id for r in found.collect()) == list(range(200, 260))
    assert 0 < most_joined(found) <= len(REPEATED)


def test_overlaps_judge_equal_rectangles_once(spark):
    for rows in (ODD, REPEATED):
        found = spatial.overlaps(rects(spark, rows), ["scene"], "id")
        assert sorted((r.scene, r.id_a, r.id_b) for r in found.collect()) == crossing(rows)
    assert 0 < most_joined(found) <= 6  # pairs of three boxes


def test_nested_density_and_transitions(spark):
    df = rects(spark, [("scene-01", 1, (0, 0, 100, 100)), ("scene-01", 2, (10, 10, 20, 20)), ("scene-01", 3, (5, 5, 90, 90)), ("scene-02", 1, (7, 8, 10, 10)), ("scene-03", 1, (1, 2, 3, 4))])
    assert [r.id for r in spatial.nested(df, ["scene"], "id").collect()] == [2]
    assert spatial.density(df, ["scene"], 10_000).where("crowded").count() == 1
    t = spatial.transitions(df.withColumn("e", F.lit(1)), "e", "scene", "id").orderBy("source_scene").collect()
    assert [(r.source_scene, r.target_scene, r.source_panel, r.target_x, r.confidence) for r in t] == [("scene-01", "scene-02", 1, 7, "high"), ("scene-02", "scene-03", 1, 1, "high")]


def test_strokes(spark):
    long, beside, far = np.array([[0, 0], [100, 0]]), np.array([[10, 4], [20, 4], [30, 4]]), np.array([[0, 80], [60, 80]])
    assert spatial.drop_covered([beside, long, far]) == [1, 2]
    merged = spatial.merge_fragments([long, np.array([[110, 0], [150, 0]]), np.array([[105, 5], [105, 60]])])
    assert sorted(len(m) for m in merged) == [2, 4]
    joined = lambda *ps: [m.tolist() for m in spatial.merge_fragments([np.array(p) for p in ps])]
    assert joined([[0, 0], [50, 0]], [[60, 0], [99, 0]]) == [[[99, 0], [60, 0], [50, 0], [0, 0]]]
    assert joined([[0, 0], [50, 0]], [[79, 0], [99, 0]]) == [[[0, 0], [50, 0]], [[79, 0], [99, 0]]]  # 29 px
    assert joined([[0, 0], [50, 0]], [[50, 0], [50, 40]]) == [[[50, 40], [50, 0], [50, 0], [0, 0]]]  # ends that meet need no direction
    assert joined([[10, 0], [90, 0]], [[5, 0]]) == [[[5, 0], [10, 0], [90, 0]]] and len(joined([[0, 5], [0, 90]], [[0, 0]])) == 2  # a point lies level
    bent = [[0, 0], [40, 0], [40, 0], [40, 0], [44, 4], [45, 9]]  # the last step alone gives the direction
    assert len(joined(bent, [[45, 20], [45, 60]])) == 1 and len(joined(bent, [[55, 9], [95, 9]])) == 2
    assert [len(m) for m in joined([[0, 0], [90, 0]], [[110, 0], [160, 0]], [[95, 2], [99, 2]])] == [4, 2]  # joined ends are free no more
    assert spatial.group_strokes([far, long, np.array([[100, 10], [100, 17]])]) == [1, 0, 0]
    df = spark.createDataFrame([("a", 1, [(0, 0), (100, 0)]), ("a", 2, [(10, 4), (30, 4)]), ("a", 3, []), ("b", 1, [(5, 5)])], "k string, s int, pts array<struct<x:int,y:int>>")
    assert sorted((r.k, r.n_points) for r in spatial.simplify_strokes(df, ["k"], "s").collect()) == [("a", 2), ("b", 1)]


def test_raster(spark):
    steps = spark.createDataFrame([("slow", i, [4 * i] * 4) for i in range(21)] + [("cut", i, [20 if i < 10 else 200] * 4) for i in range(20)] + [("one", 0, [1] * 4)], "clip string, n int, v array<int>")
    got = {r.clip: (r.max_step, r.total_change) for r in raster.frame_changes(steps, "clip", "n", "v").collect()}
    assert got == {"slow": (4.0, 80.0), "cut": (180.0, 180.0), "one": (0.0, 0.0)}
    assert {r.clip: r.finding for r in raster.wipe_findings(raster.frame_changes(steps, "clip", "n", "v")).collect()} == {"cut": "hard_cut", "one": "no_change"}
    pairs = spark.createDataFrame([("m", [True] * 18, [i > 0 for i in range(18)]), ("m", [True] * 18, [True] * 18), ("n", [False], [False])], "k string, w array<boolean>, g array<boolean>")
    assert {r.k: r.missing_ratio for r in raster.missing_ratio(pairs, "k", "w", "g").collect()} == {"m": pytest.approx(1 / 36), "n": 0.0}
    flat = spark.createDataFrame([("p", [250] * 100), ("short", [1]), ("holed", [None] * 100), ("none", None), ("inked", [250] * 40 + [10] * 20 + [250] * 40)], "img string, v array<int>")
    stats = raster.board_stats(flat, "img", "v", 10, 10, 2, edge=1, band=(4, 6))
    assert {(r.img, r.code) for r in raster.board_findings(stats, "img").collect()} == {("p", "blank"), ("p", "bottom_band"), ("inked", "bottom_band")}
    got = {r.img: (r.n_ink, r.ghost, r.background, r.edge_ratio) for r in stats.collect()}
    assert got["p"] == (0, 0.0, 250.0, 0.0) and got["inked"] == (20, 240.0, 250.0, 0.4) and got["short"] == got["holed"] == got["none"] == (None,) * 4
    assert raster.board_stats(flat.limit(0), "img", "v", 10, 10, 2).count() == 0
    parts = spark.createDataFrame([("p", 100 + 30 * i, 300, 20, 20, 300, 110.0 + 30 * i, 310.0) for i in range(5)] + [("p", 500, 700, 20, 20, 300, 510.0, 710.0)], "img string, x int, y int, w int, h int, area int, cx double, cy double")
    assert [(r.line_no, r.n_parts) for r in raster.text_lines(parts, "img", 1920, 1080).collect()] == [(1, 5)]


def legal(**change):
    doc = {
        "knowledge_model": {"subject": "s", "target_claim": "c", "task_type": "A+C", "learner": {"misconception": "m", "misconception_source": "x"},
                            "model": {"core": "k", "nodes": [{"id": "n1", "evidence": ["e1"]}], "relations": [{"from": "n1", "to": "n1", "type": "t"}]},
                            "learning_outcome": {"recognition": "r"}, "evidence": [{"id": "e1", "source": "s", "confidence": "model inference"}],
                            "dependencies": ["d"], "scope": {"exclude": [{"idea": "i"}]}, "source_coverage": "all"},
        "learner_model": {"constraints": {"prerequisites": [], "misconceptions_to_resolve": [], "essential_relations": [], "optional_details": [], "load_budget": 2}, "ordering_rationale": "o",
                          "transitions": [{"id": "t1", "from_state": "a", "to_state": "b", "cognitive_operation": "RELATE", "obstacle": "GAP", "success_condition": "s", "load": 1}]},
        "scenes": [{"id": "scene-01", "beat_refs": ["b1"], "elements": [{"id": "panel-1", "phrase": "p"}], "beats": [
            {"id": "b1", "state_before": "a", "state_after": "b", "cognitive_operation": "RELATE", "obstacle": "GAP", "evidence_refs": ["e1"], "narration_goal": "g", "visual_goal": "v",
             "expression_goal": {"attention_target": "t"}, "narrative": {"function": "EXPLAIN", "spans": ["s"]}, "visual_operation": "CAUSE",
             "reveal": [{"op": "DRAW", "target": "x", "bound_span": 0}], "channel_allocation": {"verbal": ["x"]},
             "elements": [{"semantic_role": "r", "cognitive_function": "c", "used_by": ["b1"], "introduced_at": "b1"}]}]}],
    }
    for path, value in change.items():
        at, *keys = doc, *path.split("__")
        for k in keys[:-1]:
            at = at[int(k)] if isinstance(at, list) else at[k]
        last = int(keys[-1]) if isinstance(at, list) else keys[-1]
        if value is ...:
            del at[last]
        else:
            at[last] = value
    return json.dumps(doc)


BEAT = "scenes__0__beats__0__"
LINT = [
    (legal(), []), (None, ["IR.NO_SCRIPT"]), ("{", ["IR.BAD_JSON"]), ("[1]", ["IR.BAD_JSON"]),
    (legal(knowledge_model=None), ["KM.MISSING"]), (legal(knowledge_model__subject=" "), ["KM.REQUIRED"]), (legal(knowledge_model__task_type="A X"), ["KM.TASK_TYPE"]),
    (legal(knowledge_model__scope={"exclude": []}), ["KM.SCOPE"]), (legal(knowledge_model__learner__misconception_source=...), ["KM.SCARECROW"]),
    (legal(knowledge_model__learning_outcome={"x": 1}), ["KM.OUTCOME"]), (legal(knowledge_model__evidence__0__confidence="sure"), ["KM.EVIDENCE_CONFIDENCE"]),
    (legal(knowledge_model__evidence__0__confidence="teaching simplification"), ["KM.SIMPLIFICATION_UNDOC"]), (legal(knowledge_model__evidence__0__source="\t"), ["KM.EVIDENCE_SOURCE"]),
    (legal(knowledge_model__model__relations=["x", {"from": "zz", "to": "n1", "type": ""}]), ["KM.RELATION", "KM.RELATION_DANGLING", "KM.RELATION_TYPE"]),
    (legal(knowledge_model__model__nodes=[{"id": "n1"}]), ["KM.EVIDENCE_UNBOUND"]), (legal(knowledge_model__target_claim=" k "), ["KM.CLAIM_IS_MODEL"]),
    (legal(learner_model="x"), ["LM.MISSING"]), (legal(learner_model__constraints__load_budget=...), ["LM.CONSTRAINTS"]), (legal(learner_model__transitions=[]), ["LM.NO_TRANSITION"]),
    (legal(learner_model__transitions__0__load=3), ["LM.OVERLOAD"]), (legal(learner_model__transitions__0__to_state="a "), ["LM.STATE_NO_CHANGE"]), (legal(learner_model__ordering_rationale=""), ["LM.ORDER_UNJUSTIFIED"]),
    (legal(learner_model__transitions=[{"from_state": "a", "to_state": "b", "cognitive_operation": "X", "obstacle": None, "success_condition": ""}, {"from_state": "c", "to_state": "d", "cognitive_operation": "APPLY", "obstacle": "GAP", "success_condition": "s"}]),
     ["LM.CHAIN_BROKEN", "LM.OBSTACLE", "LM.OPERATION", "LM.SUCCESS_CONDITION", "P5.BEAT_COUNT"]),
    (legal(scenes__0__id=...), ["SCENE.ID_FIELD_MISSING"]), (legal(scenes__0__id="scene-03b"), ["SCENE.ID_BAD_FORMAT"]),
    (legal(scenes__0__elements=[{"phrase": ""}, {"id": "x", "text": "t"}]), ["SCENE.ELEMENT_ID_BAD_FORMAT", "SCENE.ELEMENT_ID_FIELD_MISSING", "SCENE.ELEMENT_PHRASE_EMPTY"]),
    (legal(scenes__0__beat_refs=["zz"]), ["EP.ORPHAN_BEAT"]), (legal(**{BEAT + "state_after": None}), ["EP.STATE_EMPTY"]), (legal(**{BEAT + "state_after": "a"}), ["EP.STATE_NO_CHANGE"]),
    (legal(**{BEAT + "obstacle": "X", BEAT + "visual_operation": "Y"}), ["EP.OBSTACLE", "EP.VISUAL_OPERATION"]), (legal(**{BEAT + "evidence_refs": ["e9", "e1"]}), ["EP.EVIDENCE_DANGLING"]),
    (legal(**{BEAT + "narrative": {"function": "X", "spans": []}}), ["EP.NARRATIVE_FUNCTION", "EP.NARRATIVE_SPANS", "EP.NARRATIVE_SPANS"]), (legal(**{BEAT + "reveal": []}), ["EP.NO_REVEAL"]),
    (legal(**{BEAT + "reveal": [5, {"op": "REMOVE", "target": "", "bound_span": 1, "at_ms": 5}, {"op": "Q", "target": "t", "bound_span": None}, {"op": "DRAW", "target": "t", "bound_span": "0"}]}),
     ["EP.HANDKEYED_TIME", "EP.REVEAL_OP", "EP.REVEAL_SHAPE", "EP.REVEAL_TARGET", "EP.REVEAL_UNBOUND", "EP.SPAN_INDEX", "ISA.UNSUPPORTED_OP"]),
    (legal(**{BEAT + "channel_allocation": {"verbal": [], "smell": ["x"]}}), ["EP.CHANNEL", "EP.CHANNEL_EMPTY"]), (legal(**{BEAT + "expression_goal": {}}), ["EP.ATTENTION"]),
    (legal(**{BEAT + "elements": [1, {"semantic_role": "r"}]}), ["EP.ELEMENT_SHAPE", "EP.INTRODUCED_AT", "P6.ELEMENT_NO_ROLE", "P6.ORNAMENT"]),
    (legal(**{BEAT + "narration_goal": ..., BEAT + "visual_goal": " "}), ["EP.NARRATION_GOAL", "EP.VISUAL_GOAL"]),
]


def test_lint_codes(spark):
    docs = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(LINT)], "id int, body string").repartition(2)
    got = {i: [] for i in range(len(LINT))}
    for r in lint.lint(docs, ["id"], "body").collect():
        got[r.id].append(r.code)
    for i, (_, want) in enumerate(LINT):
        assert sorted(got[i]) == sorted(want), i
    assert lint.lint(docs.limit(0), ["id"], "body").count() == 0


def test_panel_findings(spark):
    p = spark.createDataFrame([("s", i) for i in range(5)] + [("t", 0), ("u", 0), ("u", 1)], "scene string, i int")
    e = spark.createDataFrame([("s", i) for i in range(5)] + [("u", 0)], "scene string, i int")
    assert sorted((r.scene, r.code[6:]) for r in lint.panel_findings(p, e, ["scene"]).collect()) == [("s", "PANEL_COUNT"), ("t", "PANEL_COUNT"), ("t", "PANEL_ELEMENT_MISMATCH"), ("u", "PANEL_ELEMENT_MISMATCH")]


def test_gates(spark):
    info = spark.createDataFrame([("ok", 10_000, 10_500, True, True, "h264 yuv420p 44100", -16.0, -1.5, 0, ["ftyp", "moov", "mdat"]), ("bad", 10_000, 13_000, False, False, "vp9", -10.0, 0.0, 2, ["mdat", "moov"]),
                                  ("none", None, None, None, None, None, None, None, None, None)],
                                 "e string, final_ms long, narration_ms long, has_video boolean, has_audio boolean, codecs string, lufs double, peak_db double, n_silences int, atoms array<string>")
    codes = {}
    for r in gates.media(info, ["e"]).collect():
        codes.setdefault(r.e, set()).add(r.code)
    assert codes == {"bad": {"no_video", "no_audio", "duration_drift", "codec", "pixel_format", "sample_rate", "loudness", "peak", "faststart", "silence"}, "none": {"no_duration", "no_video", "faststart"}}
    notes = spark.createDataFrame([("a", "words", "3/3", ["均分 2"]), ("b", None, "2/3", [])], "e string, schedule string, matched string, warnings array<string>")
    assert sorted((r.e, r.code) for r in gates.degraded(notes, ["e"]).collect()) == [("a", "degraded"), ("b", "schedule_not_words"), ("b", "unmatched")]
    themes = spark.createDataFrame([("t", {"ink": "#a0B", "bg": "#fff"})], "id string, colours map<string,string>")
    assert [r.value for r in gates.contract(themes, spark.createDataFrame([("t", "use #FFF")], "id string, text string"), "id").collect()] == ["#a0B"]
    files = spark.createDataFrame([("e", "a", b"1"), ("e", "b", None)], "e string, name string, content binary")
    m = fingerprint.manifest(files, ["e"], "name", "content")
    assert m.first().fingerprint == fingerprint.manifest(files.orderBy(F.desc("name")), ["e"], "name", "content").first().fingerprint
    old = spark.createDataFrame([(1, "x"), (2, None), (3, "y"), (4, None)], "k int, h string")
    new = spark.createDataFrame([(1, "z"), (2, None), (5, "q"), (4, "n")], "k int, h string")
    assert sorted((r.k, r.status) for r in fingerprint.drift(old, new, ["k"], "h").collect()) == [(1, "changed"), (3, "missing"), (4, "changed"), (5, "added")]


def png(pixels):
    h, w = len(pixels), len(pixels[0])
    raw = b"".join(b"\0" + b"".join(bytes(p) for p in row) for row in pixels)
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_readers(spark, tmp_path):
    (tmp_path / "a.srt").write_text("﻿2\r\n00:00:02,000 --> 00:00:03.500\r\n<i>Two</i>\r\nlines\r\n\r\n1\r\n00:00:00,000 --> 00:00:01,000\r\nOne\r\n\r\n3\r\n00:00:05,000 --> 00:00:06,000\r\n \r\n", encoding="utf-8", newline="")
    cues = readers.srt_cues(readers.whole_texts(spark, str(tmp_path / "*.srt"))).orderBy("cue_no").collect()
    assert [(r.text, r.start_ms, r.end_ms) for r in cues] == [("One", 0, 1000), ("Two\nlines", 2000, 3500)]
    (tmp_path / "w1.json").write_text('{"version": 1, "granularity": "word", "words": [{"scene_index": 0, "text": "a", "start_ms": 1, "end_ms": 2}]}')
    (tmp_path / "w2.json").write_text('{"version": ')
    assert sorted((r.corrupt, len(r.words or [])) for r in readers.words_json(spark, str(tmp_path / "w*.json")).collect()) == [(False, 1), (True, 0)]
    assert readers.documents(spark, str(tmp_path / "w*.json")).where("doc is null").count() == 1
    texts = spark.createDataFrame([("a", '{"scene-01": {"panels": [{"x": 1, "y": 2, "width": 3, "h": 4}]}}'), ("b", '{"scenes": {"scene-02": {"panels": [{"x": 1, "y": 2, "w": 3, "h": 4, "color": "red"}]}}}'), ("c", "x")], "path string, text string")
    assert sorted((r.path, r.scene_id, r.w, r.color) for r in readers.layouts(texts).collect()) == [("a", "scene-01", 3, "blue"), ("b", "scene-02", 3, "red")]
    note = spark.createDataFrame([("a", '{"elements": [{"id": "p", "ops": [], "reveal": {"startMs": 5, "durationMs": 6, "protectedRegions": [null, {"x": 1}]}}, {"id": "q", "sequence": 3, "ops": [{"op": "DRAW"}, {"op": "GROUP"}]}]}')], "path string, text string")
    assert [(r.id, r.sequence, r.n_ops, len(r.protected or [])) for r in readers.annotations(note).orderBy("sequence").collect()] == [("p", 0, 1, 1), ("q", 3, 2, 0)]
    (tmp_path / "i.png").write_bytes(png([[(10, 20, 30), (200, 200, 200)]]))
    px = readers.pixels(readers.images(spark, str(tmp_path / "i.png"))).orderBy("x").collect()
    assert [(p.b, p.g, p.r) for p in px] == [(30, 20, 10), (200, 200, 200)] and px[1].grey == 200
    assert readers.binary_digests(spark, str(tmp_path / "i.png")).first().size == (tmp_path / "i.png").stat().st_size
    flags = spark.createDataFrame([('{"a": true}',), ('["a", "b"]',), ("[]",), (None,)], "v string")
    assert [r.x for r in flags.select(readers.confirmations(F.col("v")).alias("x")).collect()] == [{"a": True}, {}, {}, None]
    log = "I: -20.0 LUFS Peak: -3.0 dBFS silence_duration: 2.5 silence_duration: 1 I: -16.5 LUFS Peak: -1.5 dBFS"
    r = spark.createDataFrame([(log,), ("",)], "v string").select(readers.loudness(F.col("v")).alias("x")).collect()
    assert tuple(r[0].x) == (-16.5, -1.5, 1) and tuple(r[1].x) == (None, None, 0)
    people = spark.createDataFrame([("a.json", '{"characters": [{"id": "x", "immutable": {"hair": "red"}}, null]}'), ("b.txt", "tall")], "path string, text string")
    assert sorted(r.id for r in readers.characters(people).collect()) == ["legacy", "x"]
    states = spark.createDataFrame([(1, '{"confirmations": ["a", {"b": 1}]}'), (2, '{"confirmations": {"x": true}, "confirmation_log": ["y"]}'), (3, '{"confirmations": 5}'), (4, "{"), (5, None), (6, "[]")], "k int, text string")
    assert {r.k: (r.confirmations, r.confirmation_log) for r in readers.migrated_states(states, "k").collect()} == {1: ({}, ["a", '{"b":1}']), 2: ({"x": True}, ["y"]), 3: ({}, []), 6: ({}, [])}
    docs = spark.createDataFrame([(1, '{"scenes": [{"narration": "a"}]}'), (2, '{"scenes": []}'), (3, '{"scenes": [{"narration": " "}, {}]}'), (4, "{"), (5, "{}")], "k int, t string").select("k", F.try_parse_json("t").alias("doc"))
    assert sorted((r.k, r.code) for r in readers.script_refusals(docs, "k").collect()) == [(2, "scenes_missing"), (3, "narration_blank"), (5, "scenes_missing")]
    assert sorted(r.code for r in readers.word_file_findings(readers.words_json(spark, str(tmp_path / "w*.json")), "path").collect()) == ["scenes_missing", "words_malformed"]
    titled = spark.createDataFrame([("a", '{"s": {"texts": [{"text": "T", "cx": 1, "cy": 2, "size": 30, "font": "f", "panel": 1}, {"text": "U"}]}}')], "path string, text string")
    assert [(r.scene_id, r.text_no, r.text, r.size, r.panel) for r in readers.layout_texts(titled).orderBy("text_no").collect()] == [("s", 1, "T", 30, 1), ("s", 2, "U", None, None)] and readers.layouts(titled).count() == 0
    sidecar = spark.createDataFrame([("a", '[{"text": "T", "bbox": [1, 2, 3, 4], "panel": 2}, {"text": "U"}]'), ("b", None)], "path string, text string")
    assert [tuple(r) for r in readers.labels(sidecar).collect()] == [("a", 1, "T", 2, 1, 2, 3, 4)]
    cand = spark.createDataFrame([(1, ["/no", "/b", "/a"]), (2, ["/no"])], "k int, candidates array<string>")
    assert [(r.k, r.path) for r in readers.resolve(cand, spark.createDataFrame([("/a",), ("/b",)], "path string"), "k").collect()] == [(1, "/b")]


def test_writers(spark, tmp_path):
    cues = spark.createDataFrame([("e", 2000, 3500, "Two"), ("e", -5, 1000, "One")], "e string, start_ms bigint, end_ms bigint, text string")
    text = writers.srt(cues, "e").first().text
    assert text == "1\n00:00:00,000 --> 00:00:01,000\nOne\n\n2\n00:00:02,000 --> 00:00:03,500\nTwo\n"
    writers.save_texts(writers.srt(cues, "e"), "e", str(tmp_path / "out"))
    back = readers.srt_cues(readers.whole_texts(spark, str(tmp_path / "out" / "e=e" / "*.txt"))).orderBy("cue_no").collect()
    assert [(r.text, r.start_ms) for r in back] == [("One", 0), ("Two", 2000)]
    words = spark.createDataFrame([("e", 0, 1, 0, 500, "Hi", 1, 0, 50), ("e", 0, 2, 600, 700, "you", 1, 10, 10)], "e string, scene_index int, i int, start_ms bigint, end_ms bigint, text string, line_no int, gap_cs bigint, k_cs bigint")
    assert writers.ass(words, "e", ["scene_index", "i"]).first().text.endswith("Dialogue: 0,0:00:00.00,0:00:00.70,Default,,0,0,0,,{\\k50}Hi{\\k10}{\\k10}you")
    windows = spark.createDataFrame([("e", 0, 0, 700)], "e string, scene_index int, start_ms bigint, end_ms bigint")
    assert json.loads(writers.words_document(words, windows, "e").first().text)["words"][1]["text"] == "you"
    spans = spark.createDataFrame([("e", "scene-01", 1, "you", 600, 700), ("e", "scene-01", 0, "Hi", 0, 500)], "e string, scene_id string, sentence_no int, sentence string, start_ms bigint, end_ms bigint")
    held = json.loads(writers.words_document(words, windows, "e", spans).first().text)["narration_spans"]
    assert held == {"scene-01": [{"index": 0, "text": "Hi", "start_ms": 0, "end_ms": 500}, {"index": 1, "text": "you", "start_ms": 600, "end_ms": 700}]}
    told = spark.createDataFrame([("e", 500, 510, "a\nb"), ("e", 0, 900, None)], "e string, start_ms bigint, end_ms bigint, text string")
    assert writers.plain_ass(told, "e").first().text.split("\n")[-2:] == ["Dialogue: 0,0:00:00.00,0:00:00.90,Default,,0,0,0,,", r"Dialogue: 0,0:00:00.50,0:00:00.90,Default,,0,0,0,,a\Nb"]
    blocks = spark.createDataFrame([("e", 2, "b"), ("e", 1, "a"), ("e", 3, None)], "e string, n int, block string")
    assert writers.prompt(blocks, "e", "n", "block").first().text == "a\nb"
    assert writers.move_element(spark.createDataFrame([("e", 500)], "e string, duration_ms bigint"), "e", True).first().start_ms == 0
    assert "[blocking] X" in writers.report(spark.createDataFrame([("e", "blocking", "X")], "e string, severity string, code string"), "e").first().text


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, df in (("sliding", sliding_activity(stream, "user_id", "ts", "value", "2 days", "1 day", "1 hour")), ("sessions", speech_sessions(stream, "user_id", "ts", "1 day", "1 hour"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(name).count() > 0


def test_registry(spark, sf):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)
    entry = __spark_entry__.entry(spark)
    assert entry.columns == ["episode_id", "scene_index", "sentence_no", "sentence", "start_ms", "end_ms"] and entry.count() > 0
