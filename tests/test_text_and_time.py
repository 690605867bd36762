"""Text, time codes, timelines, alignment and scheduling: golden values and brute force."""

import random

import pytest
from pyspark.sql import functions as F

import brute
from beatloom.functions import geometry as G
from beatloom.functions import text as T
from beatloom.operators import align, schedule, timeline


def column(spark, values, expr, ddl="v string"):
    df = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], "i int, " + ddl)
    return [r.x for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


def test_text_functions(spark):
    c = F.col("v")
    assert column(spark, ["a-b_c 1²é①你。", None, ""], T.normalize(c)) == ["abc1²é①你", None, ""]
    assert column(spark, ["a，b. c_d-e%", None], T.strip_punctuation(c)) == ["abc_d-e%", None]
    assert column(spark, ["第一句。第二句？Third! 尾", "  \n", "", None, "。a"], T.split_sentences(c)) == [["第一句。", "第二句？", "Third!", " 尾"], [], [], None, ["a"]]
    assert column(spark, ["a。 ", "b;", "c", "", None, "d…"], T.is_sentence_end(c)) == [True, True, False, False, False, True]
    assert column(spark, [" 　\t", "a", None], T.nonempty(c)) == [False, True, False]
    assert column(spark, ["<i>a</i>b"], T.strip_markup(c)) == ["ab"]
    assert column(spark, ["A+B D", "", None], T.task_tokens(c)) == [["A", "B", "D"], [], []]
    assert column(spark, [("C", "x"), (None, "讲故事和算法"), ("Z", "算法"), ("", "我认为"), ("b", "故事"), (None, None)], T.knowledge_type(F.col("t"), c), "t string, v string") == [
        "technical", "story", "technical", "opinion", "educational", "educational"]
    assert column(spark, [("kitten", "sitting"), ("", ""), ("a", ""), ("你好", "你们")], T.levenshtein_ratio(F.col("a"), F.col("b")), "a string, b string") == [pytest.approx(1 - 3 / 7), 1.0, 0.0, 0.5]
    assert column(spark, [("abcd", "bcde"), (None, None)], T.gestalt_ratio(F.col("a"), F.col("b")), "a string, b string") == [0.75, 1.0]


def test_time_codes(spark):
    ms = [0, -5, 3_723_004, 359_999_999]
    srt = column(spark, ms, T.ms_to_srt(F.col("v")), "v bigint")
    assert srt == ["00:00:00,000", "00:00:00,000", "01:02:03,004", "99:59:59,999"]
    assert column(spark, [*srt, "1:2:3", None, "00:00:01.500"], T.srt_to_ms(F.col("v"))) == [0, 0, 3_723_004, 359_999_999, None, None, 1500]
    assert column(spark, [5, 15, 25, 61_005], T.ms_to_ass(F.col("v")), "v bigint") == ["0:00:00.00", "0:00:00.02", "0:00:00.02", "0:01:01.00"]
    assert column(spark, [19_999, 20_000], T.ticks_to_ms(F.col("v")), "v bigint") == [1, 2]


def test_geometry(spark):
    assert column(spark, ["#102030", "ffffff"], G.hex_to_bgr(F.col("v"))) == [[48, 32, 16], [255, 255, 255]]
    assert column(spark, [0.0, 0.5, 1.0, 2.0], G.ease(F.col("v")), "v double") == pytest.approx([0, 0.5, 1, 1])
    grids = column(spark, [1, 2, 3, 5], G.grid(F.col("v")), "v bigint")
    assert [len(g) for g in grids] == [1, 2, 3, 5] and tuple(grids[2][2]) == (3, 980, 560, 880, 460, "red") and grids[3][4].y == 60 + 2 * (293 + 40)


WORDS = [("a", 0, 100), ("b。", 100, 200), ("c" * 10, 210, 300), ("d" * 9, 300, 350), ("e", 360, 400), ("", 400, 410), (" ", 410, 420), ("f", 900, 950), ("g?", 950, 990)]


def words(spark, rows, key="s"):
    return spark.createDataFrame([(key, i, *r) for i, r in enumerate(rows)], "k string, i int, text string, start_ms bigint, end_ms bigint")


def captions_by_loop(rows, limit, pause):
    out, cur, prev = [], [], None
    for t, s, e in rows:
        if not t.strip():
            continue
        if cur and s - prev >= pause:
            out.append(cur)
            cur = []
        cur.append((t, s, e))
        prev = e
        if t.strip()[-1] in "。！？!?；;…" or sum(len(x[0]) for x in cur) >= limit:
            out.append(cur)
            cur = []
    return [("".join(x[0] for x in c), c[0][1], c[-1][2]) for c in [*out, cur] if c]


def test_captions_equal_a_loop(spark):
    rng = random.Random(6)
    for n, rows in enumerate([WORDS, []] + [[]] * 3):
        if n > 1:
            t = 0
            for _ in range(120):
                t += rng.choice([0, 10, 399, 400, 700])
                rows = [*rows, (rng.choice(["x", "yy", "zzz。", " ", "w" * 9]), t, t + 50)]
                t += 50
        got = timeline.captions(words(spark, rows), ["k"], ["start_ms", "i"]).orderBy("caption_no").select("text", "start_ms", "end_ms").collect()
        assert [tuple(r) for r in got] == captions_by_loop(rows, 22, 400)


def test_subtitle_lines_and_karaoke(spark):
    lines = timeline.subtitle_lines(words(spark, WORDS), ["k"], ["start_ms", "i"])
    got = {r.i: r.line_no for r in lines.collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 2, 4: 3, 6: 3, 7: 4, 8: 4}
    k = {r.i: (r.gap_cs, r.k_cs) for r in timeline.karaoke(lines, ["k"], ["start_ms", "i"]).collect()}
    assert k[2] == (0, 9) and k[6] == (1, 1) and k[3] == (0, 5)


def test_order_runs_and_sweeps(spark):
    df = spark.createDataFrame([("a", i, s, e) for i, (s, e) in enumerate([(0, 5), (9, 3), (4, 6), (2, 8), (7, 9)])], "k string, i int, start_ms int, end_ms int")
    assert [r.i for r in timeline.order_violations(df, ["k"], ["i"]).collect()] == [3]
    flags = spark.createDataFrame([("a", i, f) for i, f in enumerate([True, True, False, None, True, True, True, False, True])], "k string, i int, f boolean")
    assert [(r.first_pos, r.last_pos) for r in timeline.runs(flags, ["k"], ["i"], F.col("f")).orderBy("run_no").collect()] == [(1, 2), (5, 7)]
    travel = spark.createDataFrame([("a", "travel", 0, 1600, 0.0), ("a", "draw", 1600, 4000, 30.0), ("b", "gaze", 0, 6000, 0.0), ("c", "travel", 0, 1500, 0.0)], "scene string, kind string, start_ms bigint, end_ms bigint, length double")
    assert {r.scene: (r.n_windows, r.n_sweeps) for r in timeline.sweep_audit(travel, "scene").collect()} == {"a": (4, 1), "b": (8, 0), "c": (0, 0)}


def test_serialise_and_split(spark):
    rows = [("s", 1, 0, 100), ("s", 2, 120, 50), ("s", 3, 900, 10), ("s", 4, None, None), ("s", 5, 0, 20)]
    df = spark.createDataFrame(rows, "k string, i int, start_ms bigint, duration_ms bigint")
    assert [(r.actual_start, r.actual_end) for r in timeline.serialise(df, ["k"], ["i"]).orderBy("i").collect()] == [(150, 250), (400, 450), (900, 910), (None, None), (1060, 1080)]
    ops = spark.createDataFrame([("s", i, k) for k in (3,) for i in range(7)], "k string, i int, n int")
    assert [r.panel_no for r in timeline.even_split(ops, ["k"], ["i"], "n").orderBy("i").collect()] == [1, 1, 1, 2, 2, 3, 3]


def test_contiguous_windows(spark):
    df = spark.createDataFrame([("e", 0, 50, 100, 900), ("e", 1, 150, 300, 900), ("e", 2, None, None, 900), ("e", 3, 250, 400, 900)], "k string, i int, start_ms bigint, end_ms bigint, total bigint")
    got = [(r.repaired_start, r.repaired_end) for r in timeline.contiguous(df, "k", "i", "total").orderBy("i").collect()]
    assert got == [(0, 150), (150, 300), (300, 300), (300, 900)]


def test_phrase_matching(spark):
    units = words(spark, [("Hello", 0, 10), (",", 10, 12), ("wörld", 20, 30), ("again", 30, 40), ("gradiant", 50, 60)])
    hays = align.haystacks(units, ["k"], ["start_ms", "i"])
    phrases = spark.createDataFrame([(1, "s", "hello"), (2, "s", "o, wör"), (3, "s", "gradient"), (4, "s", "nothing"), (5, "s", None), (6, "s", "渐变 x"), (7, "zz", "Hello"), (8, "s", "--")], "id int, k string, p string")
    dictionary = align.fixed_dictionary(spark, {"渐": ["gradiant"], "渐变": ["zzzz"]})
    got = {r.id: (r.start_ms, r.end_ms, r.method) for r in align.phrase_matches(phrases, hays, ["k"], "id", "p", dictionary).collect()}
    assert got[1] == (0, 30, "fuzzy") and got[2] == (0, 30, "exact") and got[3] == (50, 60, "fuzzy") and got[6] == (50, 60, "exact_translation")
    assert got[4][2] is None and got[5][2] is None and got[7][2] is None and got[8][2] is None


def test_large_dictionaries_are_joined(spark):
    entries = {"渐": ["g"], "渐变": ["zz"], "ab": ["1"], "b": ["2"], "abc": ["3", "4"], "": ["none"]}
    phrases = spark.createDataFrame([(1, "渐变"), (2, "x渐变y"), (3, " ABC "), (4, "xb"), (5, "q"), (6, None), (7, " "), (8, "x渐变y")], "id int, phrase string")
    dictionary = align.fixed_dictionary(spark, entries).where("term <> ''")
    want = [(1, ["zz"]), (2, ["g"]), (3, ["3", "4"]), (4, ["2"]), (8, ["g"])]
    for most in (100, 2):
        assert sorted(tuple(r) for r in align.translations(phrases, dictionary, most).collect()) == want


def test_crowded_scenes_and_matched_spans(spark):
    units = words(spark, [("one", 0, 10), ("two", 10, 20), ("three", 20, 30), ("four", 30, 40)])
    hays = align.haystacks(units, ["k"], ["start_ms", "i"])
    phrases = spark.range(200).select(F.col("id").cast("int").alias("id"), F.lit("s").alias("k"), F.when(F.col("id") % 2 == 0, "two three").otherwise("zzzz").alias("p"))
    got = align.phrase_matches(phrases, hays, ["k"], "id", "p")
    assert got.count() == 200 and got.where("method = 'exact' and start_ms = 10 and end_ms = 30").count() == 100 == got.where("method is null").count()
    told = spark.createDataFrame([("s", "Three four! One two! Zzzz? "), ("q", "One.")], "k string, n string")
    spans = align.matched_spans(told, units, ["k"], ["start_ms", "i"], "n")
    assert [tuple(r) for r in spans.orderBy("sentence_no").collect()] == [("s", 0, 20, 40, "fuzzy", False), ("s", 1, 0, 30, "fuzzy", True)]


def test_panels_follow_sentences_then_phrases(spark):
    spans = spark.createDataFrame([("s", 0, 0, 10), ("s", 2, 10, 25), ("s", 3, 30, 50)], "k string, sentence_no int, start_ms int, end_ms int")
    ops = spark.createDataFrame([("s", 1, 0), ("s", 1, 2), ("s", 2, 9), ("s", 2, -1), ("s", 3, None), ("t", 1, 0)], "k string, panel_no int, bound_span int")
    assert [tuple(r) for r in align.sentence_unions(ops, spans, ["k"]).collect()] == [("s", 1, 0, 50)]
    panels = spark.createDataFrame([("s", i) for i in (1, 2, 3)], "k string, panel_no int")
    matches = spark.createDataFrame([("s", 1, 3, 4, "exact"), ("s", 2, 5, 6, "fuzzy"), ("s", 3, None, None, None)], "k string, panel_no int, start_ms int, end_ms int, method string")
    got = align.panel_spans(panels, ops, spans, matches, ["k"]).orderBy("panel_no")
    assert [tuple(r) for r in got.collect()] == [("s", 1, 0, 50, "sentences"), ("s", 2, 5, 6, "fuzzy"), ("s", 3, None, None, None)]


def test_fuzzy_equals_brute_force():
    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(8)
    for _ in range(150):
        hay = "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 40)))
        needle = "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 10)))
        best = None
        for size in range(max(1, len(needle) // 2), min(len(hay), int(1.5 * len(needle))) + 1):
            for start in range(len(hay) - size + 1):
                ratio = 1 - lev(hay[start:start + size], needle) / max(size, len(needle))
                if ratio >= 0.75 and (best is None or ratio > best[2]):
                    best = (start, size, ratio)
        assert align.best_window(hay, needle) == best


def test_cues_follow_scenes(spark):
    cues = spark.createDataFrame([("e", 0, "One two."), ("e", 10, "noise"), ("e", 20, "three"), ("e", 30, "one"), ("f", 0, "x")], "k string, start_ms int, text string")
    scenes = spark.createDataFrame([("e", 0, "One two. One"), ("e", 1, "Three four"), ("e", 2, None)], "k string, scene_index int, narration string")
    got = {(r.k, r.start_ms): r.scene_index for r in align.assign_cues(cues, scenes.withColumn("narration", F.lower("narration")), "k", ["start_ms"]).collect()}
    assert got[("e", 20)] == 1 and got[("e", 30)] == 1 and got[("f", 0)] == 0


def test_op_slices(spark):
    ops = spark.createDataFrame([("e", "b", i, s) for i, s in enumerate([0, 1, 2, 3])] + [("e", "c", 0, 9)], "k string, beat_id string, op_no int, bound_span int")
    slices = spark.createDataFrame([("e", "b", 0, "s1"), ("e", "b", 1, "s2"), ("e", "c", 0, "s1")], "k string, beat_id string, slice_no int, scene_id string")
    counts = spark.createDataFrame([("e", "s1", 1), ("e", "s2", 2)], "k string, scene_id string, n_sentences int")
    got = sorted((r.beat_id, r.scene_id, r.op_no, r.bound_span) for r in align.slice_ops(ops, slices, counts, ["k"]).collect())
    assert got == [("b", "s1", 0, 0), ("b", "s2", 1, 0), ("b", "s2", 2, 1), ("c", "s1", 0, 9)]


def test_window_plans(spark):
    rng = random.Random(5)
    scenes = {0: (10_000, [(2000, 3000), None, (6000, 6100)]), 1: (2000, [None] * 6), 2: (20_000, [None, (5000, 6000), (5500, 5600), None, None]), 3: (None, [(0, 10)])}
    for k in range(4, 150):
        d = rng.choice([0, 900, 3000, 6000, 15_000])
        starts = [rng.randrange(0, d + 500) if rng.random() < 0.5 else None for _ in range(rng.randrange(1, 9))]
        scenes[k] = (d, [s if s is None else (s, s + rng.randrange(0, 3000)) for s in starts])
    rows = [(k, i, d, *(span or (None, None))) for k, (d, spans) in scenes.items() for i, span in enumerate(spans)]
    df = spark.createDataFrame(rows, "k int, o int, dur int, span_start int, span_end int").withColumn("panel_no", F.lit(9))
    got, notes = {}, {}
    for r in schedule.schedule_windows(df, ["k"], "o", "dur").orderBy("k", "panel_no").collect():
        got.setdefault(r.k, []).append((r.start_ms, r.start_ms + r.duration_ms))
        notes[r.k] = r.warnings
    assert got == {k: brute.reveal_windows(d or 0, spans) for k, (d, spans) in scenes.items()}
    assert got[0] == [(1050, 3000), (3150, 5850), (6000, 6450)] and notes[0] == f"{schedule.EVEN} 1;hook"
    assert notes[1] == f"{schedule.EVEN} 6;{schedule.TOO_SHORT};{schedule.NO_ROOM};{schedule.OUT_OF_RESERVE}"
    assert all(b[0] >= a[1] for a, b in zip(got[2], got[2][1:], strict=False)) and notes[2] == f"{schedule.EVEN} 1;{schedule.EVEN} 2"
    assert schedule.schedule_windows(df.limit(0), ["k"], "o", "dur").count() == 0


def test_slots_fit_their_window(spark):
    rows = [("a", i, n, 4000) for i, n in enumerate([400.0, 1600.0])] + [("b", i, 3000.0, 200) for i in range(3)]
    got = schedule.slot_durations(spark.createDataFrame(rows, "k string, i int, len double, dur bigint"), ["k"], "len", "dur").collect()
    by = {k: [r.slot_ms for r in sorted(got, key=lambda r: r.i) if r.k == k] for k in "ab"}
    assert 0.60 < by["a"][1] / 4000 < 0.72 and by["a"][0] / 4000 > 0.28
    assert min(by["b"]) >= 45 and sum(by["b"]) <= 200


def test_stroke_tasks_stay_in_their_window(spark):
    rng = random.Random(9)
    rows = [(k, i, rng.uniform(0, 900), *[rng.uniform(0, 1900) for _ in range(4)], 100, 100 + rng.choice([5, 300, 4000])) for k in range(20) for i in range(8)]
    rows = [(*r[:8], [x for x in rows if x[0] == r[0]][0][8]) for r in rows]
    df = spark.createDataFrame(rows, "k int, i int, length double, x0 double, y0 double, x1 double, y1 double, a int, b int")
    ends = {r[0]: r[8] for r in rows}
    got = schedule.stroke_schedule(df, ["k"], ["i"], "a", "b").collect()
    assert all(r.end_ms > r.start_ms or r.kind for r in got) and all(r.end_ms <= ends[r.k] + 16 for r in got)
    assert {r.k for r in got} == set(range(20)) and sum(r.kind == "draw" for r in got) == 160
