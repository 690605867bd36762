"""The general problems against brute force, on the supplied tables and on small irregular ones."""

import json
import random

from pyspark.sql import functions as F

import brute
from beatloom.operators import drift, intervals, nested
from beatloom.operators.ordered import prefix_sum, previous_row
from beatloom.plans import problems


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_p1_found_equals_brute_force(spark, sf):
    scripts = spark.read.parquet(f"{sf}/scripts.parquet").select("script_id", "body").collect()
    want = [x for s in scripts for x in brute.script_items(*s)]
    assert rows(problems.p1_found(spark, sf)) == sorted(want, key=str)


def test_p1_irregular_bodies(spark):
    reveal = json.dumps([{"op": "DRAW"}, 3, {"op": "GROUP"}])
    bodies = [None, "", "{", "[]", "7", '"x"', "null", "{}", json.dumps({"scenes": {}}),
              json.dumps({"scenes": {"b": {"id": 1}, "a": {"beats": {"op": 1}}}}),
              json.dumps({"scenes": [None, {"beats": [{"reveal": reveal}, "x", {"reveal": {"r": {}, "q": {}}}]}]}),
              json.dumps({"scenes": [{"beat_refs": ["b2", "zz", "b1", 5]}, {"beats": None, "beat_refs": ["b1"]}],
                          "beats": [{"id": "b1", "reveal": [{}]}, {"id": "b2"}, 4]}),
              json.dumps({"knowledge_model": json.dumps({"model": json.dumps({"nodes": {"id": "n"}, "relations": [[], {}]}), "evidence": "text"})})]
    bodies += bodies[-2:]
    df = spark.createDataFrame([(i, b, "x") for i, b in enumerate(bodies)], "script_id long, body string, level string")
    levels = list(problems.SCRIPT_KINDS)
    want = sorted((s, k, *[p for p in pos if p >= 0]) for i, b in enumerate(bodies) for s, k, *pos in brute.script_items(i, b))
    shredded = nested.shred(df, ["script_id"], "body", problems.BEAT_REFS)
    every = [*levels, *(p for p in nested.levels_of(shredded) if p not in levels)]
    for flat in (nested.flatten(df, ["script_id"], "body", levels, problems.BEAT_REFS), nested.related(shredded, ["script_id"], every, problems.BEAT_REFS).where(F.col("level").isin(levels))):
        got = sorted((r.script_id, problems.SCRIPT_KINDS[r.level], *r.ordinals) for r in flat.where("type = 'object'").collect())
        assert got == want
        assert flat.where("parent_key is null").select("level").distinct().count() == 3
        parents = flat.select("script_id", F.col("node_key").alias("parent_key"))
        assert flat.where("parent_key is not null").join(parents, ["script_id", "parent_key"], "left_anti").count() == 0
    schema = {(r.path, r.type) for r in nested.merged_schema(df, "body").collect()}
    assert {("scenes", "list"), ("scenes", "object"), ("scenes[].beats[].reveal", "text of list")} <= schema
    flat = nested.flatten(df, ["script_id"], "body", levels, problems.BEAT_REFS, members=True)
    table = nested.child_table(flat, ["script_id"], "scenes[].beats[]", "beat_")
    assert "beat_reveal" in table.columns and table.count() == flat.where("level = 'scenes[].beats[]' and type = 'object'").count()


def test_p1_levels_follow_the_documents(spark):
    """A seventh level, lists of values and of lists, names with dots, and objects where other documents have the list."""
    bodies = [json.dumps({"scenes": [{"shots": [{"a": 1, "tags": ["x", None, 2]}, 7]}, {"shots": [[{"b": 1}], []]}], "x.y": [{"q": [1]}], "x": {"y": [3]}}),
              json.dumps({"scenes": {"s": {"shots": {"u": {"a": 2}, "v": {"a": 3, "tags": "[4]"}}}}}),
              json.dumps({"scenes": [{"shots": {"a": 5, "tags": {"k": 1}}}]}), '{"scenes": [NaN]}']
    df = spark.createDataFrame([(i, b, "z") for i, b in enumerate(bodies)], "script_id long, body string, entries string")
    shredded = nested.shred(df, ["script_id"], "body")
    levels = nested.levels_of(shredded)
    assert set(levels) == {"scenes[]", "scenes[].shots[]", "scenes[].shots[].tags[]", "scenes[].shots[][]", "x%2Ey[]", "x%2Ey[].q[]", "x.y[]"}
    flat = nested.related(shredded, ["script_id"], levels)
    got = {(r.script_id, r.level, *r.ordinals): (r.type, r.value) for r in flat.where("not level = 'scenes[]'").collect()}
    assert got == {
        (0, "scenes[].shots[]", 0, 0): ("object", '{"a": 1, "tags": ["x", null, 2]}'), (0, "scenes[].shots[]", 0, 1): ("integer", "7"),
        (0, "scenes[].shots[].tags[]", 0, 0, 0): ("string", "x"), (0, "scenes[].shots[].tags[]", 0, 0, 1): ("null", None), (0, "scenes[].shots[].tags[]", 0, 0, 2): ("integer", "2"),
        (0, "scenes[].shots[]", 1, 0): ("list", None), (0, "scenes[].shots[]", 1, 1): ("list", None), (0, "scenes[].shots[][]", 1, 0, 0): ("object", '{"b": 1}'),
        (0, "x%2Ey[]", 0): ("object", '{"q": [1]}'), (0, "x%2Ey[].q[]", 0, 0): ("integer", "1"), (0, "x.y[]", 0): ("integer", "3"),
        (1, "scenes[].shots[]", 0, 0): ("object", '{"a": 2}'), (1, "scenes[].shots[]", 0, 1): ("object", '{"a": 3, "tags": "[4]"}'), (1, "scenes[].shots[].tags[]", 0, 1, 0): ("integer", "4"),
        (2, "scenes[].shots[]", 0, 0): ("object", '{"a": 5, "tags": {"k": 1}}'), (2, "scenes[].shots[].tags[]", 0, 0, 0): ("object", '{"k": 1}')}
    children, parents = flat.where("parent_key is not null"), flat.select("script_id", F.col("node_key").alias("parent_key")).distinct()
    assert children.join(parents, ["script_id", "parent_key"], "left_anti").count() == 0
    assert flat.select("script_id", "node_key").distinct().count() == flat.count()


def test_p1_every_level_has_a_table(spark, tmp_path):
    bodies = [json.dumps({"theme": "t", "scenes": [{"elements": [{"id": "e", "tips": [{"n": 1}]}], "beats": [{"elements": [{"id": "f"}, 3, {}]}]}],
                          "learner_model": {"transitions": [{"from": "a"}, {"to": "b"}]}, "grid": [[{"x": 1}], [], [2, {"x": 3}]]}),
              json.dumps({"theme": 4, "beats": [{"id": "b1", "elements": [{}], "reveal": [{"op": "DRAW"}]}], "knowledge_model": {"scope": {"exclude": [{"topic": "z"}]}}}),
              json.dumps([{"k": 1}]), "{", None]
    spark.createDataFrame(list(enumerate(bodies)), "script_id long, body string").write.parquet(f"{tmp_path}/scripts.parquet")
    got = {q: rows(problems.QUERIES[q](spark, str(tmp_path)).drop("ordinal", "parent_key")) for q in [*problems.TABLES, "p1_other", "p1_values"]}
    assert got["p1_scene_elements"] == [(0, "scenes[0].elements[0]", "e", '[{"n":1}]')]
    assert got["p1_beat_elements"] == [(0, "scenes[0].beats[0].elements[0]", "f"), (0, "scenes[0].beats[0].elements[2]", None)]
    assert got["p1_transitions"] == [(0, "learner_model.transitions[0]", "a", None), (0, "learner_model.transitions[1]", None, "b")]
    assert got["p1_excluded"] == [(1, "knowledge_model.scope.exclude[0]", "z")] and got["p1_pool_reveal"] == [(1, "beats[0].reveal[0]", "DRAW")] and got["p1_pool_elements"] == [(1, "beats[0].elements[0]")]
    assert [(r[0], r[1], r[-1]) for r in got["p1_documents"]] == [(0, None, "t"), (1, None, "4")]
    assert got["p1_other"] == [(0, "grid[][]", "grid[0].[0]", '{"x": 1}'), (0, "grid[][]", "grid[2].[1]", '{"x": 3}'),
                               (0, "scenes[].elements[].tips[]", "scenes[0].elements[0].tips[0]", '{"n": 1}'), (2, "[]", "[0]", '{"k": 1}')]
    assert got["p1_values"] == [(0, "grid[]", "grid[0]", "list", None), (0, "grid[]", "grid[1]", "list", None), (0, "grid[]", "grid[2]", "list", None),
                                (0, "grid[][]", "grid[2].[0]", "integer", "2"), (0, "scenes[].beats[].elements[]", "scenes[0].beats[0].elements[1]", "integer", "3")]


def test_p1_levels_of_the_scripts(spark):
    sf = "/root/testdata/sf0.01"
    shredded = nested.shred(spark.read.parquet(f"{sf}/scripts.parquet"), ["script_id"], "body", problems.BEAT_REFS)
    assert {level for level, _ in problems.TABLES.values()} - {nested.ROOT} <= set(nested.levels_of(shredded))
    assert problems.p1_other(spark, sf).count() == 0


def test_p1_columns_of_pool_and_lone_objects(spark, tmp_path):
    bodies = [json.dumps({"scenes": [{"beats": [{"id": 7, "reveal": [{"op": "DRAW"}]}]}]}),
              json.dumps({"scenes": [{"beat_refs": ["b1"]}], "beats": [{"id": "b1", "mood": "calm", "a.b": 1}]}),
              json.dumps({"scenes": [{"beats": {"id": 8, "tempo": 1.5, "reveal": {"op": 4, "speed": 2}}}]})]
    spark.createDataFrame(list(enumerate(bodies)), "script_id long, body string").write.parquet(f"{tmp_path}/scripts.parquet")
    beats = {r.script_id: r.asDict() for r in problems.QUERIES["p1_beats"](spark, str(tmp_path)).collect()}
    assert [beats[i]["beat_id"] for i in range(3)] == ["7", "b1", "8"]
    assert beats[1]["beat_mood"] == "calm" and beats[1]["beat_a.b"] == 1 and beats[2]["beat_tempo"] == 1.5
    reveal = {r.script_id: (r.reveal_op, r.reveal_speed) for r in problems.QUERIES["p1_reveal"](spark, str(tmp_path)).collect()}
    assert reveal == {0: ("DRAW", None), 2: ("4", 2)}


def test_p1_empty_table(spark):
    df = spark.createDataFrame([], "script_id long, body string")
    assert nested.merged_schema(df, "body").count() == 0
    shredded = nested.shred(df, ["script_id"], "body")
    assert nested.levels_of(shredded) == [] and nested.related(shredded, ["script_id"], []).count() == 0
    assert nested.flatten(df, ["script_id"], "body", list(problems.SCRIPT_KINDS), problems.BEAT_REFS).count() == 0


def test_p4_equals_brute_force(spark, sf):
    ws = spark.read.parquet(f"{sf}/words.parquet").where("scene_index is not null").collect()
    xs = [((w.episode_id, w.scene_index), w.start_ms, w.end_ms) for w in ws]
    assert rows(problems.p4_found(spark, sf)) == sorted(((*k, a, b) for k, a, b in brute.gaps(xs, 400)), key=str)
    assert rows(problems.p4_periods(spark, sf)) == sorted(((*k, a, b) for k, a, b in brute.periods(xs, 400)), key=str)


def test_intervals_across_shards(spark):
    rng = random.Random(1)
    for width, spread in ((7, 60), (50, 400), (1000, 300)):
        xs = []
        for _ in range(400):
            s = rng.randrange(-spread, spread)
            xs.append((rng.choice(["a", "a", "b", None]), s, s + rng.choice([-1, 0, 1, 2, 5, 9, rng.randrange(1, spread // 2 if rng.random() < 0.05 else 4)])))
        xs += [("c", None, 3), ("c", 3, None), ("d", 0, 5), ("d", 0, 5), ("e", -(10**12), 10**12)]
        df = spark.createDataFrame([(*x, 1) for x in xs], "p string, s long, e long, _shard int")
        for gap in (1, 2, 4):
            assert rows(intervals.gaps(df, ["p"], "s", "e", gap, width)) == brute.gaps(xs, gap)
            assert rows(intervals.periods(df, ["p"], "s", "e", gap, width)) == brute.periods(xs, gap)
    empty = spark.createDataFrame([], "k string, s long, e long")
    assert intervals.gaps(empty, ["k"], "s", "e").count() == intervals.periods(empty, ["k"], "s", "e").count() == 0


def test_p5_equals_brute_force(spark, sf):
    fs = spark.read.parquet(f"{sf}/raw_files.parquet").collect()
    want = brute.changes([(f.file_id, (f.episode_id, f.file_kind), f.written_at, f.payload) for f in fs])
    assert rows(problems.p5_found(spark, sf)) == sorted(want, key=str)


def test_drift_cases(spark):
    files = ['{"a": 1, "b": {"x": true, "y": null}, "c": false, "d": false}', "{", None,
             '{"a": 1.0, "b": {"z": true, "y": 2}, "e": false}', '{"a": 1.0, "b": {"z": true, "y": 2}, "e": false}',
             '{"b": {"y": "2"}, "a.b": 1.0, "f": null}', "[]", '{"q": {"w": [1]}}', '{"r": {"w": [1]}, "s": {"w": [1]}}']
    rows_in = [(i, "g", 0, p, "extra") for i, p in enumerate(files)] + [(50, None, 0, '{"a": 1}', ""), (51, None, 1, '{"a": "1"}', "")]
    df = spark.createDataFrame(rows_in, "file_id long, g string, t int, payload string, members string")
    want = brute.changes([r[:4] for r in rows_in])
    assert rows(drift.changes(df, "file_id", ["g"], ["t", "file_id"], "payload")) == sorted(want, key=str)
    assert drift.changes(df.limit(0), "file_id", ["g"], ["t", "file_id"], "payload").count() == 0


def test_typed_table_reports_failed_casts(spark):
    df = spark.createDataFrame([(1, '{"version": "2", "voice": "a"}'), (2, '{"v": {"major": 1}}'), (3, '{"version": 3.0}'), (4, "{")], "id long, p string")
    got = drift.typed_table(drift.path_values(df, "p"), ["id"], {"version": (["version", "v"], "bigint"), "voice": (["voice"], "string")})
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, 2, "a", ""), (2, None, None, "version"), (3, 3, None, ""), (4, None, None, "")]


def test_typed_table_holds_every_member(spark):
    files = ['{"gates": {"ok": true}, "phases": {"drawn": true}, "boards": [1], "rate": 2, "file_id": "x", "mix": 1.5}',
             '{"confirmations": {"ok": false}, "phases": {"drawn": "later"}, "boards": {"items": [1]}, "Rate": 3, "mix": 2}',
             '{"confirmations": "yes", "title": {"value": "t"}, "rate": "fast", "a.b": 1, "a": {"b": 2}, "phases": {"drawn": false}}', "[]", None,
             '{"title": "t", "name": "n", "rate": 4.0, "boards": [2]}']
    df = spark.createDataFrame(list(enumerate(files)), "file_id long, p string")
    loaded = drift.path_values(df, "p").where("members is not null")
    fields = drift.derived_fields(loaded, {"title": ["title", "name"], "confirmations": ["confirmations", "gates"], "look": ["look"]}, ["file_id"])
    got = {r.file_id: r.asDict() for r in drift.typed_table(loaded, ["file_id"], fields).collect()}
    assert {c: t for c, (_, t) in fields.items()} == {
        "title": "string", "confirmations": "object", "look": "string", "Rate": "bigint", "a": "object", "a.b": "bigint", "boards": "list", "file_id_2": "string",
        "mix": "double", "name": "string", "phases": "object", "rate_2": "bigint", "title.value": "string", "confirmations.ok": "boolean",
        "a.b_2": "bigint", "boards.items": "list", "phases.drawn": "boolean"}
    held = lambda i: {c: v for c, v in got[i].items() if v is not None and c != "file_id"}
    assert held(0) == {"confirmations": '{"ok":true}', "confirmations.ok": True, "phases": '{"drawn":true}', "phases.drawn": True, "boards": "[1]",
                       "rate_2": 2, "file_id_2": "x", "mix": 1.5, "failed_casts": ""}
    assert held(1) == {"confirmations": '{"ok":false}', "confirmations.ok": False, "phases": '{"drawn":"later"}', "boards": '{"items":[1]}',
                       "boards.items": "[1]", "Rate": 3, "mix": 2.0, "failed_casts": "boards,phases.drawn"}
    assert held(2) == {"confirmations": '"yes"', "title": '{"value":"t"}', "title.value": "t", "a.b": 1, "a": '{"b":2}', "a.b_2": 2,
                       "phases": '{"drawn":false}', "phases.drawn": False, "failed_casts": "title,confirmations,rate_2"}
    assert held(3) == {"failed_casts": ""} and held(5) == {"title": "t", "name": "n", "rate_2": 4, "boards": "[2]", "failed_casts": ""}


def test_synonyms_come_from_renames(spark):
    """a -> b -> c are one field; d and e had one value once but stand beside each other; f was retyped, g dropped."""
    files = ['{"a": "x1", "d": 1, "f": 1}', '{"b": "x1", "d": 1, "f": "1"}', '{"b": "x2", "e": 1}', '{"c": "x2", "e": 2, "d": 3}', '{"c": {"a": 1}, "e": 2, "g": 5}', '{"c": {"q": 1}, "e": 2}']
    df = spark.createDataFrame([(i, "g", i, p) for i, p in enumerate(files)], "id long, g string, t long, p string")
    loaded = drift.path_values(df, "p").drop("p")
    differences = drift.compared(loaded, "id", ["g"], ["t", "id"])
    assert rows(differences.where("change_kind <> 'renamed'").select("id", "outer", "was", "now")) == sorted(
        [(1, None, "f", "f"), (2, None, "f", None), (3, None, None, "d"), (4, None, "c", "c"), (4, None, "d", None), (4, None, None, "g"), (5, None, "g", None)], key=str)
    assert rows(differences.where("change_kind = 'renamed'").select("id", "outer", "was", "now")) == [(1, None, "a", "b"), (2, None, "d", "e"), (3, None, "b", "c"), (5, "c", "a", "q")]
    synonyms = drift.found_synonyms(loaded, differences)
    assert synonyms == {"c": ["c", "b", "a"]}
    table = drift.typed_table(loaded, ["id"], drift.derived_fields(loaded, synonyms, ["id"]))
    assert [(r.c, r.e, r.failed_casts) for r in table.orderBy("id").collect()][:4] == [("x1", None, ""), ("x1", None, ""), ("x2", 1, ""), ("x2", 2, "")]
    assert drift.found_synonyms(loaded.limit(0), differences.limit(0)) == {}


def test_p5_tables_hold_every_member(spark, sf):
    files = spark.read.parquet(f"{sf}/raw_files.parquet").collect()
    for kind, query in (("state", problems.QUERIES["p5_state"]), ("words", problems.QUERIES["p5_words"])):
        table = {r.file_id: r.asDict() for r in query(spark, sf).collect()}
        for f in files:
            doc = brute._loads(f.payload) if f.file_kind == kind and f.payload is not None else None
            if isinstance(doc, dict):
                row = table.pop(f.file_id)
                top = [c for c in row if "." not in c and c not in ("file_id", "episode_id", "written_at", "failed_casts")]
                failed = [c for c in row["failed_casts"].split(",") if c in top and row[c] is None]
                assert sum(v is not None for v in doc.values()) == sum(row[c] is not None for c in top) + len(failed)
        assert all(r["failed_casts"] == "" for r in table.values())


def test_two_level_order(spark):
    rng = random.Random(2)
    data = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(50), i, rng.choice([None, 1, 2, 3])) for i in range(500)]
    df = spark.createDataFrame(data, "k string, o int, id int, v int")
    total, last, want = {}, {}, {}
    for k, o, i, v in sorted(data, key=lambda r: (r[1], r[2])):
        total[k] = total.get(k, 0) + (v or 0)
        want[i] = (total[k], last.get(k))
        last[k] = v
    sums = {r.id: r.s for r in prefix_sum(df, ["k"], ["o", "id"], "v", "s").collect()}
    prev = {r.id: r.p for r in previous_row(df, ["k"], ["o", "id"], F.col("v"), "p").collect()}
    assert {i: (sums[i], prev[i]) for i in sums} == want
