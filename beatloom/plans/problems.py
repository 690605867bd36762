"""Queries of the general data problems: nested records, intervals, schema drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, intervals, nested
from ..shared import materialise, spread
from ..sources import load

SCRIPT_KINDS = {
    "scenes[]": "scene",
    "scenes[].beats[]": "beat",
    "scenes[].beats[].reveal[]": "reveal",
    "knowledge_model.model.nodes[]": "node",
    "knowledge_model.model.relations[]": "relation",
    "knowledge_model.evidence[]": "evidence",
}
TABLES = {  # the levels of the scripts by query; p1_other has those of any other
    "p1_documents": (nested.ROOT, "doc_"),
    "p1_scenes": ("scenes[]", "scene_"),
    "p1_scene_elements": ("scenes[].elements[]", "element_"),
    "p1_beats": ("scenes[].beats[]", "beat_"),
    "p1_beat_elements": ("scenes[].beats[].elements[]", "element_"),
    "p1_reveal": ("scenes[].beats[].reveal[]", "reveal_"),
    "p1_pool_beats": ("beats[]", "beat_"),
    "p1_pool_elements": ("beats[].elements[]", "element_"),
    "p1_pool_reveal": ("beats[].reveal[]", "reveal_"),
    "p1_nodes": ("knowledge_model.model.nodes[]", "node_"),
    "p1_relations": ("knowledge_model.model.relations[]", "relation_"),
    "p1_evidence": ("knowledge_model.evidence[]", "evidence_"),
    "p1_excluded": ("knowledge_model.scope.exclude[]", "excluded_"),
    "p1_transitions": ("learner_model.transitions[]", "transition_"),
}
BEAT_REFS = {"scenes[].beats[]": nested.Refs(member="beat_refs", pool="beats")}
PAUSE_MS = 400


def p1_schema(spark: SparkSession, d: str) -> DataFrame:
    return nested.merged_schema(spread(load(spark, d, "scripts", "body")), "body")


def _levels(shredded: DataFrame) -> list[str]:
    """The levels that the documents show; those of SCRIPT_KINDS are lists even where no document writes one as such."""
    return [*SCRIPT_KINDS, *(p for p in nested.levels_of(shredded) if p not in SCRIPT_KINDS)]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    shredded = nested.shred(spread(load(spark, d, "scripts", "script_id", "body")), ["script_id"], "body", BEAT_REFS, values=False)
    flat = nested.related(shredded, ["script_id"], _levels(shredded), BEAT_REFS, values=False)
    kind = F.create_map(*[F.lit(x) for kv in SCRIPT_KINDS.items() for x in kv])[F.col("level")]
    spatial = F.col("level").startswith("scenes[]")
    pos = lambda i: F.coalesce(F.get("ordinals", F.lit(i)), F.lit(-1))
    outside = F.lit(-1)
    return flat.where(kind.isNotNull()).select("script_id", kind.alias("item_kind"),
                       F.when(spatial, pos(0)).otherwise(outside).cast("int").alias("scene_pos"),
                       F.when(spatial, pos(1)).otherwise(outside).cast("int").alias("beat_pos"),
                       F.when(spatial, pos(2)).otherwise(pos(0)).cast("int").alias("item_pos"))


def _opened(v: str) -> str:  # text that holds JSON stands for it
    return f"CASE WHEN json_type({v}) = 'VARCHAR' AND json_valid(json_extract_string({v}, '$')) THEN CAST(json_extract_string({v}, '$') AS JSON) ELSE {v} END"


def _entries(name: str, src: str, keys: str, v: str) -> str:
    return f"""{name}_v AS (SELECT {keys}, {_opened(v)} AS v FROM {src}),
{name}_l AS (SELECT {keys}, CASE json_type(v) WHEN 'ARRAY' THEN CAST(v AS JSON[]) WHEN 'OBJECT' THEN CASE WHEN len(json_keys(v)) = 0 THEN CAST([] AS JSON[])
 WHEN len(list_filter(json_keys(v), lambda k: json_type(json_extract(v, k)) <> 'OBJECT')) = 0 THEN list_transform(json_keys(v), lambda k: json_extract(v, k)) ELSE [v] END ELSE CAST([] AS JSON[]) END AS l FROM {name}_v),
{name} AS (SELECT {keys}, unnest(l) AS x, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos FROM {name}_l)"""


_P1_LEVELS = "WITH " + ",\n".join([  # the levels one below the other
    "d AS (SELECT script_id, CAST(body AS JSON) AS doc FROM scripts WHERE body IS NOT NULL AND json_valid(body))",
    _entries("sc", "d", "script_id, doc", "json_extract(doc, 'scenes')"),
    "so AS (SELECT script_id, doc, x AS s, pos AS scene_pos FROM sc WHERE json_type(x) = 'OBJECT')",
    _entries("own", "(SELECT * FROM so WHERE list_contains(json_keys(s), 'beats'))", "script_id, scene_pos", "json_extract(s, 'beats')"),
    _entries("rf", "(SELECT * FROM so WHERE NOT list_contains(json_keys(s), 'beats') AND list_contains(json_keys(doc), 'beats'))", "script_id, scene_pos", "json_extract(s, 'beat_refs')"),
    _entries("pl", "d", "script_id", "json_extract(doc, 'beats')"),
    "pool AS (SELECT script_id, json_extract_string(x, 'id') AS id, arg_min(x, pos) AS x FROM pl WHERE json_type(x) = 'OBJECT' AND json_type(json_extract(x, 'id')) = 'VARCHAR' GROUP BY 1, 2)",
    "bt AS (SELECT script_id, scene_pos, pos AS beat_pos, x FROM own WHERE json_type(x) = 'OBJECT' UNION ALL SELECT rf.script_id, scene_pos, pos, pool.x FROM rf JOIN pool ON pool.script_id = rf.script_id AND json_type(rf.x) = 'VARCHAR' AND json_extract_string(rf.x, '$') = pool.id)",
    _entries("rv", "bt", "script_id, scene_pos, beat_pos", "json_extract(x, 'reveal')"),
    f"km AS (SELECT script_id, {_opened('k')} AS k FROM (SELECT script_id, json_extract(doc, 'knowledge_model') AS k FROM d))",
    f"md AS (SELECT script_id, {_opened('m')} AS m FROM (SELECT script_id, json_extract(k, 'model') AS m FROM km WHERE json_type(k) = 'OBJECT'))",
    _entries("nd", "(SELECT * FROM md WHERE json_type(m) = 'OBJECT')", "script_id", "json_extract(m, 'nodes')"),
    _entries("rl", "(SELECT * FROM md WHERE json_type(m) = 'OBJECT')", "script_id", "json_extract(m, 'relations')"),
    _entries("ev", "(SELECT * FROM km WHERE json_type(k) = 'OBJECT')", "script_id", "json_extract(k, 'evidence')")]) + "\n"

P1_FOUND_SQL = _P1_LEVELS + """SELECT script_id, 'scene' AS item_kind, scene_pos, -1 AS beat_pos, -1 AS item_pos FROM so UNION ALL SELECT script_id, 'beat', scene_pos, beat_pos, -1 FROM bt UNION ALL
SELECT script_id, 'reveal', scene_pos, beat_pos, pos FROM rv WHERE json_type(x) = 'OBJECT' UNION ALL SELECT script_id, 'node', -1, -1, pos FROM nd WHERE json_type(x) = 'OBJECT' UNION ALL
SELECT script_id, 'relation', -1, -1, pos FROM rl WHERE json_type(x) = 'OBJECT' UNION ALL SELECT script_id, 'evidence', -1, -1, pos FROM ev WHERE json_type(x) = 'OBJECT'"""


def _p1_table_sql(src: str, node: str, parent: str, pos: str, prefix: str, members: str) -> str:
    """``members`` are those that the level has in the supplied scripts; ``!`` marks whole numbers."""
    cast = lambda m: f"TRY_CAST(json_extract_string(x, '{m[1:]}') AS BIGINT) AS {prefix}{m[1:]}" if m[0] == "!" else f"json_extract_string(x, '{m}') AS {prefix}{m}"
    return f"{_P1_LEVELS}SELECT script_id, {node} AS node_key, {parent} AS parent_key, {pos} AS ordinal, {', '.join(map(cast, members.split()))} FROM {src} WHERE json_type(x) = 'OBJECT'"


_BEAT = "'scenes[' || scene_pos || '].beats[' || beat_pos || ']'"
P1_TABLE_SQL = {
    "p1_scenes": _p1_table_sql("(SELECT script_id, scene_pos, s AS x FROM so)", "'scenes[' || scene_pos || ']'", "CAST(NULL AS VARCHAR)", "scene_pos", "scene_",
                               "beat_refs beats board_subject elements id narration"),
    "p1_beats": _p1_table_sql("bt", _BEAT, "'scenes[' || scene_pos || ']'", "beat_pos", "beat_",
                              "channel_allocation cognitive_operation elements evidence_refs id narrative obstacle reveal scene_slice state_after state_before visual_operation"),
    "p1_reveal": _p1_table_sql("rv", _BEAT + " || '.reveal[' || pos || ']'", _BEAT, "pos", "reveal_", "!bound_span op target"),
    "p1_nodes": _p1_table_sql("nd", "'knowledge_model.model.nodes[' || pos || ']'", "CAST(NULL AS VARCHAR)", "pos", "node_", "evidence id"),
    "p1_relations": _p1_table_sql("rl", "'knowledge_model.model.relations[' || pos || ']'", "CAST(NULL AS VARCHAR)", "pos", "relation_", "from to type"),
    "p1_evidence": _p1_table_sql("ev", "'knowledge_model.evidence[' || pos || ']'", "CAST(NULL AS VARCHAR)", "pos", "evidence_", "claim confidence id note source"),
}
_IN_SCENE = "'scenes[' || scene_pos || ']'"
_P1_MORE = {  # further levels: a name, where its list stands, the keys it takes along
    "p1_scene_elements": (_entries("se", "so", "script_id, scene_pos", "json_extract(s, 'elements')"), "se", _IN_SCENE + " || '.elements[' || pos || ']'", _IN_SCENE, "pos", "element_", "id phrase"),
    "p1_beat_elements": (_entries("be", "bt", "script_id, scene_pos, beat_pos", "json_extract(x, 'elements')"), "be", _BEAT + " || '.elements[' || pos || ']'", _BEAT, "pos", "element_", "id introduced_at semantic_role used_by"),
    "p1_pool_beats": ("u AS (SELECT 1)", "pl", "'beats[' || pos || ']'", "CAST(NULL AS VARCHAR)", "pos", "beat_",
                      "channel_allocation cognitive_operation elements evidence_refs id narrative obstacle reveal scene_slice state_after state_before visual_operation"),
    "p1_pool_elements": (_entries("pe", "(SELECT script_id, pos AS nth, x FROM pl WHERE json_type(x) = 'OBJECT')", "script_id, nth", "json_extract(x, 'elements')"), "pe",
                         "'beats[' || nth || '].elements[' || pos || ']'", "'beats[' || nth || ']'", "pos", "element_", "id introduced_at semantic_role used_by"),
    "p1_pool_reveal": (_entries("pr", "(SELECT script_id, pos AS nth, x FROM pl WHERE json_type(x) = 'OBJECT')", "script_id, nth", "json_extract(x, 'reveal')"), "pr",
                       "'beats[' || nth || '].reveal[' || pos || ']'", "'beats[' || nth || ']'", "pos", "reveal_", "!bound_span op target"),
    "p1_excluded": (_entries("xc", "km", "script_id", "json_extract(json_extract(k, 'scope'), 'exclude')"), "xc", "'knowledge_model.scope.exclude[' || pos || ']'", "CAST(NULL AS VARCHAR)", "pos", "excluded_", "idea reason"),
    "p1_transitions": (_entries("tr", "d", "script_id", "json_extract(json_extract(doc, 'learner_model'), 'transitions')"), "tr", "'learner_model.transitions[' || pos || ']'", "CAST(NULL AS VARCHAR)", "pos", "transition_",
                       "from_state id !load to_state"),
    "p1_documents": ("u AS (SELECT script_id, doc AS x FROM d)", "u", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)", "CAST(NULL AS INTEGER)", "doc_", "beats knowledge_model learner_model scenes theme"),
}
P1_TABLE_SQL |= {name: _p1_table_sql(*rest).replace(_P1_LEVELS, _P1_LEVELS.rstrip() + ",\n" + more + "\n") for name, (more, *rest) in _P1_MORE.items()}
P1_SCHEMA_SQL = f"""WITH RECURSIVE w AS (SELECT '' AS path, CAST(body AS JSON) AS raw FROM scripts WHERE body IS NOT NULL AND json_valid(body) AND json_type(body) <> 'NULL'
UNION ALL SELECT CASE WHEN c.k IS NULL THEN path || '[]' WHEN path = '' THEN c.k ELSE path || '.' || c.k END, c.x FROM (SELECT path, {_opened('raw')} AS v FROM w) w, LATERAL (
 SELECT NULL AS k, unnest(CASE WHEN json_type(v) = 'ARRAY' THEN CAST(v AS JSON[]) WHEN json_type(v) = 'OBJECT' AND len(list_filter(json_keys(v), lambda n: json_type(json_extract(v, n)) <> 'OBJECT')) = 0
  THEN list_transform(json_keys(v), lambda n: json_extract(v, n)) ELSE CAST([] AS JSON[]) END) AS x
 UNION ALL SELECT n, json_extract(v, n) FROM (SELECT unnest(CASE WHEN json_type(v) = 'OBJECT' THEN json_keys(v) ELSE [] END) AS n)) c),
t AS (SELECT path, json_type(raw) AS rt, json_type({_opened('raw')}) AS it FROM w)
SELECT path, type, count(*) AS n FROM (SELECT path, CASE WHEN rt = 'VARCHAR' AND it <> 'VARCHAR' THEN 'text of ' ELSE '' END || CASE coalesce(it, 'NULL') WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DOUBLE' THEN 'decimal' WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'object' ELSE 'integer' END AS type FROM t)
GROUP BY path, type"""


def _p1_table(level: str, prefix: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        scripts = spread(load(spark, d, "scripts", "script_id", "body"))
        flat = nested.flatten(scripts, ["script_id"], "body", [level], BEAT_REFS, values=False, members=True)
        return nested.child_table(flat, ["script_id"], level, prefix)
    return query


def _all_levels(spark: SparkSession, d: str) -> DataFrame:
    shredded = nested.shred(spread(load(spark, d, "scripts", "script_id", "body")), ["script_id"], "body", BEAT_REFS)
    return nested.related(shredded, ["script_id"], _levels(shredded), BEAT_REFS)


def p1_values(spark: SparkSession, d: str) -> DataFrame:
    """The entries of every list that are no objects: values, and lists as the parents of their own entries."""
    rows = _all_levels(spark, d).where("type <> 'object'")
    return rows.select("script_id", "level", "node_key", "parent_key", F.element_at("ordinals", -1).alias("ordinal"), "type", "value")


def p1_other(spark: SparkSession, d: str) -> DataFrame:
    """The objects of every list level that has no table of its own."""
    named = [level for level, _ in TABLES.values()]
    rows = _all_levels(spark, d).where((F.col("type") == "object") & ~F.col("level").isin(named))
    return rows.select("script_id", "level", "node_key", "parent_key", F.element_at("ordinals", -1).alias("ordinal"), "value")


def _words(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "words", "episode_id", "scene_index", "start_ms", "end_ms").where("scene_index is not null")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    g = intervals.gaps(_words(spark, d), ["episode_id", "scene_index"], "start_ms", "end_ms", PAUSE_MS)
    return g.withColumnsRenamed({"gap_start": "gap_start_ms", "gap_end": "gap_end_ms"})


def p4_periods(spark: SparkSession, d: str) -> DataFrame:
    return intervals.periods(_words(spark, d), ["episode_id", "scene_index"], "start_ms", "end_ms", PAUSE_MS)


_P4_MERGED = """
WITH v AS (SELECT episode_id, scene_index, start_ms s, end_ms e FROM words
           WHERE scene_index IS NOT NULL AND start_ms IS NOT NULL AND end_ms IS NOT NULL AND end_ms > start_ms),
o AS (SELECT *, max(e) OVER (PARTITION BY episode_id, scene_index ORDER BY s, e
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v)
"""
P4_FOUND_SQL = _P4_MERGED + """
SELECT episode_id, scene_index, reach AS gap_start_ms, s AS gap_end_ms FROM o WHERE s - reach >= 400"""
P4_PERIODS_SQL = _P4_MERGED + """,
m AS (SELECT *, sum(CASE WHEN reach IS NULL OR s - reach >= 400 THEN 1 ELSE 0 END) OVER (
        PARTITION BY episode_id, scene_index ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT episode_id, scene_index, min(s) AS period_start, max(e) AS period_end FROM m GROUP BY episode_id, scene_index, island"""

def _raw(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "raw_files", "file_id", "episode_id", "file_kind", "written_at", "payload")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(_raw(spark, d), "file_id", ["episode_id", "file_kind"], ["written_at", "file_id"], "payload")


P5_FOUND_SQL = """
WITH f AS (SELECT file_id, episode_id, file_kind, written_at, CAST(payload AS JSON) AS j FROM raw_files WHERE payload IS NOT NULL AND json_valid(payload)),
o AS (SELECT file_id, j, lag(j) OVER (PARTITION BY episode_id, file_kind ORDER BY written_at, file_id) AS pj FROM f),
p AS (SELECT * FROM o WHERE pj IS NOT NULL),
n1 AS (SELECT file_id, unnest(json_keys(j)) AS k, generate_subscripts(json_keys(j), 1) AS pos, j FROM p),
w1 AS (SELECT file_id, unnest(json_keys(pj)) AS k, generate_subscripts(json_keys(pj), 1) AS pos, pj FROM p),
n2 AS (SELECT file_id, '' AS lvl, k, pos, json_extract(j, k) AS v FROM n1), w2 AS (SELECT file_id, '' AS lvl, k, pos, json_extract(pj, k) AS v FROM w1),
both_ AS (SELECT n2.file_id, n2.k, n2.v AS nv, w2.v AS wv FROM n2 JOIN w2 ON n2.file_id = w2.file_id AND n2.k = w2.k WHERE json_type(n2.v) = 'OBJECT' AND json_type(w2.v) = 'OBJECT'),
n3 AS (SELECT file_id, k AS lvl, unnest(json_keys(nv)) AS ik, generate_subscripts(json_keys(nv), 1) AS pos, nv FROM both_),
w3 AS (SELECT file_id, k AS lvl, unnest(json_keys(wv)) AS ik, generate_subscripts(json_keys(wv), 1) AS pos, wv FROM both_),
kind AS (SELECT * FROM (VALUES ('UBIGINT', 'integer'), ('BIGINT', 'integer'), ('HUGEINT', 'integer'), ('DOUBLE', 'decimal'), ('VARCHAR', 'string'), ('BOOLEAN', 'boolean'), ('ARRAY', 'list'), ('OBJECT', 'object')) AS t(a, b)),
n AS (SELECT x.*, b AS t FROM (SELECT * FROM n2 UNION ALL SELECT file_id, lvl, ik, pos, json_extract(nv, ik) FROM n3) x JOIN kind ON json_type(v) = a),
w AS (SELECT x.*, b AS t FROM (SELECT * FROM w2 UNION ALL SELECT file_id, lvl, ik, pos, json_extract(wv, ik) FROM w3) x JOIN kind ON json_type(v) = a),
fresh AS (SELECT *, row_number() OVER (PARTITION BY file_id, lvl, CAST(v AS VARCHAR) ORDER BY pos) AS nth FROM n WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.file_id = n.file_id AND w.lvl = n.lvl AND w.k = n.k)),
gone AS (SELECT *, row_number() OVER (PARTITION BY file_id, lvl, CAST(v AS VARCHAR) ORDER BY pos) AS nth FROM w WHERE NOT EXISTS (SELECT 1 FROM n WHERE w.file_id = n.file_id AND w.lvl = n.lvl AND w.k = n.k)),
name AS (SELECT f.file_id, f.lvl, f.k, CASE WHEN g.k IS NULL THEN 'added' ELSE 'renamed' END AS change_kind FROM fresh f LEFT JOIN gone g ON f.file_id = g.file_id AND f.lvl = g.lvl AND CAST(f.v AS VARCHAR) = CAST(g.v AS VARCHAR) AND f.nth = g.nth
 UNION ALL SELECT g.file_id, g.lvl, g.k, 'removed' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.file_id = g.file_id AND f.lvl = g.lvl AND CAST(f.v AS VARCHAR) = CAST(g.v AS VARCHAR) AND f.nth = g.nth)
 UNION ALL SELECT n.file_id, n.lvl, n.k, 'retyped' FROM n JOIN w ON w.file_id = n.file_id AND w.lvl = n.lvl AND w.k = n.k WHERE n.t <> w.t)
SELECT file_id, CASE WHEN lvl = '' THEN k ELSE lvl || '.' || k END AS field_name, change_kind FROM name"""


def p5_types(spark: SparkSession, d: str) -> DataFrame:
    return drift.type_statistics(drift.path_values(_raw(spark, d), "payload"), ["file_kind"])


_P5_MEMBERS = """f AS (SELECT file_id, file_kind, CAST(payload AS JSON) AS j FROM raw_files WHERE payload IS NOT NULL AND json_valid(payload)),
t AS (SELECT file_id, file_kind, k AS path, k AS outer_, NULL AS inner_, json_extract(j, k) AS v FROM (SELECT *, unnest(json_keys(j)) AS k FROM f WHERE json_type(j) = 'OBJECT')),
m AS (SELECT * FROM t UNION ALL SELECT file_id, file_kind, path || '.' || i, outer_, i, json_extract(v, i) FROM (SELECT *, unnest(json_keys(v)) AS i FROM t WHERE json_type(v) = 'OBJECT')),
s AS (SELECT *, CASE json_type(v) WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DOUBLE' THEN 'decimal' WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'object' ELSE 'integer' END AS type FROM m WHERE json_type(v) <> 'NULL')"""
P5_TYPES_SQL = f"WITH {_P5_MEMBERS} SELECT file_kind, path, type, count(*) AS files FROM s GROUP BY ALL"


def p5_file_types(spark: SparkSession, d: str) -> DataFrame:
    """The raw type at each path of each file."""
    return drift.file_statistics(drift.path_values(_raw(spark, d), "payload"), ["file_id"]).select("file_id", "path", "type")


P5_FILE_TYPES_SQL = f"WITH {_P5_MEMBERS} SELECT file_id, path, type FROM s"


def p5_synonyms(spark: SparkSession, d: str) -> DataFrame:
    """The names that the renames between files show to be one field."""
    rows = [(kind, field, place, name) for kind in ("state", "words") for field, names in _p5_loaded(spark, d, kind)[1].items() for place, name in enumerate(names)]
    return spark.createDataFrame(rows, "file_kind string, field string, place int, name string")


def _p5_loaded(spark: SparkSession, d: str, file_kind: str) -> tuple[DataFrame, dict[str, list[str]]]:
    files = drift.path_values(_raw(spark, d).where(F.col("file_kind") == file_kind), "payload").where("members is not null")
    loaded = materialise(files.drop("payload", "file_kind"), "typed-files")
    return loaded, drift.found_synonyms(loaded, drift.compared(loaded, "file_id", ["episode_id"], ["written_at", "file_id"]))


def _p5_table(file_kind: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        keys = ["file_id", "episode_id", "written_at"]
        loaded, synonyms = _p5_loaded(spark, d, file_kind)
        return drift.typed_table(loaded, keys, drift.derived_fields(loaded, synonyms, keys))
    return query


# what the supplied files show at scale 0.01: columns and types in order, and the names of those that were renamed
P5_SHOWN = {
    "words": ("duration_ms:bigint granularity:string version:bigint voice:string checksum:string hook_ms:bigint rate:string retries:bigint reviewed_by:string sample_rate:bigint scenes:list tags:list "
              "words:list duration_ms.major:bigint duration_ms.major_ok:bigint granularity.value:string version.major:bigint version.value:string voice.value:string voice.value_ok:string",
              {"duration_ms": "duration_ms total_ms length_ms", "granularity": "granularity level timing_unit unit", "version": "version format_version v words_version", "voice": "voice speaker"}),
    "state": ("confirmations:object created:string schema:string theme:string title:string boards:list checksum:string hook_ms:bigint mix_gain:double phases:object rate:string retries:bigint "
              "reviewed_by:string sample_rate:bigint tags:list confirmations.0:string confirmations.1:string confirmations.2:string confirmations.audio_confirmed:string "
              "confirmations.content_confirmed:boolean confirmations.final_confirmed:boolean confirmations.items:list confirmations.visual_confirmed:boolean confirmations.visual_confirmed_ok:boolean "
              "created.value:string theme.value:string theme.value_ok:string boards.items:list boards.layout_checked:string phases.annotated:boolean phases.annotated_ok:boolean "
              "phases.boards_generated:boolean phases.boards_generated_ok:boolean phases.legal_checked:string phases.note:string phases.rendered:boolean",
              {"confirmations": "confirmations approvals gates", "created": "created created_at", "schema": "schema schema_tag", "theme": "theme look theme_id", "title": "title episode_title name"}),
}


def _canonical(v: str, depth: int) -> str:
    """JSON text with sorted members, down to ``depth`` levels."""
    if not depth:
        return f"CAST({v} AS VARCHAR)"
    e = f"e{depth}"
    return (f"CASE json_type({v}) WHEN 'OBJECT' THEN '{{' || array_to_string(list_transform(list_sort(json_keys({v})), lambda {e}: CAST(to_json({e}) AS VARCHAR) || ':' || {_canonical(f'json_extract({v}, {e})', depth - 1)}), ',') || '}}' "
            f"WHEN 'ARRAY' THEN '[' || array_to_string(list_transform(CAST({v} AS JSON[]), lambda {e}: {_canonical(f'coalesce({e}, CAST(chr(110) || chr(117) || chr(108) || chr(108) AS JSON))', depth - 1)}), ',') || ']' ELSE CAST({v} AS VARCHAR) END")


def _p5_sql(file_kind: str) -> str:
    """Each column from the first of its names that a file has, with the casts that failed."""
    columns, synonyms = P5_SHOWN[file_kind]
    raw, text, cast, failed = [], [], [], []
    for n, (column, t) in enumerate(c.split(":") for c in columns.split()):
        outer, _, inner = column.partition(".")
        paths = [f'$."{name}"' + (f'."{inner}"' if inner else "") for name in synonyms.get(outer, outer).split()]
        held = [f"CASE WHEN json_type(json_extract(j, '{p}')) <> 'NULL' THEN json_extract(j, '{p}') END" for p in paths]
        raw.append(f"coalesce({', '.join(held)}) AS v{n}")
        text.append(f"CASE WHEN json_type(v{n}) = 'VARCHAR' AND '{t}' NOT IN ('list', 'object') THEN json_extract_string(v{n}, '$') ELSE {_canonical(f'v{n}', 2)} END AS t{n}")
        number = f"TRY_CAST(t{n} AS DECIMAL(38, 9))"
        cast.append({"bigint": f"CASE WHEN {number} % 1 = 0 THEN TRY_CAST({number} AS BIGINT) END", "double": f"TRY_CAST(t{n} AS DOUBLE)",
                     "boolean": f"CASE WHEN lower(t{n}) IN ('t', 'true', 'y', 'yes', '1') THEN true WHEN lower(t{n}) IN ('f', 'false', 'n', 'no', '0') THEN false END"}.get(t, f"t{n}") + f' AS "{column}"')
        shape = {"list": f"json_type(v{n}) <> 'ARRAY'", "object": f"json_type(v{n}) <> 'OBJECT'", "string": f"json_type(v{n}) IN ('ARRAY', 'OBJECT')"}.get(t, f'"{column}" IS NULL')
        failed.append(f"CASE WHEN v{n} IS NOT NULL AND {shape} THEN '{column}' END")
    return (f"WITH j AS (SELECT file_id, episode_id, written_at, CAST(payload AS JSON) AS j FROM raw_files WHERE file_kind = '{file_kind}' AND payload IS NOT NULL AND json_valid(payload)), "
            f"r AS (SELECT *, {', '.join(raw)} FROM j), t AS (SELECT *, {', '.join(text)} FROM r), c AS (SELECT *, {', '.join(cast)} FROM t) "
            f"SELECT file_id, episode_id, written_at, {', '.join(chr(34) + c.split(':')[0] + chr(34) for c in columns.split())}, array_to_string(list_filter([{', '.join(failed)}], lambda x: x IS NOT NULL), ',') AS failed_casts FROM c")


QUERIES = {
    "p1_found": p1_found, "p1_schema": p1_schema,
    **{name: _p1_table(level, prefix) for name, (level, prefix) in TABLES.items()}, "p1_values": p1_values, "p1_other": p1_other,
    "p4_found": p4_found, "p4_periods": p4_periods,
    "p5_found": p5_found, "p5_types": p5_types, "p5_file_types": p5_file_types, "p5_synonyms": p5_synonyms, "p5_words": _p5_table("words"), "p5_state": _p5_table("state"),
}
ORACLE_SQL = {"p1_found": P1_FOUND_SQL, "p1_schema": P1_SCHEMA_SQL, **P1_TABLE_SQL, "p4_found": P4_FOUND_SQL, "p4_periods": P4_PERIODS_SQL, "p5_found": P5_FOUND_SQL, "p5_types": P5_TYPES_SQL, "p5_file_types": P5_FILE_TYPES_SQL,
              "p5_words": _p5_sql("words"), "p5_state": _p5_sql("state")}
