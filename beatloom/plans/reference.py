"""Queries of the timeline, alignment, layout, raster and integrity operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..functions.dictionary import CROSS_LANGUAGE
from ..operators import align, fingerprint, gates, lint, raster, schedule, spatial, timeline
from ..operators.ordered import next_row
from ..sources import load, readers
from . import adapters as A

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
SCENE, ORDER = A.SCENE, A.ORDER


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f
    return register


# text


@query(r"SELECT doc_id, regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g') AS norm FROM documents")
def normalized_text(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents", "doc_id", "text").select("doc_id", T.normalize(F.col("text")).alias("norm"))


_SENT = r"""sent AS (SELECT episode_id, scene_index, unnest(list_filter(regexp_extract_all(narration, '[^。？！!?]+[。？！!?]?'), lambda x: NOT regexp_full_match(x, '[\s\p{Z}]*'))) AS sentence,
 generate_subscripts(list_filter(regexp_extract_all(narration, '[^。？！!?]+[。？！!?]?'), lambda x: NOT regexp_full_match(x, '[\s\p{Z}]*')), 1) - 1 AS sentence_no FROM nar)"""


@query(f"WITH {A.NAR}, {_SENT} SELECT episode_id, scene_index, CAST(sentence_no AS INTEGER) AS sentence_no, sentence FROM sent")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    n = A.narrations(spark, d)
    return n.select(*SCENE, F.posexplode(T.split_sentences(F.col("narration"))).alias("sentence_no", "sentence"))


@query(r"SELECT word_id, coalesce(regexp_matches(regexp_replace(text, '[\s\p{Z}]+$', ''), '[。！？!?；;…]$'), false) AS is_end FROM words")
def sentence_ends(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "words", "word_id", "text").select("word_id", T.is_sentence_end(F.col("text")).alias("is_end"))


@query(f"WITH {A.NAR} SELECT episode_id, scene_index, CASE WHEN regexp_matches(narration, '故事|人物|经历|历史|传说|案例') THEN 'story' WHEN regexp_matches(narration, '算法|代码|技术|架构|系统|原理|机制|模型') THEN 'technical' WHEN regexp_matches(narration, '应该|必须|观点|认为|批判|反思') THEN 'opinion' ELSE 'educational' END AS knowledge_type FROM nar")
def knowledge_type(spark: SparkSession, d: str) -> DataFrame:
    return A.narrations(spark, d).select(*SCENE, T.knowledge_type(F.lit(None).cast("string"), F.col("narration")).alias("knowledge_type"))


@query("SELECT doc_id, regexp_replace(text, '<[^>]+>', '', 'g') AS bare FROM documents")
def markup_strip(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents", "doc_id", "text").select("doc_id", T.strip_markup(F.col("text")).alias("bare"))


@query("SELECT scene_key, coalesce(nullif(scene_id, ''), printf('scene-%02d', scene_index + 1)) AS scene_id FROM scenes WHERE scene_index IS NOT NULL")
def positional_ids(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "scenes", "scene_key", "scene_id", "scene_index").where("scene_index is not null")
    return s.select("scene_key", T.first_nonempty(F.col("scene_id"), F.format_string("scene-%02d", F.col("scene_index") + 1)).alias("scene_id"))


@query(r"SELECT element_key, TRY_CAST(regexp_extract(element_id, '^(?i)panel[-_]?(\d+)$', 1) AS INTEGER) AS panel_no FROM elements")
def panel_numbers(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "elements", "element_key", "element_id").select("element_key", F.regexp_extract("element_id", r"(?i)\Apanel[-_]?(\d+)\z", 1).try_cast("int").alias("panel_no"))


@query("SELECT event_id, json_extract_string(TRY_CAST(props AS JSON), '$.page') AS page, json_extract_string(TRY_CAST(props AS JSON), '$.ref') AS ref FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events", "event_id", "props")
    return e.select("event_id", F.get_json_object("props", "$.page").alias("page"), F.get_json_object("props", "$.ref").alias("ref"))


# timelines


@query(f"WITH {A.TL} SELECT episode_id, scene_index, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_units FROM tl GROUP BY episode_id, scene_index")
def scene_windows(spark: SparkSession, d: str) -> DataFrame:
    return timeline.scene_windows(A.timeline(spark, d), SCENE)


@query(f"WITH {A.TL}, w AS (SELECT episode_id, scene_index, max(end_ms) - min(start_ms) AS duration_ms FROM tl GROUP BY 1, 2) SELECT episode_id, scene_index, duration_ms, CAST(coalesce(sum(duration_ms) OVER (PARTITION BY episode_id ORDER BY scene_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_ms FROM w")
def running_offsets(spark: SparkSession, d: str) -> DataFrame:
    w = scene_windows(spark, d).select(*SCENE, (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))
    return timeline.running_offsets(w, "episode_id", "scene_index", "duration_ms")


@query(f"WITH {A.TL}, w AS (SELECT episode_id, scene_index, max(end_ms) - min(start_ms) AS duration_ms FROM tl GROUP BY 1, 2) SELECT episode_id, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, CAST(grouping(episode_id) AS INTEGER) AS is_total FROM w GROUP BY ROLLUP(episode_id)")
def duration_rollup(spark: SparkSession, d: str) -> DataFrame:
    w = scene_windows(spark, d).select(*SCENE, (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))
    return timeline.with_total(w, "episode_id", "duration_ms")


_VIOL = """v AS (SELECT *, lag(start_ms) OVER (PARTITION BY episode_id, scene_index ORDER BY word_id) AS previous_start_ms FROM words WHERE scene_index IS NOT NULL AND end_ms >= start_ms),
bad AS (SELECT * FROM v WHERE start_ms < previous_start_ms)"""


@query(f"WITH {_VIOL} SELECT episode_id, scene_index, count(*) AS n_offenders, string_agg(CASE WHEN rn <= 3 THEN CAST(word_id AS VARCHAR) END, ',' ORDER BY rn) AS first FROM (SELECT *, row_number() OVER (PARTITION BY episode_id, scene_index ORDER BY word_id) AS rn FROM bad) GROUP BY 1, 2")
def word_order_violations(spark: SparkSession, d: str) -> DataFrame:
    """Words that start before the one before them in order of arrival, counted, with the first three."""
    w = load(spark, d, "words", "word_id", "episode_id", "scene_index", "start_ms", "end_ms").where("scene_index is not null")
    return gates.first_offenders(timeline.order_violations(w, SCENE, ["word_id"]), SCENE, ["word_id"], "word_id")


@query("""WITH v AS (SELECT *, lower(trim(granularity)) = 'sentence' AS s, last_value(CASE WHEN end_ms >= start_ms THEN start_ms END IGNORE NULLS) OVER (PARTITION BY episode_id, scene_index ORDER BY word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM words WHERE scene_index IS NOT NULL)
SELECT episode_id, scene_index, code, severity, count(*) AS n FROM (
SELECT episode_id, scene_index, 'bad_number' AS code, 'blocking' AS severity FROM v WHERE start_ms IS NULL OR end_ms IS NULL UNION ALL
SELECT episode_id, scene_index, 'negative_duration', 'blocking' FROM v WHERE end_ms < start_ms UNION ALL
SELECT episode_id, scene_index, 'out_of_order', 'blocking' FROM v WHERE end_ms >= start_ms AND start_ms < b UNION ALL
SELECT episode_id, scene_index, 'sentence_granularity', 'warning' FROM v WHERE s) GROUP BY ALL""")
def word_table_gate(spark: SparkSession, d: str) -> DataFrame:
    w = load(spark, d, "words", "word_id", "episode_id", "scene_index", "start_ms", "end_ms", "granularity").where("scene_index is not null")
    return gates.word_table(w, SCENE, ["word_id"])


@query(f"""WITH {A.TL}, w AS (SELECT episode_id, scene_index, min(start_ms) AS a, max(end_ms) AS b FROM tl WHERE length(text) > 4 GROUP BY 1, 2)
SELECT word_id FROM tl JOIN w USING (episode_id, scene_index) WHERE start_ms < a - 50 OR end_ms > b + 50""")
def words_outside_cues(spark: SparkSession, d: str) -> DataFrame:
    """Words that reach out of the window of their scene's longer words."""
    units = A.timeline(spark, d)
    return timeline.outside_windows(units, timeline.scene_windows(units.where(F.length("text") > 4), SCENE), SCENE).select("word_id")


@query("SELECT user_id, event_id, event_type, nxt AS next_state FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE trim(event_type) <> '' AND trim(nxt) <> '' AND trim(event_type) <> trim(nxt)")
def state_chain_breaks(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events", "event_id", "ts", "user_id", "event_type")
    return timeline.chain_breaks(e, ["user_id"], ["ts", "event_id"], "event_type", "event_type").select("user_id", "event_id", "event_type", "next_state")


def _fold_sql(limit: int, pause: int, blank: str) -> str:
    # one recursion step per word position, all scenes at once
    end = r"regexp_matches(regexp_replace(text, '[\s\p{Z}]+$', ''), '[。！？!?；;…]$')"
    return f"""{A.TL}, o AS (SELECT *, row_number() OVER w AS i, length(text) AS n, coalesce({end}, false) AS closes, lag(end_ms) OVER w AS pe FROM tl WHERE {blank}
 WINDOW w AS (PARTITION BY episode_id, scene_index ORDER BY start_ms, word_id)),
f AS (SELECT episode_id, scene_index, i, word_id, text, start_ms, end_ms, closes, CAST(n AS BIGINT) AS used, CAST(1 AS BIGINT) AS line FROM o WHERE i = 1 UNION ALL
 SELECT o.episode_id, o.scene_index, o.i, o.word_id, o.text, o.start_ms, o.end_ms, o.closes,
  CASE WHEN f.closes OR o.start_ms - o.pe >= {pause} OR f.used >= {limit} THEN o.n ELSE f.used + o.n END,
  CASE WHEN f.closes OR o.start_ms - o.pe >= {pause} OR f.used >= {limit} THEN f.line + 1 ELSE f.line END
 FROM f JOIN o ON o.episode_id = f.episode_id AND o.scene_index = f.scene_index AND o.i = f.i + 1)"""


@query(f"""WITH RECURSIVE {_fold_sql(22, 400, r"NOT regexp_full_match(text, '[\s\p{Z}]*')")}
SELECT episode_id, scene_index, CAST(line AS INTEGER) AS caption_no, string_agg(text, '' ORDER BY i) AS text, arg_min(start_ms, i) AS start_ms, arg_max(end_ms, i) AS end_ms, count(*) AS n_words FROM f GROUP BY 1, 2, 3""")
def caption_groups(spark: SparkSession, d: str) -> DataFrame:
    return timeline.captions(A.timeline(spark, d), SCENE, ORDER)


_LINES = _fold_sql(18, 350, "text <> ''")


@query(f"WITH RECURSIVE {_LINES} SELECT word_id, CAST(line AS INTEGER) AS line_no FROM f")
def subtitle_lines(spark: SparkSession, d: str) -> DataFrame:
    return timeline.subtitle_lines(A.timeline(spark, d), SCENE, ORDER).select("word_id", "line_no")


@query(f"""WITH RECURSIVE {_LINES} SELECT word_id, CAST(greatest(0, round_even((start_ms - coalesce(lag(end_ms) OVER w, start_ms)) / 10.0, 0)) AS BIGINT) AS gap_cs,
CAST(greatest(1, round_even((end_ms - start_ms) / 10.0, 0)) AS BIGINT) AS k_cs FROM f WINDOW w AS (PARTITION BY episode_id, scene_index, line ORDER BY i)""")
def karaoke_timing(spark: SparkSession, d: str) -> DataFrame:
    lines = timeline.subtitle_lines(A.timeline(spark, d), SCENE, ORDER)
    return timeline.karaoke(lines, SCENE, ORDER).select("word_id", "gap_cs", "k_cs")


_TC = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"


@query(f"SELECT word_id, {_TC.format('greatest(start_ms, 0)')} AS srt, greatest(start_ms, 0) AS back_ms FROM words WHERE start_ms IS NOT NULL")
def srt_times(spark: SparkSession, d: str) -> DataFrame:
    """Starts as subtitle time codes and read back."""
    w = load(spark, d, "words", "word_id", "start_ms").where("start_ms is not null").withColumn("srt", T.ms_to_srt(F.col("start_ms")))
    return w.select("word_id", "srt", T.srt_to_ms(F.col("srt")).alias("back_ms"))


@query("SELECT word_id, printf('%d:%02d:%02d.%02d', cs // 360000, cs // 6000 % 60, cs // 100 % 60, cs % 100) AS ass FROM (SELECT word_id, CAST(round_even(greatest(end_ms, 0) / 10.0, 0) AS BIGINT) AS cs FROM words WHERE end_ms IS NOT NULL)")
def ass_times(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "words", "word_id", "end_ms").where("end_ms is not null").select("word_id", T.ms_to_ass(F.col("end_ms")).alias("ass"))


@query(f"""WITH {A.TASKS}, e AS (SELECT user_id, max(end_ms) AS dur FROM tasks GROUP BY 1), n AS (SELECT user_id, CAST(greatest(ceil((dur - 2000) / 500.0), 0) AS BIGINT) AS n_windows FROM e),
s AS (SELECT user_id, n_windows, unnest(range(n_windows)) AS k FROM n),
f AS (SELECT s.user_id, s.k, sum(CASE WHEN kind = 'draw' THEN length ELSE 0 END) AS arc, sum(CASE WHEN kind = 'travel' THEN end_ms - start_ms ELSE 0 END) AS travel FROM s JOIN tasks t ON t.user_id = s.user_id AND t.start_ms >= s.k * 500 AND t.start_ms < s.k * 500 + 2000 GROUP BY 1, 2)
SELECT n.user_id, n_windows, (SELECT count(*) FROM f WHERE f.user_id = n.user_id AND arc < 60 AND travel > 800) AS n_sweeps FROM n""")
def sweep_audit(spark: SparkSession, d: str) -> DataFrame:
    return timeline.sweep_audit(A.tasks(spark, d), "user_id")


@query("""WITH o AS (SELECT user_id, coalesce(value > 50, false) AS flag, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events), g AS (SELECT user_id, pos, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS k FROM o WHERE flag)
SELECT user_id, CAST(first_pos AS INTEGER) AS first_pos, CAST(last_pos AS INTEGER) AS last_pos, n, CAST(row_number() OVER (PARTITION BY user_id ORDER BY first_pos) AS INTEGER) AS run_no FROM (SELECT user_id, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n FROM g GROUP BY user_id, k HAVING count(*) >= 2)""")
def run_segments(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events", "event_id", "ts", "user_id", "value")
    return timeline.runs(e, ["user_id"], ["ts", "event_id"], F.col("value") > 50)


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, l_orderkey % 3 + 1 AS k FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber))
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN i < (n % k) * (n // k + 1) THEN i // (n // k + 1) ELSE n % k + (i - (n % k) * (n // k + 1)) // greatest(n // k, 1) END + 1 AS INTEGER) AS panel_no FROM o""")
def op_split(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "lineitem", "l_orderkey", "l_linenumber").withColumn("k", F.col("l_orderkey") % 3 + 1)
    return timeline.even_split(o, ["l_orderkey"], ["l_linenumber"], "k").select("l_orderkey", "l_linenumber", "panel_no")


@query(f"WITH {A.RECTS} SELECT p_partkey, coalesce(count(*) OVER w, 0) AS n_protected, CAST(coalesce(sum(w * h) OVER w, 0) AS BIGINT) AS protected_area FROM rects WINDOW w AS (PARTITION BY scene ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def protected_regions(spark: SparkSession, d: str) -> DataFrame:
    return timeline.protected_regions(A.rects(spark, d), ["scene"], ["p_partkey"]).select("p_partkey", "n_protected", "protected_area")


_REGIONS = "reg AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_suppkey % 4000 AS BIGINT) AS start_ms, CAST(300 + l_partkey % 900 AS BIGINT) AS duration_ms FROM lineitem)"


@query(f"""WITH RECURSIVE {_REGIONS}, o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM reg),
f AS (SELECT l_orderkey, l_linenumber, i, greatest(start_ms, 150) AS s, greatest(start_ms, 150) + duration_ms AS e FROM o WHERE i = 1 UNION ALL
SELECT o.l_orderkey, o.l_linenumber, o.i, greatest(o.start_ms, f.e + 150), greatest(o.start_ms, f.e + 150) + o.duration_ms FROM f JOIN o ON o.l_orderkey = f.l_orderkey AND o.i = f.i + 1)
SELECT l_orderkey, l_linenumber, s AS actual_start, e AS actual_end FROM f""")
def region_serialisation(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_suppkey") % 4000).alias("start_ms"), (300 + F.col("l_partkey") % 900).alias("duration_ms"))
    return timeline.serialise(r, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "actual_start", "actual_end")


@query(f"""WITH {A.TL}, o AS (SELECT *, max(end_ms) OVER (PARTITION BY episode_id, scene_index ORDER BY start_ms, word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM tl)
SELECT word_id, CAST(sum(CASE WHEN reach IS NULL OR start_ms - reach > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id, scene_index ORDER BY start_ms, word_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster_no FROM o""")
def gap_clusters(spark: SparkSession, d: str) -> DataFrame:
    return timeline.clusters(A.timeline(spark, d), SCENE, ORDER, 400).select("word_id", "cluster_no")


@query(f"""WITH {A.TL}, w AS (SELECT episode_id, scene_index, min(start_ms) AS s, max(end_ms) AS e FROM tl GROUP BY 1, 2), t AS (SELECT episode_id, max(e) AS total FROM w GROUP BY 1),
a AS (SELECT w.*, total, coalesce(lag(r) OVER (PARTITION BY episode_id ORDER BY scene_index), 0) AS before FROM (SELECT *, max(e) OVER (PARTITION BY episode_id ORDER BY scene_index ROWS UNBOUNDED PRECEDING) AS r FROM w) w JOIN t USING (episode_id)),
b AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY episode_id ORDER BY scene_index) = 1 THEN 0 ELSE greatest(s, before) END AS rs FROM a)
SELECT episode_id, scene_index, CAST(rs AS BIGINT) AS repaired_start, CAST(coalesce(min(rs) OVER (PARTITION BY episode_id ORDER BY scene_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), greatest(CASE WHEN total > 0 THEN total ELSE r END, rs)) AS BIGINT) AS repaired_end FROM b""")
def contiguous_windows(spark: SparkSession, d: str) -> DataFrame:
    w = scene_windows(spark, d)
    w = w.withColumn("total", F.max("end_ms").over(Window.partitionBy("episode_id")))
    return timeline.contiguous(w, "episode_id", "scene_index", "total").select(*SCENE, F.col("repaired_start").cast("bigint").alias("repaired_start"), F.col("repaired_end").cast("bigint").alias("repaired_end"))


@query(f"WITH {A.TL}, w AS (SELECT episode_id, scene_index, min(start_ms) AS s FROM tl GROUP BY 1, 2) SELECT word_id, greatest(0, start_ms - s) AS local_start_ms, greatest(0, end_ms - s) AS local_end_ms FROM tl JOIN w USING (episode_id, scene_index)")
def local_times(spark: SparkSession, d: str) -> DataFrame:
    units = A.timeline(spark, d)
    return timeline.to_local(units, timeline.scene_windows(units, SCENE), SCENE).select("word_id", "local_start_ms", "local_end_ms")


# alignment

_HAY = r"""u AS (SELECT * FROM (SELECT episode_id, scene_index, word_id, start_ms, end_ms, regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g') AS t FROM tl) WHERE t <> ''),
off AS (SELECT *, sum(length(t)) OVER (PARTITION BY episode_id, scene_index ORDER BY start_ms, word_id ROWS UNBOUNDED PRECEDING) AS b FROM u),
hay AS (SELECT episode_id, scene_index, string_agg(t, '' ORDER BY start_ms, word_id) AS hay FROM u GROUP BY 1, 2)"""
_HIT = """hit AS (SELECT n.*, instr(hay, needle) - 1 AS at FROM n JOIN hay h ON h.episode_id = n.episode_id AND h.scene_index = n.scene_index WHERE needle <> '' AND instr(hay, needle) > 0)"""


@query(rf"""WITH {A.TL}, {A.NAR}, {_SENT}, {_HAY}, n AS (SELECT *, regexp_replace(sentence, '[^\p{{L}}\p{{N}}]+', '', 'g') AS needle FROM sent), {_HIT}
SELECT h.episode_id, h.scene_index, CAST(sentence_no AS INTEGER) AS sentence_no, any_value(sentence) AS sentence, arg_min(start_ms, b) AS start_ms, arg_max(end_ms, b) AS end_ms FROM hit h
JOIN off o ON o.episode_id = h.episode_id AND o.scene_index = h.scene_index AND o.b > h.at AND o.b - length(o.t) < h.at + length(h.needle) GROUP BY 1, 2, 3""")
def narration_spans(spark: SparkSession, d: str) -> DataFrame:
    return align.narration_spans(A.narrations(spark, d), A.timeline(spark, d), SCENE, ORDER, "narration")


def _phrases(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "scenes", "scene_key", "episode_id", "scene_index").where("scene_index is not null")
    return load(spark, d, "elements", "element_key", "scene_key", "phrase").join(s, "scene_key")


@query(rf"""WITH {A.TL}, {_HAY}, n AS (SELECT element_key, episode_id, scene_index, regexp_replace(phrase, '[^\p{{L}}\p{{N}}]+', '', 'g') AS needle FROM elements JOIN scenes USING (scene_key) WHERE scene_index IS NOT NULL), {_HIT},
r AS (SELECT element_key, arg_min(start_ms, b) AS s, arg_max(end_ms, b) AS e FROM hit h JOIN off o ON o.episode_id = h.episode_id AND o.scene_index = h.scene_index AND o.b > h.at AND o.b - length(o.t) < h.at + length(h.needle) GROUP BY 1)
SELECT element_key, s AS matched_start_ms, e AS matched_end_ms FROM n LEFT JOIN r USING (element_key)""")
def phrase_match_exact(spark: SparkSession, d: str) -> DataFrame:
    p = _phrases(spark, d)
    return align.exact_matches(p, align.haystacks(A.timeline(spark, d), SCENE, ORDER), SCENE, "phrase").select("element_key", "matched_start_ms", "matched_end_ms")


@query()
def phrase_match(spark: SparkSession, d: str) -> DataFrame:
    """Exact, then fuzzy, then through the dictionary."""
    hays = align.haystacks(A.timeline(spark, d), SCENE, ORDER)
    return align.phrase_matches(_phrases(spark, d), hays, SCENE, "element_key", "phrase", align.fixed_dictionary(spark, CROSS_LANGUAGE))


_DICT_SQL = ", ".join(f"('{k}', {i}, '{'/'.join(v)}')" for i, (k, v) in enumerate(CROSS_LANGUAGE.items()))


@query(f"""WITH dict(term, pos, tr) AS (VALUES {_DICT_SQL}), k AS (SELECT element_key, lower(trim(phrase)) AS k FROM elements WHERE trim(phrase) <> '')
SELECT element_key, arg_min(tr, CASE WHEN k = term THEN 0 ELSE 1000 END + pos) AS translations FROM k JOIN dict ON contains(k, term) GROUP BY 1""")
def dictionary_match(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "elements", "element_key", "phrase").select(F.col("element_key").alias("id"), "phrase")
    t = align.translations(p, align.fixed_dictionary(spark, CROSS_LANGUAGE))
    return t.select(F.col("id").alias("element_key"), F.array_join("translations", "/").alias("translations"))


@query()
def cue_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Sentence cues to the scenes whose narration holds them."""
    cues = load(spark, d, "words", "word_id", "episode_id", "text", "start_ms", "granularity").where("lower(trim(granularity)) = 'sentence' and start_ms is not null")
    return align.assign_cues(cues, A.narrations(spark, d), "episode_id", ["start_ms", "word_id"])


@query()
def coverage_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Likeness of what was spoken and the narration, letters and digits alone, with the gate's verdict."""
    hays = align.haystacks(A.timeline(spark, d), SCENE, ORDER).select(*SCENE, "hay")
    r = A.narrations(spark, d).where("narration is not null").join(hays, SCENE).select(*SCENE, T.gestalt_ratio(F.col("hay"), T.normalize(F.col("narration"))).alias("ratio"))
    verdict = gates.coverage(r, SCENE, "ratio").select(*SCENE, "code")
    return r.join(verdict, SCENE, "left")


# scheduling


@query(f"""WITH {A.SLOTS}, a AS (SELECT *, sqrt(greatest(len, 1e-6)) AS w, count(*) OVER p AS n FROM slots WINDOW p AS (PARTITION BY l_orderkey)), b AS (SELECT *, greatest(60 * n, dur - 120 * (n - 1)) AS budget, sum(w) OVER (PARTITION BY l_orderkey) AS tw FROM a),
c AS (SELECT *, greatest(60, CAST(floor(budget * w / tw) AS BIGINT)) AS d FROM b), e AS (SELECT *, sum(d) OVER (PARTITION BY l_orderkey) AS td FROM c)
SELECT l_orderkey, l_linenumber, CASE WHEN td > budget THEN greatest(45, CAST(floor(d * (CAST(budget AS DOUBLE) / td)) AS BIGINT)) ELSE d END AS slot_ms FROM e""")
def slot_durations(spark: SparkSession, d: str) -> DataFrame:
    return schedule.slot_durations(A.slots(spark, d), ["l_orderkey"], "len", "dur").select("l_orderkey", "l_linenumber", "slot_ms")


@query(f"""WITH {A.SLOTS}, a AS (SELECT *, CAST(floor(dur * 0.10::DOUBLE) AS BIGINT) AS layout, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS i FROM slots),
b AS (SELECT *, greatest(800, CAST(floor((dur - 300 - layout - 600 - 150 * n) / n) AS BIGINT)) AS each FROM a) SELECT l_orderkey, l_linenumber, each AS duration_ms, CAST(300 + layout + 150 + i * (each + 150) AS BIGINT) AS start_ms FROM b""")
def legacy_schedule(spark: SparkSession, d: str) -> DataFrame:
    return schedule.legacy_schedule(A.slots(spark, d), ["l_orderkey"], ["l_linenumber"], "dur").select("l_orderkey", "l_linenumber", "duration_ms", "start_ms")


def _anchored(found: DataFrame, units: DataFrame, start: str, end: str) -> DataFrame:
    """Matched panels with their scene's duration and their span in the scene's own time."""
    windows = timeline.scene_windows(units, SCENE).select(*SCENE, F.col("start_ms").alias("_w"), (F.col("end_ms") - F.col("start_ms")).alias("duration"))
    local = lambda c: F.greatest(F.lit(0), F.col(c) - F.col("_w"))
    when = lambda c: F.when(F.col(c).isNotNull(), local(c))
    return found.join(windows, SCENE).withColumn("span_start", when(start)).withColumn("span_end", when(end))


def _panels(spark: SparkSession, d: str) -> DataFrame:
    units = A.timeline(spark, d)
    found = align.exact_matches(_phrases(spark, d), align.haystacks(units, SCENE, ORDER), SCENE, "phrase")
    return _anchored(found, units, "matched_start_ms", "matched_end_ms")


_EXACT = rf"""{A.TL}, {_HAY}, n AS (SELECT element_key, episode_id, scene_index, regexp_replace(phrase, '[^\p{{L}}\p{{N}}]+', '', 'g') AS needle FROM elements JOIN scenes USING (scene_key) WHERE scene_index IS NOT NULL), {_HIT},
r AS (SELECT element_key, arg_min(start_ms, b) AS s, arg_max(end_ms, b) AS e FROM hit h JOIN off o ON o.episode_id = h.episode_id AND o.scene_index = h.scene_index AND o.b > h.at AND o.b - length(o.t) < h.at + length(h.needle) GROUP BY 1)"""


def _planned(matches: str) -> str:
    """``planned``: the windows of the panels ``n`` whose matches are ``r``."""
    return f"""{matches},
win AS (SELECT episode_id, scene_index, min(start_ms) AS w, max(end_ms) - min(start_ms) AS d FROM tl GROUP BY 1, 2),
pan AS (SELECT n.episode_id, n.scene_index, n.element_key, greatest(1500, d - 600) AS hi, greatest(0, s - w) AS ss, greatest(0, e - w) AS se, s IS NOT NULL AS own, CAST(row_number() OVER (PARTITION BY n.episode_id, n.scene_index ORDER BY n.element_key) AS INTEGER) - 1 AS i,
 CAST(count(*) OVER (PARTITION BY n.episode_id, n.scene_index) AS INTEGER) AS c FROM n LEFT JOIN r USING (element_key) JOIN win ON win.episode_id = n.episode_id AND win.scene_index = n.scene_index),
fold AS (SELECT episode_id, scene_index, i, hi, c, own, CASE WHEN own THEN least(greatest(ss, 1050), hi - 450) END AS s, CASE WHEN own THEN greatest(least(se, hi), least(greatest(ss, 1050), hi - 450) + 450) END AS e,
  CASE WHEN own THEN greatest(least(se, hi), least(greatest(ss, 1050), hi - 450) + 450) + 150 ELSE 1050 END AS free FROM pan WHERE i = 0 UNION ALL
 SELECT p.episode_id, p.scene_index, p.i, p.hi, p.c, p.own, CASE WHEN p.own THEN least(greatest(ss, f.free), p.hi - 450) END, CASE WHEN p.own THEN greatest(least(se, p.hi), least(greatest(ss, f.free), p.hi - 450) + 450) END,
  CASE WHEN p.own THEN greatest(least(se, p.hi), least(greatest(ss, f.free), p.hi - 450) + 450) + 150 ELSE f.free END FROM fold f JOIN pan p ON p.episode_id = f.episode_id AND p.scene_index = f.scene_index AND p.i = f.i + 1),
side AS (SELECT *, coalesce(max(CASE WHEN own THEN i END) OVER b, -1) AS li, last_value(e IGNORE NULLS) OVER b AS le, coalesce(min(CASE WHEN own THEN i END) OVER a, c) AS ri, first_value(s IGNORE NULLS) OVER a AS rs FROM fold
 WINDOW b AS (PARTITION BY episode_id, scene_index ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY episode_id, scene_index ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
run AS (SELECT *, i - li - 1 AS k, ri - li - 1 AS n, coalesce(rs - 150, hi) AS stop, least(coalesce(le + 150, 1050), coalesce(rs - 150, hi)) AS lo FROM side),
each AS (SELECT *, floor((stop - lo - 150 * (n - 1)) / n::DOUBLE) AS share FROM run),
timed AS (SELECT *, lo + k * (CASE WHEN share < 300 THEN greatest(120, share) ELSE share END + 150) AS t, CASE WHEN share < 300 THEN greatest(120, share) ELSE share END AS per FROM each),
placed AS (SELECT *, own OR k = 0 OR t < stop AS fits, CASE WHEN own THEN s WHEN k = 0 OR t < stop THEN t ELSE hi - 300 END AS ps, CASE WHEN own THEN e WHEN k = 0 OR t < stop THEN greatest(least(t + per, stop), t + 120) ELSE hi END AS pe FROM timed),
planned AS (SELECT episode_id, scene_index, i + 1 AS panel_no, CAST(CASE WHEN i = 0 AND ps > 1200 THEN 1050 ELSE ps END AS BIGINT) AS start_ms, CAST(pe AS BIGINT) AS end_ms, own AS anchored, share < 300 AS short_, NOT own AND k = 0 AS opens, n, NOT fits AS homeless, lag(fits) OVER (PARTITION BY episode_id, scene_index ORDER BY i) AS fitted, k FROM placed)"""


@query(f"WITH RECURSIVE {_planned(_EXACT)} SELECT episode_id, scene_index, panel_no, start_ms, end_ms - start_ms AS duration_ms, anchored FROM planned")
def schedule_windows(spark: SparkSession, d: str) -> DataFrame:
    """Reveal windows of each scene's elements, anchored where their phrases stand exactly."""
    return schedule.schedule_windows(_panels(spark, d), SCENE, "element_key", "duration").drop("warnings")


@query()
def schedule_windows_matched(spark: SparkSession, d: str) -> DataFrame:
    """The same, anchored by the whole precedence: exact, fuzzy, through the dictionary."""
    units = A.timeline(spark, d)
    found = align.phrase_matches(_phrases(spark, d), align.haystacks(units, SCENE, ORDER), SCENE, "element_key", "phrase", align.fixed_dictionary(spark, CROSS_LANGUAGE))
    return schedule.schedule_windows(_anchored(found, units, "start_ms", "end_ms"), SCENE, "element_key", "duration")


def _ops(panels: DataFrame) -> DataFrame:
    """Every second element as a reveal of its panel, bound to one of the scene's first three sentences."""
    k = F.col("element_key")
    return panels.where(k % 2 == 1).select(*SCENE, "panel_no", k.alias("op_no"), F.lit("DRAW").alias("op"), F.format_string("el-%d", k).alias("target"), (k % 3).cast("int").alias("bound_span"))


def _numbered(spark: SparkSession, d: str, units: DataFrame) -> DataFrame:
    """The elements of each scene that has a timeline, as numbered panels."""
    with_units = _phrases(spark, d).join(units.select(*SCENE).distinct(), SCENE)
    return with_units.withColumn("panel_no", F.row_number().over(Window.partitionBy(*SCENE).orderBy("element_key")))


def _documents(panels: DataFrame, spans: DataFrame, matches: DataFrame, units: DataFrame) -> DataFrame:
    ops = _ops(panels)
    found = _anchored(align.panel_spans(panels, ops, spans, matches, SCENE), units, "start_ms", "end_ms")
    planned = schedule.schedule_windows(found, SCENE, "panel_no", "duration")
    cells = found.withColumn("n", F.count("*").over(Window.partitionBy(*SCENE))).withColumn("cell", F.element_at(G.grid(F.col("n")), F.col("panel_no")))
    return schedule.annotations(cells, planned, SCENE, F.col("cell"), ops)


_SPANS = rf"""{A.NAR}, {_SENT}, sn AS (SELECT *, regexp_replace(sentence, '[^\p{{L}}\p{{N}}]+', '', 'g') AS needle FROM sent),
sh AS (SELECT s.*, instr(hay, needle) - 1 AS at FROM sn s JOIN hay h ON h.episode_id = s.episode_id AND h.scene_index = s.scene_index WHERE needle <> '' AND instr(hay, needle) > 0),
spans AS (SELECT h.episode_id, h.scene_index, sentence_no, arg_min(start_ms, b) AS s, arg_max(end_ms, b) AS e FROM sh h JOIN off o ON o.episode_id = h.episode_id AND o.scene_index = h.scene_index AND o.b > h.at AND o.b - length(o.t) < h.at + length(h.needle) GROUP BY 1, 2, 3),
places AS (SELECT *, row_number() OVER (PARTITION BY episode_id, scene_index ORDER BY sentence_no) - 1 AS place FROM spans),
panels AS (SELECT n.*, CAST(row_number() OVER (PARTITION BY n.episode_id, n.scene_index ORDER BY element_key) AS INTEGER) AS panel_no FROM n JOIN (SELECT DISTINCT episode_id, scene_index FROM tl) t ON t.episode_id = n.episode_id AND t.scene_index = n.scene_index),
unions AS (SELECT p.episode_id, p.scene_index, p.panel_no, p.element_key, min(s) AS s, max(e) AS e FROM panels p JOIN places q ON q.episode_id = p.episode_id AND q.scene_index = p.scene_index AND q.place = p.element_key % 3 WHERE p.element_key % 2 = 1 GROUP BY ALL)"""


@query(f"WITH {_EXACT}, {_SPANS} SELECT episode_id, scene_index, panel_no, s AS start_ms, e AS end_ms FROM unions")
def sentence_unions(spark: SparkSession, d: str) -> DataFrame:
    """The time of the sentences that each panel's reveals are bound to."""
    units = A.timeline(spark, d)
    spans = align.narration_spans(A.narrations(spark, d), units, SCENE, ORDER, "narration")
    return align.sentence_unions(_ops(_numbered(spark, d, units)), spans, SCENE)


_BOUND = f"{_EXACT.replace('r AS (SELECT element_key', 'x AS (SELECT element_key')}, {_SPANS}, r AS (SELECT element_key, coalesce(u.s, x.s) AS s, coalesce(u.e, x.e) AS e FROM x FULL JOIN unions u USING (element_key))"
_NOTES = f"""notes AS (SELECT episode_id, scene_index, string_agg(note, chr(1) ORDER BY i, o) AS notes FROM (
 SELECT episode_id, scene_index, panel_no AS i, 1 AS o, '{schedule.EVEN} ' || n AS note FROM planned WHERE opens UNION ALL SELECT episode_id, scene_index, panel_no, 2, '{schedule.TOO_SHORT}' FROM planned WHERE opens AND short_
 UNION ALL SELECT episode_id, scene_index, panel_no, 3, '{schedule.NO_ROOM}' FROM planned WHERE homeless AND (fitted OR k = 1) UNION ALL SELECT DISTINCT episode_id, scene_index, 1000, 4, 'hook' FROM placed WHERE i = 0 AND ps > 1200
 UNION ALL SELECT DISTINCT episode_id, scene_index, 1000, 5, '{schedule.OUT_OF_RESERVE}' FROM (SELECT *, lag(end_ms) OVER (PARTITION BY episode_id, scene_index ORDER BY panel_no) > start_ms AS over_ FROM planned) WHERE over_) GROUP BY 1, 2)"""
_GRID = """cells AS (SELECT n, i, CASE WHEN n = 3 AND i = 1 THEN 60 WHEN n = 3 THEN 60 + (i - 2) * 920 ELSE 60 + ((i - 1) % 2) * 920 END AS x, CASE WHEN n <= 2 THEN 60 WHEN n = 3 THEN CASE WHEN i = 1 THEN 60 ELSE 560 END ELSE 60 + ((i - 1) // 2) * (h + 40) END AS y,
 CASE WHEN n = 1 OR n = 3 AND i = 1 THEN 1800 ELSE 880 END AS w, CASE WHEN n <= 2 THEN 960 WHEN n = 3 THEN 460 ELSE h END AS h
 FROM (SELECT n, unnest(range(1, n + 1)) AS i, CAST((960 - ((n + 1) // 2 - 1) * 40) // ((n + 1) // 2) AS BIGINT) AS h FROM (SELECT DISTINCT CAST(c AS BIGINT) AS n FROM pan)))"""
_REGION = "{'x': CAST(c.x + 14 AS INTEGER), 'y': CAST(c.y + 14 AS INTEGER), 'width': CAST(c.w - 28 AS INTEGER), 'height': CAST(c.h - 28 AS INTEGER)}"
_DOCS_SQL = f"""WITH RECURSIVE {_planned(_BOUND)}, {_NOTES}, {_GRID}, laid AS (SELECT p.*, q.element_key, q.c AS total, w.d, c.x, c.y, c.w AS cw, c.h AS ch, {_REGION} AS region FROM planned p JOIN pan q ON q.episode_id = p.episode_id AND q.scene_index = p.scene_index AND q.i = p.panel_no - 1
 JOIN cells c ON c.n = q.c AND c.i = p.panel_no JOIN win w ON w.episode_id = p.episode_id AND w.scene_index = p.scene_index),
kept AS (SELECT *, coalesce(list(region) OVER (PARTITION BY episode_id, scene_index ORDER BY panel_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS protected FROM laid),
el AS (SELECT episode_id, scene_index, panel_no, anchored, total, d, '{{"id":"panel-' || panel_no || '","sequence":' || panel_no || ',"region":' || CAST(to_json(region) AS VARCHAR) || ',"reveal":' || CAST(to_json({{'startMs': start_ms, 'durationMs': end_ms - start_ms, 'protectedRegions': protected}}) AS VARCHAR)
 || ',"handPath":' || CAST(to_json({{'start': [x + cw // 2, greatest(0, y - 60)], 'end': [x + cw // 2, y + ch + 40]}}) AS VARCHAR) || ',"kind":"panel"' || CASE WHEN element_key % 2 = 1 THEN ',"ops":[{{"op":"DRAW","target":"el-' || element_key || '","bound_span":' || element_key % 3 || '}}]' ELSE '' END || '}}' AS j FROM kept),
doc AS (SELECT episode_id, scene_index, max(total) AS total, max(d) AS d, count(*) FILTER (anchored) AS k, string_agg(j, ',' ORDER BY panel_no) AS js FROM el GROUP BY 1, 2)
SELECT doc.episode_id, doc.scene_index, CAST(total AS BIGINT) AS n_panels, k || '/' || total AS matched, '{{"canvas":{{"width":1920,"height":1080}},"sceneDurationMs":' || d || ',"elements":[{{"id":"layout","sequence":0,"region":{{"x":0,"y":0,"width":1920,"height":1080}},"reveal":{{"startMs":300,"durationMs":600,"protectedRegions":[]}},"handPath":{{"start":[960,40],"end":[960,1040]}},"kind":"layout"}},'
 || js || '],"meta":{{"schedule":"words","granularity":"word","matched":"' || k || '/' || total || '","warnings":' || CASE WHEN notes IS NULL THEN '[]' ELSE CAST(to_json(string_split(notes, chr(1))) AS VARCHAR) END || '}}}}' AS document FROM doc LEFT JOIN notes USING (episode_id, scene_index)"""


@query(_DOCS_SQL)
def annotation_documents(spark: SparkSession, d: str) -> DataFrame:
    """Schedule, layout grid, reveals and protected regions as one document per scene, by sentences and exact phrases."""
    units = A.timeline(spark, d)
    hays, panels = align.haystacks(units, SCENE, ORDER), _numbered(spark, d, units)
    spans = align.narration_spans(A.narrations(spark, d), units, SCENE, ORDER, "narration")
    exact = align.exact_matches(panels, hays, SCENE, "phrase").select(
        *SCENE, "panel_no", F.col("matched_start_ms").alias("start_ms"), F.col("matched_end_ms").alias("end_ms"), F.when(F.col("matched_start_ms").isNotNull(), "exact").alias("method"))
    return _documents(panels, spans, exact, units)


@query()
def annotation_documents_matched(spark: SparkSession, d: str) -> DataFrame:
    """The same by the whole precedence, for sentences and phrases."""
    units, dictionary = A.timeline(spark, d), align.fixed_dictionary(spark, CROSS_LANGUAGE)
    panels = _numbered(spark, d, units)
    spans = align.matched_spans(A.narrations(spark, d), units, SCENE, ORDER, "narration", dictionary)
    matches = align.phrase_matches(panels, align.haystacks(units, SCENE, ORDER), SCENE, "panel_no", "phrase", dictionary)
    return _documents(panels, spans, matches, units)


@query()
def narration_spans_matched(spark: SparkSession, d: str) -> DataFrame:
    """Sentences in the word timelines: exact, fuzzy, through the dictionary."""
    return align.matched_spans(A.narrations(spark, d), A.timeline(spark, d), SCENE, ORDER, "narration", align.fixed_dictionary(spark, CROSS_LANGUAGE))


_STROKES = f"""{A.POINTS}, seg AS (SELECT vec_id, CAST(i // 8 AS INTEGER) AS s, i, x, y, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS dd FROM points WINDOW w AS (PARTITION BY vec_id, i // 8 ORDER BY i)),
st AS (SELECT vec_id, s, sum(dd) AS len, arg_min(x, i) AS x0, arg_min(y, i) AS y0, arg_max(x, i) AS x1, arg_max(y, i) AS y1 FROM seg GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER w AS no, greatest(1, floor(2000 * len / sum(greatest(len, 1e-6)) OVER (PARTITION BY vec_id))) AS draw, sqrt(pow(lead(x0) OVER w - x1, 2) + pow(lead(y0) OVER w - y1, 2)) AS jump FROM st WINDOW w AS (PARTITION BY vec_id ORDER BY s)),
it AS (SELECT vec_id, no, 0 AS part, 'draw' AS kind, draw AS ms FROM o UNION ALL SELECT vec_id, no, 1, 'travel', greatest(40, floor(jump / 2.8::DOUBLE)) FROM o WHERE jump > 48),
sc AS (SELECT *, greatest(1, floor(ms * CASE WHEN sum(ms) OVER (PARTITION BY vec_id) > 2000 THEN 2000 / sum(ms) OVER (PARTITION BY vec_id) ELSE 1.0 END)) AS k FROM it),
ln AS (SELECT *, 1000 + sum(k) OVER (PARTITION BY vec_id ORDER BY no, part ROWS UNBOUNDED PRECEDING) AS e FROM sc), lz AS (SELECT *, e - k AS b, max(e) OVER (PARTITION BY vec_id) AS z FROM ln),
pl AS (SELECT *, 1000 + floor((b - 1000) * (2000 / greatest(1, z - 1000)::DOUBLE)) AS pb, 1000 + floor((e - 1000) * (2000 / greatest(1, z - 1000)::DOUBLE)) AS pe FROM lz)"""


@query(f"WITH {_STROKES} SELECT vec_id, CAST(no AS INTEGER) AS stroke_no, kind, CAST(CASE WHEN z > 3000 THEN pb ELSE b END AS BIGINT) AS start_ms, CAST(CASE WHEN z > 3000 THEN greatest(pe, pb + 1) ELSE e END AS BIGINT) AS end_ms FROM pl")
def stroke_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Draw and travel tasks for each vector cut into four strokes."""
    w = Window.partitionBy("vec_id", "s").orderBy("i")
    pts = A.points(spark, d).withColumn("s", F.floor(F.col("i") / 8).cast("int"))
    arc = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    strokes = pts.withColumn("_d", arc).groupBy("vec_id", "s").agg(F.coalesce(F.sum("_d"), F.lit(0.0)).alias("length"), F.min_by("x", "i").alias("x0"), F.min_by("y", "i").alias("y0"), F.max_by("x", "i").alias("x1"), F.max_by("y", "i").alias("y1"))
    strokes = strokes.withColumn("from_ms", F.lit(1000)).withColumn("to_ms", F.lit(3000))
    return schedule.stroke_schedule(strokes, ["vec_id"], ["s"], "from_ms", "to_ms")


# layouts

_IX = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"


@query(f"""WITH {A.RECTS}, pts AS (SELECT s_suppkey, CAST(s_suppkey % 50 AS INTEGER) AS scene, (s_suppkey * 29) % 1900 AS px, (s_suppkey * 31) % 1000 AS py FROM supplier)
SELECT scene, s_suppkey, arg_min(p_partkey, w * h * 10000000::BIGINT + p_partkey) AS p_partkey FROM pts JOIN rects USING (scene) WHERE px >= x AND px < x + w AND py >= y AND py < y + h GROUP BY 1, 2""")
def rect_assignment(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    pts = load(spark, d, "supplier", "s_suppkey").select("s_suppkey", (k % 50).cast("int").alias("scene"), (k * 29 % 1900).alias("px"), (k * 31 % 1000).alias("py"))
    r = A.rects(spark, d).withColumn("o", F.col("p_partkey"))
    return spatial.assign_points(pts, r, ["scene"], "s_suppkey", "p_partkey", "o")


@query(f"""WITH {A.RECTS} SELECT scene, id_a, id_b, round(i / greatest(u, 1), 6) AS iou FROM (SELECT a.scene, a.p_partkey AS id_a, b.p_partkey AS id_b, CAST({_IX} AS DOUBLE) AS i, a.w * a.h + b.w * b.h - {_IX} AS u FROM rects a JOIN rects b ON a.scene = b.scene AND a.p_partkey < b.p_partkey) WHERE i / greatest(u, 1) > 0.10""")
def rect_iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    return spatial.overlaps(A.rects(spark, d), ["scene"], "p_partkey", digits=6)


@query(f"WITH {A.RECTS} SELECT scene, count(*) AS n_panels, round(sum(w * h) / 2073600.0::DOUBLE, 6) AS density, sum(w * h) / 2073600.0::DOUBLE > 0.55 AS crowded FROM rects GROUP BY 1")
def layout_density(spark: SparkSession, d: str) -> DataFrame:
    return spatial.density(A.rects(spark, d), ["scene"]).withColumn("density", F.round("density", 6))


@query(f"WITH {A.RECTS} SELECT scene, p_partkey FROM rects a WHERE EXISTS (SELECT 1 FROM rects b WHERE b.scene = a.scene AND b.w * b.h > a.w * a.h AND ({_IX})::DOUBLE / (a.w * a.h) >= 0.72::DOUBLE AND a.w * a.h <= b.w * b.h * 0.55::DOUBLE)")
def nested_outlines(spark: SparkSession, d: str) -> DataFrame:
    return spatial.nested(A.rects(spark, d), ["scene"], "p_partkey")


@query(f"""WITH {A.RECTS}, n AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY p_partkey) AS no FROM rects), b AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY w * h DESC, no) AS rk FROM n),
s AS (SELECT scene, no, lead(scene) OVER (PARTITION BY scene // 10 ORDER BY scene) AS nxt FROM b WHERE rk = 1)
SELECT s.scene AS source_scene, s.nxt AS target_scene, CAST(s.no AS INTEGER) AS source_panel, coalesce(t.x, f.x) AS target_x, coalesce(t.y, f.y) AS target_y, CASE WHEN t.x IS NOT NULL THEN 'high' ELSE 'medium' END AS confidence
FROM s LEFT JOIN n t ON t.scene = s.nxt AND t.no = s.no LEFT JOIN n f ON f.scene = s.nxt AND f.no = 1 WHERE s.nxt IS NOT NULL""")
def transition_recommendations(spark: SparkSession, d: str) -> DataFrame:
    r = A.rects(spark, d).withColumn("episode", F.floor(F.col("scene") / 10))
    return spatial.transitions(r, "episode", "scene", "p_partkey").select("source_scene", "target_scene", "source_panel", "target_x", "target_y", "confidence")


@query(f"""WITH {A.POINTS}, s AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS dd FROM points WINDOW w AS (PARTITION BY vec_id ORDER BY i))
SELECT vec_id, count(*) AS n_points, round(sum(dd), 4) AS arc, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, round(avg(x), 4) AS mean_x, round(avg(y), 4) AS mean_y FROM s GROUP BY 1""")
def polyline_metrics(spark: SparkSession, d: str) -> DataFrame:
    p = spatial.polylines(A.points(spark, d), ["vec_id"], "i")
    return p.select("vec_id", "n_points", F.round("arc", 4).alias("arc"), "min_x", "max_x", "min_y", "max_y", F.round("mean_x", 4).alias("mean_x"), F.round("mean_y", 4).alias("mean_y"))


@query(f"""WITH {A.POINTS}, s AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS dd FROM points WINDOW w AS (PARTITION BY vec_id ORDER BY i))
SELECT vec_id, i, round(sum(dd) OVER (PARTITION BY vec_id ORDER BY i ROWS UNBOUNDED PRECEDING), 4) AS arc FROM s""")
def arc_lengths(spark: SparkSession, d: str) -> DataFrame:
    """How far along its polyline each point lies."""
    return timeline.arc_lengths(A.points(spark, d), ["vec_id"], "i").select("vec_id", "i", F.round("arc", 4).alias("arc"))


@query()
def stroke_simplification(spark: SparkSession, d: str) -> DataFrame:
    """Strokes of each label, four per vector: covered ones dropped, fragments joined, objects grouped."""
    pts = A.points(spark, d).withColumn("s", F.floor(F.col("i") / 8).cast("int"))
    p = F.struct((F.col("x") / 20).cast("int").alias("x"), (F.col("y") / 20).cast("int").alias("y"))
    strokes = pts.groupBy("vec_id", "s").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", p.alias("p")))), lambda q: q["p"]).alias("pts"))
    return spatial.simplify_strokes(strokes, ["vec_id"], "s")


@query("SELECT n, CAST(i AS INTEGER) AS no, CAST(60 + ((i - 1) % 2) * (880 + 40) AS INTEGER) AS x, CAST(60 + ((i - 1) // 2) * (h + 40) AS INTEGER) AS y, 880 AS w, h FROM (SELECT n, unnest(range(1, n + 1)) AS i, CAST((960 - ((n + 1) // 2 - 1) * 40) // ((n + 1) // 2) AS INTEGER) AS h FROM (SELECT unnest(range(4, 13)) AS n))")
def grid_layout(spark: SparkSession, d: str) -> DataFrame:
    """Default panels for 4 to 12 elements."""
    return spark.range(4, 13).select(F.col("id").alias("n"), F.explode(G.grid(F.col("id"))).alias("p")).select("n", "p.no", "p.x", "p.y", "p.w", "p.h")


# rasters


@query(f"""WITH {A.FRAMES}, s AS (SELECT label, i, vec_id, v, abs(v - lag(v) OVER (PARTITION BY label, i ORDER BY vec_id)) AS dd FROM frames), st AS (SELECT label, vec_id, avg(dd) AS m FROM s GROUP BY 1, 2), e AS (SELECT label, i, arg_min(v, vec_id) AS a, arg_max(v, vec_id) AS b FROM frames GROUP BY 1, 2)
SELECT label, n_frames, round(coalesce(max_step, 0), 6) AS max_step, round(total, 6) AS total_change FROM (SELECT label, count(*) AS n_frames, max(m) AS max_step FROM st GROUP BY 1) JOIN (SELECT label, avg(abs(b - a)) AS total FROM e GROUP BY 1) USING (label)""")
def frame_diff(spark: SparkSession, d: str) -> DataFrame:
    c = raster.frame_changes(A.frames(spark, d), "label", "vec_id", "v")
    return c.withColumn("max_step", F.round("max_step", 6)).withColumn("total_change", F.round("total_change", 6))


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    p = A.frames(spark, d).select("vec_id", F.posexplode("v").alias("i", "v"))
    return p.select("vec_id", "v", (F.col("i") % 8).cast("int").alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"))


def _boards(spark: SparkSession, d: str) -> DataFrame:
    return raster.board_stats(A.frames(spark, d), "vec_id", "v", 8, 8, 2, edge=1, ink=8, band=(2, 6))


_LAP = """n AS (SELECT vec_id, y, x, v, coalesce(lag(v) OVER r, lead(v) OVER r) AS a, coalesce(lead(v) OVER r, lag(v) OVER r) AS b, coalesce(lag(v) OVER c, lead(v) OVER c) AS e, coalesce(lead(v) OVER c, lag(v) OVER c) AS g FROM p
 WINDOW r AS (PARTITION BY vec_id, y ORDER BY x), c AS (PARTITION BY vec_id, x ORDER BY y)), l AS (SELECT vec_id, avg(CASE WHEN abs(a + b + e + g - 4 * v) > 30 THEN 1.0 ELSE 0.0 END) AS edge_ratio FROM n GROUP BY 1)"""
_MEASURED = f"""{A.FRAMES}, p AS (SELECT vec_id, v, i % 8 AS x, i // 8 AS y FROM frames), {_LAP}, m AS (SELECT vec_id, avg(v) AS mean, stddev_pop(v) AS std, median(v) AS median, avg(v) FILTER (x < 2 AND y < 2) AS corner_tl, avg(v) FILTER (x >= 6 AND y < 2) AS corner_tr,
avg(v) FILTER (x < 2 AND y >= 6) AS corner_bl, avg(v) FILTER (x >= 6 AND y >= 6) AS corner_br, avg(v) FILTER (y >= 6) AS bottom, avg(v) FILTER (y < 4) AS top FROM p GROUP BY 1)"""


@query(f"WITH {_MEASURED} SELECT vec_id, {', '.join(f'round({c}, 6) AS {c}' for c in ('mean', 'std', 'median', 'corner_tl', 'corner_tr', 'corner_bl', 'corner_br', 'bottom', 'top', 'edge_ratio'))} FROM m JOIN l USING (vec_id)")
def board_stats(spark: SparkSession, d: str) -> DataFrame:
    names = ("mean", "std", "median", "corner_tl", "corner_tr", "corner_bl", "corner_br", "bottom", "top", "edge_ratio")
    return _boards(spark, d).select("vec_id", *[F.round(c, 6).alias(c) for c in names])


@query(f"""WITH {_MEASURED} SELECT vec_id, unnest(list_filter([CASE WHEN std < 15 THEN 'blank' END, CASE WHEN std >= 15 AND edge_ratio < 0.005 THEN 'low_information' END, CASE WHEN corner_tl < 185 THEN 'corner_tl' END, CASE WHEN corner_tr < 185 THEN 'corner_tr' END,
CASE WHEN corner_bl < 185 THEN 'corner_bl' END, CASE WHEN corner_br < 185 THEN 'corner_br' END, CASE WHEN bottom > top * 0.75::DOUBLE THEN 'bottom_band' END], lambda x: x IS NOT NULL)) AS code FROM m JOIN l USING (vec_id)""")
def board_findings(spark: SparkSession, d: str) -> DataFrame:
    return raster.board_findings(_boards(spark, d), "vec_id").select("vec_id", "code")


@query(f"""WITH {A.FRAMES}, p AS (SELECT vec_id, v, i % 8 AS x, i // 8 AS y FROM frames), b AS (SELECT vec_id, median(v) AS m FROM p WHERE x < 1 OR x >= 7 OR y < 1 OR y >= 7 GROUP BY 1) SELECT vec_id, count(*) FILTER (abs(v - m) > 8) AS n_ink FROM p JOIN b USING (vec_id) GROUP BY 1""")
def ink_pixels(spark: SparkSession, d: str) -> DataFrame:
    return _boards(spark, d).select("vec_id", "n_ink")


@query(f"""WITH {A.FRAMES}, p AS (SELECT label, vec_id, i, v > 10 AS ink, lead(v > 10) OVER (PARTITION BY label, i ORDER BY vec_id) AS nxt FROM frames) SELECT label, count(*) FILTER (ink) AS n_wanted, round(count(*) FILTER (ink AND NOT nxt) / greatest(count(*) FILTER (ink), 1)::DOUBLE, 6) AS missing_ratio FROM p WHERE nxt IS NOT NULL GROUP BY 1""")
def ink_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Inked pixels that the clip's next frame has lost."""
    pairs = next_row(A.frames(spark, d), ["label"], ["vec_id"], F.col("v"), "nxt").where("nxt is not null")
    inked = lambda c: F.transform(c, lambda v: v > 10)
    return raster.missing_ratio(pairs.select("label", inked("v").alias("ink"), inked("nxt").alias("nxt")), "label", "ink", "nxt").withColumn("missing_ratio", F.round("missing_ratio", 6))


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    p = A.frames(spark, d).select("vec_id", F.posexplode("v").alias("i", "v"))
    return p.select("vec_id", "v", (F.col("i") % 8).cast("int").alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"))


@query(f"""WITH {A.FRAMES}, p AS (SELECT vec_id, i % 8 AS x, i // 8 AS y FROM frames WHERE v > 0), g AS (SELECT *, x - row_number() OVER (PARTITION BY vec_id, y ORDER BY x) AS k FROM p WHERE y % 6 = 3)
SELECT vec_id, CAST(y AS INTEGER) AS y, CAST(max(x) AS INTEGER) AS from_x, CAST(min(x) AS INTEGER) AS to_x, count(*) AS n FROM g GROUP BY vec_id, y, k HAVING count(*) >= 3""")
def fill_runs(spark: SparkSession, d: str) -> DataFrame:
    return raster.fill_runs(_pixels(spark, d).withColumn("ink", F.col("v") > 0), "vec_id", "x", "y", "ink")


@query("SELECT CAST(i AS INTEGER) AS i, round(0.5 - 0.5 * cos(3.141592653589793::DOUBLE * least(1.0, greatest(0.0, (i - 10) / 80.0))), 9) AS eased FROM range(101) AS r(i)")
def ease_curve(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(101).select(F.col("id").cast("int").alias("i"), F.round(G.ease((F.col("id") - 10) / 80.0), 9).alias("eased"))


# integrity


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 7)")
def dangling_refs(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose customer is in none of the nations but one."""
    c = load(spark, d, "customer", "c_custkey", "c_nationkey").where("c_nationkey <> 7").select(F.col("c_custkey").alias("o_custkey"))
    return load(spark, d, "orders", "o_orderkey", "o_custkey").join(c, "o_custkey", "left_anti").select("o_orderkey")


@query("SELECT c_custkey, 'no_order' AS code, 'warning' AS severity FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderkey % 9 = 0)")
def orphan_refs(spark: SparkSession, d: str) -> DataFrame:
    """Customers without an order of every ninth number."""
    o = load(spark, d, "orders", "o_custkey", "o_orderkey").where("o_orderkey % 9 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return gates.missing(load(spark, d, "customer", "c_custkey"), o, ["c_custkey"], "no_order", "warning")


@query("SELECT DISTINCT episode_id, 'no_words' AS code, 'blocking' AS severity FROM episodes e WHERE NOT EXISTS (SELECT 1 FROM words w WHERE w.episode_id = e.episode_id)")
def missing_timelines(spark: SparkSession, d: str) -> DataFrame:
    return gates.missing(load(spark, d, "episodes", "episode_id"), load(spark, d, "words", "episode_id"), ["episode_id"], "no_words")


@query("SELECT word_id FROM words WHERE granularity IS NULL OR granularity NOT IN ('word', 'sentence')")
def membership_enum(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "words", "word_id", "granularity").where(~F.coalesce(F.col("granularity").isin("word", "sentence"), F.lit(False))).select("word_id")


@query("SELECT sha256(text) AS digest, count(*) - 1 AS n_extra FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "documents", "text").where("text is not null").select(F.sha2("text", 256).alias("digest"))
    return gates.duplicates(t, ["digest"])


@query("""SELECT episode_id, sha256(string_agg(l, chr(10) ORDER BY l)) AS fingerprint, count(*) AS n_files FROM (SELECT episode_id, concat_ws(':', CAST(file_id AS VARCHAR), coalesce(sha256(payload), 'missing'), CAST(coalesce(octet_length(encode(payload)), -1) AS VARCHAR)) AS l FROM raw_files) GROUP BY 1""")
def fingerprint_manifest(spark: SparkSession, d: str) -> DataFrame:
    return fingerprint.manifest(load(spark, d, "raw_files", "file_id", "episode_id", "payload"), ["episode_id"], "file_id", "payload")


@query("""WITH o AS (SELECT episode_id, file_kind, sha256(payload) AS h, row_number() OVER (PARTITION BY episode_id, file_kind ORDER BY written_at, file_id) AS a, row_number() OVER (PARTITION BY episode_id, file_kind ORDER BY written_at DESC, file_id DESC) AS z FROM raw_files WHERE payload IS NOT NULL)
SELECT episode_id, file_kind, f.h AS recorded, l.h AS actual, 'changed' AS status FROM (SELECT * FROM o WHERE a = 1) f JOIN (SELECT * FROM o WHERE z = 1) l USING (episode_id, file_kind) WHERE f.h <> l.h""")
def fingerprint_drift(spark: SparkSession, d: str) -> DataFrame:
    """Episodes whose latest file differs from their first."""
    f = load(spark, d, "raw_files", "file_id", "episode_id", "file_kind", "written_at", "payload").where("payload is not null").withColumn("h", F.sha2("payload", 256))
    at = F.struct("written_at", "file_id")
    ends = f.groupBy("episode_id", "file_kind").agg(F.min_by("h", at).alias("first"), F.max_by("h", at).alias("last"))
    keys = ["episode_id", "file_kind"]
    return fingerprint.drift(ends.select(*keys, F.col("first").alias("h")), ends.select(*keys, F.col("last").alias("h")), keys, "h")


@query()
def lint_findings(spark: SparkSession, d: str) -> DataFrame:
    """Every broken rule of every saved script."""
    return lint.lint(load(spark, d, "scripts", "script_id", "body"), ["script_id"], "body")


@query()
def lint_summary(spark: SparkSession, d: str) -> DataFrame:
    return gates.summary(lint_findings(spark, d), ["script_id"])


@query("SELECT 0 AS no, 'ftyp' AS name, CAST(8 AS BIGINT) AS size UNION ALL SELECT 1, 'moov', 12 UNION ALL SELECT 2, 'mdat', 8")
def media_atoms(spark: SparkSession, d: str) -> DataFrame:
    """Top-level atoms of a literal stream."""
    data = b"\x00\x00\x00\x08ftyp\x00\x00\x00\x0cmoov\x00\x00\x00\x00\x00\x00\x00\x08mdat\x00\x00\x00\x01stop"
    one = spark.createDataFrame([(bytearray(data),)], "content binary")
    return one.lateralJoin(readers.atoms()(F.col("content").outer())).select("no", "name", "size")


@query(f"""WITH {A.TASKS}, t AS (SELECT * FROM tasks WHERE end_ms > start_ms), f AS (SELECT user_id, kind, start_ms, end_ms, unnest(range(CAST(ceil(start_ms * 2 / 1000.0) AS BIGINT), CAST(ceil(end_ms * 2 / 1000.0) AS BIGINT))) AS frame_no FROM t)
SELECT user_id, frame_no, kind, round((frame_no * 500.0::DOUBLE - start_ms) / (end_ms - start_ms), 6) AS progress FROM (SELECT *, row_number() OVER (PARTITION BY user_id, frame_no ORDER BY start_ms DESC, end_ms DESC, kind DESC) AS rn FROM f) WHERE rn = 1""")
def frame_states(spark: SparkSession, d: str) -> DataFrame:
    """The task under way at each frame, two frames a second."""
    return timeline.frame_states(A.tasks(spark, d), "user_id", 2).withColumn("progress", F.round("progress", 6))


@query(f"""WITH {A.TASKS}, k AS (SELECT user_id, CASE kind WHEN 'travel' THEN 'move' ELSE kind END AS kind, start_ms, end_ms FROM tasks), n AS (SELECT user_id, CAST(round_even(max(end_ms) * 2 / 1000.0::DOUBLE, 0) AS BIGINT) AS n FROM k GROUP BY 1), z AS (SELECT user_id, max(end_ms) AS z FROM k WHERE kind = 'draw' GROUP BY 1),
f AS (SELECT user_id, unnest(range(n)) AS frame_no FROM n), v AS (SELECT DISTINCT f.user_id, frame_no FROM f JOIN k ON k.user_id = f.user_id AND kind = 'draw' AND frame_no * 500 BETWEEN start_ms - 350 AND end_ms UNION SELECT f.user_id, frame_no FROM f JOIN z ON z.user_id = f.user_id AND frame_no * 500 >= z AND frame_no * 500 < z + 180)
SELECT user_id, frame_no FROM v WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.user_id = v.user_id AND kind = 'move' AND frame_no * 500 BETWEEN start_ms AND end_ms)""")
def hand_frames(spark: SparkSession, d: str) -> DataFrame:
    """The frames that show the hand, two a second; travelling stands for a moving object."""
    t = A.tasks(spark, d).withColumn("kind", F.when(F.col("kind") == "travel", "move").otherwise(F.col("kind")))
    return timeline.hand_frames(t, "user_id", 2)


@query(f"""WITH {A.TASKS}, d AS (SELECT user_id, kind AS eid, max(end_ms) AS e FROM tasks GROUP BY 1, 2), w AS (SELECT user_id, max(end_ms) AS e FROM tasks WHERE kind = 'draw' GROUP BY 1), l AS (SELECT user_id, unnest(['draw', 'travel', 'label', 'note']) AS eid FROM (SELECT DISTINCT user_id FROM tasks)), a AS (SELECT user_id, 'label' AS eid, max(end_ms) AS e FROM tasks WHERE kind = 'gaze' GROUP BY 1)
SELECT user_id, eid, coalesce(d.e, a.e, w.e) AS reveal_ms FROM l LEFT JOIN d USING (user_id, eid) LEFT JOIN a USING (user_id, eid) LEFT JOIN w USING (user_id)""")
def label_reveals(spark: SparkSession, d: str) -> DataFrame:
    """Labels by their own task, else their annotation's window, else the end of drawing."""
    t = A.tasks(spark, d).withColumn("eid", F.col("kind"))
    labels = t.select("user_id").distinct().select("user_id", F.explode(F.array(*map(F.lit, ("draw", "travel", "label", "note")))).alias("eid"))
    windows = t.where("kind = 'gaze'").select("user_id", F.lit("label").alias("eid"), "end_ms")
    return timeline.label_reveals(labels, t, windows, ["user_id"]).select("user_id", "eid", "reveal_ms")


@query(f"""WITH {A.FRAMES}, p AS (SELECT vec_id, v, i % 8 AS x, i // 8 AS y FROM frames), b AS (SELECT vec_id, median(v) AS m FROM p WHERE x < 1 OR x >= 7 OR y < 1 OR y >= 7 GROUP BY 1)
SELECT vec_id, round(avg(abs(v - m)), 6) AS deviation FROM p JOIN b USING (vec_id) WHERE y >= 2 AND y < 6 GROUP BY 1""")
def ghost_deviation(spark: SparkSession, d: str) -> DataFrame:
    return _boards(spark, d).select("vec_id", F.round("ghost", 6).alias("deviation"))


@query(f"""WITH {A.FRAMES}, p AS (SELECT vec_id, v, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y FROM frames) SELECT vec_id, x, y FROM p a WHERE v > 15 AND NOT EXISTS (SELECT 1 FROM p b WHERE b.vec_id = a.vec_id AND b.v < -15 AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1)""")
def new_ink(spark: SparkSession, d: str) -> DataFrame:
    """Bright pixels with no dark pixel beside them."""
    p = _pixels(spark, d)
    return raster.new_ink(p.where("v < -15").select("vec_id", "x", "y"), p.where("v > 15"), "vec_id", "x", "y", 1).select("vec_id", "x", "y")


@query("""WITH l AS (SELECT episode_id, 1 AS pr, 'theme' AS name, theme AS value FROM episodes UNION ALL SELECT episode_id, 1, 'voice', voice FROM episodes UNION ALL SELECT episode_id, 2, 'theme', 'chalk' FROM episodes UNION ALL SELECT episode_id, 2, 'voice', 'studio-a' FROM episodes)
SELECT episode_id, name, arg_min(value, pr) AS value FROM l WHERE value IS NOT NULL AND value <> '' GROUP BY 1, 2""")
def merged_settings(spark: SparkSession, d: str) -> DataFrame:
    """Each episode's own settings over the defaults."""
    e = load(spark, d, "episodes", "episode_id", "theme", "voice")
    own = e.select("episode_id", F.lit(1).alias("priority"), F.create_map(F.lit("theme"), F.col("theme"), F.lit("voice"), F.col("voice")).alias("settings"))
    default = e.select("episode_id", F.lit(2).alias("priority"), F.create_map(F.lit("theme"), F.lit("chalk"), F.lit("voice"), F.lit("studio-a")).alias("settings"))
    return gates.merged(own.unionByName(default), "episode_id", "priority", "settings")
