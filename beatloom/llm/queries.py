"""Queries of the text problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import materialise, spread
from ..sources import load
from . import chunks, mixing, sentences, spans, tokens, unify

LIMIT, OVERLAP, TOKENS, SPAN = 600, 60, 128, 200


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of every narration and word text; those within the limit are one piece."""
    scenes = load(spark, d, "scenes", "scene_key", "narration", "lang").select(
        F.lit("narration").alias("item_kind"), F.col("scene_key").alias("item_id"), F.col("narration").alias("text"), "lang")
    words = load(spark, d, "words", "word_id", "text").select(
        F.lit("word").alias("item_kind"), F.col("word_id").alias("item_id"), "text", F.lit(None).cast("string").alias("lang"))
    return chunks.split_items(scenes.unionByName(words), ["item_kind", "item_id"], "text", LIMIT, OVERLAP, "lang")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pieces(spark, d).where("n_pieces > 1 and piece_no = 0").select("item_kind", "item_id")


def p2_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of every narration by size in tokens."""
    scenes = spread(load(spark, d, "scenes", "scene_key", "narration", "lang"))
    return chunks.split_items_by_tokens(scenes, ["scene_key"], "narration", TOKENS, TOKENS // 8, "lang")


P2_FOUND_SQL = """
SELECT 'narration' AS item_kind, scene_key AS item_id FROM scenes WHERE length(narration) > 600
UNION ALL SELECT 'word', word_id FROM words WHERE length(text) > 600"""


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    terms = load(spark, d, "terms").select(F.col("term_id").alias("id"), F.col("term").alias("text"))
    words = load(spark, d, "words", "word_id", "text").withColumnRenamed("word_id", "id")
    phrases = load(spark, d, "elements", "element_key", "phrase").toDF("id", "text")
    narrations = load(spark, d, "scenes", "scene_key", "narration").toDF("id", "text")
    kind = lambda df, k: df.select(F.lit(k).alias("item_kind"), "id_a", "id_b")
    return (kind(unify.look_alikes(terms, words), "word")
            .unionByName(kind(unify.look_alikes(terms, phrases), "phrase"))
            .unionByName(kind(unify.look_alike_pairs(narrations), "narration")))


def p3_skeletons(spark: SparkSession, d: str) -> DataFrame:
    """Every text of the three tables with its consistent form."""
    sources = (("word", "words", "word_id", "text"), ("phrase", "elements", "element_key", "phrase"), ("narration", "scenes", "scene_key", "narration"))
    parts = [load(spark, d, t, i, c).toDF("id", "text").withColumn("item_kind", F.lit(k)) for k, t, i, c in sources]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return unify.with_skeleton(rows, "text").select("item_kind", "id", "skeleton")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    scenes = spread(load(spark, d, "scenes", "scene_key", "narration", "lang"))
    return sentences.sentence_ends(scenes, ["scene_key"], "narration", "lang").select("scene_key", "end_char")


def p6_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentence units themselves, in order."""
    scenes = spread(load(spark, d, "scenes", "scene_key", "narration", "lang"))
    cut = sentences.sentence_ends(scenes, ["scene_key", "narration"], "narration", "lang")
    piece = F.substring("narration", F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))
    return cut.select("scene_key", "sentence_no", "start_char", "end_char", piece.alias("sentence"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(spread(load(spark, d, "documents", "doc_id", "text")), ["doc_id"], "text")


def p7_edits(spark: SparkSession, d: str) -> DataFrame:
    """Every document with a remark put into its middle and one after its end, encoded as an edit of what it was."""
    docs = spread(load(spark, d, "documents", "doc_id", "text"))
    half = F.floor(F.length("text") / 2).cast("int")
    text = F.concat(F.substring(F.col("text"), F.lit(1), half), F.lit("[sic]"), F.substring(F.col("text"), half + 1, F.length("text")), F.lit(" (seen)"))
    return tokens.edited_ids(docs.withColumn("edited", text), ["doc_id"], "text", "edited")


def _sized(spark: SparkSession, d: str, weights: bool) -> DataFrame:
    """Sizes in tokens of the documents of target sources."""
    targets = load(spark, d, "mix_targets", "source")
    docs = spread(load(spark, d, "documents", "doc_id", "source", "text")).join(targets, "source", "left_semi")
    keys = ["doc_id", "source"]
    if weights:
        docs, keys = docs.withColumn("weight", mixing.quality(F.col("text"))), [*keys, "weight"]
    return tokens.token_counts(docs, keys, "text")


def p8_quality(spark: SparkSession, d: str) -> DataFrame:
    """The weight of every document in the draw."""
    docs = load(spark, d, "documents", "doc_id", "text")
    return docs.select("doc_id", F.round(mixing.quality(F.col("text")), 9).alias("weight"))


P8_QUALITY_SQL = f"SELECT doc_id, round({mixing.QUALITY_SQL}, 9) AS weight FROM documents"


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.plan(_sized(spark, d, False), load(spark, d, "mix_targets")).where("short").select("source")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    sized = materialise(_sized(spark, d, True), "sized")
    return mixing.mix(sized, load(spark, d, "mix_targets"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    sized, targets = materialise(_sized(spark, d, True), "sized"), load(spark, d, "mix_targets")
    return mixing.report(mixing.mix(sized, targets), mixing.plan(sized, targets))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents", "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_pairs(_docs(spark, d), "doc_id", "text", SPAN)


P9_FOUND_SQL = """
WITH w AS (SELECT DISTINCT doc_id, md5(substr(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200))
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM w a JOIN w b ON a.h = b.h AND a.doc_id < b.doc_id"""


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its class of equal texts and with how many others it shares a span."""
    return spans.shared_classes(_docs(spark, d), "doc_id", "text", SPAN)[0]


def p9_class_pairs(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_classes(_docs(spark, d), "doc_id", "text", SPAN)[1]


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    """The spans; their ids are digests and left to the tests."""
    return spans.shared_spans(_docs(spark, d), "doc_id", "text", SPAN).drop("span_id")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_report(_docs(spark, d), "doc_id", "text", SPAN)


_P9_WINDOWS = """WITH d AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS cls, count(*) OVER (PARTITION BY text) AS n FROM documents WHERE length(text) >= 200),
w AS MATERIALIZED (SELECT cls, i, md5(substr(text, i, 200)) AS h FROM (SELECT cls, text, unnest(range(1, length(text) - 198)) AS i FROM d WHERE doc_id = cls)),
s AS MATERIALIZED (SELECT * FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING min(cls) < max(cls)))"""
_P9_LINKED = """p AS MATERIALIZED (SELECT DISTINCT a.cls AS ca, b.cls AS cb FROM (SELECT DISTINCT cls, h FROM s) a JOIN (SELECT DISTINCT cls, h FROM s) b ON a.h = b.h AND a.cls <> b.cls)"""
P9_CLASSES_SQL = f"""{_P9_WINDOWS}, {_P9_LINKED}, c AS (SELECT DISTINCT cls, n FROM d), l AS (SELECT ca, sum(n) AS across FROM p JOIN c ON c.cls = cb GROUP BY ca)
SELECT x.doc_id, coalesce(d.cls, x.doc_id) AS class_id, coalesce(d.n, 1) AS n_copies, CAST(coalesce(d.n - 1, 0) + coalesce(across, 0) AS BIGINT) AS n_links FROM documents x LEFT JOIN d USING (doc_id) LEFT JOIN l ON l.ca = d.cls"""
P9_CLASS_PAIRS_SQL = f"{_P9_WINDOWS}, {_P9_LINKED} SELECT ca AS class_a, cb AS class_b FROM p WHERE ca < cb"
# windows of two texts that go on side by side are one match; those within no longer match of the text are its spans
_P9_SPANS = f"""{_P9_WINDOWS}, m AS (SELECT a.cls, b.cls AS o, a.i, a.i - b.i AS g FROM s a JOIN s b ON a.h = b.h AND a.cls <> b.cls),
k AS (SELECT cls, o, g, i, i - row_number() OVER (PARTITION BY cls, o, g ORDER BY i) AS isle FROM m),
f AS (SELECT cls, o, min(i) - 1 AS a, max(i) + 199 AS z FROM k GROUP BY cls, o, g, isle),
t AS (SELECT cls, a, z, least(min(o), cls) AS lo, greatest(max(o), cls) AS hi FROM f GROUP BY cls, a, z),
x AS (SELECT *, max(z) OVER (PARTITION BY cls ORDER BY a, z DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM t),
q AS (SELECT doc_id, a, z, CASE WHEN lo = x.cls THEN hi ELSE lo END AS other_doc FROM x JOIN d ON d.cls = x.cls AND n = 1 WHERE reach IS NULL OR z > reach
 UNION ALL SELECT doc_id, 0, length(text), CASE WHEN doc_id = cls THEN max(doc_id) OVER (PARTITION BY text) ELSE cls END FROM d WHERE n > 1)"""
P9_SPANS_SQL = f"{_P9_SPANS} SELECT doc_id, CAST(a AS INTEGER) AS start_char, CAST(z AS INTEGER) AS end_char, other_doc FROM q"
P9_REPORT_SQL = f"""{_P9_SPANS}, r AS (SELECT doc_id, count(*) AS n_spans, sum(z - greatest(a, coalesce(before, 0))) AS shared_chars FROM (SELECT *, lag(z) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM q) GROUP BY 1)
SELECT doc_id, CAST(coalesce(length(text), 0) AS INTEGER) AS n_chars, coalesce(n_spans, 0) AS n_spans, CAST(coalesce(shared_chars, 0) AS BIGINT) AS shared_chars FROM documents LEFT JOIN r USING (doc_id)"""


QUERIES = {f.__name__: f for f in (p2_found, p2_pieces, p2_tokens, p3_found, p3_skeletons, p6_found, p6_sentences, p7_ids, p7_edits,
                                   p8_found, p8_quality, p8_mix, p8_report, p9_found, p9_classes, p9_class_pairs, p9_spans, p9_report)}
ORACLE_SQL = {"p2_found": P2_FOUND_SQL, "p8_quality": P8_QUALITY_SQL, "p9_found": P9_FOUND_SQL, "p9_classes": P9_CLASSES_SQL, "p9_class_pairs": P9_CLASS_PAIRS_SQL,
              "p9_spans": P9_SPANS_SQL, "p9_report": P9_REPORT_SQL}
