"""Aligning phrases and sentences to word timelines.

A scene's hay is the normalised text of its units in order; a match in it is
mapped back to the first and last unit it touches by their running character
offsets.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

FUZZY_LEAST = 0.75  # fixed value
CONSTANT_TERMS = 256  # entries of a dictionary that is held as a constant


def haystacks(units: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per scene: ``hay`` and ``units``, (from, to, start_ms, end_ms) by character, in order.

    Units without letters or digits add nothing and never anchor.  A scene's
    units are collected into its row: a scene is one narration, the largest
    thing that a phrase is looked up in.
    """
    rows = units.select(*keys, *order, "start_ms", "end_ms", T.normalize(F.col("text")).alias("_t")).where(F.col("_t") != "")
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_to", F.sum(F.length("_t")).over(w))
    item = F.struct(F.col("_to").alias("to"), (F.col("_to") - F.length("_t")).alias("from"), "start_ms", "end_ms", F.col("_t").alias("t"))
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("units"))
    return packed.withColumn("hay", F.array_join(F.transform("units", lambda u: u["t"]), ""))


def _bounds(units: Column, start: Column, length: Column) -> Column:
    """(start_ms, end_ms) of the characters from ``start`` (0-based) on."""
    touched = F.filter(units, lambda u: (u["from"] < start + length) & (u["to"] > start))
    return F.struct(touched[0]["start_ms"].alias("start_ms"), F.element_at(touched, -1)["end_ms"].alias("end_ms"))


def exact_matches(needles: DataFrame, hays: DataFrame, keys: list[str], needle: str) -> DataFrame:
    """Needles with ``matched_start_ms`` and ``matched_end_ms`` of their first occurrence, null where there is none."""
    rows = needles.withColumn("_n", T.normalize(F.col(needle))).join(hays, keys, "left")
    at = F.when(F.col("_n") != "", F.position("_n", "hay"))
    rows = rows.withColumn("_at", F.when(at > 0, at - 1))
    hit = F.when(F.col("_at").isNotNull(), _bounds(F.col("units"), F.col("_at"), F.length("_n")))
    return rows.withColumn("_hit", hit).withColumn("matched_start_ms", F.col("_hit.start_ms")).withColumn("matched_end_ms", F.col("_hit.end_ms")).drop("_n", "_at", "_hit", "units", "hay")


def least_distances(hay: np.ndarray, needle: np.ndarray) -> np.ndarray:
    """For each end in the hay, the least edit distance of the needle to any stretch that ends there."""
    at = np.arange(len(hay) + 1)
    row = np.zeros(len(hay) + 1, np.int64)  # a match may begin anywhere
    for i, c in enumerate(needle, 1):
        step = np.empty_like(row)
        step[0] = i
        step[1:] = np.minimum(row[:-1] + (hay != c), row[1:] + 1)
        row = np.minimum.accumulate(step - at) + at
    return row[1:]


def window_distances(hay: np.ndarray, needle: np.ndarray, starts: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(size, edit distances of the needle to the windows of that size at ``starts``), size by size.

    One column of the table for all starts at once.  Windows that would reach
    over the end of the hay come out as far as they are long.
    """
    n = len(needle)
    column = np.repeat(np.arange(n + 1, dtype=np.int32)[:, None], len(starts), axis=1)
    padded = np.concatenate([hay, np.full(longest, -1, hay.dtype)])
    down = np.arange(n + 1, dtype=np.int32)[:, None]
    for size in range(1, longest + 1):
        step = np.empty_like(column)
        step[0] = size
        step[1:] = np.minimum(column[:-1] + (padded[starts + size - 1][None] != needle[:, None]), column[1:] + 1)
        column = np.minimum.accumulate(step - down, axis=0) + down
        yield size, column[-1]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _best_of(h: np.ndarray, x: np.ndarray, starts: np.ndarray, low: int, high: int, least: float) -> tuple[int, int, float] | None:
    best, score = None, 0.0
    for size, distance in window_distances(h, x, starts, high):
        if size >= low:
            ratio = np.where(starts + size <= len(h), 1 - distance / max(len(x), size), -1.0)
            k = int(ratio.argmax())
            if ratio[k] > score and ratio[k] >= least:
                best, score = (int(starts[k]), size, float(ratio[k])), ratio[k]
    return best


def best_window(hay: str, needle: str, least: float = FUZZY_LEAST) -> tuple[int, int, float] | None:
    """(start, length, ratio) of the window of 0.5 to 1.5 times the needle most like it, at least ``least``.

    The shortest, then earliest of the best.  The least distance of any stretch
    that begins at a place bounds what its windows can reach: the most promising
    places are tried first, then those that could do as well.
    """
    n = len(needle)
    if not n or not hay:
        return None
    h, x = codes(hay), codes(needle)
    # a window differs by what it is longer or shorter at least
    low, high = max(1, n // 2, math.ceil(n * least - 1e-9)), min(len(hay), int(1.5 * n), math.floor(n / least + 1e-9) if least else len(hay))
    if low > high:
        return None
    bound = least_distances(h[::-1], x[::-1])[::-1]
    reach = 1 - bound / max(n, high) + 1e-12
    first = np.flatnonzero(bound == bound.min())
    if reach[first[0]] < least:
        return None
    best = _best_of(h, x, first, low, high, least)
    hope = np.flatnonzero(reach >= (best[2] if best else least))
    return _best_of(h, x, hope, low, high, least) if len(hope) > len(first) else best


FOUND = "array<struct<id:{0},start_ms:bigint,end_ms:bigint,method:string>>"
CROWD = 64  # phrases that a scene's row carries; a scene of more has several rows


def _first_match(hay: str, forms: list[str]) -> tuple[int, int, str] | None:
    """(first character, last character, method): each form exactly, then fuzzily, before the next form."""
    for no, form in enumerate(forms):
        own = "_translation" if no else ""
        at = hay.find(form)
        if at >= 0:
            return at, at + len(form) - 1, "exact" + own
        if (window := best_window(hay, form)) is not None:  # as far as the longest window may reach
            return window[0], min(window[0] + max(1, int(1.5 * len(form))) - 1, len(hay) - 1), "fuzzy" + own
    return None


def phrase_matches(phrases: DataFrame, hays: DataFrame, keys: list[str], id_col: str, phrase: str, dictionary: DataFrame | None = None) -> DataFrame:
    """(id, keys, start_ms, end_ms, method): the phrase, then its translations, each exactly and then fuzzily; the first that fits.

    ``method`` is ``exact``, ``fuzzy``, ``exact_translation``,
    ``fuzzy_translation`` or null without a match, a phrase or a hay.  A fuzzy
    match lasts to the end of 1.5 times the phrase from its start on.
    ``dictionary`` has ``term``, ``translations`` and ``pos``.

    A scene's phrases go to the scene, up to 64 to a row, so that its hay is not
    copied for each.  Ids need be unique within a scene alone; repeated rows are
    matched alike.
    """
    needles = phrases.select(*keys, F.col(id_col).alias("_id"), F.col(phrase).alias("_p"))
    if dictionary is not None:
        needles = with_translations(needles, "_p", dictionary)
    else:
        needles = needles.withColumn("translations", F.lit(None).cast("array<string>"))
    own = T.normalize(F.coalesce(F.col("_p"), F.lit("")))
    forms = F.array_distinct(F.filter(F.concat(F.array(own), F.transform(F.coalesce("translations", F.array().cast("array<string>")), T.normalize)), lambda x: x != ""))
    forms = F.when(own != "", forms).otherwise(F.array().cast("array<string>"))
    needles = needles.select(*keys, "_id", forms.alias("_f"))
    crowd = F.ceil(F.count("*").over(Window.partitionBy(*keys)) / CROWD)
    packed = needles.withColumn("_c", F.pmod(F.xxhash64("_id"), crowd)).groupBy(*keys, "_c").agg(F.collect_list(F.struct(F.col("_id").alias("id"), F.col("_f").alias("f"))).alias("_needles"))
    rows = packed.join(hays.select(*keys, "hay", "units"), keys, "left")
    rows = rows.repartition(int(phrases.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # by number: searching a few rows may take long
    id_type = needles.schema["_id"].dataType.simpleString()

    @F.pandas_udf(FOUND.format(id_type))
    def search(hay: pd.Series, units: pd.Series, wanted: pd.Series) -> pd.Series:
        out = []
        for h, us, ns in zip(hay, units, wanted, strict=True):
            to = np.array([u["to"] for u in us] if us is not None else [], np.int64)
            row = []
            for n in ns:
                m = _first_match(h, list(n["f"])) if h else None
                if m is None:
                    row.append({"id": n["id"], "start_ms": None, "end_ms": None, "method": None})
                else:
                    first, last = us[int(np.searchsorted(to, m[0], side="right"))], us[int(np.searchsorted(to, m[1], side="right"))]
                    row.append({"id": n["id"], "start_ms": int(first["start_ms"]), "end_ms": int(last["end_ms"]), "method": m[2]})
            out.append(row)
        return pd.Series(out, dtype=object)

    found = rows.select(*keys, F.explode(search("hay", "units", "_needles")).alias("_m"))
    return found.select(F.col("_m.id").alias(id_col), *keys, "_m.start_ms", "_m.end_ms", "_m.method")


def with_translations(phrases: DataFrame, phrase: str, dictionary: DataFrame, most: int = CONSTANT_TERMS) -> DataFrame:
    """Add ``translations``: those of the entry that is the phrase, else of the first entry that stands within it, else null.

    Phrases compare trimmed and in lower case; null and blank ones have none.  A
    dictionary of at most ``most`` entries becomes a constant of the expression.
    A larger one is joined: a phrase offers its stretches of the lengths that
    terms have, distinct phrases only, and the terms among them are ranked.
    """
    key = F.lower(F.trim(F.col(phrase)))
    entries = dictionary.select("pos", "term", "translations")
    few = entries.limit(most + 1).collect()
    if len(few) <= most:
        listed = json.dumps([r.asDict() for r in sorted(few, key=lambda r: r["pos"])], ensure_ascii=False)
        known = F.from_json(F.lit(listed), "array<struct<pos:int,term:string,translations:array<string>>>")
        rows = phrases.withColumn("_k", key)
        whole, within = F.filter(known, lambda e: e["term"] == F.col("_k")), F.filter(known, lambda e: F.contains(F.col("_k"), e["term"]))
        hit = F.coalesce(F.get(whole, F.lit(0)), F.get(within, F.lit(0)))
        return rows.withColumn("translations", F.when(F.col("_k") != "", hit["translations"])).drop("_k")
    sizes = [r[0] for r in entries.where("term <> ''").select(F.length("term")).distinct().collect()]
    part = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("_k") - n + 1, F.lit(1))), lambda i: F.substring(F.col("_k"), i, F.lit(n)))
    cuts = F.flatten(F.array(*map(part, sizes)))
    keyed = phrases.select(key.alias("_k")).where("_k <> ''").distinct()
    hits = keyed.select("_k", F.explode(F.array_distinct(cuts)).alias("term")).join(entries, "term")
    best = hits.groupBy("_k").agg(F.min_by("translations", F.struct((F.col("term") != F.col("_k")).alias("part"), "pos")).alias("translations"))
    return phrases.withColumn("_k", key).join(best, "_k", "left").drop("_k")


def translations(phrases: DataFrame, dictionary: DataFrame, most: int = CONSTANT_TERMS) -> DataFrame:
    """(id, translations) of the phrases that have an entry; see :func:`with_translations`."""
    return with_translations(phrases.select("id", "phrase"), "phrase", dictionary, most).select("id", "translations").where("translations is not null")


def narration_spans(narrations: DataFrame, units: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """keys, ``sentence_no`` from 0, ``sentence``, ``start_ms``, ``end_ms`` of each sentence that stands exactly in its scene's units."""
    sentences = narrations.select(*keys, F.posexplode(T.split_sentences(F.col(text))).alias("sentence_no", "sentence"))
    found = exact_matches(sentences, haystacks(units, keys, order), keys, "sentence").where("matched_start_ms is not null")
    return found.select(*keys, "sentence_no", "sentence", F.col("matched_start_ms").alias("start_ms"), F.col("matched_end_ms").alias("end_ms"))


def matched_spans(narrations: DataFrame, units: DataFrame, keys: list[str], order: list[str], text: str, dictionary: DataFrame | None = None) -> DataFrame:
    """The same by the whole precedence of :func:`phrase_matches`, with its ``method`` and ``disorder``.

    ``disorder`` tells a span that begins before the one before it ends, which
    points to a wrong match.  Sentences without a match are left out.
    """
    sentences = narrations.select(*keys, F.posexplode(T.split_sentences(F.col(text))).alias("sentence_no", "sentence"))
    found = phrase_matches(sentences, haystacks(units, keys, order), keys, "sentence_no", "sentence", dictionary).where("method is not null")
    before = F.lag("end_ms").over(Window.partitionBy(*keys).orderBy("sentence_no"))
    return found.select(*keys, "sentence_no", "start_ms", "end_ms", "method", F.coalesce(F.col("start_ms") < before, F.lit(False)).alias("disorder"))


def sentence_unions(ops: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, panel_no, start_ms, end_ms): from the first start to the last end of the sentences that a panel's ops are bound to.

    ``ops`` has keys, ``panel_no`` and ``bound_span``, the place of a sentence
    among the scene's ``spans`` (keys, ``sentence_no``, bounds), from 0; bounds
    out of their range are passed over.  Panels without a valid one have no row.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("sentence_no")) - 1
    placed = spans.select(*keys, place.alias("bound_span"), "start_ms", "end_ms")
    return ops.select(*keys, "panel_no", "bound_span").join(placed, [*keys, "bound_span"]).groupBy(*keys, "panel_no").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def panel_spans(panels: DataFrame, ops: DataFrame, spans: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """Panels with ``start_ms``, ``end_ms`` and ``method``: the union of their ops' sentences, else their phrase's match, else nulls.

    ``panels`` has keys and ``panel_no``; ``matches`` keys, ``panel_no``,
    bounds and ``method``.
    """
    unions = sentence_unions(ops, spans, keys).select(*keys, "panel_no", F.struct("start_ms", "end_ms", F.lit("sentences").alias("method")).alias("_u"))
    found = matches.where("method is not null").select(*keys, "panel_no", F.struct("start_ms", "end_ms", "method").alias("_m"))
    rows = panels.join(unions, [*keys, "panel_no"], "left").join(found, [*keys, "panel_no"], "left").withColumn("_s", F.coalesce("_u", "_m"))
    return rows.select(*panels.columns, "_s.start_ms", "_s.end_ms", "_s.method")


def assign_cues(cues: DataFrame, scenes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, cue order, ``scene_index``) by a cursor that only moves forward.

    ``cues`` has key, ``order`` and ``text``; ``scenes`` has key,
    ``scene_index`` and ``narration``.  Each cue goes to the first scene from
    the current one on in which it stands after what earlier cues took;
    unmatched cues stay with the current scene.  The walk is sequential within
    an episode, so episodes are the unit of work.  Episodes without scenes give
    scene 0.
    """
    packed = scenes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("scene_index", T.strip_punctuation(F.coalesce("narration", F.lit(""))).alias("t")))).alias("_scenes"))
    rows = cues.select(key, *order, T.strip_punctuation(F.coalesce("text", F.lit(""))).alias("_t"))
    gathered = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, "_t"))).alias("_cues")).join(packed, key, "left")
    order_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*order).schema.fields)
    key_ddl = rows.schema[key].dataType.simpleString()

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, cs, ss in zip(pdf[key], pdf["_cues"], pdf["_scenes"], strict=True):
                ss = list(ss) if ss is not None else []
                at, cursor = 0, [0] * len(ss)
                for c in cs:
                    for j in range(at, len(ss)):
                        pos = ss[j]["t"].find(c["_t"], cursor[j]) if c["_t"] else -1
                        if pos >= 0:
                            cursor[j], at = pos + len(c["_t"]), j
                            break
                    out.append((k, *[c[o] for o in order], ss[at]["scene_index"] if ss else 0))
            yield pd.DataFrame(out, columns=[key, *order, "scene_index"])

    return gathered.mapInPandas(walk, f"`{key}` {key_ddl}, {order_ddl}, scene_index int")


def slice_ops(ops: DataFrame, slices: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Reveal ops of beats told over several scenes: each scene keeps the ops bound to its own sentences, rebased.

    ``ops``: keys, ``beat_id``, ``op_no``, ``bound_span``; ``slices``: keys,
    ``beat_id``, ``slice_no``, ``scene_id``; ``counts``: keys, ``scene_id``,
    ``n_sentences``.  A beat of one scene keeps all its ops as they are.
    """
    w = Window.partitionBy(*keys, "beat_id").orderBy("slice_no")
    s = slices.join(counts, [*keys, "scene_id"], "left").fillna(0, ["n_sentences"])
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("lo", F.coalesce(F.sum("n_sentences").over(before), F.lit(0))).withColumn("n_slices", F.count("*").over(Window.partitionBy(*keys, "beat_id")))
    s = s.withColumn("broken", F.min("n_sentences").over(Window.partitionBy(*keys, "beat_id")) == 0)
    j = ops.join(s, [*keys, "beat_id"])
    single = F.col("n_slices") == 1
    owner = F.col("broken") & ~single & (F.col("slice_no") == 0)
    mine = ~F.col("broken") & (F.col("bound_span") >= F.col("lo")) & (F.col("bound_span") < F.col("lo") + F.col("n_sentences"))
    return j.where(single | owner | mine).select(*keys, "beat_id", "scene_id", "op_no", F.when(single | owner, F.col("bound_span")).otherwise(F.col("bound_span") - F.col("lo")).alias("bound_span"))


def fixed_dictionary(spark: SparkSession, entries: dict[str, list[str]]) -> DataFrame:
    """A dictionary frame from (term, translations) in their order."""
    rows = [F.struct(F.lit(k).alias("term"), F.array(*map(F.lit, v)).alias("translations"), F.lit(i).alias("pos")) for i, (k, v) in enumerate(entries.items())]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("e")).select("e.*")
