"""Mixing sources to target weights by tokens.

Per source the budget is its share of the total; whole epochs come first, as
many as fit and its cap of repeats allows, then a fraction: its documents in
the order of exponential keys scaled by quality weight (Efraimidis-Spirakis),
summed up to what is left of the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import prefix_sum

MAX_SOURCES = 10_000  # targets up to this many are broadcast
SALTS = 64  # beyond that, a source's documents meet their target in so many parts
LEAST, FULL = 0.05, 80  # the least weight; a text of fewer characters weighs less


def _variety(parts: Column) -> Column:
    return F.size(F.array_distinct(parts)) / F.size(parts)


def quality(text: Column) -> Column:
    """A document's weight, from 0.05 to 1, that of a null or empty text the least.

    The product of the share of letters, marks and figures in it, of how many
    of its lines and (by the square root) of its words are not repetitions, of
    what is left of it without mark-up, and of its length up to 80 characters.
    """
    size = F.nullif(F.length(text).cast("double"), F.lit(0.0))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}]+", "")) / size
    bare = F.length(F.regexp_replace(text, r"<[^<>]*>|[{}|\\]", "")) / size
    lines, words = _variety(F.split(text, r"\n")), F.sqrt(_variety(F.split(text, r"[ \t\r\n]+")))
    weight = letters * bare * lines * words * F.least(F.lit(1.0), size / FULL)
    return F.coalesce(F.greatest(weight, F.lit(LEAST)), F.lit(LEAST))


QUALITY_SQL = r"""coalesce(greatest(0.05::DOUBLE, length(regexp_replace(text, '[^\p{L}\p{M}\p{N}]+', '', 'g')) / nullif(length(text), 0)::DOUBLE * length(regexp_replace(text, '<[^<>]*>|[{}|\\]', '', 'g')) / nullif(length(text), 0)::DOUBLE
 * len(list_distinct(string_split(text, chr(10)))) / len(string_split(text, chr(10)))::DOUBLE
 * sqrt(len(list_distinct(string_split_regex(text, '[ \t\r\n]+'))) / len(string_split_regex(text, '[ \t\r\n]+'))::DOUBLE) * least(1.0::DOUBLE, length(text) / 80.0::DOUBLE)), 0.05)"""


def plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target source: its size, budget, whole epochs and what is left for the fraction.

    ``sized`` has ``source`` and ``n_tokens``; ``targets`` has unique
    ``source``, ``target_share`` and ``max_repeats``.  T, the total, is the size
    of all documents of target sources, each once.  A source without documents
    has size 0; documents of other sources or none count nowhere.
    """
    sizes = sized.groupBy("source").agg(F.sum(F.col("n_tokens").cast("bigint")).alias("size"), F.count("*").alias("n_docs"))
    each = targets.where("source is not null").select("source", "target_share", "max_repeats").join(sizes, "source", "left")
    each = each.fillna(0, ["size", "n_docs", "target_share", "max_repeats"])
    total = F.sum("size").over(Window.partitionBy(F.lit(0)))  # one row per target source
    each = each.withColumn("total", total).withColumn("budget", F.col("target_share") * F.col("total"))
    epochs = F.when(F.col("size") == 0, 0).otherwise(F.least(F.floor(F.col("budget") / F.col("size")), F.col("max_repeats")))
    left = F.when((F.col("size") > 0) & (F.col("epochs") < F.col("max_repeats")), F.col("budget") - F.col("epochs") * F.col("size")).otherwise(0.0)
    return (each.withColumn("epochs", epochs.cast("int")).withColumn("rest", left)
            .withColumn("short", F.col("size") * F.col("max_repeats") < F.col("budget")))


def mix(sized: DataFrame, targets: DataFrame, key: str = "doc_id", weight: str = "weight", seed: int = 17, max_sources: int = MAX_SOURCES) -> DataFrame:
    """(key, ``source``, ``n_tokens``, ``copies``) of every document in the mix.

    ``copies`` is the source's whole epochs, plus one if the document is drawn
    for the fraction; never more than ``max_repeats``.  A drawn document may
    pass the budget by at most half its size.  The draw depends on key and seed
    alone, so lost tasks repeat it; a null or non-positive weight counts as the
    least positive one.  Documents without tokens add nothing and are left out.
    Up to ``max_sources`` targets are broadcast, more are joined by a salted key.
    """
    planned = plan(sized, targets).select("source", "epochs", "rest", "max_repeats")
    u = (F.xxhash64(F.col(key), F.lit(seed)).bitwiseAND((1 << 52) - 1) + 0.5) / float(1 << 52)
    drawn = -F.log(u) / F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(1e-9))
    docs = sized.where("n_tokens > 0").select(key, "source", "n_tokens", drawn.alias("draw"))
    if targets.limit(max_sources + 1).count() <= max_sources:
        docs = docs.join(F.broadcast(planned), "source")
    else:
        salted = planned.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        docs = docs.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(salted, ["source", "_salt"]).drop("_salt")
    whole = docs.where("epochs > 0 or rest > 0").drop("max_repeats")
    summed = prefix_sum(whole, ["source"], ["draw", key], "n_tokens", "upto")
    copies = F.col("epochs") + F.when(F.col("upto") - F.col("n_tokens") / 2 <= F.col("rest"), 1).otherwise(0)
    return summed.select(key, "source", "n_tokens", copies.alias("copies")).where("copies > 0")


def report(mixed: DataFrame, planned: DataFrame) -> DataFrame:
    """Per target source: what was wanted and what the mix reaches, of T and of itself."""
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens").cast("bigint") * F.col("copies")).alias("mix_tokens"),
                                      F.count("*").alias("mix_docs"), F.max("copies").alias("most_copies"))
    rows = planned.join(got, "source", "left").fillna(0, ["mix_tokens", "mix_docs", "most_copies"])
    all_mixed = F.sum("mix_tokens").over(Window.partitionBy(F.lit(0)))
    return rows.select("source", "target_share", "max_repeats", "n_docs", "size", "budget", "epochs", "short", "mix_docs", "mix_tokens", "most_copies",
                       (F.col("mix_tokens") / F.nullif(F.col("total"), F.lit(0))).alias("share_of_total"),
                       (F.col("mix_tokens") / F.nullif(all_mixed, F.lit(0))).alias("share_of_mix"))
