"""Coverage of time: merged periods and the gaps between them.

Two levels, so that one huge entity is spread over many tasks:

1. every interval is clipped into time shards of fixed width (at most a head,
   a tail and one bridge for the shards between, however long it is) and merged
   inside its shard;
2. one row per (entity, shard) carries the furthest end over the shard
   borders, and the pieces that touch a border are stitched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _pieces(df: DataFrame, keys: list[str], start: str, end: str, width: int) -> DataFrame:
    """Head, tail and bridge pieces as (keys, shard, s, e); pre-aggregated to one row per start."""
    s, e = F.col("_s"), F.col("_e")
    first, last = F.floor(s / width).cast("bigint"), F.floor((e - 1) / width).cast("bigint")
    piece = lambda shard, a, b: F.struct(shard.alias("shard"), a.alias("s"), b.alias("e"))
    head = piece(first, s, F.least(e, (first + 1) * width))
    tail = piece(last, last * width, e)
    bridge = piece(first + 1, (first + 1) * width, last * width)
    parts = (F.when(first == last, F.array(head))
             .when(first + 1 == last, F.array(head, tail))
             .otherwise(F.array(head, bridge, tail)))
    valid = df.select(*keys, F.col(start).cast("bigint").alias("_s"), F.col(end).cast("bigint").alias("_e"))
    valid = valid.where(s.isNotNull() & e.isNotNull() & (e > s))
    return (valid.select(*keys, F.explode(parts).alias("_p"))
            .groupBy(*keys, F.col("_p.shard").alias("_shard"), F.col("_p.s").alias("_s"))
            .agg(F.max("_p.e").alias("_e")))


def _stitched(df: DataFrame, keys: list[str], start: str, end: str, min_gap: int, width: int) -> DataFrame:
    """One row per (entity, shard): its islands in order, and ``carry``, the furthest end before it.

    Islands inside a shard are at least ``min_gap`` apart, so a row holds at
    most ``width / min_gap`` of them (plus one bridge), whatever the input.
    """
    in_shard = Window.partitionBy(*keys, "_shard").orderBy("_s", "_e")
    before = in_shard.rowsBetween(Window.unboundedPreceding, -1)
    upto = in_shard.rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max("_e").over(before)
    opened = F.when(reach.isNull() | (F.col("_s") - reach >= min_gap), 1).otherwise(0)
    islands = (_pieces(df, keys, start, end, width)
               .withColumn("_open", opened).withColumn("_island", F.sum("_open").over(upto))
               .groupBy(*keys, "_shard", "_island").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"))
               .groupBy(*keys, "_shard").agg(F.array_sort(F.collect_list(F.struct(F.col("_s").alias("s"), F.col("_e").alias("e")))).alias("_islands")))
    reach_of = F.array_max(F.transform("_islands", lambda i: i["e"]))
    earlier = Window.partitionBy(*keys).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    return islands.withColumn("_carry", F.max(reach_of).over(earlier))


def _with_previous_end() -> Column:
    """Islands as (prev, s, e): prev is the furthest end before the island, null for the very first.

    A shard's islands are apart and in order, so that is the end of the one
    before or what the shards before reach.
    """
    before = lambda k: F.get("_islands", k - 1)["e"]
    return F.transform("_islands", lambda i, k: F.struct(F.greatest("_carry", F.when(k > 0, before(k))).alias("prev"), i["s"].alias("s"), i["e"].alias("e")))


def gaps(df: DataFrame, keys: list[str], start: str, end: str, min_gap: int = 1, width: int = 600_000) -> DataFrame:
    """Stretches of ``min_gap`` or more that no interval of the entity covers.

    Columns: keys, ``gap_start``, ``gap_end``.  Rows with a null bound or
    ``end <= start`` cover nothing; an entity of such rows alone has no gaps.
    Repeated, nested and overlapping rows change nothing.  Null keys form an
    entity of their own; filter them before if they mean nothing.  Other
    columns are ignored, an empty frame gives an empty frame.
    """
    i = F.explode(_with_previous_end()).alias("_i")
    return (_stitched(df, keys, start, end, min_gap, width).select(*keys, i)
            .where(F.col("_i.s") - F.col("_i.prev") >= min_gap)
            .select(*keys, F.col("_i.prev").alias("gap_start"), F.col("_i.s").alias("gap_end")))


def periods(df: DataFrame, keys: list[str], start: str, end: str, min_gap: int = 1, width: int = 600_000) -> DataFrame:
    """Continuous periods, gaps under ``min_gap`` closed: keys, ``period_start``, ``period_end``.

    Same rules as :func:`gaps`.  A period's end is the furthest end before the
    next period's start, found in its own shard or in the first later shard
    that opens one.
    """
    shards = _stitched(df, keys, start, end, min_gap, width).withColumn("_all", _with_previous_end())
    shards = shards.withColumn("_starts", F.filter(
        "_all", lambda i: i["prev"].isNull() | (i["s"] - i["prev"] >= min_gap)))
    later = Window.partitionBy(*keys).orderBy("_shard").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(*keys)
    reach = F.array_max(F.transform("_all", lambda i: F.greatest(i["e"], i["prev"])))
    first_end = F.when(F.size("_starts") > 0, F.col("_starts")[0]["prev"])
    shards = (shards.withColumn("_next_end", F.first(first_end, ignorenulls=True).over(later))
              .withColumn("_total", F.max(reach).over(whole)))
    ends = F.concat(F.transform(F.slice("_starts", 2, F.greatest(F.size("_starts"), F.lit(1))), lambda i: i["prev"]),
                    F.array(F.coalesce("_next_end", "_total")))
    return (shards.where(F.size("_starts") > 0)
            .select(*keys, F.explode(F.arrays_zip(F.transform("_starts", lambda i: i["s"]).alias("s"), ends.alias("e"))).alias("_p"))
            .select(*keys, F.col("_p.s").alias("period_start"), F.col("_p.e").alias("period_end")))
