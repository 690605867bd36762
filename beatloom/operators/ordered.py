"""Ordered computations that do not put a whole group into one task.

A plain ``Window.partitionBy(key).orderBy(...)`` sorts a hot key in one task.
Here the rows are range-partitioned on (keys, order) first, so a hot key
spreads over many shards; a second, narrow pass over one row per (key, shard)
carries state across the shard borders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialise

SHARD = "_shard"


def range_shards(df: DataFrame, keys: list[str], order: list[str], name: str = "shards",
                 prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``df`` range-partitioned on keys and order, with the partition's number in ``_shard``.

    Written to the shared folder: both later passes see the same borders.
    Rows with equal (keys, order) stay in one shard, so ``order`` should end in
    a unique column.  ``prepare`` is narrow work on the rows, done after the
    borders are drawn (drawing them reads the rows once more) and before they
    are written; it must keep keys, order and ``_shard``.
    """
    cols = [F.col(c) for c in [*keys, *order]]
    return materialise(prepare(df.repartitionByRange(*cols).withColumn(SHARD, F.spark_partition_id())), name)


def _same(a: DataFrame, b: DataFrame, cols: list[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & a[c].eqNullSafe(b["_k_" + c])
    return cond


def prefix_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Add a column for each of ``sums``: its running sum in each key up to and with the row.

    Null values count as 0.  Null keys form one group.  An empty frame gives an
    empty frame.
    """
    values = {f"_v{i}": F.coalesce(c, F.lit(0)) for i, c in enumerate(sums.values())}
    shards = range_shards(df.withColumns(values), keys, order, "prefix-sum")
    totals = shards.groupBy(*keys, SHARD).agg(*[F.sum(v).alias(v) for v in values])
    before = Window.partitionBy(*keys).orderBy(SHARD).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*[F.col(c).alias("_k_" + c) for c in [*keys, SHARD]], *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias("_carry" + v) for v in values])
    local = Window.partitionBy(*keys, SHARD).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = shards.withColumns({"_local" + v: F.sum(v).over(local) for v in values})
    rows = inside.join(carry, _same(inside, carry, [*keys, SHARD]), "left")
    kept = [c for c in df.columns if c not in sums]
    return rows.select(*kept, *[(F.col("_local" + v) + F.col("_carry" + v)).alias(out) for out, v in zip(sums, values, strict=True)])


def prefix_sum(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``, the running sum of ``value``; see :func:`prefix_sums`."""
    return prefix_sums(df, keys, order, {out: F.col(value)})


def _beside(df: DataFrame, keys: list[str], order: list[str], payload: Column, out: str, prepare: Callable[[DataFrame], DataFrame], ahead: bool) -> DataFrame:
    shards = range_shards(df, keys, order, "rows-beside", prepare)
    kept = [c for c in shards.columns if c not in (SHARD, out)]
    shards = shards.withColumn("_payload", F.struct(payload.alias("v")))
    ends = shards.groupBy(*keys, SHARD).agg((F.min_by if ahead else F.max_by)("_payload", F.struct(*order)).alias("_end"))
    step = F.lead if ahead else F.lag
    carry = ends.select(*[F.col(c).alias("_k_" + c) for c in [*keys, SHARD]], step("_end").over(Window.partitionBy(*keys).orderBy(SHARD)).alias("_carry"))
    inside = shards.withColumn("_next", step("_payload").over(Window.partitionBy(*keys, SHARD).orderBy(*order)))
    return (inside.join(carry, _same(inside, carry, [*keys, SHARD]), "left")
            .select(*kept, F.coalesce("_next", "_carry")["v"].alias(out)))


def previous_row(df: DataFrame, keys: list[str], order: list[str], payload: Column, out: str,
                 prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Add ``out``, ``payload`` of the row before in the key's order, null for the first.

    Only the last row of each (key, shard) passes through the second level.
    ``prepare`` is applied to the rows first (see :func:`range_shards`).
    """
    return _beside(df, keys, order, payload, out, prepare, ahead=False)


def next_row(df: DataFrame, keys: list[str], order: list[str], payload: Column, out: str) -> DataFrame:
    """Add ``out``, ``payload`` of the row after in the key's order, null for the last."""
    return _beside(df, keys, order, payload, out, lambda rows: rows, ahead=True)
