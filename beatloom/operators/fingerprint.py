"""Content fingerprints and drift between what was recorded and what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest(files: DataFrame, keys: list[str], name: str, content: str) -> DataFrame:
    """One digest per group of files: SHA-256 over the names and digests in order of name; a null content counts as missing.

    Files are hashed where they are; only (name, digest, size) is gathered per
    group, combined before the shuffle.
    """
    digest = F.coalesce(F.sha2(F.col(content).cast("binary"), 256), F.lit("missing"))
    size = F.coalesce(F.octet_length(F.col(content).cast("binary")), F.lit(-1))
    line = F.concat_ws(":", F.col(name).cast("string"), digest, size.cast("string"))
    return files.select(*keys, line.alias("_l")).groupBy(*keys).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("_l")), "\n"), 256).alias("fingerprint"), F.count("*").alias("n_files"))


def drift(recorded: DataFrame, actual: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """keys, ``recorded``, ``actual``, ``status`` (added, missing, changed) of what differs; equal and both-null ones are left out."""
    r = recorded.select(*keys, F.col(digest).alias("recorded"), F.lit(True).alias("_r"))
    a = actual.select(*keys, F.col(digest).alias("actual"), F.lit(True).alias("_a"))
    both = r.join(a, keys, "full_outer")
    status = F.when(F.col("_r").isNull(), "added").when(F.col("_a").isNull(), "missing").when(~F.col("recorded").eqNullSafe(F.col("actual")), "changed")
    return both.withColumn("status", status).where("status is not null").select(*keys, "recorded", "actual", "status")


def unrecorded(manifests: DataFrame, recorded: DataFrame, keys: list[str], least_files: int) -> DataFrame:
    """What has all its files but no fingerprint on record; ``manifests`` has ``n_files``."""
    whole = manifests.where(F.col("n_files") >= least_files)
    return whole.join(recorded.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit("fingerprint_unrecorded").alias("code"), F.lit("warning").alias("severity"))
