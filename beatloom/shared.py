"""Intermediate results in the cluster's shared folder.

A written table cuts lineage like a checkpoint, is computed once, keeps column
pruning, and survives the loss of an executor.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    made = Path(tempfile.mkdtemp(prefix="beatloom-")) / f"{root.name}.zip"
    with zipfile.ZipFile(made, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(made))


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="beatloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once under the shared folder and return a scan of it; removed at exit."""
    spark = df.sparkSession
    if not _written:
        atexit.register(clean)
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """``scan`` over all cores where its files give fewer tasks than there are cores, else as it is.

    For scans that feed heavy Python stages; larger inputs have tasks enough
    and are never shuffled for it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan._jdf.rdd().getNumPartitions() < cores else scan


def clean() -> None:
    """Remove what :func:`materialise` has written."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone by then
            pass
