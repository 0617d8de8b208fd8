"""Tables written to the folder that all executors share, to cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. A private one only where that is unset and all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", root) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return root.rstrip("/")


_BASES: list[str] = []


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Frees all tables that operators wrote within: for use once a result is written elsewhere."""
    first = len(_BASES)
    try:
        yield
    finally:
        for base in _BASES[first:]:
            _delete(spark, base)
        del _BASES[first:]


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Written tables of one operator run; ``drop`` frees those that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        _BASES.append(self.base)

    def path(self, name: str = "t") -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        at = self.path(name)
        df.write.option("compression", "zstd").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._scratch_path = at
        return out

    def drop(self, *tables: DataFrame | str) -> None:
        for t in tables:
            _delete(self.spark, t if isinstance(t, str) else t._scratch_path)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Texts may be long: hand few rows at a time to Python workers. Never raises a smaller setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
