"""Intermediate tables in the folder that driver and executors share.

Cutting lineage through a written table survives the loss of executors; the
folder is the one the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}
#: Folders of the operator runs of this process, in order.
_roots: list[str] = []

#: Rows of a few numbers that are broadcast at most: some ten megabytes.
BROADCAST = 200_000


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder, with its scheme. A local session without one
    gets a temporary folder; a cluster without one is an error, since executors
    would not see each other's files."""
    conf = spark.sparkContext.getConf()
    if named := conf.get("spark.checkpoint.dir", None):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(named)
        system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return re.sub("^file:/+", "file:///", system.makeQualified(at).toString()).rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        made = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _local[app] = "file://" + made
    return _local[app]


class Scratch:
    """Tables of one operator run; ``free`` drops those that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        _roots.append(self.root)

    def path(self, tag: str) -> str:
        return f"{self.root}/{tag}-{len(self.paths)}-{uuid.uuid4().hex[:8]}"

    def cut(self, df: DataFrame, tag: str) -> DataFrame:
        """``df`` written out and read back: later plans start from the files."""
        path = self.path(tag)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def measured(self, df: DataFrame, tag: str, **metrics: Column) -> tuple[DataFrame, dict]:
        """``cut``, and aggregates over the rows that need no job of their own."""
        seen = Observation(f"{tag}-{uuid.uuid4().hex}")
        out = self.cut(df.observe(seen, *(c.alias(k) for k, c in metrics.items())), tag)
        return out, seen.get

    def lookup(self, df: DataFrame, tag: str) -> DataFrame:
        """``cut`` for the small side of a join: to be broadcast if it has at most BROADCAST rows, else joined as Spark sees fit."""
        out, found = self.measured(df, tag, n=F.count("*"))
        return F.broadcast(out) if found["n"] <= BROADCAST else out

    def free(self, *frames: DataFrame) -> None:
        for df in frames:
            _, path = self.paths.pop(id(df))
            remove(self.spark, path)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Removes the tables of operator runs that began inside, at its end; their results must have been written by then."""
    before = len(_roots)
    yield
    for root in _roots[before:]:
        remove(spark, root)
    del _roots[before:]


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
