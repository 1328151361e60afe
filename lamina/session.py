"""What jobs need of a session: the package on the workers, tables in the shared folder, and how long these live."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths of tables by scope, the innermost last; the first scope lasts as long as the process.
_scopes: list[list[str]] = [[]]


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session, so that functions of it can run there wherever they are."""
    if getattr(spark.sparkContext, "_lamina_sent", False):
        return
    root = Path(__file__).resolve().parent
    with zipfile.ZipFile(at := f"{tempfile.mkdtemp(prefix='lamina-')}/lamina.zip", "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(at)
    spark.sparkContext._lamina_sent = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary folder on one machine; RuntimeError on a cluster, whose machines would each have a folder of their own."""
    if not (at := spark.conf.get("spark.checkpoint.dir", None)):
        if not (at := getattr(spark, "_lamina_shared", None)):
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            at = spark._lamina_shared = f"file://{tempfile.mkdtemp(prefix='lamina-')}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder that lives as long as the innermost scope."""
    _scopes[-1].append(path := f"{shared_dir(spark)}/lamina-{uuid.uuid4().hex[:12]}-{name}")
    return path


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of the shared folder and empty their list."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def recorded(paths: list[str]) -> Iterator[list[str]]:
    """Tables made meanwhile are noted in paths, for their owner to drop."""
    _scopes.append(paths)
    try:
        yield paths
    finally:
        _scopes.pop()


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables made meanwhile are deleted at the end: results that read them must be written or fetched before."""
    with recorded([]) as paths:
        try:
            yield
        finally:
            drop(spark, paths)


@atexit.register
def _drop_the_rest() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _scopes[0] and spark.sparkContext._jsc is not None:
        drop(spark, _scopes[0])


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a written table of the shared folder: lineage ends there, so a lost executor costs no recomputation, and the shuffle files behind it are freed at once."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = scratch_path(spark, name), spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if its scan has fewer, as that of one small file; else df itself."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().executedPlan().outputPartitioning().numPartitions() >= cores:
        return df
    # always true, but not to the optimizer, which would move later filters and their work below the exchange
    return df.repartition(cores).filter(F.monotonically_increasing_id() >= 0)
