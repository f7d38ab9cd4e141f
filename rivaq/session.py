"""Sessions and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import logging
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: set[str] = set()
_shipped: dict[str, str] = {}


def local_session(cpus: int = 8, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rivaq")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shipped(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for each context: operators that run Python there need it."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="rivaq-code-")  # on the driver alone, which hands it out
        path = os.path.join(folder, "rivaq.zip")
        with zipfile.ZipFile(path, "w") as z:
            for at, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(at, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        sc.addPyFile(path)
        _shipped[sc.applicationId] = folder
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a new temporary folder where that is unset (local runs)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="rivaq-")
        spark.sparkContext.setCheckpointDir(at)
        spark.conf.set("spark.checkpoint.dir", at)
        _written.add(at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is not used yet; deleted at the end of the session, or of scratch()."""
    path = f"{shared_dir(spark)}/rivaq/{name}-{uuid.uuid4().hex}"
    _written.add(path)
    return path


def saved(df: DataFrame, name: str = "part") -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts the lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._rivaq_path = path
    return back


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that saved() wrote and nothing reads any more, as those of earlier rounds."""
    for df in tables:
        path = getattr(df, "_rivaq_path", None)
        if path in _written:
            _delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what saved() wrote within: the results must have been written or collected by then."""
    before = set(_written)
    try:
        yield
    finally:
        for path in [p for p in _written - before if "/rivaq/" in p]:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _written.discard(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than cores, such as one of a single small file, spread over all cores for work that costs more than the shuffle of its rows; other scans, and rows that are shuffled anyway, stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if any(x in plan for x in ("Aggregate", "Join", "Window", "Sort", "Repartition", "Deduplicate", "InPandas", "InArrow")):
        return df  # asking such a plan for its partitions would run its shuffles
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _clean() -> None:
    for folder in _shipped.values():
        shutil.rmtree(folder, ignore_errors=True)
    path = ""
    try:
        spark = SparkSession.getActiveSession()
        for path in sorted(_written, key=len, reverse=True) if spark is not None and spark.sparkContext._jsc else ():
            _delete(spark, path)
    except Exception as e:  # the session or its file system may be gone
        logging.getLogger(__name__).warning("left behind: %s (%s)", path or "tables of this session", e)


atexit.register(_clean)
