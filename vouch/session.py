"""Getting the library to the executors."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that Spark hands to Python at once where nobody has chosen, and the number that stands for no choice.
SMALL, ROWS, UNCHOSEN = 1024, "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once an application.

    Where the package is installed on every machine this changes nothing; where
    it isn't, the helpers that run in tasks would not be importable.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="vouch-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def small_batches(spark: SparkSession) -> None:
    """Texts may be long, so fewer rows than Spark's own number go to Python at once, unless the session says so."""
    if spark.conf.get(ROWS) == UNCHOSEN:
        spark.conf.set(ROWS, str(SMALL))


def tidy(each: Callable) -> Callable:
    """A function for mapInArrow whose task, when it ends, hands the memory it has freed back to the system.

    Python workers live on between tasks, beside the executor's own memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from each(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under the folder that the cluster names in spark.checkpoint.dir; in local mode a temporary one where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="vouch-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a Parquet table in the shared folder: a stage that later ones read and no failure makes anew."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
