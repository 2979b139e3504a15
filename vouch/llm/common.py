"""What several operators of this subpackage share: table access, written tables, a stable order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.session import SMALL, shared_folder, ship, small_batches, tidy  # noqa: F401

#: Ids that are broadcast, at most: 16 MB.
FEW_IDS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Texts may be long, so fewer rows than Spark's own number go to Python at once, unless the session says so."""
    ship(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a Parquet table in the shared folder.

    Cuts the lineage: a lost executor costs a reread, never a recomputation of
    what stands before, and two readers don't run the work twice.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(column, salt: int = 0):
    """A column's 64-bit hash: the stable order used where a bounded sample is drawn."""
    return F.xxhash64(column, F.lit(salt))


def fresh(name: str, columns: list[str]) -> str:
    """A column name that none of these is."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def among(df: DataFrame, key: str, ids: DataFrame, out: bool = False) -> DataFrame:
    """The rows of df whose key is (with out: isn't) in the one column of ids; null keys never are.

    Up to FEW_IDS ids are broadcast, so df isn't shuffled; more are joined by
    shuffle, which Spark splits where a key is hot.
    """
    other = fresh("id", df.columns)
    ids = ids.toDF(other).where(F.col(other).isNotNull())
    if ids.limit(FEW_IDS + 1).count() <= FEW_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, F.col(f"`{key}`") == F.col(other), "left_anti" if out else "left_semi")


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of at most SMALL rows, so that few of their texts are Python objects at a time."""
    for batch in batches:
        for begin in range(0, max(1, batch.num_rows), SMALL):
            yield batch.slice(begin, SMALL)


def ddl(df: DataFrame) -> str:
    """The schema of df as text, whatever the names of its columns."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema)
