"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``.

Operators cut lineage by writing such a table and reading it back: a lost executor costs no more than the tasks that it
ran. A table belongs to the call that made it. Operators ``drop`` what their result does not read; what it reads stays until
the owner of the call releases it (``with owner() as tables: ...``), or else until the Python process ends. Nobody deletes
the tables of another call.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """The intermediate tables of some calls."""

    def __init__(self):
        self.paths: dict[str, SparkSession] = {}

    def release(self) -> None:
        """Delete the tables; what is read from them must have been written."""
        while self.paths:
            path, spark = self.paths.popitem()
            delete(spark, path)


_process = Tables()
_owner: ContextVar[Tables] = ContextVar("owner", default=_process)


@contextmanager
def owner() -> Iterator[Tables]:
    """Tables that are made inside belong to the object given; they are deleted at the end of the block."""
    tables = Tables()
    token = _owner.set(tables)
    try:
        yield tables
    finally:
        _owner.reset(token)
        tables.release()


def delete(spark: SparkSession, path: str) -> None:
    try:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # noqa: BLE001  the session has ended
        return


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where it is unset and Spark is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile

    folder = "file://" + tempfile.mkdtemp(prefix="fixmine-")
    spark.conf.set("spark.checkpoint.dir", folder)
    _process.paths[folder] = spark
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path that is not in use yet, below the shared folder; it belongs to the present owner."""
    path = f"{shared_folder(spark)}/fixmine-{name}-{uuid.uuid4().hex}"
    _owner.get().paths[path] = spark
    return path


def present() -> Tables:
    """Who owns the tables that are made now."""
    return _owner.get()


def keep(df: DataFrame, name: str, of: Tables | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return the table; it belongs to the present owner, or to ``of``."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if of is not None:
        of.paths[path] = _owner.get().paths.pop(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``keep`` returned, when all that is read from them has been written."""
    own = _owner.get()
    for t in tables:
        own.paths.pop(t.kept_at, None)
        delete(t.sparkSession, t.kept_at)


atexit.register(_process.release)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def columns_for(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the named columns, cast to the types that the operators need; other columns and their names don't matter."""
    from pyspark.sql import functions as F

    return df.select(*(F.col(f"`{c}`").cast(kind).alias(c) for c, kind in wanted.items()))


def spare(df: DataFrame, name: str) -> str:
    """``name``, or a longer one where ``df`` has it already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def bound(share: float) -> int:
    """The number at or below which lies that share of 64-bit hashes."""
    return min(2**63 - 1, int(share * 2.0**64) - 2**63)
