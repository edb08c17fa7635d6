"""Where lineage is cut: the shared folder that the cluster names, or a temporary one in local runs."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def checkpoints(spark: SparkSession) -> None:
    """Make ``checkpoint()`` usable; only a local session without ``spark.checkpoint.dir`` gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="fixmine-")
    sc.setCheckpointDir(folder)


def dealt(df: DataFrame, keys: Sequence[str], rows: int = 4096, like: DataFrame | None = None) -> DataFrame:
    """``df`` dealt out by its keys, some ``rows`` to a partition, for steps that make many rows of each and sort them within a key.

    like: a table of as many rows that is cheaper to count.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-(df if like is None else like).count() // rows)), *keys)


def scratch(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that is not in use; what is written there goes with the Python process."""
    checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read from there: a cut of lineage that is smaller and faster to read than a checkpoint."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clear() -> None:
    for spark, path in _made:
        try:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # noqa: BLE001  the session has ended
            return
