"""Row functions with a status, staged batches that skip what is done, and a streaming vote."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_json(text: str | None) -> str | None:
    """The text of an object again, keys sorted; raises on anything else."""
    import json

    return None if text is None else json.dumps(json.loads(text), sort_keys=True)


class _Clock:
    """Stops what runs in the worker's main thread after so many seconds."""

    def __init__(self, seconds: float | None):
        self.seconds = seconds

    def __enter__(self):
        if self.seconds:
            import signal

            def stop(*_):
                raise TimeoutError(f"more than {self.seconds} s")

            self.old = signal.signal(signal.SIGALRM, stop)
            signal.setitimer(signal.ITIMER_REAL, self.seconds)

    def __exit__(self, *_):
        if self.seconds:
            import signal

            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, self.old)


def safe_rows(df: DataFrame, key: str, column: str, function: Callable[[str | None], str | None], timeout: float | None = None, elapsed: bool = False) -> DataFrame:
    """(key, status, result, error) of a function of each row; a row that raises, or takes more seconds than ``timeout``, has the status failed.

    elapsed: with the seconds that a row took.
    """
    import time

    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, x in zip(pdf[key], pdf[column], strict=True):
                began = time.perf_counter()
                try:
                    with _Clock(timeout):
                        row = (k, "ok", function(x), None)
                except Exception as e:  # noqa: BLE001  any failure is the row's result
                    row = (k, "failed", None, f"{type(e).__name__}: {e}")
                out.append((*row, time.perf_counter() - began) if elapsed else row)
            yield pd.DataFrame(out, columns=[key, "status", "result", "error", *["elapsed"] * elapsed])

    return df.select(key, column).mapInPandas(run, f"{key} {kind}, status string, result string, error string" + ", elapsed double" * elapsed)


def with_retry(df: DataFrame, key: str, column: str, first: Callable, second: Callable, timeouts: tuple[float | None, float | None] = (None, None)) -> DataFrame:
    """``safe_rows`` with another function, and another timeout, for the rows that failed."""
    once = safe_rows(df, key, column, first, timeouts[0])
    failed = df.join(once.where("status = 'failed'").select(key), key, "left_semi")
    return once.where("status = 'ok'").unionByName(safe_rows(failed, key, column, second, timeouts[1]))


def run_stages(df: DataFrame, key: str, folder: str, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """The last stage's rows; each stage is a table under ``folder``, and rows whose key is in it already are not run again.

    A row that a stage drops goes no further.
    """
    spark, rows = df.sparkSession, df
    for name, stage in stages:
        path = f"{folder}/{name}"
        try:
            done = spark.read.parquet(path)
            todo = rows.join(done.select(key).distinct(), key, "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            todo = rows
        stage(todo).write.mode("append").parquet(path)
        rows = spark.read.parquet(path)
    return rows


def streaming_votes(events: DataFrame, item: str, candidate: str, time: str, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Votes per window, item and candidate of a stream, final when the watermark has passed the window.

    The reference workflow has no streams; this is an extra for live votes.
    """
    return events.withWatermark(time, late).groupBy(F.window(time, window), item, candidate).agg(F.count("*").alias("n")).select("window.start", "window.end", item, candidate, "n")


def stream_modes(events: DataFrame, item: str, candidate: str, sink: Callable[[DataFrame, int], None]):
    """A writer that gives each micro-batch's modes to ``sink``."""
    from fixmine.operators.votes import modes

    return events.writeStream.foreachBatch(lambda batch, n: sink(modes(batch, item, candidate), n))
