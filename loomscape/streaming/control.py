"""Pace, progress and cancellation of streams and batch jobs."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.types import StructType


def paced_files(spark: SparkSession, path: str, schema: StructType | str, files: int = 1) -> DataFrame:
    """A stream of a folder's Parquet files, at most so many in a micro-batch: what is
    waiting stays in the folder, not in memory."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


class Progress(StreamingQueryListener):
    """Rows and micro-batches of each query by its id, which a restart from its checkpoint
    keeps; and how its last run ended: None while it runs, else its error or an empty text.
    Events come late and aren't replayed: these are for reports, not for results."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:
        self.ended[str(event.id)] = None

    def onQueryProgress(self, event) -> None:
        query, rows = str(event.progress.id), event.progress.numInputRows
        self.rows[query] = self.rows.get(query, 0) + rows
        self.batches[query] = self.batches.get(query, 0) + (rows > 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.id)] = event.exception or ""


@contextmanager
def tagged(context: SparkContext, tag: str) -> Iterator[None]:
    """Jobs that this thread starts within can be ended by cancel(); not empty, no comma."""
    context.addJobTag(tag)
    try:
        yield
    finally:
        context.removeJobTag(tag)


def cancel(context: SparkContext, tag: str) -> None:
    """Ends all running jobs of a tag; their actions raise an error. Later ones aren't hit."""
    context.cancelJobsWithTag(tag)
