"""Ingest as a stream: files that arrive in a folder become documents, and each micro-batch an ingest that can be replayed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine


def text_files(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """A stream of doc_id (the path) and text of whole files whose names match."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def binary_files(spark: SparkSession, path: str, parse: Callable[[DataFrame], DataFrame], pattern: str = "*.pdf") -> DataFrame:
    """A stream of documents that `parse` makes of files (path, content)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return parse(spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(path).select("path", "content"))


def into(engine: Engine, documents: DataFrame, checkpoint: str, name: str = "files", now: bool = True) -> StreamingQuery:
    """Start to ingest a stream of documents (doc_id, text); with `now` it ends once what is there has been taken.

    A batch is ingested under its number. Where it comes again after a failure, parts that were done stay as they are. A
    part that fails ends the query, so that its batch comes again.
    """

    def take(batch: DataFrame, number: int) -> None:
        status = engine.ingest(batch, f"{name}-{number}")
        failed = {k: v for k, v in status.items() if v != "ok"}
        if failed:
            raise RuntimeError(f"batch {number}: {failed}")

    out = documents.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if now else out).start()
