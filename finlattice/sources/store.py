"""Stores of points (a compacted base and deltas), graphs and feedback, as Parquet folders by collection."""

from __future__ import annotations

import uuid
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.retrieval import upsert_latest
from ..session import cut


#: Documents of a span in which places are counted by one window, and ids up to which they are broadcast.
SPAN, BROADCAST_IDS = 10_000, 200_000


class PointStore:
    """Points of collections, replaced by id: a compacted base, and the ingests since as deltas.

    An ingest writes a folder of its own, named by its number. A scan reads the base and the deltas after it; ids of deltas
    are taken out of the base by an anti-join (broadcast up to BROADCAST_IDS ids), so the base isn't shuffled for a few new
    points, and without deltas a scan is a plain read. `compact` writes what a scan gives as the next base and then moves the
    pointer to it, so a reader sees one or the other; files that the pointer no longer names go with the next compaction.
    A batch of a stream has a number of its own that it keeps when it is replayed: a finished one changes nothing.
    """

    SCHEMA = "point_id bigint, text string, dense array<float>, ticker string"

    def __init__(self, spark: SparkSession, path: str, dim: int):
        self.spark, self.path, self.dim = spark, path.rstrip("/"), dim
        self.files = Files(spark)

    def _at(self, kind: str, collection: str) -> str:
        return f"{self.path}/{kind}/collection={quote(collection, safe='')}"

    def _pointer(self, collection: str) -> tuple[int, int]:
        """(version of the base, last ingest in it), -1 where there is none."""
        told = self.files.read(f"{self._at('current', collection)}/pointer")
        return tuple(map(int, told.split())) if told else (-1, -1)

    def _deltas(self, collection: str) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self.files.names(self._at("delta", collection)) if n.startswith("seq="))

    def collections(self) -> list[str]:
        found = {n for kind in ("delta", "current") for n in self.files.names(f"{self.path}/{kind}")}
        return sorted(unquote(n.split("=", 1)[1]) for n in found if n.startswith("collection="))

    def ingest(self, collection: str, points: DataFrame, batch: str | None = None) -> int | None:
        """Add an ingest; its points replace those of earlier ones with their ids. Vectors must have the right length.

        batch: a name under which this ingest may come again; None is returned for one that is done.
        """
        marker = f"{self._at('batches', collection)}/{quote(batch, safe='')}" if batch else None
        told = self.files.read(marker) if marker else None
        if told and told.endswith("done"):
            return None
        seq = int(told) if told else max([self._pointer(collection)[1], *self._deltas(collection), *self._claimed(collection)]) + 1
        if marker:
            self.files.write(marker, str(seq))
        sized = points.withColumn("dense", F.when(F.size("dense") == self.dim, F.col("dense")).otherwise(F.raise_error(F.lit(f"vectors must have {self.dim} values"))))
        ticker = F.col("ticker") if "ticker" in points.columns else F.lit(None)
        rows = sized.select(F.col("point_id").cast("long").alias("point_id"), F.col("text").cast("string").alias("text"), F.col("dense").cast("array<float>").alias("dense"), ticker.cast("string").alias("ticker"))
        rows.write.mode("overwrite").parquet(f"{self._at('delta', collection)}/seq={seq}")
        if marker:
            self.files.write(marker, f"{seq} done")
        return seq

    def _claimed(self, collection: str) -> list[int]:
        """Numbers that batches have taken, written or not."""
        folder = self._at("batches", collection)
        return [int((self.files.read(f"{folder}/{n}") or "-1").split()[0]) for n in self.files.names(folder)]

    def _base(self, collection: str, version: int) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self._at('base', collection)}/version={version}")

    def scan(self, collection: str | None = None) -> DataFrame:
        """point_id, text, dense, ticker, collection: the latest of each id, of one collection or of all."""
        if collection is None:
            out = self.spark.createDataFrame([], f"{self.SCHEMA}, collection string")
            for name in self.collections():
                out = out.unionByName(self.scan(name))
            return out
        version, last = self._pointer(collection)
        rows = self._base(collection, version) if version >= 0 else None
        pending = [n for n in self._deltas(collection) if n > last]
        if pending:
            folder = self._at("delta", collection)
            delta = self.spark.read.option("basePath", folder).schema(f"{self.SCHEMA}, seq int").parquet(*[f"{folder}/seq={n}" for n in pending])
            newest = upsert_latest(delta.withColumnRenamed("seq", "ingest_seq").withColumn("collection", F.lit(collection))).drop("ingest_seq", "collection")
            if rows is not None:
                ids = delta.select("point_id").distinct()
                few = delta.count() <= BROADCAST_IDS
                newest = rows.join(F.broadcast(ids) if few else ids, "point_id", "left_anti").unionByName(newest)
            rows = newest
        if rows is None:
            rows = self.spark.createDataFrame([], self.SCHEMA)
        return rows.withColumn("collection", F.lit(collection))

    def compact(self, collection: str) -> None:
        """Make the next base from the base and the deltas so far, and then drop what the former base had replaced."""
        version, last = self._pointer(collection)
        pending = [n for n in self._deltas(collection) if n > last]
        if not pending:
            return
        rows = self.scan(collection).drop("collection")
        rows.repartitionByRange("point_id").sortWithinPartitions("point_id").write.mode("overwrite").parquet(f"{self._at('base', collection)}/version={version + 1}")
        self.files.write(f"{self._at('current', collection)}/pointer", f"{version + 1} {pending[-1]}")
        self.files.delete(f"{self._at('base', collection)}/version={version - 1}")
        for n in self._deltas(collection):
            if n <= last:
                self.files.delete(f"{self._at('delta', collection)}/seq={n}")


class Files:
    """Small files and folders of the file system that Spark uses."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _of(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        target, system = self._of(folder)
        return sorted(s.getPath().getName() for s in system.listStatus(target) if not s.getPath().getName().startswith((".", "_"))) if system.exists(target) else []

    def read(self, path: str) -> str | None:
        target, system = self._of(path)
        if not system.exists(target):
            return None
        stream = system.open(target)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Put a whole file in place of the one there: it is written beside it and then renamed."""
        target, system = self._of(path)
        beside, _ = self._of(f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
        stream = system.create(beside)
        stream.write(bytearray(text.encode()))
        stream.close()
        system.delete(target, False)
        if not system.rename(beside, target):
            raise OSError(f"can't write {path}")

    def delete(self, path: str) -> None:
        target, system = self._of(path)
        system.delete(target, True)


class GraphStore:
    """Nodes, edges and mentions as Parquet tables by collection; ingests append, and repeats merge when read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    TABLES = {"nodes": "id string, type string", "edges": "src string, src_type string, dst string, dst_type string, type string", "mentions": "doc_id string, node_id string"}

    def ingest(self, collection: str, nodes: DataFrame, edges: DataFrame, mentions: DataFrame) -> None:
        for name, rows in (("nodes", nodes), ("edges", edges), ("mentions", mentions)):
            cols = [F.col(c.split()[0]).cast("string") for c in self.TABLES[name].split(", ")]
            rows.select(*cols, F.lit(collection).alias("collection")).write.mode("append").partitionBy("collection").parquet(f"{self.path}/{name}")

    def read(self, name: str, collection: str) -> DataFrame:
        """nodes, edges or mentions of a collection without repeats; empty before the first ingest."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target):
            return self.spark.createDataFrame([], self.TABLES[name])
        rows = self.spark.read.schema(f"{self.TABLES[name]}, collection string").parquet(f"{self.path}/{name}")
        return rows.where(F.col("collection") == collection).drop("collection").dropDuplicates()


class FeedbackLog:
    """An append-only table of what users said of routed questions; readable as a stream for adaptive thresholds."""

    SCHEMA = "question_id bigint, intent string, confidence double, was_helpful boolean, correct_strategy string, ts timestamp"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, feedback: DataFrame) -> None:
        """feedback: question_id, intent, confidence, was_helpful, and correct_strategy and ts where known."""
        extra = {"correct_strategy": F.lit(None).cast("string"), "ts": F.current_timestamp()}
        rows = feedback.withColumns({c: v for c, v in extra.items() if c not in feedback.columns})
        rows.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in self.SCHEMA.split(", ")]).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.SCHEMA).parquet(self.path)


def positions(chunks: DataFrame) -> DataFrame:
    """chunks with point_id: their place in the ingest, in the order of doc_id and chunk_pos, whatever type the ids have.

    Documents are sorted by ranges of about SPAN each, counted within them, and then over the ranges.
    """
    spark = chunks.sparkSession
    sizes = cut(chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")))
    ranges = max(1, -(-sizes.count() // SPAN))
    ordered = cut(sizes.repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id").withColumn("_k", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("_s", F.shiftright("_k", 33))
    totals = ordered.groupBy("_s").agg(F.sum("_n").alias("_m")).orderBy("_s").collect()  # a row for each range
    starts, before = [], 0
    for row in totals:
        starts.append((row._s, before))
        before += row._m
    earlier = F.broadcast(spark.createDataFrame(starts, "_s long, _e long"))
    within = Window.partitionBy("_s").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    shift = ordered.join(earlier, "_s").select("doc_id", (F.col("_e") + F.coalesce(F.sum("_n").over(within), F.lit(0))).alias("_b"))
    return chunks.join(shift, "doc_id").withColumn("point_id", F.col("_b") + F.col("chunk_pos")).drop("_b")
