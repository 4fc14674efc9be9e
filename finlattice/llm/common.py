"""Helpers shared by the corpus operators: shared storage, Arrow text access, bounded groups."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch sent to a Python worker.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20
#: Shuffled bytes of a partition up to which it may become the hash table of a join.
HASH_JOIN_BYTES = 32 << 20


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches and hash joins, and make sure that the checkpoint folder is known.

    A shuffled join becomes a hash join only if every partition of its smaller side turns out to be small; others sort and
    can spill. The folder is the one the cluster names in spark.checkpoint.dir; only where that is unset (tests) one is made up.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", str(HASH_JOIN_BYTES))
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def shared_dir(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    import tempfile

    return tempfile.mkdtemp(prefix="finlattice-shared-")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, to be swept once no result depends on it."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    for scope in _SCOPES.get():
        scope.append(path)
    return path


_SCRATCH: list[str] = []
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch_but(spark: SparkSession, *kept: str):
    """Sweep at the end what was written inside, but for tables of the names given: all that the result reads."""
    mine: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), mine))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        sweep(spark, [p for p in mine if p in _SCRATCH and p.rsplit("/", 1)[1].rsplit("-", 1)[0] not in kept])


def scratch() -> list[str]:
    """The paths given out so far and not yet swept."""
    return list(_SCRATCH)


def sweep(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that no result still to be read depends on."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        if path in _SCRATCH:
            _SCRATCH.remove(path)


#: Ids up to this count are broadcast; beyond it they shuffle with the documents.
BROADCAST_IDS = 200_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is among ids (one column, doc_id); rows that share an id share its fate."""
    name = free_name("_gone", docs)
    gone = written(ids.select(F.col("doc_id").cast("long").alias(name)).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col(name)), "left_anti")


def free_name(name: str, df: DataFrame) -> str:
    """name, with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = column.cast(pa.large_binary())
    if binary.null_count:
        binary = pc.fill_null(binary, b"")
    _, offsets, data = binary.buffers()
    spans = np.frombuffer(offsets, np.int64, len(binary) + 1, binary.offset * 8) if len(binary) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[spans[0] : spans[-1]], spans - spans[0]


def pieces(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `most` bytes; one document is never cut."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        stop = min(n, max(stop, start + 1))
        yield start, stop
        start = stop


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)

    return df.mapInArrow(run, schema)


def bounded_groups(df: DataFrame, key: str, most: int, seed_col: str, bytes_of: tuple[str, int] | None = None) -> DataFrame:
    """Split the groups of `key` so that every pair of rows of a group meets in some part of at most about 2 * most rows.

    A group of n rows gets b = ceil(n / most) blocks; part (i, j) holds blocks i and j, so a row is copied b times.
    bytes_of: a column of sizes and how much of it counts like `most` rows. Groups of up to 2 * most rows stay whole. Adds the columns part_i, part_j and block (the row's own); rows alone in their group go.
    """
    weight = F.count(F.lit(1)) / most
    if bytes_of:
        weight = F.greatest(weight, F.sum(bytes_of[0]) / bytes_of[1])
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), weight.alias("_w")).where("_n > 1")
    blocks = F.when(F.col("_w") <= 2, F.lit(1)).otherwise(F.ceil("_w")).cast("int")
    out = df.join(sizes, key).withColumn("_b", blocks)
    mine = F.pmod(F.xxhash64(F.col(seed_col), F.lit("block")), F.col("_b")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("_b") - 1), lambda o: F.struct(F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j")))
    whole = out.where("_b = 1").withColumns({"part_i": F.lit(0), "part_j": F.lit(0), "block": F.lit(0)})
    cut = out.where("_b > 1").withColumn("_p", F.explode(pair)).withColumns({"part_i": F.col("_p.i"), "part_j": F.col("_p.j"), "block": mine}).drop("_p")
    return whole.unionByName(cut).drop("_n", "_w", "_b")


def map_runs(df: DataFrame, keys: list[str], function: Callable, schema: str, n: int | None = None) -> DataFrame:
    """Apply function(table) to the rows of each key, many small groups to a Python call.

    Rows are dealt by the hash of the keys and sorted; a group that straddles two Arrow batches is put together again.
    The function gets a pyarrow table and an array of run starts (with the end), and yields record batches.
    """
    n = n or partitions(df.sparkSession)

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            starts = run_starts(table, keys)
            last = int(starts[-2])
            held = table.slice(last)
            if last:
                yield from function(table.slice(0, last), starts[:-1])
        if held is not None and held.num_rows:
            yield from function(held, run_starts(held, keys))

    return df.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def run_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    n = table.num_rows
    new = np.zeros(n, bool)
    new[0] = True
    for key in keys:
        values = table.column(key).combine_chunks().to_numpy(zero_copy_only=False)
        new[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(new), n)


def forest(n: int) -> tuple[np.ndarray, Callable[[int], int]]:
    """A union-find over n nodes with path halving."""
    parent = np.arange(n)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return int(x)

    return parent, find


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ceil_div(a: int, b: int) -> int:
    return math.ceil(a / b) if a else 0
