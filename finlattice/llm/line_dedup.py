"""Line dedup over levelled sorted runs of line hashes, in DataFrame operations only.

A run is a table of (h1, h2, n_docs, last_doc), bucketed and sorted by the 128-bit hash of the line key, so merges and
anti-joins of runs move nothing between executors. Every batch is counted by itself, in a partition of its own with the same
buckets. Each in turn is merge-anti-joined with the runs: keys that a run already settles (frequent, with a later document)
add nothing and go; the rest is the batch's own run on level 0. When a level has FANOUT runs they are compacted into one of
the next. What all batches know together is only ever in the runs. In the end lines go whose key is frequent and whose
document isn't the last that holds it.

Documents are read once for the hashes of all batches, once for the lines that go, and once to cut these out, by a join on
the id that sorts and can spill.

Defined cases: null or empty text is one empty line; each row counts as one document, so repeated rows count again, and
all rows with the largest doc_id keep their lines; a null doc_id never is the largest; an empty table gives no rows;
other columns pass through `apply`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_CHARS, MIN_DOCS, FANOUT = 40, 5, 2
#: Frequent keys up to this count are broadcast (24 bytes each); beyond it the join shuffles.
BROADCAST_KEYS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Spark's literals have no \f: it would be the letter f.
_STRIP = "trim(BOTH ' \\t\\n\\u000B\\u000C\\r' FROM l)"
_KEYED = f"transform(split(coalesce(text, ''), '\\n', -1), l -> {_STRIP})"
# lower() also changes other alphabets, so it serves only lines that are ASCII throughout.
_KEY = f"CASE WHEN octet_length(k) = char_length(k) THEN lower(k) ELSE translate(k, '{_UPPER}', '{_LOWER}') END"
_HASH = f"transform(filter({_KEYED}, k -> char_length(k) >= {{least}}), k -> named_struct('h1', xxhash64({_KEY}), 'h2', xxhash64('second', {_KEY})))"


def _hashes(least: int) -> Column:
    return F.expr(f"array_distinct({_HASH.format(least=least)})")


class LineRuns:
    """The levelled runs of one corpus, in the shared folder; close() when no more is to be read from them."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS):
        self.spark, self.fanout, self.min_chars, self.min_docs = spark, fanout, min_chars, min_docs
        self.buckets = common.partitions(spark)
        self.levels: list[list[DataFrame]] = []
        self._tables: list[str] = []
        self._paths: list[str] = []

    def lines(self, docs: DataFrame, batch: Column | None = None) -> DataFrame:
        batch = F.lit(0) if batch is None else batch
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), batch.alias("batch"), F.explode(_hashes(self.min_chars)).alias("h")).select("doc_id", "batch", "h.h1", "h.h2")

    def add(self, docs: DataFrame) -> None:
        """Add a batch of documents."""
        self.add_batches(docs, F.lit(0), 1)

    def add_batches(self, docs: DataFrame, batch: Column, n: int) -> None:
        """Add the batches 0 to n - 1 of docs, one after the other; the documents are read once for all."""
        counts = [F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc")]
        stats = self.lines(docs, batch.cast("int")).groupBy("batch", "h1", "h2").agg(*counts)
        stats = self._stored(stats.repartition(self.buckets, "h1", "h2"), "line-stats", "batch")  # counted first, then dealt as buckets are
        for k in range(n):
            self._add(stats.where(F.col("batch") == k).select("h1", "h2", "n_docs", "last_doc"))

    def _add(self, stats: DataFrame) -> None:
        for run in [r for level in self.levels for r in level]:
            old = run.where(F.col("n_docs") >= self.min_docs).select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("last_doc").alias("old"))
            settled = (F.col("h1") == F.col("o1")) & (F.col("h2") == F.col("o2")) & F.coalesce(F.col("old") >= F.col("last_doc"), F.col("last_doc").isNull())
            stats = stats.join(old.hint("merge"), settled, "left_anti")
        self._put(0, stats)

    def _stored(self, rows: DataFrame, name: str, part: str | None = None) -> DataFrame:
        """rows as a table in as many buckets as shuffles have partitions, sorted by the hash; with part, partitioned by it."""
        path = common.scratch_path(self.spark, name)
        label = path.rsplit("/", 1)[1].replace("-", "_")
        self._tables.append(label)
        self._paths.append(path)
        writer = rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path)
        (writer.partitionBy(part) if part else writer).saveAsTable(label)
        return self.spark.table(label)

    def _put(self, level: int, stats: DataFrame) -> None:
        run = self._stored(stats, f"line-run-{level}")
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._merge(full))

    def _merge(self, runs: list[DataFrame]) -> DataFrame:
        """The runs as one, two at a time: a full join of bucketed tables moves nothing. (Spark 4.1 ignores buckets under a union.)"""
        out = runs[0]
        for k, run in enumerate(runs[1:]):
            if k:
                out = self._stored(out, "line-merge")
            other = run.select("h1", "h2", F.col("n_docs").alias("n"), F.col("last_doc").alias("last")).hint("merge")
            zero = F.lit(0).cast("long")
            out = out.join(other, ["h1", "h2"], "full").select("h1", "h2", (F.coalesce("n_docs", zero) + F.coalesce("n", zero)).alias("n_docs"), F.greatest("last_doc", "last").alias("last_doc"))
        return out

    def frequent(self) -> DataFrame:
        runs = [r for level in self.levels for r in level]
        return self._merge(runs).where(F.col("n_docs") >= self.min_docs).select("h1", "h2", "last_doc")

    def close(self) -> None:
        for label in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {label}")
        common.sweep(self.spark, self._paths)
        self._tables, self._paths, self.levels = [], [], []

    def drops(self, docs: DataFrame) -> DataFrame:
        """doc_id and the hashes of the lines that these documents lose; a written table."""
        keys = common.written(self.frequent(), "line-keys")
        if keys.count() <= BROADCAST_KEYS:
            keys = F.broadcast(keys)
        lost = self.lines(docs).join(keys, ["h1", "h2"]).where(F.coalesce(F.col("doc_id") < F.col("last_doc"), F.col("last_doc").isNotNull()))
        return common.written(lost.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("lost")), "lost-lines")

    def apply(self, docs: DataFrame) -> DataFrame:
        """docs with the columns ALL and KEPT (arrays of lines) at the end."""
        lost = self.drops(docs).select(F.col("doc_id").alias(_LOST[0]), F.col("lost").alias(_LOST[1])).hint("shuffle_merge")
        both = docs.join(lost, docs["doc_id"].cast("long").eqNullSafe(F.col(_LOST[0])), "left")
        key = _KEY.replace("(k)", f"({_STRIP})").replace("translate(k,", f"translate({_STRIP},")
        gone = f"array_contains({_LOST[1]}, named_struct('h1', xxhash64({key}), 'h2', xxhash64('second', {key})))"
        lines = "split(coalesce(text, ''), '\\n', -1)"
        kept = f"CASE WHEN {_LOST[1]} IS NULL THEN {lines} ELSE filter({lines}, l -> NOT {gone}) END"
        return both.select(*[docs[f"`{c}`"] for c in docs.columns], F.expr(lines).alias(ALL), F.expr(kept).alias(KEPT))


#: Names that no table has: other columns can't clash with them.
ALL, KEPT = "line_dedup: all lines", "line_dedup: kept lines"
_LOST = ("line_dedup_lost_4f1d_id", "line_dedup_lost_4f1d_lines")
BATCHES = 4


def dedup_lines(docs: DataFrame, batch: Column | None = None, n: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """Add all documents in n batches (default: by a hash of the id) to fresh runs and apply these to all."""
    with common.scratch_but(docs.sparkSession, "lost-lines"):
        return _dedup_lines(docs, batch, n, fanout)


def _dedup_lines(docs: DataFrame, batch: Column | None, n: int, fanout: int) -> DataFrame:
    runs = LineRuns(docs.sparkSession, fanout)
    try:
        runs.add_batches(docs, F.pmod(F.xxhash64("doc_id", F.lit("batch")), F.lit(n)) if batch is None else batch, n)
        return runs.apply(docs)
    finally:
        runs.close()


def cleaned(applied: DataFrame) -> DataFrame:
    """The documents themselves: text without the lines that go, and n_chars to match; null text stays null."""
    text = F.when(F.col("text").isNotNull(), F.array_join(F.col(f"`{KEPT}`"), "\n"))
    out = applied.withColumn("text", text)
    if "n_chars" in applied.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(applied.schema["n_chars"].dataType))
    return out.drop(ALL, KEPT)


def digest(applied: DataFrame) -> DataFrame:
    """The columns of the query."""
    lines, kept = F.col(f"`{ALL}`"), F.col(f"`{KEPT}`")
    return applied.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(kept)).cast("long").alias("n_dropped"),
        F.sha2(F.array_join(kept, "\n"), 256).alias("kept_sha256"),
    )
