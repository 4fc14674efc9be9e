"""Ranked lexical search with a tiered index: exact top documents for each of many items.

The index holds shards of documents; within a shard postings stand by term. Its tiers are files: the first has each
term's postings of highest impact (up to a share of the documents), the second more, the last all. A tier's file holds the
tiers above it too, so that a search reads one file and joins none. The vocabulary has, for every term and tier, the
largest impact left out, its residual bound.

A search of a tier gives every document a bound: what its postings there score, and the residual bounds of the item's
other terms. The documents with the highest bounds are scored exactly on all their postings. If the item's last exact
score is above all bounds that remain, the result is proven; items lacking that proof fall through to the next tier,
and the last one leaves nothing out. Tiers are cut by counts of impacts in buckets, not by samples, so bounds hold.

Only terms that items have are indexed. Items go in blocks of ITEM_TERMS terms, of which the driver and each task hold one
at a time; every block is a pass over the documents. Tasks keep the best of each item over all their shards.

Defined cases: null and empty texts have no terms and never appear; items without terms, or whose terms no document has,
have no rows; rows of documents or items that share an id are ranked each by itself, null ids included (equal scores: null
first); repeated rows repeat; an empty table on either side gives no rows; texts of any length are counted in pieces;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TOP = 50
#: Documents scored exactly to prove an item, and the shares of all documents that tiers take of a term (at least LEAST).
COMPLETED, SHARES, LEAST = 150, (1 / 64, 1 / 8), 1000
#: Documents and postings of a shard, terms of a block of items, impact buckets, text bytes counted at once.
SHARD_DOCS, SHARD_POSTINGS, ITEM_TERMS, BUCKETS, PIECE = 4096, 1 << 20, 500_000, 64, 1 << 20
#: Candidates up to which they are broadcast to the shards (24 bytes each).
BROADCAST_ROWS = 200_000
_NULL = -(1 << 63)
#: Fixed values of the score.
IMPACT, TF, LENGTH = 1_000_000_000, 1000, 20
_TERM = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_SHARD = "shard long, n_docs long, n_words long, ids binary, size binary, terms binary, starts binary, docs binary, tf binary"
_TIER = "tier int, shard long, ids binary, terms binary, starts binary, docs binary, impact binary"


def counted(text: str | None) -> Counter[bytes]:
    """Terms and their occurrences; texts are cut between terms, so a long one isn't held as words."""
    low = (text or "").encode().translate(_TERM)
    if len(low) <= PIECE:
        return Counter(low.split())
    out: Counter[bytes] = Counter()
    at = 0
    while at < len(low):
        stop = low.find(b" ", at + PIECE)
        stop = len(low) if stop < 0 else stop
        out.update(low[at:stop].split())
        at = stop
    return out


def impacts(tf: np.ndarray, size: np.ndarray, n: int, words: int) -> np.ndarray:
    """Of postings with these counts in documents of these lengths, among n documents of so many words; below 10 ** 6."""
    return IMPACT * tf // (TF * tf + LENGTH * (50 + 50 * size * n // words))


def _array(value: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def shards(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Shards of the documents, with their postings of the terms of the vocabulary, sorted by term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def flush(number: int, n: int, words: int, rows: list[tuple]) -> pa.RecordBatch:
        count = np.array([len(r[2]) for r in rows], np.int64)
        term = np.concatenate([r[2] for r in rows]) if rows else np.zeros(0, np.int32)
        tf = np.concatenate([r[3] for r in rows]) if rows else np.zeros(0, np.int32)
        order = np.argsort(term, kind="stable")
        terms, starts = np.unique(term[order], return_index=True)
        arrays = [np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), terms, np.append(starts, len(term)).astype(np.int32), np.repeat(np.arange(len(rows), dtype=np.int32), count)[order], tf[order]]
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (number, n, words)] + [pa.array([a.tobytes()], pa.binary()) for a in arrays], ["shard", "n_docs", "n_words", "ids", "size", "terms", "starts", "docs", "tf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        number = TaskContext.get().partitionId() << 32
        n = words = postings = 0
        rows: list[tuple] = []
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                counts = counted(text.as_py())
                size = counts.total()
                n, words = n + (size > 0), words + size
                found = known.keys() & counts.keys()
                if found:
                    rows.append((_NULL if doc is None else doc, size, np.array([known[t] for t in found], np.int32), np.array([counts[t] for t in found], np.int32)))
                    postings += len(found)
                if len(rows) >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    yield flush(number, n, words, rows)
                    number, n, words, postings, rows = number + 1, 0, 0, 0, []
        if n:
            yield flush(number, n, words, rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SHARD)


@dataclass
class Index:
    """shards: all postings; tiers: those of high impact, by tier; by term id: df, residual bounds and weights."""

    shards: DataFrame
    tiers: DataFrame
    n_docs: int
    n_words: int
    df: np.ndarray
    residual: list[np.ndarray]

    def weights(self) -> np.ndarray:
        return np.array([math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * x + 1))) if x else 0 for x in self.df.tolist()], np.int64)


def build(docs: DataFrame, vocabulary: dict[bytes, int], shares: tuple[float, ...] = SHARES, least: int = LEAST) -> Index | None:
    """The tiered index of the vocabulary's terms over docs; None where no document has a term."""
    spark = docs.sparkSession
    base = common.written(shards(docs, vocabulary), "ranked-shards")
    total = base.agg(F.sum("n_docs").alias("n"), F.sum("n_words").alias("w")).first()
    if not total.n:
        return None
    n, words = total.n, total.w

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            key, count, most = (np.concatenate(x) for x in zip(*held))
            keys, where = np.unique(key, return_inverse=True)
            counts, tops = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            np.add.at(counts, where, count)
            np.maximum.at(tops, where, most)
            return keys, counts, tops

        def rows(part: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array((part[0] // BUCKETS).astype(np.int32)), pa.array((part[0] % BUCKETS).astype(np.int32)), pa.array(part[1]), pa.array(part[2])], ["term", "bucket", "n", "top"])

        for batch in batches:
            for k in range(batch.num_rows):
                terms, starts, _, _, impact = _postings(batch, k, n, words)
                key = np.repeat(terms.astype(np.int64), np.diff(starts)) * BUCKETS + impact * BUCKETS // 1_000_000
                held.append((key, np.ones(len(key), np.int64), impact))
                held = [merged()]
                if len(held[0][0]) > 1 << 21:
                    yield rows(held.pop())
        if held:
            yield rows(merged())

    counts = base.select("ids", "size", "terms", "starts", "docs", "tf").mapInArrow(histogram, "term int, bucket int, n long, top long")
    counts = counts.groupBy("term", "bucket").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
    running = counts.withColumn("_c", F.sum("n").over(Window.partitionBy("term").orderBy(F.col("bucket").desc())))
    most = [max(least, int(n * s)) for s in shares]
    cuts = [F.min(F.when(F.col("_c") <= m, F.col("bucket"))).alias(f"cut{j}") for j, m in enumerate(most)]
    bounds = [F.max(F.when(F.col("_c") > m, F.col("top"))).alias(f"bound{j}") for j, m in enumerate(most)]
    known = running.groupBy("term").agg(F.sum("n").alias("df"), *cuts, *bounds).toArrow()  # a row for each term of the items

    term = known.column("term").to_numpy()

    def dense(name: str, none: int) -> np.ndarray:
        out = np.full(len(vocabulary), none, np.int64)
        out[term] = known.column(name).fill_null(none).to_numpy()
        return out

    cut = spark.sparkContext.broadcast([dense(f"cut{j}", BUCKETS).astype(np.int8) for j in range(len(most))])

    def split(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for k in range(batch.num_rows):
            terms, starts, docs_, ids, impact = _postings(batch, k, n, words)
            of = np.repeat(np.arange(len(terms)), np.diff(starts))
            for tier, least_bucket in enumerate(cut.value):
                mine = np.flatnonzero(impact * BUCKETS // 1_000_000 >= least_bucket[terms][of])
                if len(mine):
                    there, begin = np.unique(of[mine], return_index=True)
                    arrays = [ids, terms[there], np.append(begin, len(mine)).astype(np.int32), docs_[mine], impact[mine].astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array([tier], pa.int32()), batch.column("shard").slice(k, 1), *[pa.array([a.tobytes()], pa.binary()) for a in arrays]], ["tier", "shard", "ids", "terms", "starts", "docs", "impact"])

    path = common.scratch_path(spark, "ranked-tiers")
    common.map_arrow(base, split, _TIER).write.partitionBy("tier").parquet(path)
    tiers = spark.read.schema(_TIER).parquet(path)
    return Index(base, tiers, n, words, dense("df", 0), [dense(f"bound{j}", 0) for j in range(len(most))])


def _postings(batch: pa.RecordBatch, k: int, n: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """terms, starts, docs, ids, impact of a row of shards or tiers."""
    column = lambda name, kind: _array(batch.column(name)[k], kind)
    terms, starts, docs, ids = column("terms", np.int32), column("starts", np.int32), column("docs", np.int32), column("ids", np.int64)
    if "impact" in batch.schema.names:
        return terms, starts, docs, ids, column("impact", np.int32).astype(np.int64)
    return terms, starts, docs, ids, impacts(column("tf", np.int32).astype(np.int64), column("size", np.int64)[docs], n, words)


class Asked:
    """A block of items as arrays: for each of an item's terms its owner, term id, weight and residual bound."""

    def __init__(self, owners: np.ndarray, terms: np.ndarray, weights: np.ndarray, residual: np.ndarray, n: int):
        self.owners, self.terms, self.weights, self.residual, self.n = owners, terms, weights[terms], residual[terms], n
        self.rest = np.zeros(n, np.int64)  # the bound of a document that has no posting here
        np.add.at(self.rest, owners, self.weights * self.residual)

    def scores(self, terms: np.ndarray, starts: np.ndarray, docs: np.ndarray, impact: np.ndarray, n_docs: int, only: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(item, what each document of a shard scores above the item's rest) for items that have a term there."""
        if not len(terms):
            return
        place = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1)
        fine = (terms[place] == self.terms) & (self.weights > 0)
        if only is not None:
            fine &= np.isin(self.owners, only)
        hits = np.flatnonzero(fine)
        if not len(hits):
            return
        edges = np.append(np.flatnonzero(np.diff(self.owners[hits], prepend=-1)), len(hits)).tolist()
        begin, end = starts[place[hits]].tolist(), starts[place[hits] + 1].tolist()
        weight, residual, owner = self.weights[hits].tolist(), self.residual[hits].tolist(), self.owners[hits].tolist()
        for a, b in zip(edges, edges[1:]):
            total = np.zeros(n_docs, np.int64)
            for k in range(a, b):
                part = slice(begin[k], end[k])
                total[docs[part]] += weight[k] * (impact[part] - residual[k])
            yield owner[a], total


def best_of(table: DataFrame, index: Index, asked: Asked, k: int) -> DataFrame:
    """item, score, doc_id, shard, doc: at most k of each item for each task, by score (above the item's rest), then doc_id."""
    spark = table.sparkSession
    shared, n, words = spark.sparkContext.broadcast(asked), index.n_docs, index.n_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                terms, starts, docs, ids, impact = _postings(batch, row, n, words)
                shard = batch.column("shard")[row].as_py()
                for item, total in asked.scores(terms, starts, docs, impact, len(ids)):
                    old = held.get(item)
                    full = old is not None and len(old[0]) == k
                    at = np.flatnonzero(total >= (max(1, int(old[0][-1])) if full else 1))
                    if not len(at):
                        continue
                    if len(at) > k:
                        score = total[at]
                        at = at[score >= np.partition(score, len(at) - k)[len(at) - k]]
                    new = [total[at], ids[at], np.full(len(at), shard), at]
                    if old is not None:
                        new = [np.concatenate(x) for x in zip(old, new)]
                    order = np.lexsort((new[1], -new[0]))[:k]
                    held[item] = [x[order] for x in new]
        if held:
            size = [len(x[0]) for x in held.values()]
            columns = [np.repeat(np.array(list(held), np.int64), size), *[np.concatenate([x[c] for x in held.values()]).astype(np.int64) for c in range(4)]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["item", "score", "doc_id", "shard", "doc"])

    few = table.coalesce(2 * spark.sparkContext.defaultParallelism)  # what tasks keep is k rows an item, however many shards they read
    return few.mapInArrow(run, "item long, score long, doc_id long, shard long, doc long")


def completed(candidates: DataFrame, index: Index, asked: Asked) -> DataFrame:
    """item, doc_id, shard, doc, score of candidates (item, shard, doc), on all their postings."""
    shared, n, words = candidates.sparkSession.sparkContext.broadcast(asked), index.n_docs, index.n_words
    wanted = candidates.groupBy("shard").agg(F.collect_list("item").alias("items"), F.collect_list("doc").alias("at"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in range(batch.num_rows):
            terms, starts, docs, ids, impact = _postings(batch, row, n, words)
            items, at = (np.array(batch.column(c)[row].as_py(), np.int64) for c in ("items", "at"))
            order = np.argsort(items, kind="stable")
            items, at = items[order], at[order]
            score = np.zeros(len(items), np.int64)
            for item, total in shared.value.scores(terms, starts, docs, impact, len(ids), np.unique(items)):
                a, b = np.searchsorted(items, [item, item + 1])
                score[a:b] = total[at[a:b]]
            yield pa.RecordBatch.from_arrays([pa.array(items), pa.array(ids[at]), pa.array(score)], ["item", "doc_id", "score"])

    small = F.broadcast(wanted) if candidates.count() <= BROADCAST_ROWS else wanted
    both = index.shards.drop("n_docs", "n_words").join(small, "shard")
    return common.map_arrow(both, run, "item long, doc_id long, score long")


def _ranked(df: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), *[F.col(c) for c in ("doc_id", "shard", "doc") if c in df.columns])
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, owners: np.ndarray, terms: np.ndarray, n: int, k: int = TOP, complete: int = COMPLETED) -> tuple[list[DataFrame], list[int]]:
    """Ranked rows (item, rank, doc_id, score) in parts, and how many items each tier proved. owners ascend, below n."""
    weights, parts, proved = index.weights(), [], []
    for tier, residual in enumerate(index.residual):
        if not len(owners):
            return parts, proved
        bound, exact = Asked(owners, terms, weights, residual, n), Asked(owners, terms, weights, np.zeros_like(residual), n)
        found = best_of(index.tiers.where(F.col("tier") == tier), index, bound, complete + 1)
        found = common.written(_ranked(found, complete + 1), "ranked-bounds")
        scored = common.written(_ranked(completed(found.where(F.col("rank") <= complete), index, exact).where("score > 0"), k), "ranked-scores")
        lasts = scored.where(F.col("rank") == k).select("item", F.col("score").alias("last"))
        others = found.where(F.col("rank") > complete).select("item", F.col("score").alias("other"))
        sides = lasts.join(others, "item", "full").toArrow()  # a row for each item at most
        last, other = np.zeros(n, np.int64), bound.rest.copy()
        item = sides.column("item").to_numpy()
        last[item] = sides.column("last").fill_null(0).to_numpy()
        other[item] += sides.column("other").fill_null(0).to_numpy()
        proven = (last > other) | (other == 0)  # every other document scores less, or nothing
        asked = np.unique(owners)
        proved.append(int(proven[asked].sum()))
        parts.append(_only(scored, asked[proven[asked]]))
        keep = ~proven[owners]
        owners, terms = owners[keep], terms[keep]
    if len(owners):
        exact = Asked(owners, terms, weights, np.zeros_like(weights), n)
        parts.append(_ranked(best_of(index.shards, index, exact, k), k))
        proved.append(len(np.unique(owners)))
    return parts, proved


def _only(df: DataFrame, items: np.ndarray) -> DataFrame:
    spark: SparkSession = df.sparkSession
    names = spark.createDataFrame(pa.table({"item": pa.array(items, pa.int64())}))
    return df.join(F.broadcast(names), "item", "left_semi")


def rank(docs: DataFrame, items: DataFrame, k: int = TOP, item_terms: int = ITEM_TERMS, **tiers: object) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring rows of docs (doc_id, text) for each row of items (item_id, text)."""
    spark = docs.sparkSession

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        terms = [list(counted(x.as_py())) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("_n"), batch.column("item_id"), pa.array(terms, pa.list_(pa.binary()))], ["_n", "item_id", "terms"])

    with common.scratch_but(spark, "ranked-results"):
        numbered = items.select(F.monotonically_increasing_id().alias("_n"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
        asked = common.written(common.map_arrow(numbered, cut, "_n long, item_id long, terms array<binary>"), "ranked-items")
        blocks = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // item_terms))
        out = []
        for b in range(blocks):
            block = asked.where(F.pmod(F.xxhash64("_n"), F.lit(blocks)) == b).toArrow().sort_by("_n")
            lists = block.column("terms").combine_chunks() if block.num_rows else pa.array([], pa.list_(pa.binary()))
            flat = lists.flatten().dictionary_encode()
            vocabulary = {t: i for i, t in enumerate(flat.dictionary.to_pylist())}
            index = build(docs, vocabulary, **tiers) if vocabulary else None
            if index is None:
                continue
            owners = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            parts, _ = search(index, owners, flat.indices.to_numpy().astype(np.int64), len(lists), k)
            names = spark.createDataFrame(pa.table({"item": pa.array(range(len(lists)), pa.int64()), "item_id": block.column("item_id")}))
            for part in parts:
                out.append(common.written(part.select("item", "rank", "doc_id", "score").join(F.broadcast(names), "item"), "ranked-results"))
        if not out:
            return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    return found.select("item_id", "rank", F.nullif("doc_id", F.lit(_NULL)).alias("doc_id"), "score")
