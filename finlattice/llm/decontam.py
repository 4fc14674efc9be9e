"""Benchmark decontamination by Wu-Manber search over words.

The alphabet is the words of the benchmark, so a word that no benchmark text has lets the search jump a whole window.
Per window length there is a shift table over hashed blocks of two words; where it says zero, the bucket of the block
that ends the window (with the block that begins it) selects the test strings, and a comparison of all words confirms.

A benchmark beyond BLOCK_BYTES is cut into blocks, each with a matcher; all are broadcast (as files; a worker holds at most
RESIDENT in memory), and a single pass over the documents searches a range of texts for every block in turn.

Defined cases: a null text has no words; a null or wordless benchmark text, or one without item_id, never occurs; items
that share an id count once; repeated rows of documents give repeated rows, each judged by itself, null ids included; an
empty benchmark leaves every document clean; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 13
#: Benchmark bytes of one matcher, and how many matchers a worker keeps loaded.
BLOCK_BYTES, RESIDENT = 4 << 20, 4
#: Text bytes searched at once.
_LANE, _TABLE_BITS, _BATCH = 128, 20, 4 << 20
_WORD = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


class WuManber:
    """Finds windows of word ids; patterns of one length share a shift table and sorted buckets."""

    def __init__(self, items: list[tuple[int, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        ids = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)] for _, text in items]
        size = np.array([len(x) for x in ids], np.int64)
        self.text = np.array([w for x in ids for w in x], np.int32)  # a window is kept as the place where it begins here
        first = np.cumsum(size) - size
        length = np.minimum(size, window)
        self.groups = []
        for m in np.unique(length[length > 0]).tolist():
            mine = np.flatnonzero(length == m)
            count = size[mine] - m + 1
            at = np.repeat(first[mine] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            self.groups.append(self._tables(m, at, np.repeat(np.array([items[k][0] for k in mine.tolist()], np.int64), count)))

    @staticmethod
    def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        mixed = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        return (common.mix64(mixed) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def _tables(self, m: int, at: np.ndarray, owners: np.ndarray) -> dict:
        block = min(2, m)
        shift = np.full(1 << _TABLE_BITS, m - block + 1, np.int16)
        for end in range(block - 1, m):  # a slot shared by several blocks keeps the smallest shift
            np.minimum.at(shift, self._slot(self.text[at + end - block + 1], self.text[at + end]), np.int16(m - 1 - end))
        which = np.zeros(len(at), np.int64)  # equal windows get one number, a word at a time
        for j in range(m):
            which = np.unique(which << 32 | self.text[at + j], return_inverse=True)[1].reshape(-1)
        patterns = np.zeros(int(which.max()) + 1, np.int64)
        patterns[which] = at
        key = self._bucket(self.text, patterns + m - 1, m, block)
        order = np.argsort(key, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        pairs = np.unique(np.stack([rank[which], owners], 1), axis=0)
        return {"m": m, "block": block, "shift": shift, "patterns": patterns[order], "keys": key[order], "first": np.searchsorted(pairs[:, 0], np.arange(len(order) + 1)), "owners": pairs[:, 1]}

    def _bucket(self, ids: np.ndarray, ends: np.ndarray, m: int, block: int) -> np.ndarray:
        """The bucket of the windows of m words that end at the given places: their last block and their first."""
        return self._slot(ids[ends - block + 1], ids[ends]) << _TABLE_BITS | self._slot(ids[ends - m + 1], ids[ends - m + block])

    def search(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences in documents given as word ids: start word, end word (both in ids), and (occurrence, item) pairs."""
        starts, ends, hits = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
        n = 0
        for g in self.groups:
            at = self._zero_shifts(g, ids, offsets)
            key = self._bucket(ids, at, g["m"], g["block"])
            low, high = np.searchsorted(g["keys"], key, "left"), np.searchsorted(g["keys"], key, "right")
            count = high - low
            where = np.repeat(np.arange(len(at)), count)
            pattern = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            for j in range(g["m"]):  # all words must agree
                same = ids[at[where] - g["m"] + 1 + j] == self.text[g["patterns"][pattern] + j]
                where, pattern = where[same], pattern[same]
            begin, end = g["first"][pattern], g["first"][pattern + 1]
            owners = np.repeat(np.arange(len(where)), end - begin)
            item = g["owners"][np.repeat(begin, end - begin) + np.arange(len(owners)) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin)]
            starts.append(at[where] - g["m"] + 1)
            ends.append(at[where] + 1)
            hits.append(np.stack([owners + n, item], 1))
            n += len(where)
        return np.concatenate(starts), np.concatenate(ends), np.concatenate(hits)

    def _zero_shifts(self, g: dict, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """End positions that the shift table doesn't rule out; lanes of words advance together, each by its own shift."""
        m = g["m"]
        size = offsets[1:] - offsets[:-1]
        lanes = np.where(size >= m, -(-(size - m + 1) // _LANE), 0)
        doc = np.repeat(np.arange(len(size)), lanes)
        at = offsets[:-1][doc] + m - 1 + _LANE * (np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        stop = np.minimum(at + _LANE, offsets[1:][doc])
        found = [np.zeros(0, np.int64)]
        while len(at):
            jump = g["shift"][self._slot(ids[at - g["block"] + 1], ids[at])]
            found.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        return np.sort(np.concatenate(found))


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


_FOUND = "n_words long, spans array<struct<start:long,end:long>>, items array<long>"


def _occurrences(matchers: list, column: pa.Array):
    """Ranges of the texts, each with n_words, the merged spans and the items of its texts. matchers: broadcast, one for each block."""
    data, offsets = common.utf8(column)
    raw = data.tobytes()
    for lo, hi in common.pieces(offsets, _BATCH):
        words = [raw[offsets[k] : offsets[k + 1]].translate(_WORD).split() for k in range(lo, hi)]
        at = np.cumsum([0] + [len(w) for w in words])
        spans: list = [[] for _ in words]
        items: list = [[] for _ in words]
        for n, shared in enumerate(matchers):
            get = shared.value.vocabulary.get
            starts, ends, hits = shared.value.search(np.array([get(w, 0) for mine in words for w in mine], np.int64), at)
            if n >= RESIDENT:
                shared.__dict__.pop("_value", None)  # loaded from its file again for the next range
            doc = np.searchsorted(at, starts, "right") - 1
            by, owner = np.argsort(doc, kind="stable"), doc[hits[:, 0]]
            of = np.argsort(owner, kind="stable")
            for d in np.unique(doc).tolist():
                mine = by[slice(*np.searchsorted(doc[by], [d, d + 1]))]
                spans[d] += zip((starts[mine] - at[d]).tolist(), (ends[mine] - at[d]).tolist())
                items[d] += hits[of[slice(*np.searchsorted(owner[of], [d, d + 1]))], 1].tolist()
        yield lo, hi, np.diff(at), [_merge(s) for s in spans], [sorted(set(x)) for x in items]


def _matchers(benchmark: DataFrame, window: int, block_bytes: int) -> list:
    """Broadcast matchers, built one after the other. The benchmark's size is checked first; beyond block_bytes its items are dealt into blocks of about that size."""
    spark = benchmark.sparkSession
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("text is not null and item_id is not null")
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, common.ceil_div(size, block_bytes))
    out = []
    for b in range(blocks):
        mine = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        items = [(r[0], r[1].encode("utf-8", "surrogatepass")) for r in mine.collect()]
        out.append(spark.sparkContext.broadcast(WuManber(items, window)))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, merged word spans that benchmark windows cover, and the items that occur: one row for each row of docs."""
    matchers = _matchers(benchmark, window, block_bytes)
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def one(batch: pa.RecordBatch):
        for lo, hi, n_words, spans, items in _occurrences(matchers, batch.column("text")):
            found = [[{"start": a, "end": b} for a, b in s] for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(n_words, pa.int64()), pa.array(found, spans_type), pa.array(items, pa.list_(pa.int64()))], ["doc_id", "n_words", "spans", "items"])

    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), one, f"doc_id long, {_FOUND}")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns; each row has its own verdict, whatever its doc_id."""
    matchers, at = _matchers(benchmark, window, block_bytes), docs.columns.index("text")

    def one(batch: pa.RecordBatch):
        for lo, hi, n_words, spans, _ in _occurrences(matchers, batch.column(at)):
            hit = np.array([sum(b - a for a, b in s) for s in spans])
            yield batch.slice(lo, hi - lo).filter(pa.array((hit == 0) | (20 * hit < n_words)))

    return common.map_arrow(docs, one, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query: counts, the digest of the items and the verdict (n_hit > 0 and 20 * n_hit >= n_words)."""
    hit = F.expr("aggregate(spans, 0L, (a, x) -> a + x.end - x.start)")
    names = F.expr("array_join(array_sort(transform(items, x -> cast(x as string))), ',')")
    out = found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
