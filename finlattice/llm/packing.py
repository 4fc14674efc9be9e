"""Packing of tokenised documents into sequences as a cutting-stock problem, solved by column generation.

A document's ids (with the end id) are cut at every LENGTH ids; the pieces form a histogram over length classes WIDTH
wide. A linear program over patterns (how many pieces of each class share a sequence) is solved on the driver: knapsack
dynamic programming prices new columns until none improves. The solution is rounded down, what is left is filled first-fit
decreasing, and the pieces, ranked within their class, are dealt to the slots of the patterns on the executors. The driver
only sees the histogram, of at most LENGTH / WIDTH classes, and at most SHARES counts more for the ranks within them.

Defined cases: null or empty text has the end id alone; repeated rows are packed each; an empty table gives no rows;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

LENGTH, WIDTH, END_ID = 2048, 8, 1
#: A task ranks this many pieces of a class, or this share of all pieces if that is more: the driver's counts stay few.
RANKED, SHARES = 2000, 20_000
#: Bytes of words and ids that a worker keeps, with what Python adds to each; words from LONG bytes on go to the tokenizer each time.
CACHE_BYTES, ENTRY_BYTES, LONG = 80 << 20, 200, 64
_PRUNE = 1e-9
_LATIN = re.compile("[a-zß-öø-ÿ]+")
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_LETTER = np.array([97 <= c <= 122 for c in range(256)])
_MARK = np.array([c < 128 and not 97 <= c <= 122 and not (c == 32 or 9 <= c <= 13) for c in range(256)])


class Words:
    """Ids of texts by a table of their distinct words.

    White space ends tokens in this tokenizer and words don't affect each other, so a text's ids are those of its words.
    Words of Latin letters are one pre-token that no normaliser changes once lower-cased; they are merged many at a time.
    All others, and texts with "<|" in them as a whole, are left to the tokenizer; neither these nor long words are kept.
    Ids are kept as little-endian bytes. The table is emptied between batches once it holds `most` bytes.
    """

    def __init__(self, path: str, most: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.held = Tokenizer.from_file(path), most, 0
        model = json.loads(self.tokenizer.to_str())["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level vocabularies: these bytes are themselves, others follow from 256 on
        chars = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.inner = np.array([vocab[chars[b]] for b in range(256)], np.uint64)
        self.last = np.array([vocab[chars[b] + end] for b in range(256)], np.uint64)
        pairs = np.array([vocab[x] << 32 | vocab[y] for x, y in model["merges"]], np.uint64)
        made = np.array([vocab[x + y] for x, y in model["merges"]], np.uint64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.rank, self.made = pairs[order], order.astype(np.int64), made[order]
        self.table: dict[bytes, bytes] = {}

    def _ranks(self, ids: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs that begin at these places the merge and its rank; len(rank) where there is none."""
        after = np.minimum(at + 1, len(ids) - 1)
        key = ids[at] << np.uint64(32) | ids[after]
        slot = np.minimum(np.searchsorted(self.pairs, key), len(self.rank) - 1)
        hit = (self.pairs[slot] == key) & (word[at] == word[after]) & (after > at)
        return slot, np.where(hit, self.rank[slot], len(self.rank))

    def merged(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that are one pre-token each: all words take their best merge at once, round after round.

        Only pairs next to a merge are looked up again.
        """
        size = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        ids = self.inner[data]
        ends = np.cumsum(size) - 1
        ids[ends] = self.last[data[ends]]
        word = np.repeat(np.arange(len(words)), size)
        done_ids, done_word = [], []
        none = len(self.rank)
        slot, rank = self._ranks(ids, word, np.arange(len(ids)))
        while len(ids):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(ids))))
            over = best == none
            done_ids.append(ids[over])
            done_word.append(word[over])
            pick = (rank == best) & ~over
            before = np.append(False, pick[:-1])
            if (pick & before).any():  # a run of one symbol: every other pair, from the left
                start = np.flatnonzero(pick & ~before)
                place = np.flatnonzero(pick)
                pick[place[(place - start[np.searchsorted(start, place, "right") - 1]) % 2 == 1]] = False
            chosen = np.flatnonzero(pick)
            ids[chosen] = self.made[slot[chosen]]
            keep = ~over
            keep[chosen + 1] = False
            moved = np.cumsum(keep) - 1
            ids, word, slot, rank = ids[keep], word[keep], slot[keep], rank[keep]
            new = moved[chosen]
            look = np.concatenate([new, new[new > 0] - 1])
            slot[look], rank[look] = self._ranks(ids, word, look)
        word = np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        raw = np.concatenate(done_ids)[order].astype("<u4").tobytes()
        at = np.searchsorted(word[order], np.arange(len(words) + 1)) * 4
        return [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]

    def _learn(self, words: list[bytes]) -> None:
        low = b"\n".join(words).decode("utf-8", "replace").lower().split("\n")
        fast = [k for k, w in enumerate(low) if _LATIN.fullmatch(w)]
        got = dict(zip([words[k] for k in fast], self.merged([low[k].encode() for k in fast]))) if fast else {}
        slow = [w for w in words if w not in got]
        got.update(zip(slow, self._encoded(slow)))
        self.held += sum(len(w) + len(i) + ENTRY_BYTES for w, i in got.items())
        self.table.update(got)

    def _encoded(self, texts: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids of documents laid end to end."""
        if self.held > self.most:
            self.table, self.held = {}, 0
        low = _LOWER[data]
        # a space before a mark that follows an ASCII letter changes no id, as tokens end there anyway
        cut = np.flatnonzero(_MARK[low[1:]] & _LETTER[low[:-1]]) + 1
        spaced = np.insert(low, cut, 32).tobytes()
        at = (offsets + np.searchsorted(cut, offsets)).tolist()
        split = [spaced[a:b].split() for a, b in zip(at[:-1], at[1:])]
        raw = data.tobytes()
        whole: dict[int, bytes] = {}
        if b"<|" in raw:
            for k in range(len(split)):
                if b"<|" in (text := raw[offsets[k] : offsets[k + 1]]):
                    whole[k], split[k] = text, []
        new = set().union(*split) - self.table.keys()
        long = sorted(w for w in new if len(w) >= LONG)
        if len(new) > len(long):
            self._learn(sorted(new.difference(long)))
        get = self.table.__getitem__
        if long:
            self.table.update(zip(long, self._encoded(long)))
        out = [b"".join(map(get, words)) for words in split]
        for w in long:
            del self.table[w]
        for k, got in zip(whole, self._encoded(list(whole.values()))):
            out[k] = got
        return out


@lru_cache(1)
def _words(path: str) -> Words:
    return Words(path)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """The pieces of all documents. path None: each executor asks the tokenizer package for its own copy."""

    def one(batch: pa.RecordBatch):
        words = _words(path or tokenizer_path())
        ids = batch.column("doc_id").to_pylist()
        data, offsets = common.utf8(batch.column("text"))
        for lo, hi in common.pieces(offsets, 1 << 20):
            rows = []
            for k, got in zip(range(lo, hi), words.ids(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])):
                full = got + END_ID.to_bytes(4, "little")
                n = len(full) // 4
                rows += [(ids[k], s, min(length, n - s), zlib.crc32(full[4 * s : 4 * (s + length)]), n) for s in range(0, n, length)]
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), one, _PIECES)


def price(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the best pattern for the values, by dynamic programming over the room left."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    by_size = np.full(room + 1, -1.0)
    owner = np.full(room + 1, -1)
    for k, s in enumerate(sizes):
        if values[k] > by_size[s]:
            by_size[s], owner[s] = values[k], k
    for w in range(1, room + 1):
        got = by_size[1 : w + 1] + best[w - 1 :: -1]
        j = int(got.argmax())
        if got[j] > best[w - 1] + _PRUNE and by_size[j + 1] > 0:
            best[w], pick[w] = got[j], j + 1
        else:
            best[w] = best[w - 1]
    pattern = np.zeros(len(sizes), np.int64)
    w = room
    while w > 0:
        if pick[w] < 0:
            w -= 1
        else:
            pattern[owner[pick[w]]] += 1
            w -= pick[w]
    return float(best[room]), pattern


def _invert(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots; small matrices, and no threads of a linear algebra library that vie with the executors."""
    n = len(matrix)
    both = np.hstack([matrix.astype(float), np.eye(n)])
    for k in range(n):
        p = k + int(np.abs(both[k:, k]).argmax())
        both[[k, p]] = both[[p, k]]
        both[k] /= both[k, k]
        column = both[:, k].copy()
        column[k] = 0
        rows = np.flatnonzero(column)
        both[rows] -= np.outer(column[rows], both[k])
    return both[:, n:]


def solve(sizes: np.ndarray, demand: np.ndarray, room: int, most: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used, covering the demand of every class exactly or with slots to spare."""
    n = len(sizes)
    if not n:
        return np.zeros((0, 0), np.int64), np.zeros(0, np.int64)
    basis = np.diag(room // sizes).astype(np.int64)  # column k: pattern k
    inverse = np.diag(1.0 / np.diag(basis))
    x = np.einsum("ij,j->i", inverse, demand)
    for step in range(most):
        if step % 50 == 49:
            inverse = _invert(basis)
            x = np.maximum(np.einsum("ij,j->i", inverse, demand), 0)
        value, pattern = price(inverse.sum(axis=0), sizes, room)
        if value <= 1 + 1e-7:
            break
        way = np.einsum("ij,j->i", inverse, pattern)
        up = way > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, way, 1), np.inf)
        out = int(ratio.argmin())
        t = max(ratio[out], 0.0)
        x = np.maximum(x - t * way, 0)
        x[out] = t
        basis[:, out] = pattern
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row
    whole = np.floor(x + 1e-6).astype(np.int64)
    left = np.maximum(demand - basis @ whole, 0)
    patterns, used = [basis[:, k] for k in range(n) if whole[k]], [int(whole[k]) for k in range(n) if whole[k]]
    for p in first_fit(sizes, left, room):
        patterns.append(p)
        used.append(1)
    return np.array(patterns, np.int64).reshape(-1, n), np.array(used, np.int64)


def first_fit(sizes: np.ndarray, counts: np.ndarray, room: int) -> list[np.ndarray]:
    """What rounding leaves over: at most a pattern's worth for each class."""
    bins: list[np.ndarray] = []
    free: list[int] = []
    for k in np.argsort(-sizes):
        todo = int(counts[k])
        for b in range(len(bins)):
            if not todo:
                break
            if (fit := min(todo, free[b] // int(sizes[k]))) > 0:
                bins[b][k] += fit
                free[b] -= fit * int(sizes[k])
                todo -= fit
        while todo:
            fit = min(todo, room // int(sizes[k]))
            row = np.zeros(len(sizes), np.int64)
            row[k] = fit
            bins.append(row)
            free.append(room - fit * int(sizes[k]))
            todo -= fit
    return bins


class Plan:
    """For each class the ranges of ranks that the patterns take, with the sequence and slot where each begins."""

    def __init__(self, sizes: np.ndarray, patterns: np.ndarray, used: np.ndarray):
        base = np.cumsum(used) - used
        self.ranges = {}
        for k, size in enumerate(sizes.tolist()):
            rows = np.flatnonzero(patterns[:, k])
            per = patterns[rows, k]
            take = per * used[rows]
            slot = patterns[rows, :k].sum(axis=1)
            self.ranges[size] = (np.cumsum(take) - take, per, base[rows], slot)

    def place(self, classes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, slot = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for size in np.unique(classes).tolist():
            first, per, base, before = self.ranges[size]
            mine = classes == size
            r = np.searchsorted(first, ranks[mine], "right") - 1
            inner = ranks[mine] - first[r]
            sequence[mine] = base[r] + inner // per[r]
            slot[mine] = before[r] + inner % per[r]
        return sequence, slot


def assign(pieces: DataFrame, length: int = LENGTH, width: int = WIDTH, ranked: int = RANKED) -> DataFrame:
    """pieces with sequence_id and offset. pieces is read more than once and should be a written table."""
    spark = pieces.sparkSession
    classed = pieces.withColumn("class", F.ceil(F.col("length") / width).cast("int"))
    total = {int(r[0]): int(r[1]) for r in classed.groupBy("class").count().collect()}
    sizes = np.array(sorted(total), np.int64)
    patterns, used = solve(sizes, np.array([total[c] for c in sizes.tolist()], np.int64), length // width)
    # a class has as many salts as it needs for `ranked` pieces in each; the ranks of a salt follow those of the one before
    ranked = max(ranked, sum(total.values()) // SHARES)
    salts = F.array(*[F.lit(max(1, common.ceil_div(total.get(c, 0), ranked))) for c in range(length // width + 1)])
    tagged = classed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.element_at(salts, F.col("class") + 1)).cast("int"))
    counts = sorted((int(r[0]), int(r[1]), int(r[2])) for r in tagged.groupBy("class", "salt").count().collect())
    before, at = {}, {}
    for c, s, n in counts:
        before[c << 32 | s] = at.get(c, 0)
        at[c] = at.get(c, 0) + n
    shared = spark.sparkContext.broadcast((Plan(sizes, patterns, used), before))
    rank = F.row_number().over(Window.partitionBy("class", "salt").orderBy("doc_id", "start", "length", "ids_crc32")).cast("long") - 1
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def one(batch: pa.RecordBatch):
        plan, first = shared.value
        classes = batch.column("class").to_numpy().astype(np.int64)
        key = classes << 32 | batch.column("salt").to_numpy()
        ranks = batch.column("rank").to_numpy() + np.array([first[k] for k in key.tolist()], np.int64)
        sequence, slot = plan.place(classes, ranks)
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence), pa.array(slot)], [*names, "sequence_id", "slot"])

    placed = common.map_arrow(tagged.withColumn("rank", rank), one, _PIECES + ", sequence_id long, slot long")
    above = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(above), F.lit(0)).cast("long")).drop("slot")


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, width: int = WIDTH) -> DataFrame:
    return assign(common.written(cut(docs, path, length), "pieces"), length, width)
