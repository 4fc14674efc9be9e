"""Exact removal of repeated byte strings by suffix arrays over shards.

Every N-byte window has a minimiser, the least hash of the GRAM-byte strings in it, so equal windows have equal ones.
Consecutive windows with one minimiser form a segment. Groups of documents exchange minimiser hashes to learn which occur
in two documents; only the segments of these can hold a repeat, and they go to the shard of their minimiser. Equal
segments are folded, compared byte by byte: the smallest doc_id stands for all, copies with larger ids are covered. That
happens in each group, then for every FAN rows of a shard until no shard has more, so a hot passage is a segment of at
most FAN rows in one task. What differs is cut into arrays of at most MOST bytes, each sorted by Larsson-Sadakane prefix
doubling in numpy to depth N, only unsorted groups each round; Kasai's recurrence gives the common prefixes, and suffixes
that share N bytes form a group. The sorted windows of the arrays are merged by binary search. A window goes if its group
has a smaller doc_id. Hashes only select; equality is always decided on the bytes.

Rows exchanged: one for each group of GROUP_BYTES and bucket or shard, so few even where buckets grow with the corpus.
Defined cases: null text counts as empty; texts under N bytes keep all; rows that share a doc_id don't cover each other; a
null doc_id covers nothing and keeps all; repeated rows give repeated rows; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, GRAM = 50, 20
#: Text bytes hashed at once, and of a group of such blocks.
BLOCK_BYTES, GROUP_BYTES = 2 << 20, 12 << 20
#: Positions of one suffix array; ranks and positions then share a 64-bit sort key.
MOST = 1 << 19
#: Text bytes of a bucket of minimisers, and of a shard if all text were candidates (a segment repeats its overlap).
BUCKET_BYTES, SHARD_BYTES, OVERLAP = 64 << 20, 16 << 20, 4
#: Rows of a shard folded at once, and candidate bytes of a group folded at once.
FAN, FOLD_BYTES = 256, 48 << 20
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


def _packed(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(a).tobytes())


def _open(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind) if b else np.zeros(0, kind)


def _words(data: np.ndarray, n: int, kind: str = "<u8") -> np.ndarray:
    """The 8-byte word at each of the first n positions (data is padded)."""
    return np.ndarray((n,), kind, data, strides=(1,))


# ---- groups of documents and their segments

_PART = pa.struct([("ids", pa.binary()), ("known", pa.binary()), ("offsets", pa.binary()), ("bytes", pa.int64()), ("data", pa.binary())])


def groups_of(docs: DataFrame, block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Documents in groups of about group_bytes, or what a task has: grp, bytes, parts (blocks, compressed; known: 0 for a null id)."""

    def run(batches):
        task, n, parts, size = TaskContext.get().partitionId(), 0, [], 0

        def group():
            return pa.RecordBatch.from_arrays([pa.array([(task << 33) + n], pa.int64()), pa.array([size], pa.int64()), pa.array([parts], pa.list_(_PART))], ["grp", "bytes", "parts"])

        for batch in batches:
            ids = batch.column("doc_id")
            data, offsets = common.utf8(batch.column("text"))
            for lo, hi in common.pieces(offsets, block_bytes):
                mine, raw = ids.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]]
                parts.append({
                    "ids": _packed(mine.fill_null(0).to_numpy()), "known": _packed(mine.is_valid().to_numpy(zero_copy_only=False)), "offsets": _packed(offsets[lo : hi + 1] - offsets[lo]),
                    "bytes": len(raw), "data": zstandard.ZstdCompressor(3).compress(raw.tobytes()),
                })
                size += len(raw)
                if size >= group_bytes:
                    yield group()
                    n, parts, size = n + 1, [], 0
        if parts:
            yield group()

    kind = "array<struct<ids:binary,known:binary,offsets:binary,bytes:long,data:binary>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"grp long, bytes long, parts {kind}")


class Block:
    """A block in memory, with the runs of windows that share a minimiser."""

    def __init__(self, row: dict, n: int = WINDOW):
        self.ids, self.known = _open(row["ids"], np.int64), _open(row["known"], bool)
        self.offsets, self.n = _open(row["offsets"], np.int64), n
        size = int(row["bytes"])
        self.data = np.zeros(size + 64, np.uint8)
        self.data[:size] = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"]), np.uint8)
        self.size = size

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each run: minimiser (spread again), document, first window, number of windows."""
        n, size = self.n, self.size
        none = np.zeros(0, np.int64)
        if size < n:
            return none.astype(np.uint64), none, none, none
        a = _words(self.data, size - GRAM + 1)
        b, c = _words(self.data[8:], size - GRAM + 1), _words(self.data[GRAM - 8 :], size - GRAM + 1)
        h = common.mix64(a * np.uint64(_BASES[0]) ^ common.mix64(b * np.uint64(_BASES[1]) + c))
        span, width, low = n - GRAM + 1, 1, h
        while width * 2 <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        rest = span - width
        low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
        valid = np.zeros(len(low) + 1, bool)
        for k in np.flatnonzero((np.diff(self.offsets) >= n) & self.known).tolist():
            valid[self.offsets[k] : self.offsets[k + 1] - n + 1] = True
        new = valid[:-1].copy()
        new[1:] &= ~valid[:-2] | (low[1:] != low[:-1])
        starts = np.flatnonzero(new)
        if not len(starts):
            return none.astype(np.uint64), none, none, none
        stops = np.append(starts[1:], len(low))
        gaps = np.flatnonzero(~valid[: len(low)])  # a run ends before the next invalid window
        if len(gaps):
            nxt = np.searchsorted(gaps, starts)
            stops = np.minimum(stops, np.where(nxt < len(gaps), gaps[np.minimum(nxt, len(gaps) - 1)], len(low)))
        doc = np.searchsorted(self.offsets, starts, "right") - 1
        return common.mix64(low[starts] ^ np.uint64(0x5851F42D4C957F2D)), doc, starts, stops - starts


@dataclass
class Keys:
    """The runs of a group (block, doc_id, first window, windows, minimiser) and its distinct minimisers by bucket."""

    part: np.ndarray
    ids: np.ndarray
    starts: np.ndarray
    count: np.ndarray
    value: np.ndarray
    distinct: np.ndarray
    both: np.ndarray  # whether a distinct minimiser occurs in two documents of the group
    place: np.ndarray  # of each run among the distinct minimisers


def keys_of(parts: list[dict], buckets: int, n: int) -> Keys:
    found = []
    for k, row in enumerate(parts):
        block = Block(row, n)
        value, doc, starts, count = block.runs()
        found.append((np.full(len(value), k, np.int32), block.ids[doc], starts, count, value))
    part, ids, starts, count, value = (np.concatenate(x) for x in zip(*found))
    key = (value >> np.uint64(40)) % np.uint64(buckets) << np.uint64(40) | value & np.uint64((1 << 40) - 1)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.append(True, ranked[1:] != ranked[:-1])[: len(ranked)]
    heads = np.flatnonzero(new)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    by_id = ids[order]
    both = np.minimum.reduceat(by_id, heads) != np.maximum.reduceat(by_id, heads) if len(heads) else np.zeros(0, bool)
    return Keys(part, ids, starts, count, value, ranked[heads], both, place)


def _rows(batch: pa.RecordBatch):
    yield from batch.to_pylist()


def minimisers(groups: DataFrame, buckets: int, n: int) -> DataFrame:
    """bucket, grp and the sorted distinct minimisers of the group in the bucket (40 bits each), with a flag for each."""

    def one(batch: pa.RecordBatch):
        for row in _rows(batch):
            keys = keys_of(row["parts"], buckets, n)
            bucket = (keys.distinct >> np.uint64(40)).astype(np.int64)
            at = np.searchsorted(bucket, np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(at))
            low = keys.distinct.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            for lo in range(0, len(some), 1000):
                mine = some[lo : lo + 1000]
                flags = [np.packbits(keys.both[at[k] : at[k + 1]]).tobytes() for k in mine]
                cols = [pa.array(mine, pa.int32()), pa.array([row["grp"]] * len(mine), pa.int64()), pa.array([low[at[k] : at[k + 1]].tobytes() for k in mine], pa.binary()), pa.array(flags, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["bucket", "grp", "keys", "flags"])

    return common.map_arrow(groups, one, "bucket int, grp long, keys binary, flags binary")


def repeated(table: pa.Table) -> pa.Table:
    """Of one bucket: for each group a bit for each of its minimisers, set if some other document has it."""
    keys, flags = [], []
    for k, f in zip(table.column("keys").to_pylist(), table.column("flags").to_pylist()):
        low = np.frombuffer(k, np.uint8).reshape(-1, 5)
        wide = np.zeros((len(low), 8), np.uint8)
        wide[:, :5] = low
        keys.append(wide.view("<u8").reshape(-1))
        flags.append(np.unpackbits(np.frombuffer(f, np.uint8), count=len(low)).astype(bool))
    ends = np.cumsum([0] + [len(k) for k in keys])
    flat = np.concatenate(keys)
    del keys
    order = np.argsort(flat, kind="stable")
    ranked = flat[order]
    same = ranked[1:] == ranked[:-1]
    hit = np.zeros(len(flat), bool)
    hit[order[1:]] = same
    hit[order[:-1]] |= same
    hit |= np.concatenate(flags)
    bits = [np.packbits(hit[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:])]
    return pa.table({"grp": table.column("grp"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})


@dataclass
class Fold:
    """Distinct segments with the smallest doc_id that holds each, its copies in that document, and what copies in others cover."""

    texts: list[bytes]
    ids: np.ndarray
    code: np.ndarray  # of each copy: its segment, group and place in the group
    owner: np.ndarray
    start: np.ndarray
    covered: np.ndarray  # rows of group, first byte, end


def fold(texts: list[bytes], ids: np.ndarray, code: np.ndarray, owner: np.ndarray, start: np.ndarray) -> Fold:
    """Fold equal segments; ids: of each text, code: the text of each copy."""
    seen: dict[bytes, int] = {}
    place = np.array([seen.setdefault(x, len(seen)) for x in texts], np.int64)
    least = np.full(len(seen), np.iinfo(np.int64).max)
    np.minimum.at(least, place, ids)
    size = np.array([len(x) for x in texts], np.int64)
    now = place[code]
    later = ids[code] > least[now]
    covered = np.stack([owner[later], start[later], start[later] + size[code[later]]], 1)
    return Fold(list(seen), least, now[~later], owner[~later], start[~later], covered)


def _spans(rows: np.ndarray):
    """(group, packed spans) of rows of group, first byte, end; spans that overlap become one (not those that touch: they may lie in two documents)."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    for lo, hi in zip(*_bounds(rows[:, 0])):
        a, b = rows[lo:hi, 1], np.maximum.accumulate(rows[lo:hi, 2])
        head = np.append(True, a[1:] >= b[:-1])
        yield int(rows[lo, 0]), _packed(np.stack([a[head], b[np.append(np.flatnonzero(head)[1:] - 1, len(b) - 1)]], 1))


def _bounds(ranked: np.ndarray) -> tuple[list[int], list[int]]:
    at = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, np.int64)
    return at.tolist(), np.append(at[1:], len(ranked)).tolist() if len(at) else []


_SEGMENTS = "shard int, salt int, grp long, covered binary, ids binary, size binary, data binary, code binary, owner binary, start binary"
_COLUMNS = ["shard", "salt", "grp", "covered", "ids", "size", "data", "code", "owner", "start"]
_KINDS = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 7]


def _batches(rows: list[tuple]):
    for lo in range(0, len(rows), 500):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[lo : lo + 500]), _KINDS)], _COLUMNS)


def _segment_row(shard: int, salt: int, f: Fold, picked: np.ndarray, copies: np.ndarray) -> tuple:
    """A row of the picked segments (sorted) and their copies."""
    texts = [f.texts[k] for k in picked.tolist()]
    size = np.array([len(x) for x in texts], np.int32)
    data = zstandard.ZstdCompressor(1).compress(b"".join(texts))
    return (shard, salt, None, None, _packed(f.ids[picked]), _packed(size), data, _packed(np.searchsorted(picked, f.code[copies]).astype(np.int32)), _packed(f.owner[copies]), _packed(f.start[copies].astype(np.int64)))


def _covered_rows(shard: int, salt: int, rows: np.ndarray) -> list[tuple]:
    return [(shard, salt, grp, spans, *[None] * 6) for grp, spans in _spans(rows)]


def segments(joined: DataFrame, buckets: int, shards: int, salts: int, n: int) -> DataFrame:
    """The folded candidate segments of each group, dealt to shards, and rows of what copies within the group cover."""

    def one(batch: pa.RecordBatch):
        for row in _rows(batch):
            grp, keys = row["grp"], keys_of(row["parts"], buckets, n)
            hit = np.zeros(len(keys.distinct), bool)
            bounds = np.searchsorted((keys.distinct >> np.uint64(40)).astype(np.int64), np.arange(buckets + 1))
            for item in row["hits"] or []:
                lo, hi = bounds[item["bucket"]], bounds[item["bucket"] + 1]
                hit[lo:hi] = np.unpackbits(np.frombuffer(item["bits"], np.uint8), count=hi - lo)
            pick = np.flatnonzero(hit[keys.place]) if len(keys.place) else keys.place
            base = np.cumsum([0] + [p["bytes"] for p in row["parts"]])
            salt = int(common.mix64(np.array([grp], np.uint64))[0] % np.uint64(salts))
            held: list[tuple] = []

            def settled():
                texts = [x for t, *_ in held for x in t]
                ids, start, shard = (np.concatenate(x) for x in list(zip(*held))[1:])
                f = fold(texts, ids, np.arange(len(texts)), np.full(len(texts), grp), start)  # noqa: B023
                home = np.zeros(len(f.texts), np.int64)
                # a segment's shard follows from its minimiser, so from its text
                home[f.code] = shard[np.searchsorted(start, f.start)]
                order, by = np.argsort(home, kind="stable"), np.argsort(home[f.code], kind="stable")
                at, to = np.searchsorted(home[order], np.arange(shards + 1)), np.searchsorted(home[f.code][by], np.arange(shards + 1))
                rows = [_segment_row(s, salt, f, np.sort(order[at[s] : at[s + 1]]), by[to[s] : to[s + 1]]) for s in np.flatnonzero(np.diff(at)).tolist()]  # noqa: B023
                yield from _batches(rows + _covered_rows(grp % shards, salt, f.covered))  # noqa: B023

            volume = 0
            for k, part in enumerate(row["parts"]):
                mine = pick[keys.part[pick] == k]
                if not len(mine):
                    continue
                raw = Block(part, n).data.tobytes()
                starts, size = keys.starts[mine], keys.count[mine] + n - 1
                texts = [raw[a:b] for a, b in zip(starts.tolist(), (starts + size).tolist())]
                held.append((texts, keys.ids[mine], starts + base[k], ((keys.value[mine] >> np.uint64(8)) % np.uint64(shards)).astype(np.int64)))
                volume += int(size.sum())
                if volume >= FOLD_BYTES:
                    yield from settled()
                    held, volume = [], 0
            if held:
                yield from settled()

    return common.map_arrow(joined, one, _SEGMENTS)


def gathered(table: pa.Table) -> tuple[list[tuple[int, bytes]], Fold]:
    """The covered spans that pass through, and the fold of all segments of the rows."""
    through, texts, ids, code, owner, start = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in table.to_batches():
        for row in batch.to_pylist():
            if row["covered"]:
                through.append((row["grp"], row["covered"]))
                continue
            raw, size = zstandard.ZstdDecompressor().decompress(row["data"]), _open(row["size"], np.int32)
            ends = np.cumsum(size, dtype=np.int64)
            code.append(_open(row["code"], np.int32) + len(texts))
            texts += [raw[a:b] for a, b in zip((ends - size).tolist(), ends.tolist())]
            ids.append(_open(row["ids"], np.int64))
            owner.append(_open(row["owner"], np.int64))
            start.append(_open(row["start"], np.int64))
    return through, fold(texts, *(np.concatenate(x) for x in (ids, code, owner, start)))


def fold_rows(table: pa.Table, fan: int) -> pa.Table:
    """Rows of one shard and salt, folded to one row and to the rows of what is covered; the salt becomes the next level's."""
    shard, salt = table.column("shard")[0].as_py(), table.column("salt")[0].as_py() // fan
    through, f = gathered(table)
    rows = [(shard, salt, grp, spans, *[None] * 6) for grp, spans in through] + _covered_rows(shard, salt, f.covered)
    if f.texts:
        rows.append(_segment_row(shard, salt, f, np.arange(len(f.texts)), np.arange(len(f.code))))
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], _COLUMNS)


# ---- suffix arrays


def suffix_array(data: np.ndarray, size: int, depth: int = WINDOW) -> np.ndarray:
    """Suffixes of data[:size] in the order of their first `depth` bytes; data is zero-padded by at least 64 bytes.

    Larsson-Sadakane: ranks at depth h give those at 2h; sorted groups (of one suffix) are left out of later rounds.
    """
    bits = max(1, size.bit_length())
    h = min(5, (63 - bits) // 8)
    place = np.arange(size, dtype=np.uint64)
    word = _words(data, size, ">u8").astype(np.uint64) >> np.uint64(64 - 8 * h)
    order = np.sort(word << np.uint64(bits) | place)
    sa = (order & np.uint64((1 << bits) - 1)).astype(np.int64)
    word = order >> np.uint64(bits)
    new = np.ones(size, bool)
    new[1:] = word[1:] != word[:-1]
    rank = np.zeros(size + depth, np.int64)  # of suffixes past the end: the least
    first = np.maximum.accumulate(np.where(new, np.arange(size), 0))
    rank[sa] = first + 1
    pending = np.flatnonzero(_grouped(new))
    while h < depth and len(pending):
        step = min(h, depth - h)
        suffix, group = sa[pending], first[pending]
        # group starts order the groups, the ranks `step` bytes on order within them
        high, low = group.astype(np.uint64), rank[suffix + step].astype(np.uint64)
        if 3 * bits < 64:
            key = np.sort(high << np.uint64(2 * bits) | low << np.uint64(bits) | np.arange(len(pending), dtype=np.uint64))
            moved = suffix[(key & np.uint64((1 << bits) - 1)).astype(np.int64)]
            pair = key >> np.uint64(bits)
        else:
            pair = high << np.uint64(bits) | low
            by = np.argsort(pair, kind="stable")
            moved, pair = suffix[by], pair[by]
        sa[pending] = moved
        split = np.ones(len(pending), bool)
        split[1:] = pair[1:] != pair[:-1]
        head = np.maximum.accumulate(np.where(split, pending, 0))
        first[pending] = head
        rank[moved] = head + 1
        h += step
        pending = pending[_grouped(split)]
    return sa


def _grouped(new: np.ndarray) -> np.ndarray:
    """Of entries in groups that begin where new is set: those whose group has more than one."""
    last = np.ones(len(new), bool)
    last[:-1] = new[1:]
    return ~(new & last)


def common_prefixes(data: np.ndarray, sa: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """For each place of the array the bytes shared with the suffix before it, up to depth.

    Kasai's recurrence in text order: a suffix shares at least one byte less than the one a byte before it did. Positions
    are taken in four interleaved passes, each beginning at the bound that the pass before gives; at the cap there is none.
    """
    size = len(sa)
    before = np.full(size, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    shared = np.zeros(size, np.int64)
    words = _words(data, len(data) - 7)
    for phase in range(4):
        i = np.arange(phase, size, 4)
        if phase:
            known = shared[i - 1]
            at = np.where((known > 0) & (known < depth), known - 1, 0)
        else:
            at = np.zeros(len(i), np.int64)
        live = np.flatnonzero(before[i] >= 0)
        while len(live):
            x = words[i[live] + at[live]] ^ words[before[i[live]] + at[live]]
            same = x == 0
            at[live] += np.where(same, 8, np.bitwise_count((x & -x) - np.uint64(1)).astype(np.int64) >> 3)
            live = live[same]
            live = live[at[live] < depth]
        shared[i] = np.minimum(at, depth)
    return shared[sa]


def array_groups(data: np.ndarray, size: int, valid: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Valid window starts in suffix order, and the number of the group of equal windows of each, in sorted order."""
    sa = suffix_array(data, size, n)
    shared = common_prefixes(data, sa, n)
    group = np.cumsum(shared < n)
    fine = valid[sa]
    _, dense = np.unique(group[fine], return_inverse=True)
    return sa[fine], dense


def covered_windows(data: np.ndarray, sizes: np.ndarray, ids: np.ndarray, n: int, most: int) -> np.ndarray:
    """Mask of the window starts, in segments laid end to end, whose window also starts in a segment of a smaller id."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    out = np.zeros(total, bool)
    cuts, at = [], 0
    while at < len(sizes):
        base = ends[at] - sizes[at]
        stop = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        cuts.append((at, stop, int(base), int(ends[stop - 1])))
        at = stop
    found = []
    for lo, hi, a, b in cuts:
        part = np.zeros(b - a + 64, np.uint8)
        part[: b - a] = data[a:b]
        inner = ends[lo:hi] - sizes[lo:hi] - a
        step = np.zeros(b - a + 1, np.int64)
        np.add.at(step, inner, 1)
        np.add.at(step, inner + sizes[lo:hi] - n + 1, -1)
        starts, group = array_groups(part, b - a, np.cumsum(step[:-1]) > 0, n)
        who = np.repeat(ids[lo:hi], sizes[lo:hi])[starts]
        heads = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
        found.append([starts + a, group, who, starts[heads] + a, np.minimum.reduceat(who, heads) if len(heads) else who])
    wide = np.ndarray((max(0, total - n + 1),), f"S{n}", data, strides=(1,)) if total >= n else None
    for j in range(1, len(found)):  # merge the sorted windows of every two arrays by binary search
        for i in range(j):
            one, two = wide[found[i][3]], wide[found[j][3]]
            if not len(one) or not len(two):
                continue
            place = np.minimum(np.searchsorted(one, two), len(one) - 1)
            equal = np.flatnonzero(one[place] == two)
            least = np.minimum(found[i][4][place[equal]], found[j][4][equal])
            found[i][4][place[equal]] = least
            found[j][4][equal] = least
    for starts, group, who, _, least in found:
        out[starts] = who > least[group] if len(group) else False
    return out


def shard_spans(table: pa.Table, n: int, most: int) -> pa.Table:
    """Of one shard: the spans that go, for each group."""
    out, f = gathered(table)
    rows = [f.covered]
    if f.texts:
        size = np.array([len(x) for x in f.texts], np.int64)
        gone = covered_windows(np.frombuffer(b"".join(f.texts), np.uint8), size, f.ids, n, most)
        hit = np.flatnonzero(gone)
        if len(hit):
            ends = np.cumsum(size)
            seg = np.searchsorted(ends, hit, "right")
            new = np.append(True, (hit[1:] != hit[:-1] + 1) | (seg[1:] != seg[:-1]))
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(hit)) - 1
            code, lo, hi = seg[head], hit[head] - (ends - size)[seg[head]], hit[tail] - (ends - size)[seg[head]] + n
            # each span holds for all copies of its segment
            by = np.argsort(f.code, kind="stable")
            first, last = np.searchsorted(f.code[by], code, "left"), np.searchsorted(f.code[by], code, "right")
            count = last - first
            span = np.repeat(np.arange(len(code)), count)
            copy = by[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(span))]
            rows.append(np.stack([f.owner[copy], f.start[copy] + lo[span], f.start[copy] + hi[span]], 1))
    out += _spans(np.concatenate(rows))
    return pa.table({"grp": pa.array([g for g, _ in out], pa.int64()), "spans": pa.array([s for _, s in out], pa.binary())})


# ---- the result


_KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _apply(joined: DataFrame, n: int, with_text: bool) -> DataFrame:
    def one(batch: pa.RecordBatch):
        for row in _rows(batch):
            spans = [_open(packed, np.int64).reshape(-1, 2) for packed in row["hits"] or []]
            spans = np.concatenate(spans) if spans else np.zeros((0, 2), np.int64)
            spans = spans[np.argsort(spans[:, 0])]
            base = 0
            for part in row["parts"]:
                block = Block(part, n)
                lo, hi = np.searchsorted(spans[:, 0], [base, base + block.size])
                step = np.zeros(block.size + 1, np.int32)
                np.add.at(step, spans[lo:hi, 0] - base, 1)
                np.add.at(step, spans[lo:hi, 1] - base, -1)
                base += block.size
                gone = np.cumsum(step[:-1]) > 0
                size = np.diff(block.offsets)
                new = gone.copy()
                new[1:] &= ~gone[:-1]
                edge = block.offsets[:-1][size > 0]
                new[edge] = gone[edge]
                removed = np.append(0, np.cumsum(gone))
                runs = np.append(0, np.cumsum(new))
                kept = block.data[: block.size][~gone].tobytes()
                at = block.offsets - removed[block.offsets]
                texts = [kept[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                result = texts if with_text else [hashlib.sha256(p).digest() for p in texts]
                cols = [pa.array(block.ids, pa.int64(), mask=~block.known), pa.array(size, pa.int64()), pa.array(np.diff(removed[block.offsets]), pa.int64()), pa.array(np.diff(runs[block.offsets]), pa.int64()), pa.array(result, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return common.map_arrow(joined, one, _KEPT)


def dedup(docs: DataFrame, n: int = WINDOW, with_text: bool = True, most: int = MOST, block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES, fan: int = FAN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept: the remaining bytes, or their SHA-256 without with_text."""
    spark = docs.sparkSession
    groups = common.written(groups_of(docs, block_bytes, group_bytes), "groups")
    total, n_groups = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    buckets = max(common.partitions(spark), common.ceil_div(total, BUCKET_BYTES))
    shards = max(common.partitions(spark), common.ceil_div(OVERLAP * total, SHARD_BYTES))
    found = minimisers(groups, buckets, n).groupBy("bucket").applyInArrow(repeated, "grp long, bucket int, bits binary")
    bits = found.groupBy(F.col("grp").alias("hit_grp")).agg(F.collect_list(F.struct("bucket", "bits")).alias("hits"))

    def with_hits(hits: DataFrame) -> DataFrame:
        return groups.join(hits, groups["grp"] == hits["hit_grp"], "left").drop("hit_grp")

    salts = common.ceil_div(n_groups, fan)
    parts = segments(with_hits(bits), buckets, shards, max(1, salts), n)
    while salts > 1:  # about `fan` rows of a shard to a salt; the next level has as many of their results
        parts = parts.groupBy("shard", "salt").applyInArrow(lambda t: fold_rows(t, fan), _SEGMENTS)
        salts = common.ceil_div(salts, fan)
    spans = parts.groupBy("shard").applyInArrow(lambda t: shard_spans(t, n, most), "grp long, spans binary")
    spans = spans.groupBy(F.col("grp").alias("hit_grp")).agg(F.collect_list("spans").alias("hits"))
    return _apply(with_hits(spans), n, with_text)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query, from dedup(..., with_text=False)."""
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))
