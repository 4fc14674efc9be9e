"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

Signatures hold the low B_BITS of PERMS minima. Band keys of ROWS full minima name the buckets of a document; within a
bucket the packed signatures are compared by bit counts, and a pair goes on when the collision-corrected estimate is within
five standard deviations of the threshold. What goes on is a spanning forest of each bucket, whose components are the
candidate groups; in these the full sets decide, again up to a spanning forest. So components lose no link that the bands
find (a pair at 0.8 shares one of BANDS bands with probability over 0.9999) and no group is ever written out as pairs.
Documents with the same set are one node. Buckets and groups beyond BUCKET and GROUP rows, or GROUP_BYTES of text, are cut
into blocks, so no task holds more; `confirmed` says how blocks meet.

Words are runs of anything but ASCII white space, A-Z lower-cased. A set is the distinct shingles of `shingle` words; with
fewer words the whole sequence is the one shingle. Signatures hash shingles to 64 bits, mixing eight bytes of a word at a
time; links are confirmed on the words themselves, without a hash. Defined cases: null, empty and blank texts
have no shingles and link with nothing; rows that share a doc_id are one node; a null doc_id links with nothing and is
kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS, B_BITS = 32, 6, 4
PERMS = BANDS * ROWS
BUCKET, GROUP = 4000, 1000
#: Text bytes of a block of a group; at most twice as many meet in a task, and more only in texts that are longer alone.
GROUP_BYTES = 32 << 20
_PIECE = 1 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_FOLD = np.frombuffer(_LOWER, np.uint8)
_BLANK = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
#: The low k bytes of a 64-bit word, and the length from which words are hashed one by one.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LONG = 256


@lru_cache(1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    draw = lambda: rng.integers(0, 2**64, PERMS, dtype=np.uint64)
    return draw() | np.uint64(1), draw()


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the documents laid end to end, and the offsets of the documents among them."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~_BLANK[data]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    edges = offsets[:-1][(offsets[:-1] < n)]
    begin[edges] = solid[edges]
    last = offsets[1:][offsets[1:] > 0] - 1
    end[last] = solid[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    folded = np.zeros(n + 8, np.uint8)
    folded[:n] = _FOLD[data]
    eight = np.ndarray((n + 1,), "<u8", folded, strides=(1,))
    size = ends - starts
    hashes = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    short = np.flatnonzero(size < _LONG)
    at, left = starts[short], size[short]
    while len(short):
        lane = eight[at] & _MASK[np.minimum(left, 8)]
        hashes[short] = common.mix64(hashes[short] * np.uint64(0xA0761D6478BD642F) ^ common.mix64(lane + np.uint64(0x9E3779B97F4A7C15)))
        more = left > 8
        short, at, left = short[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size >= _LONG).tolist():
        hashes[k] = int.from_bytes(hashlib.blake2b(folded[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return hashes, np.searchsorted(starts, offsets, "left")


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each document, sorted, laid end to end, and the offsets."""
    words, at = word_hashes(data, offsets)
    count = np.diff(at)
    sets: list[np.ndarray] = []

    def chain(first: np.ndarray, m: int) -> np.ndarray:
        h = np.full(len(first), m, np.uint64)
        for j in range(m):
            h = common.mix64(h * np.uint64(0xA0761D6478BD642F) + words[first + j])
        return h

    full = chain(np.arange(max(0, len(words) - shingle + 1)), shingle)
    for k, c in enumerate(count.tolist()):
        if c >= shingle:
            sets.append(np.unique(full[at[k] : at[k + 1] - shingle + 1]))
        else:
            sets.append(chain(at[k : k + 1], c) if c else np.zeros(0, np.uint64))
    ends = np.cumsum([0] + [len(s) for s in sets])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), ends


def shingle_codes(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """The distinct shingles of each text as numbers, the same for the same words and for no others."""
    vocabulary: dict[bytes, int] = {}
    whole: dict[tuple, int] = {}
    ids = [[vocabulary.setdefault(w, len(vocabulary)) for w in t.translate(_LOWER).split()] for t in texts]
    at = np.cumsum([0] + [len(x) for x in ids])
    flat = np.array([w for x in ids for w in x], np.int64)
    codes = flat[: max(0, len(flat) - shingle + 1)]
    for j in range(1, shingle):
        codes = np.unique(codes << 32 | flat[j : j + len(codes)], return_inverse=True)[1].reshape(-1)
    out = []
    for k, mine in enumerate(ids):
        if len(mine) >= shingle:
            out.append(np.unique(codes[at[k] : at[k + 1] - shingle + 1]))
        else:
            out.append(np.array([-1 - whole.setdefault(tuple(mine), len(whole))] if mine else [], np.int64))
    return out


def minima(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """PERMS minima for each non-empty set."""
    starts = ends[:-1][np.diff(ends) > 0]
    out = np.zeros((len(starts), PERMS), np.uint64)
    if len(starts):
        for p, (a, b) in enumerate(zip(*_permutations())):
            out[:, p] = np.minimum.reduceat(flat * a + b, starts)
    return out


def pack(low: np.ndarray) -> np.ndarray:
    """Rows of B_BITS-bit values packed into 64-bit words."""
    per = 64 // B_BITS
    grouped = low.reshape(len(low), -1, per)
    return np.bitwise_or.reduce(grouped << (np.arange(per, dtype=np.uint64) * np.uint64(B_BITS)), axis=2)


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity estimated from packed signatures: equal values by bit counts, corrected for chance collisions."""
    x = one ^ many
    for k in range(1, B_BITS):
        x = x | (one ^ many) >> np.uint64(k)
    mask = np.uint64(sum(1 << (B_BITS * k) for k in range(64 // B_BITS)))
    differ = np.bitwise_count(x & mask).sum(axis=-1, dtype=np.int64)
    chance = 2.0**-B_BITS
    return ((1 - differ / PERMS) - chance) / (1 - chance)


def least_estimate(threshold: float) -> float:
    chance = 2.0**-B_BITS
    p = chance + (1 - chance) * threshold
    return threshold - 5 * math.sqrt(p * (1 - p) / PERMS) / (1 - chance)


_SIGNED = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, sig binary"


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    def one(batch: pa.RecordBatch):
        data, offsets = common.utf8(batch.column("text"))
        for lo, hi in common.pieces(offsets, _PIECE):
            flat, ends = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], shingle)
            size = np.diff(ends)
            some = np.flatnonzero(size)
            low = minima(flat, ends)
            digest = np.zeros((2, hi - lo), np.uint64)
            if len(some):
                digest[0, some] = np.add.reduceat(common.mix64(flat), ends[:-1][some])
                digest[1, some] = np.add.reduceat(common.mix64(flat ^ np.uint64(0x5851F42D4C957F2D)), ends[:-1][some])
            bands, sig = [None] * (hi - lo), [None] * (hi - lo)
            keys = np.zeros((len(some), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for r in range(ROWS):
                keys = common.mix64(keys * np.uint64(0xA0761D6478BD642F) + low[:, r::ROWS])
            words = pack(common.mix64(low) & np.uint64((1 << B_BITS) - 1)) if len(some) else low
            for k, d in enumerate(some.tolist()):
                bands[d], sig[d] = keys[k].view(np.int64), words[k].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                ["doc_id", "n_shingles", "s1", "s2", "bands", "sig"],
            )

    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), one, _SIGNED)


def spanning(n: int, near) -> list[tuple[int, int]]:
    """A spanning forest of the graph that near(pivot, others) -> mask tells, without asking for pairs already connected."""
    comp = np.arange(n)
    edges = []
    for u in range(n - 1):
        others = np.flatnonzero(comp[u + 1 :] != comp[u]) + u + 1
        if not len(others):
            continue
        for v in others[near(u, others)].tolist():
            if comp[v] != comp[u]:
                edges.append((u, v))
                comp[comp == comp[v]] = comp[u]
    return edges


def _bucket_edges(least: float):
    def edges(table: pa.Table, starts: np.ndarray):
        ids = table.column("doc_id").to_numpy()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint64).reshape(len(ids), -1)
        size = np.diff(starts)
        two = starts[:-1][size == 2]
        two = two[estimates(sig[two], sig[two + 1]) >= least]
        a, b = [ids[two]], [ids[two + 1]]
        for k in np.flatnonzero(size > 2).tolist():
            s = sig[starts[k] : starts[k + 1]]
            got = spanning(len(s), lambda u, others: estimates(s[u], s[others]) >= least)  # noqa: B023
            if got:
                pair = ids[np.array(got) + starts[k]]
                a.append(pair[:, 0])
                b.append(pair[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], ["a", "b"])

    return edges


def _group_edges(shingle: int, numerator: int, denominator: int):
    def edges(table: pa.Table, starts: np.ndarray):
        a, b = [], []
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
            part = table.slice(lo, hi - lo)
            ids = part.column("doc_id").to_numpy()
            sets = shingle_codes([x or b"" for x in part.column("text").cast(pa.large_binary()).to_pylist()], shingle)
            size = np.array([len(s) for s in sets], np.int64)
            ends = np.append(0, np.cumsum(size))
            codes = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1)
            mark = np.zeros(int(codes.max()) + 1 if len(codes) else 1, np.int64)

            def near(u: int, others: np.ndarray) -> np.ndarray:
                mine = codes[ends[u] : ends[u + 1]]  # noqa: B023
                mark[mine] = 1  # noqa: B023
                total = size[others]  # noqa: B023
                first = np.cumsum(total) - total
                at = np.repeat(ends[others] - first, total) + np.arange(int(total.sum()))  # noqa: B023
                both = np.add.reduceat(mark[codes[at]], first)  # noqa: B023
                mark[mine] = 0  # noqa: B023
                return denominator * both >= numerator * (size[u] + total - both)  # noqa: B023

            order = np.argsort(-size, kind="stable")  # sets near in size come together
            got = spanning(len(ids), lambda u, others: near(order[u], order[others]))  # noqa: B023
            a += [int(ids[order[u]]) for u, _ in got]
            b += [int(ids[order[v]]) for _, v in got]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return edges


def _blocked(rows: DataFrame, key: str, most: int, name: str, by: str = "doc_id") -> DataFrame:
    """rows with `name`, the block of about `most` rows and GROUP_BYTES of its key that a row is in, and `name`_n, the number of blocks."""
    weight = F.greatest(F.count(F.lit(1)) / most, F.sum("n_bytes") / GROUP_BYTES)
    sizes = rows.groupBy(key).agg(F.greatest(F.lit(1), F.ceil(weight)).cast("int").alias(f"{name}_n"))
    return rows.join(sizes, key).withColumn(name, F.pmod(F.xxhash64(by, F.lit("block")), F.col(f"{name}_n")).cast("int"))


def confirmed(texts: DataFrame, maybe: DataFrame, shingle: int, percent: int, group: int) -> DataFrame:
    """Edges a, b of full sets that connect each group as all its links would. texts: grp, doc_id, n_bytes, text; maybe: a, b.

    Groups of up to 2 * group documents and 2 * GROUP_BYTES are compared in one task. A larger one is dealt into blocks; links within blocks and
    those of the candidate edges come first, and only documents outside its largest component so far, the strays, are then
    compared with all others, in blocks of strays against blocks of the rest. If links are plain, as among edited copies of
    one text, there are few strays and the work is linear; at worst every two blocks meet.
    """
    exact = _group_edges(shingle, percent, 100)
    edges = "a long, b long"

    def within(rows: DataFrame, keys: list[str]) -> DataFrame:
        return common.map_runs(rows.select(*keys, "doc_id", "text"), keys, exact, edges)

    sizes = common.written(texts.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("b")).where((F.col("n") > 2 * group) | (F.col("b") > 2 * GROUP_BYTES)).select("grp"), "large")
    if not sizes.take(1):
        return within(texts, ["grp"])
    small = within(texts.join(sizes, "grp", "left_anti"), ["grp"])
    large = common.written(_blocked(texts.join(sizes, "grp", "left_semi"), "grp", group, "part"), "large-texts")
    inside = within(large, ["grp", "part"])
    ends = maybe.where("a <> b").distinct().select("a", "b", F.explode(F.array("a", "b")).alias("doc_id"))
    pairs = ends.join(large.select("doc_id", "text"), "doc_id")
    first = common.written(inside.unionByName(within(pairs, ["a", "b"])), "first-links")
    roots = components(first).select(F.col("node").alias("doc_id"), "root")
    placed = common.written(large.select("grp", "doc_id", "n_bytes", "part", "part_n").join(roots, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")), "placed")
    main = placed.groupBy("grp", "root").count().groupBy("grp").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    stray = common.written(_blocked(placed.join(main, "grp").where("root <> main").select("grp", "doc_id", "n_bytes", "part_n"), "grp", group, "side"), "strays")
    if not stray.take(1):
        return small.unionByName(first)
    counts = stray.groupBy("grp").agg(F.first("side_n").alias("side_n"))
    rest = placed.join(stray.select("grp", "doc_id"), ["grp", "doc_id"], "left_anti").join(counts, "grp").select("doc_id", "grp", "part", F.explode(F.sequence(F.lit(0), F.col("side_n") - 1)).alias("side"))
    met = stray.select("doc_id", "grp", F.explode(F.sequence(F.lit(0), F.col("part_n") - 1)).alias("part"), "side")
    bodies = large.select("grp", "doc_id", "text")
    across = within(rest.unionByName(met).join(bodies, ["grp", "doc_id"]), ["grp", "part", "side"])
    among = common.bounded_groups(stray.select("grp", "doc_id", "n_bytes"), "grp", group, "doc_id", ("n_bytes", GROUP_BYTES)).drop("n_bytes").join(bodies, ["grp", "doc_id"])
    return small.unionByName(first).unionByName(across).unionByName(within(among, ["grp", "part_i", "part_j"]))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = 80, bucket: int = BUCKET, group: int = GROUP) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs. percent: the least similarity."""
    with common.scratch_but(docs.sparkSession, "signatures", "named-sets"):
        return _near_duplicates(docs, shingle, percent, bucket, group)


def _near_duplicates(docs: DataFrame, shingle: int, percent: int, bucket: int, group: int) -> DataFrame:
    signed = common.written(signatures(docs, shingle), "signatures")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    sets = ["n_shingles", "s1", "s2"]
    reps = common.written(full.groupBy(*sets).agg(F.min("doc_id").alias("rep")), "reps")
    heads = full.join(reps.withColumnRenamed("rep", "doc_id"), [*sets, "doc_id"]).select("doc_id", "bands", "sig")
    keyed = heads.select("doc_id", F.explode("bands").alias("key"))
    members = common.bounded_groups(keyed, "key", bucket, "doc_id").join(heads.select("doc_id", "sig"), "doc_id")
    runs = ["key", "part_i", "part_j"]
    maybe = common.map_runs(members.select(*runs, "doc_id", "sig"), runs, _bucket_edges(least_estimate(percent / 100)), "a long, b long")
    maybe = common.written(maybe.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidate-edges")
    groups = components(maybe)
    # Rows of one id and other texts would meet here too; the join on the id takes them as one node.
    cand = groups.select(F.col("node").alias("cand_id"), F.col("root").alias("grp"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(cand, F.col("doc_id") == F.col("cand_id")).select("grp", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    sure = confirmed(common.written(texts, "candidates"), maybe, shingle, percent, group)
    roots = components(sure).select(F.col("node").alias("rep"), "root")
    named = common.written(reps.join(roots, "rep", "left").select(*sets, F.coalesce("root", "rep").alias("root")), "named-sets")
    out = signed.select("doc_id", *sets).join(named, sets, "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("root")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
