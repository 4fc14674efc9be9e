"""Merkle manifest of a dataset: a hash tree for each source over its documents, and one over the sources' roots.

Leaves are hashed by Spark; from then on only digests move. The place of a leaf within its source comes from a sort by
ranges and running counts of the ranges. A tree is worked off in aligned blocks of FANOUT ** DEPTH nodes: one row holds a
block's digests end to end, and a task sees them as a matrix of 64 hex bytes a node, reshaped by the fanout and hashed row
by row for each level, so a block yields one node of the next tier; tiers end where every tree is one node. Proofs go
the other way: a block gets the siblings above it and finds those of all its nodes inside by index arithmetic. A source
of any size is cut into blocks, so no task holds more than blocks.

Defined cases: each null field counts as "-"; a row with a null doc_id comes first in its source and isn't tampered with;
rows with one doc_id stand in the order of their leaves, and equal rows in any, as they have equal leaves; a source with
one row has its leaf as root, and the root of a single source is the manifest's; an empty table has no rows and no root;
texts of any length are hashed whole; columns other than the five are ignored.
"""

from __future__ import annotations

import binascii
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Nodes hashed into one, and levels of a block; 729 nodes are 47 kB of hex.
FANOUT, DEPTH = 3, 6
#: Rows up to which running counts, sources' paths and the like are broadcast (some 150 bytes each, so 30 MB at most).
BROADCAST_ROWS = 200_000
_HEX = 64


def leaf_hash(text: F.Column) -> F.Column:
    """The digest (32 bytes) of a document with the given text."""
    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    parts = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def tampered_text() -> F.Column:
    """The text that an intruder leaves: without line feeds where 2 divides the checksum of the id."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def _hashed(text: bytes) -> bytes:
    return binascii.hexlify(sha256(text).digest())


def matrix(digests: bytes) -> np.ndarray:
    """Digests end to end as rows of 64 hex bytes."""
    return np.frombuffer(binascii.hexlify(digests), np.uint8).reshape(-1, _HEX)


def levels(leaves: np.ndarray, depth: int) -> list[np.ndarray]:
    """The nodes of `depth` levels above (and with) those given: full runs are rows of a reshaped matrix, hashed in turn."""
    out = [leaves]
    for _ in range(depth):
        nodes = out[-1]
        full = len(nodes) // FANOUT
        runs = nodes[: full * FANOUT].reshape(full, FANOUT * _HEX)
        digests = [sha256(run).digest() for run in runs]
        if len(nodes) > full * FANOUT:
            digests.append(sha256(nodes[full * FANOUT :].tobytes()).digest())
        out.append(matrix(b"".join(digests)))
    return out


def height(n: int) -> int:
    """Levels from n nodes to one."""
    out = 0
    while n > 1:
        n, out = -(-n // FANOUT), out + 1
    return out


def siblings(tree: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each node of the lowest level its siblings level by level, (n, 2 * depth, 64) hex bytes, and which of them exist."""
    n, other = len(tree[0]), FANOUT - 1
    found = np.zeros((n, depth * other, _HEX), np.uint8)
    there = np.zeros((n, depth * other), bool)
    at = np.arange(n)
    for level in range(depth):
        nodes = tree[level]
        begin, own = at // FANOUT * FANOUT, at % FANOUT
        for k in range(other):
            place = begin + k + (k >= own)
            there[:, level * other + k] = place < len(nodes)
            found[:, level * other + k] = nodes[np.minimum(place, len(nodes) - 1)]
        at = at // FANOUT
    return found, there


def fold(digest: bytes, path: bytes, place: int, n: int) -> tuple[bytes, bytes]:
    """(root, unused rest of the path) from a node's hex digest, its siblings end to end, its place and the number of nodes."""
    while n > 1:
        own = place % FANOUT
        more = min(FANOUT, n - (place - own)) - 1
        left, right = own * _HEX, more * _HEX
        digest = _hashed(path[:left] + digest + path[left:right])
        path, place, n = path[right:], place // FANOUT, -(-n // FANOUT)
    return digest, path


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its counted rows allow it; it must be a written table."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def placed(nodes: DataFrame, group: str, order: list[str]) -> DataFrame:
    """nodes with place (from 0, by order within the group) and n, the rows of the group; equal rows get places in any order.

    A sort by ranges cuts even a group of all rows evenly; the ranges' counts then give where each begins. nodes must be
    cheap to read twice, as a written table is.
    """
    spark = nodes.sparkSession
    ranges = common.partitions(spark)
    by = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    ordered = nodes.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id())
    ordered = common.written(ordered.withColumn("_range", F.shiftright("_row", 33)), "merkle-sorted")
    counts = ordered.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_c"), F.min("_row").alias("_first"))
    whole = Window.partitionBy(group)
    starts = counts.withColumns({"_before": F.sum("_c").over(whole.orderBy("_range")) - F.col("_c"), "n": F.sum("_c").over(whole)})
    starts = common.written(starts.select(F.col(group).alias("_g"), F.col("_range").alias("_k"), (F.col("_before") - F.col("_first")).alias("_shift"), "n"), "merkle-starts")
    both = ordered.join(_small(starts), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_k")))
    return both.withColumn("place", F.col("_row") + F.col("_shift")).drop("_row", "_range", "_g", "_k", "_shift")


def blocks(nodes: DataFrame, group: str, carried: list[str]) -> DataFrame:
    """group, block, n, digests and the carried columns as arrays, in order of place: a row for each aligned block."""
    size = FANOUT**DEPTH
    item = F.struct("place", "digest", *carried)
    rows = nodes.withColumn("block", F.floor(F.col("place") / size).cast("long")).groupBy(group, "block", "n").agg(F.array_sort(F.collect_list(item)).alias("_i"))
    whole = F.unhex(F.array_join(F.transform("_i", lambda x: F.hex(x["digest"])), ""))
    return rows.select(group, "block", "n", whole.alias("digests"), *[F.col("_i").getField(c).alias(c) for c in carried])


def tops(table: DataFrame, group: str) -> DataFrame:
    """group, place, n, digest: the node above each block, one of the n nodes of the next tier."""
    size = FANOUT**DEPTH
    kind = table.schema[group].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for digests, n in zip(batch.column("digests"), batch.column("n").to_pylist()):
            tree = levels(matrix(digests.as_py()), min(DEPTH, height(n)))
            out.append(binascii.unhexlify(tree[-1][0].tobytes()))
        above = pa.array([-(-n // size) for n in batch.column("n").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(group), batch.column("block"), above, pa.array(out, pa.binary())], [group, "place", "n", "digest"])

    return common.map_arrow(table.select(group, "block", "n", "digests"), run, f"{group} {kind}, place long, n long, digest binary")


def tiers(nodes: DataFrame, group: str, carried: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The written tables of blocks, lowest tier first, and (group, digest) of the roots. nodes: group, place, n, digest."""
    out = []
    while True:
        table = common.written(blocks(nodes, group, [] if out else carried), "merkle-blocks")
        out.append(table)
        nodes = common.written(tops(table, group), "merkle-tops")
        if nodes.where("n > 1").isEmpty():
            return out, nodes.select(group, "digest")


def descend(tables: list[DataFrame], group: str, above: DataFrame) -> DataFrame:
    """The lowest tier's blocks with path, the siblings above them in proof order, and the columns of above.

    above: group and what its root brings: path (siblings above the root, 64 hex bytes each) and more columns.
    """
    more = [c for c in above.columns if c not in (group, "path")]
    kinds = {f.name: f.dataType.simpleString() for f in above.schema}
    kind = kinds[group]
    paths = above.withColumn("place", F.lit(0).cast("long"))
    for table in reversed(tables):
        up = paths.withColumnsRenamed({group: "_g", "place": "_p"})
        paths = table.join(_small(up), F.col(group).eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_p"))).drop("_g", "_p")
        if table is tables[0]:
            return paths

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            size, places, all_paths, count = FANOUT**DEPTH, [], [], []
            for digests, n, block, path in zip(batch.column("digests"), batch.column("n").to_pylist(), batch.column("block").to_pylist(), batch.column("path")):
                leaves, depth, path = matrix(digests.as_py()), min(DEPTH, height(n)), path.as_py()
                found, there = siblings(levels(leaves, depth), depth)
                all_paths += [found[k][there[k]].tobytes() + path for k in range(len(leaves))]
                places += range(block * size, block * size + len(leaves))
                count.append(len(leaves))
            row = pa.array(np.repeat(np.arange(batch.num_rows), count))
            kept = [batch.column(c).take(row) for c in (group, *more)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(places, pa.int64()), pa.array(all_paths, pa.binary())], [group, *more, "place", "path"])

        schema = ", ".join([f"{group} {kind}", *[f"{c} {kinds[c]}" for c in more], "place long, path binary"])
        paths = common.written(common.map_arrow(paths.select(group, *more, "block", "n", "digests", "path"), run, schema), "merkle-paths")


def manifest(docs: DataFrame, with_proof: bool = True) -> DataFrame:
    """doc_id, source, place, n_source, leaf, subroot, root, proof_sha256, folded_root, verified for each row of docs.

    folded_root: what the proof and the tampered leaf, where there is one, lead to. with_proof: also proof, the siblings of
    the leaf from its level to the root, left to right.
    """
    spark = docs.sparkSession
    fields = [F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("source", "lang")], F.col("n_chars").cast("long").alias("n_chars"), F.col("text").cast("string").alias("text")]
    with common.scratch_but(spark, "merkle-sorted", "merkle-starts", "merkle-blocks", "merkle-paths"):
        hashed = docs.select(*fields).select("source", "doc_id", leaf_hash(F.col("text")).alias("digest"), leaf_hash(tampered_text()).alias("_t"))
        leaves = common.written(hashed.withColumn("other", F.nullif("_t", "digest")).drop("_t"), "merkle-leaves")
        tables, subroots = tiers(placed(leaves, "source", ["doc_id", "digest"]), "source", ["doc_id", "other"])
        of_sources = placed(subroots.withColumn("all", F.lit(1)), "all", ["source"])
        upper, root = tiers(of_sources, "all", ["source"])
        top = descend(upper, "all", root.select("all", F.col("digest").alias("root"), F.lit(b"").alias("path")))
        sources = common.written(_paths_of_sources(top), "merkle-paths")
        return _proofs(descend(tables, "source", sources), with_proof)


def _paths_of_sources(top: DataFrame) -> DataFrame:
    """source, subroot, root, path, s_place, s_n: what every source brings its own tree."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for row in batch.to_pylist():
            leaves, depth = matrix(row["digests"]), min(DEPTH, height(row["n"]))
            found, there = siblings(levels(leaves, depth), depth)
            for k, source in enumerate(row["source"]):
                rows.append((source, leaves[k].tobytes().decode(), row["root"].hex(), found[k][there[k]].tobytes() + row["path"], row["block"] * FANOUT**DEPTH + k, row["n"]))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()))], ["source", "subroot", "root", "path", "s_place", "s_n"])

    return common.map_arrow(top, run, "source string, subroot string, root string, path binary, s_place long, s_n long")


def _proofs(table: DataFrame, with_proof: bool) -> DataFrame:
    """The rows of the result from the lowest blocks and the paths above them."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
            leaves, depth, n = matrix(row["digests"]), min(DEPTH, height(row["n"])), row["n"]
            found, there = siblings(levels(leaves, depth), depth)
            first, root = row["block"] * FANOUT**DEPTH, row["root"]
            hexes, sums, folded, proofs = [], [], [], []
            for j, other in enumerate(row["other"]):
                leaf = leaves[j].tobytes()
                path = found[j][there[j]].tobytes() + row["path"]
                node, rest = fold(leaf if other is None else binascii.hexlify(other), path, first + j, n)
                hexes.append(leaf.decode())
                sums.append(sha256(path).hexdigest())
                folded.append(fold(node, rest, row["s_place"], row["s_n"])[0].decode())
                proofs.append([path[i : i + _HEX].decode() for i in range(0, len(path), _HEX)] if with_proof else None)
            m = len(hexes)
            columns = [pa.array(row["doc_id"], pa.int64()), pa.array([row["source"]] * m, pa.string()), pa.array(range(first, first + m), pa.int64()), pa.array([n] * m, pa.int64()), pa.array(hexes), pa.array([row["subroot"]] * m), pa.array([root] * m), pa.array(sums), pa.array(folded), pa.array([x == root for x in folded])]
            names = ["doc_id", "source", "place", "n_source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
            if with_proof:
                columns.append(pa.array(proofs, pa.list_(pa.string())))
                names.append("proof")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, source string, place long, n_source long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (", proof array<string>" if with_proof else "")
    return common.map_arrow(table, run, schema)


def digest(found: DataFrame) -> DataFrame:
    """The digest columns: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
