"""Near-duplicate vectors by Euclidean p-stable hashing, confirmed by exact cosines.

Normalised vectors of cosine c lie sqrt(2 - 2c) apart. Each table quantises some random Gaussian projections to cells of
width CELL; vectors that share label, table and cells meet, and their cosine decides. `plan` takes as many projections as
keep unrelated vectors of the largest label apart (their number grows with the logarithm of its rows, so the work for a
vector hardly grows), and as many tables as miss a pair at the threshold with probability MISS, closer ones hardly ever.
A bucket only yields a spanning forest of its links. The links of a vector all lie in its component, so they are then
counted there, over all pairs of the component, in blocks: no link inside a component depends on a bucket.

Equal vectors of a label are one node and count by their number. Defined cases: vectors that are null, empty or zero, or
hold null, NaN or infinite values, or have no label, link with nothing and are kept; vectors of other lengths never link;
repeated rows are vectors of their own that share an id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .minhash import spanning

LEAST, CELL, MISS = 0.98, 2.0, 1e-5
#: Unrelated vectors that a vector may meet in all its tables together, as expected for right angles.
CHANCE = 0.5
BUCKET = 1000
_ROWS = 256


def collision(distance: float, cell: float = CELL) -> float:
    """Probability that two points at a distance share a cell of one projection."""
    r = cell / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def plan(rows: int, least: float = LEAST) -> tuple[int, int]:
    """(tables, projections of each) for labels of up to `rows` vectors."""
    near, far = collision(math.sqrt(2 - 2 * least)), collision(math.sqrt(2))
    projections = 1
    while True:
        tables = math.ceil(math.log(MISS) / math.log1p(-(near**projections)))
        if tables * far**projections * rows <= CHANCE:
            return tables, projections
        projections += 1


@lru_cache(4)
def _projections(dim: int, tables: int, projections: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(dim)
    return rng.normal(size=(dim, tables * projections)), rng.uniform(0, CELL, tables * projections)


def units(vectors: np.ndarray) -> np.ndarray:
    """Normalised rows; scaled first, so that very small and very large values keep their direction."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def keys(unit: np.ndarray, label: np.ndarray, tables: int, projections: int) -> np.ndarray:
    """A 64-bit bucket key for each row and table."""
    direction, shift = _projections(unit.shape[1], tables, projections)
    cells = np.floor((unit @ direction + shift) / CELL).astype(np.int64).astype(np.uint64).reshape(len(unit), tables, projections)
    out = common.mix64(label.astype(np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93) + np.arange(tables, dtype=np.uint64) + np.uint64(unit.shape[1] << 32))
    for k in range(projections):
        out = common.mix64(out * np.uint64(0xA0761D6478BD642F) + cells[:, :, k])
    return out.view(np.int64)


def _clean(rows: DataFrame, tables: int, projections: int) -> DataFrame:
    """vec_id, label and the normalised vector as bytes (null where it links with nothing) with its cells' keys."""

    def one(batch: pa.RecordBatch):
        vectors, labels = batch.column("embedding").to_pylist(), batch.column("label").to_pylist()
        unit, cells = [None] * len(vectors), [None] * len(vectors)
        by_dim: dict[int, list[int]] = {}
        for k, (v, label) in enumerate(zip(vectors, labels)):
            if v and label is not None and None not in v:
                by_dim.setdefault(len(v), []).append(k)
        for rows in by_dim.values():
            at = np.array(rows)
            x = np.array([vectors[k] for k in rows], float)
            fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            at, x = at[fine], x[fine]
            if len(at):
                u = units(x)
                key = keys(u, np.array([labels[k] for k in at.tolist()], np.int64), tables, projections)
                for k, row, c in zip(at.tolist(), u, key):
                    unit[k], cells[k] = row.tobytes(), c
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(unit, pa.binary()), pa.array(cells, pa.list_(pa.int64()))], ["vec_id", "label", "unit", "cells"])

    picked = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return common.map_arrow(picked, one, "vec_id long, label long, unit binary, cells array<long>")


def _matrix(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("unit").to_pylist()), float).reshape(table.num_rows, -1)


def _bucket_edges(least: float):
    def edges(table: pa.Table, starts: np.ndarray):
        ids = table.column("rep").to_numpy()
        raw = table.column("unit").combine_chunks()
        size = np.diff(starts)
        a, b = [], []
        two = starts[:-1][size == 2]
        first, second = (raw.take(pa.array(two + j)).to_pylist() for j in (0, 1))
        if len({len(v) for v in first + second}) == 1:  # vectors of one length, as usual
            x, y = (np.frombuffer(b"".join(v), float).reshape(len(two), -1) for v in (first, second))
            two = two[(x * y).sum(axis=1) >= least - 1e-12]
        pairs = [(int(lo), 2) for lo in two] + list(zip(starts[:-1][size > 2].tolist(), size[size > 2].tolist()))
        for lo, n in pairs:
            x = np.frombuffer(b"".join(raw.slice(lo, n).to_pylist()), float).reshape(n, -1)
            for u, v in spanning(n, lambda u, others: x[others] @ x[u] >= least):  # noqa: B023
                a.append(int(ids[lo + u]))
                b.append(int(ids[lo + v]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return edges


def _link_counts(least: float):
    """Links of each row within a part: all pairs of a block, or the pairs between the two blocks."""

    def counts(table: pa.Table, starts: np.ndarray):
        reps, links = [], []
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
            part = table.slice(lo, hi - lo)
            ids, weight, x = part.column("rep").to_numpy(), part.column("copies").to_numpy(), _matrix(part)
            block, i, j = part.column("block").to_numpy(), part.column("part_i")[0].as_py(), part.column("part_j")[0].as_py()
            sides = [(np.arange(len(ids)), np.arange(len(ids)))] if i == j else [(np.flatnonzero(block == i), np.flatnonzero(block == j)), (np.flatnonzero(block == j), np.flatnonzero(block == i))]
            for mine, others in sides:
                for at in range(0, len(mine), _ROWS):
                    rows = mine[at : at + _ROWS]
                    near = x[rows] @ x[others].T >= least
                    near[rows[:, None] == others[None, :]] = False
                    reps.append(ids[rows])
                    links.append(near @ weight[others])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(reps), pa.int64()), pa.array(np.concatenate(links).astype(np.int64))], ["rep", "links"])

    return counts


def near_duplicates(rows: DataFrame, least: float = LEAST, bucket: int = BUCKET) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row."""
    with common.scratch_but(rows.sparkSession, "units", "counted-links"):
        return _near_duplicates(rows, least, bucket)


def _near_duplicates(rows: DataFrame, least: float, bucket: int) -> DataFrame:
    largest = rows.where("label is not null").groupBy("label").count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
    clean = common.written(_clean(rows, *plan(largest, least)).withColumns({"h1": F.xxhash64("label", "unit"), "h2": F.xxhash64(F.lit("second"), "label", "unit")}), "units")
    good = clean.where("unit is not null and vec_id is not null")
    same = ["label", "h1", "h2"]
    reps = common.written(good.groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "heads")
    heads = good.join(reps.withColumnRenamed("rep", "vec_id"), [*same, "vec_id"]).select(F.col("vec_id").alias("rep"), "copies", "unit", "cells", *same)
    heads = common.written(heads.dropDuplicates(["rep", *same]), "head-vectors")
    # One id with several vectors would be one node; its rows then share their component.
    keyed = common.bounded_groups(heads.select("rep", "h1", "h2", F.explode("cells").alias("key")), "key", bucket, "rep")
    runs = ["key", "part_i", "part_j"]
    members = keyed.join(heads.select("rep", "h1", "h2", "unit"), ["rep", "h1", "h2"])
    links = common.map_runs(members.select(*runs, "rep", "unit"), runs, _bucket_edges(least), "a long, b long")
    groups = common.written(components(links).select(F.col("node").alias("rep"), F.col("root").alias("grp")), "groups")
    parts = ["grp", "part_i", "part_j"]
    held = common.bounded_groups(heads.select("rep", "copies", "unit").join(groups, "rep"), "grp", bucket, "rep")
    counted = common.map_runs(held.select(*parts, "block", "rep", "copies", "unit"), parts, _link_counts(least), "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))
    named = reps.join(groups, "rep", "left").join(counted, "rep", "left")
    named = named.select(*same, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("grp", "rep").alias("root"))
    out = clean.join(common.written(named, "counted-links"), same, "left")
    fine = F.col("unit").isNotNull() & F.col("vec_id").isNotNull()
    out = out.select("vec_id", F.when(fine, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), F.when(fine, F.col("root")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
