"""An index of vectors for approximate top-k: k-means cells, product-quantised residuals, exact scores for what they select.

The table has a partition for each cell, with a row for every point: its id, the codes of its residual and its vector. A
search finds the nearest cells of each question, reads the codes of those cells alone, keeps the best `shortlist` points of
each question by code, and ranks them by exact cosine. Questions meet cells by number alone: their vectors go to the tasks
once for each round of questions, not once for each probe. The centres are fitted on a bounded sample (SAMPLE rows of each
cell, by the hash of the id); every row is indexed, and a large cell is dealt over several files.

Vectors have one length; others, and those that are null, zero or hold null or what isn't finite, match nothing in the exact
search either and stand in the cell -1, which no question reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut
from .retrieval import POINTS, _top, dense_top_k

#: Sample rows of a cell, most cells, codes of a part, rounds of fitting.
SAMPLE, MOST_CELLS, CODES, ROUNDS = 64, 4096, 256, 12
#: Questions of a row that meets a cell's points, rows of probes made at once, and points that a task keeps over all questions of a round.
ASKED, PROBED, KEPT = 256, 1 << 15, 1 << 19
#: Bytes of question vectors that go to the tasks at once, and probes up to which a search broadcasts them.
SENT, PAIRED = 16 << 20, 1 << 20


def _units(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows with a usable vector of this length, their vectors scaled to 1)."""
    fit = vectors.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.zeros(len(vectors), np.int64)
    sizes[fit] = vectors.filter(pa.array(fit)).value_lengths().to_numpy()
    rows = np.flatnonzero(sizes == dim)
    m = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    norm = np.sqrt((m * m).sum(axis=1))
    keep = (norm > 0) & np.isfinite(norm)
    return rows[keep], m[keep] / norm[keep, None]


def fit(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """At most k centres of x by k-means; a centre that loses all its rows moves to the row farthest from its own."""
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        nearest, far = nearest_of(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        count = np.bincount(nearest, minlength=len(centres))
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        lost = np.flatnonzero(count == 0)
        if len(lost):
            centres[lost] = x[np.argsort(-far)[: len(lost)]]
    return centres


def nearest_of(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and the squared distance less the row's own square."""
    half = (centres * centres).sum(axis=1)
    out, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    for at in range(0, len(x), 4096):
        d = half[None, :] - 2 * x[at : at + 4096] @ centres.T
        out[at : at + 4096] = d.argmin(axis=1)
        far[at : at + 4096] = d.min(axis=1)
    return out, far


class Codebook:
    """Centres of cells, and for each part of a vector the codes of what is left after the centre."""

    def __init__(self, centres: np.ndarray, parts: list[np.ndarray]):
        self.centres, self.parts = centres, parts
        self.edges = np.cumsum([0, *[p.shape[1] for p in parts]]).tolist()

    @classmethod
    def fitted(cls, sample: np.ndarray, cells: int, parts: int, seed: int = 0) -> Codebook:
        rng = np.random.default_rng(seed)
        centres = fit(sample, min(cells, len(sample)), rng)
        rest = sample - centres[nearest_of(sample, centres)[0]]
        widths = np.array_split(np.arange(sample.shape[1]), min(parts, sample.shape[1]))
        return cls(centres, [fit(rest[:, w], min(CODES, len(rest)), rng) for w in widths])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell, _ = nearest_of(x, self.centres)
        rest = x - self.centres[cell]
        codes = [nearest_of(rest[:, a:b], p)[0] for p, a, b in zip(self.parts, self.edges, self.edges[1:])]
        return cell, np.stack(codes, axis=1).astype(np.uint8)

    def scores(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Estimated products of questions (rows) with coded points of a cell."""
        out = np.repeat((q @ self.centres[cell])[:, None], len(codes), axis=1)
        for n, (p, a, b) in enumerate(zip(self.parts, self.edges, self.edges[1:])):
            out += (q[:, a:b] @ p.T)[:, codes[:, n]]
        return out


class _Pool:
    """The k best points of each question over all cells that a task sees; cut back whenever it has grown by ROOM rows."""

    ROOM = 1 << 19

    def __init__(self, k: int):
        self.k, self.rows = k, 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, names: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        least = np.partition(scores, -self.k, axis=1)[:, -self.k] if scores.shape[1] > self.k else np.full(len(names), -np.inf)
        row, column = np.nonzero(scores >= least[:, None])
        self.parts.append((names[row], ids[column], scores[row, column]))
        self.rows += len(row)
        if self.rows > self.ROOM:
            self.parts, self.rows = [self.best()], 0

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(questions, points, scores), the k best of each question by score and then by id."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        names, ids, scores = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((ids, -scores, names))
        names = names[order]
        keep = np.arange(len(names)) - np.searchsorted(names, names) < self.k
        return names[keep], ids[order][keep], scores[order][keep]


class VectorIndex:
    """An index in a folder: `points` by cell, and the codebook as a small table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, points: DataFrame, dim: int, cells: int | None = None, parts: int = 16) -> None:
        """points: point_id, dense. cells: the root of the rows where not given, MOST_CELLS at most."""
        rows = points.select(F.col("point_id").cast("long").alias("point_id"), F.col("dense").cast("array<double>").alias("dense"))
        cells = cells or max(1, min(MOST_CELLS, round(rows.count() ** 0.5)))
        sample = rows.where(F.size("dense") == dim).orderBy(F.xxhash64("point_id"), "point_id").limit(SAMPLE * cells).toArrow()  # bounded
        _, x = _units(sample.column("dense").combine_chunks(), dim)
        book = Codebook.fitted(x if len(x) else np.ones((1, dim)), cells, parts)
        told = [("centre", n, v.tolist()) for n, v in enumerate(book.centres)] + [(f"part{k}", n, v.tolist()) for k, p in enumerate(book.parts) for n, v in enumerate(p)]
        self.spark.createDataFrame(told, "kind string, n int, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/codebook")
        shared = self.spark.sparkContext.broadcast(book)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, unit = _units(batch.column("dense"), dim)
                cell, codes = np.full(batch.num_rows, -1, np.int32), [None] * batch.num_rows
                if len(at):
                    cell[at], coded = shared.value.encode(unit)
                    for r, code in zip(at.tolist(), coded):
                        codes[r] = code.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("point_id"), batch.column("dense"), pa.array(cell), pa.array(codes, pa.binary())], ["point_id", "dense", "cell", "code"])

        coded = rows.mapInArrow(run, "point_id long, dense array<double>, cell int, code binary")
        coded.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/points")

    def codebook(self) -> Codebook:
        rows = self.spark.read.parquet(f"{self.path}/codebook").orderBy("kind", "n").collect()  # bounded: centres and codes
        kinds = {r.kind for r in rows} - {"centre"}
        of = lambda kind: np.array([r.v for r in rows if r.kind == kind])
        return Codebook(of("centre"), [of(f"part{k}") for k in range(len(kinds))])

    def calibrate(self, points: DataFrame, k: int = 20, target: float = 0.97, sample: int = 256) -> int:
        """Set how many cells a search probes: as many as hold the share `target` of the k exact neighbours of sampled points.

        The sample is bounded (the first rows by the hash of the id); its exact neighbours take one pass over the points.
        """
        book = self.codebook()
        dim = book.centres.shape[1]
        asked = cut(points.where(F.size("dense") == dim).orderBy(F.xxhash64("point_id"), "point_id").limit(sample).select(F.col("point_id").cast("long").alias("question_id"), F.col("dense").cast("array<double>").alias("embedding")))
        cells = self.spark.read.parquet(f"{self.path}/points").select("point_id", "cell")
        near = dense_top_k(asked, points, k).select("question_id", "point_id").join(cells, "point_id").toArrow()  # sample * k rows
        told = asked.toArrow()
        at, unit = _units(told.column("embedding").combine_chunks(), dim)
        order = np.argsort((book.centres**2).sum(axis=1)[None, :] / 2 - unit @ book.centres.T, axis=1)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
        row = {q: n for n, q in enumerate(told.column("question_id").to_numpy()[at].tolist())}
        needed = place[[row[q] for q in near.column("question_id").to_pylist()], near.column("cell").to_numpy()] + 1 if near.num_rows else np.ones(1)
        probes = int(np.sort(needed)[min(len(needed) - 1, int(np.ceil(target * len(needed))))])
        self.spark.createDataFrame([(probes,)], "probes int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/settings")
        return probes

    def search(self, questions: DataFrame, k: int = 20, probes: int | None = None, shortlist: int = 20) -> DataFrame:
        """question_id, point_id, score, rank: the best k by exact cosine among the shortlist * k best of `probes` cells by code.

        questions: question_id, embedding. Questions whose vector doesn't fit the index find nothing. probes: what the index
        was calibrated to where not given.
        """
        probes = probes or self.spark.read.parquet(f"{self.path}/settings").first().probes
        book = self.codebook()
        dim, shared, wanted = book.centres.shape[1], self.spark.sparkContext.broadcast(book), k * shortlist

        def probed(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Rows of a batch and the cells that each probes, some PROBED at once."""
            at, unit = _units(batch.column("vector"), dim)
            centres = shared.value.centres
            n = min(probes, len(centres))
            half, few = (centres**2).sum(axis=1) / 2, max(1, PROBED // n)
            for a in range(0, len(at), few):
                yield at[a : a + few], np.argsort(half[None, :] - unit[a : a + few] @ centres.T, axis=1)[:, :n].astype(np.int32)

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                numbers = batch.column("number").to_numpy()
                for at, near in probed(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(numbers[at], near.shape[1])), pa.array(near.reshape(-1))], ["number", "cell"])

        def any_probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, near in probed(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(near))], ["cell"])

        asked = questions.select(F.col("question_id").cast("long").alias("question_id"), F.col("embedding").cast("array<double>").alias("vector")).where(F.col("question_id").isNotNull() & (F.size("vector") == dim))
        asked = cut(asked.withColumn("number", F.monotonically_increasing_id()))
        cells = sorted(r[0] for r in asked.select("vector").mapInArrow(any_probe, "cell int").distinct().collect())  # MOST_CELLS at most
        points = self.spark.read.parquet(f"{self.path}/points").where(F.col("cell").isin(cells))
        tasks = 2 * self.spark.sparkContext.defaultParallelism
        codes = _by_cell(points.select("point_id", "cell", "code").coalesce(tasks), "point_id", "code")  # a task keeps its best of each question, however much it reads
        total = asked.count()
        rounds = max(1, -(-total * wanted // KEPT), -(-total * dim * 8 // SENT))  # a task keeps at most `wanted` points of each question of a round
        small = total * probes <= PAIRED

        def scored(mine: DataFrame) -> DataFrame:
            """question_id, point_id, score: at most `wanted` rows of each question of a round for each task."""
            told = mine.orderBy("number").toArrow()  # bounded: SENT
            at, unit = _units(told.column("vector").combine_chunks(), dim)
            sent = self.spark.sparkContext.broadcast((told.column("number").to_numpy()[at], told.column("question_id").to_numpy()[at], unit))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                pool = _Pool(wanted)
                numbers, questions, units = sent.value
                for batch in batches:
                    for r in range(batch.num_rows):
                        raw = lambda c, kind: np.frombuffer(batch.column(c)[r].as_buffer(), kind)  # noqa: E731, B023
                        rows, ids = np.searchsorted(numbers, raw("q_ids", np.int64)), raw("ids", np.int64)
                        pool.add(questions[rows], ids, shared.value.scores(units[rows], batch.column("cell")[r].as_py(), raw("code", np.uint8).reshape(len(ids), -1)))
                names, ids, scores = pool.best()
                if len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(ids), pa.array(scores)], ["question_id", "point_id", "score"])

            pairs = _by_cell(mine.mapInArrow(probe, "number long, cell int").repartition("cell"), "number", None, ASKED).withColumnRenamed("ids", "q_ids")
            met = codes.join(F.broadcast(pairs), "cell") if small else codes.join(pairs, "cell").coalesce(tasks)
            return met.mapInArrow(run, "question_id long, point_id long, score double")

        out = None
        for r in range(rounds):
            part = scored(asked if rounds == 1 else asked.where(F.pmod(F.xxhash64("number"), F.lit(rounds)) == r))
            out = part if out is None else out.unionByName(part)
        near = _top(out, wanted, "score", ["point_id"])
        vectors = asked.select("question_id", "vector")
        full = near.select("question_id", "point_id").join(points.select("point_id", "dense"), "point_id").join(F.broadcast(vectors) if total * dim * 8 <= SENT else vectors, "question_id")
        return _top(full.select("question_id", "point_id", F.round(T.cosine(F.col("vector"), F.col("dense")), 9).alias("score")), k, "score", ["point_id"])


def _by_cell(df: DataFrame, ids: str, value: str | None, most: int = POINTS) -> DataFrame:
    """cell, ids and, with a value, code: rows of a cell that stand in one batch, `most` at most, end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            for c in np.unique(cell).tolist():
                mine = np.flatnonzero(cell == c)
                for at in range(0, len(mine), most):
                    part = batch.take(pa.array(mine[at : at + most]))
                    told = {"cell": pa.array([c], pa.int32()), "ids": pa.array([part.column(ids).to_numpy().tobytes()])}
                    if value:
                        told["code"] = pa.array([b"".join(part.column(value).to_pylist())])
                    yield pa.RecordBatch.from_pydict(told)

    return df.select(ids, "cell", *([value] if value else [])).mapInArrow(run, "cell int, ids binary" + (", code binary" if value else ""))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """question_id, n, recall: the share of the exact results that were found; n exact ones."""
    hit = found.select("question_id", "point_id", F.lit(1).alias("_h"))
    return exact.select("question_id", "point_id").join(hit, ["question_id", "point_id"], "left").groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("_h", F.lit(0)).cast("double")).alias("recall"))
