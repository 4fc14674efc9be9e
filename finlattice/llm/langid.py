"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent in numpy.

Subwords are runs of two to four bytes of the text with ASCII letters lower-cased and other ASCII turned into spaces. As
the score of a text is linear in its subwords, the trained embeddings and output weights are folded into one table of a
row per bucket, which predicts whole texts. Training reads whole texts of labelled documents outside the held-out fold:
at most SAMPLE rows and SAMPLE_BYTES, those of least hash; a fifth of them calibrates temperature and rejection threshold.
Only text and lang are learnt from; only text is predicted from.

Defined cases: null text or text without a letter is `und` with score 0 and rejected; rows without lang, text or doc_id
aren't learnt from; without any labelled row everything is `und` and nothing is rejected; a
model that labels no calibration text right has threshold 0; texts of any length are scored in steps of bounded memory; repeated rows give repeated
rows; an empty table gives no rows; columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bounds of the training sample, in rows and in bytes of their texts together.
SAMPLE, SAMPLE_BYTES = 1500, 24 << 20
#: Every third text is also learnt in pieces of so many bytes, all of them, for the sake of short texts.
PIECE = 200
ORDERS, BITS, DIMS, EPOCHS, RATE, BATCH = (2, 3, 4), 15, 16, 6, 0.5, 32
#: At most this share of rightly labelled calibration snippets may be rejected.
REJECT = 0.001
#: The threshold is at most this many times the score of a guess: texts of several languages aren't rejected for it.
CHANCE = 1.4
_PIECE = 1 << 20
#: Numbers in a table of a row for each byte and a column for each label.
_CELLS = 4 << 20
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def subwords(data: np.ndarray) -> list[np.ndarray]:
    """For each order the bucket of the subword that begins at each byte; the last order - 1 bytes begin none."""
    folded = _FOLD[data].astype(np.uint32)
    out = []
    for k, n in enumerate(ORDERS):
        code = np.zeros(max(0, len(folded) - n + 1), np.uint32)
        for j in range(n):
            code = code << np.uint32(8) | folded[j : j + len(code)]
        out.append(((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32) + np.int32(k << BITS))
    return out


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # a row of len(labels) for each bucket, and a last row of zeros
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Scores of each document (rows of whole texts laid end to end)."""
        size = np.diff(offsets)
        out = np.zeros((len(size), len(self.labels)))
        none, most = len(self.table) - 1, max(ORDERS)
        step = max(1 << 12, _CELLS // max(1, len(self.labels)))  # bytes whose rows are held at once
        for a in range(0, len(data), step):
            b = min(len(data), a + step)
            first, last = int(np.searchsorted(offsets, a, side="right")) - 1, int(np.searchsorted(offsets, b, side="left"))
            edges = np.clip(offsets[first : last + 1], a, b) - a
            full = np.flatnonzero(np.diff(edges))
            rows = np.zeros((b - a, len(self.labels)), np.float32)
            for n, ids in zip(ORDERS, subwords(data[a : b + most - 1])):
                ids = np.append(ids[: b - a], np.full(max(0, b - a - len(ids)), none, np.int32))
                ends = offsets[(offsets > a) & (offsets < b + n)]
                for j in range(1, n):  # subwords don't cross into the next document
                    at = ends - j - a
                    ids[at[(at >= 0) & (at < b - a)]] = none
                rows += self.table[ids]
            out[first:last][full] += np.add.reduceat(rows, edges[:-1][full], axis=0, dtype=np.float64)
        count = sum(np.maximum(size - n + 1, 0) for n in ORDERS)
        return out / np.maximum(count, 1)[:, None] + self.bias

    def scores(self, logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = logits / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return p.argmax(axis=1), p.max(axis=1)


def train(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """A model from (lang, text) rows."""
    labels = sorted({lang for lang, _ in rows})
    buckets = len(ORDERS) << BITS
    if not labels:
        return Model([], np.zeros((buckets + 1, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    rows = [rows[k] for k in rng.permutation(len(rows))]
    held = rows[: -(-len(rows) // 5)]
    examples = []
    for k, (lang, text) in enumerate(rows[len(held) :] or rows):  # a single row serves for both
        data = np.frombuffer(text.encode(), np.uint8)
        cuts = range(0, len(data), PIECE) if k % 3 == 0 else ()
        for part in (data, *(data[at : at + PIECE] for at in cuts)):
            ids, count = np.unique(np.concatenate(subwords(part)), return_counts=True)
            if len(ids):
                examples.append((labels.index(lang), ids, (count / count.sum()).astype(np.float32)))
    emb = rng.uniform(-1 / DIMS, 1 / DIMS, (buckets, DIMS)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (DIMS, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32)
    steps = EPOCHS * max(1, -(-len(examples) // BATCH))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(examples))
        for at in range(0, len(order), BATCH):
            rate = RATE * (1 - step / steps)
            step += 1
            part = [examples[k] for k in order[at : at + BATCH]]
            size = np.array([len(ids) for _, ids, _ in part])
            flat, weight = np.concatenate([ids for _, ids, _ in part]), np.concatenate([w for *_, w in part])[:, None]
            first = np.cumsum(size) - size
            mean = np.add.reduceat(emb[flat] * weight, first, axis=0)
            z = mean @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), [y for y, *_ in part]] -= 1
            back = (p @ out.T) * rate
            out -= rate * mean.T @ p
            bias -= rate * p.sum(axis=0) / len(part)
            by = np.argsort(flat, kind="stable")
            heads = np.flatnonzero(np.append(True, np.diff(flat[by]) > 0))
            emb[flat[by][heads]] -= np.add.reduceat((np.repeat(back, size, axis=0) * weight)[by], heads, axis=0).astype(np.float32)
    table = np.vstack([emb @ out, np.zeros((1, len(labels)), np.float32)]).astype(np.float32)
    model = Model(labels, table, bias.astype(np.float64))
    _calibrate(model, held)
    return model


def _calibrate(model: Model, held: list[tuple[str, str]]) -> None:
    texts = [t.encode() for _, t in held]
    offsets = np.cumsum([0] + [len(t) for t in texts])
    logits = model.logits(np.frombuffer(b"".join(texts), np.uint8), offsets)
    truth = np.array([model.labels.index(lang) if lang in model.labels else -1 for lang, _ in held])
    known = truth >= 0

    def loss(t: float) -> float:
        z = logits[known] / t
        z -= z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth[known]]).mean())

    model.temperature = min((0.1, 0.15, 0.2, 0.3, 0.5, 0.7, 1.0, 1.5, 2.0, 3.0), key=loss)
    best, score = model.scores(logits)
    right = score[known & (best == truth)]
    if len(right):
        model.threshold = float(min(CHANCE / len(model.labels), np.quantile(right, REJECT)))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def sample(docs: DataFrame, rows: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> list[tuple[str, str]]:
    """The training rows, whole texts in the order of a hash up to both bounds, which don't grow with the table.

    Labelled rows are counted first, and a hash lets about twice the bound through, so tasks send few rows to the driver.
    A text that would go beyond the bytes is left out as a whole, and so is what follows it.
    """
    part = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    total = docs.where(F.col("lang").isNotNull()).count()
    share = min(1.0, 2.5 * rows / max(total, 1))
    size = F.octet_length("text").cast("long")
    part = part.select(F.xxhash64("doc_id", F.lit("sample")).alias("seed"), F.col("lang").cast("string").alias("lang"), F.col("text").alias("text"), size.alias("size"))
    part = part.where(F.pmod("seed", F.lit(1_000_000)) < int(share * 1_000_000) + 1).where(F.col("size") <= most_bytes)
    order = ["seed", "lang", "text"]
    above = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over at most `rows` rows
    picked = part.orderBy(*order).limit(rows).withColumn("held", F.sum("size").over(above)).where(F.col("held") <= most_bytes)
    return [(r[0], r[1]) for r in picked.select("lang", "text").collect()]


def _has_letter(text: bytes) -> bool:
    at, step = 0, 64
    while at < len(text):
        stop = min(len(text), at + step)
        while stop < len(text) and text[stop] & 0xC0 == 0x80:  # not inside a character
            stop += 1
        if any(c.isalpha() for c in text[at:stop].decode("utf-8", "replace")):
            return True
        at, step = stop, 1 << 16
    return False


def _judge(m: Model, text: pa.Array) -> tuple[list[str], list[float], list[bool]]:
    """Label, score and acceptance of each text."""
    data, offsets = common.utf8(text)
    raw = data.tobytes()
    names, scores = [], []
    for lo, hi in common.pieces(offsets, _PIECE):
        if not m.labels:
            names += ["und"] * (hi - lo)
            scores += [0.0] * (hi - lo)
            continue
        best, p = m.scores(m.logits(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
        for k in range(hi - lo):
            mine = raw[offsets[lo + k] : offsets[lo + k + 1]]
            letters = _has_letter(mine)
            names.append(m.labels[best[k]] if letters else "und")
            scores.append(float(p[k]) if letters else 0.0)
    return names, scores, [not m.labels or n != "und" and s >= m.threshold for n, s in zip(names, scores)]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, accepted: one row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def one(batch: pa.RecordBatch):
        names, scores, accepted = _judge(shared.value, batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())], ["doc_id", "lang_pred", "score", "accepted"])

    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), one, "doc_id long, lang_pred string, score double, accepted boolean")


def accepted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents that the model doesn't reject, with all their columns; all of them where nothing could be learnt."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(sample(docs)))
    at = docs.columns.index("text")

    def one(batch: pa.RecordBatch):
        yield batch.filter(pa.array(_judge(shared.value, batch.column(at))[2], pa.bool_()))

    return common.map_arrow(docs, one, docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, train(sample(docs)))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
