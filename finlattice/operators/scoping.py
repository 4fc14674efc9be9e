"""Document scoping: which (ticker, year, type) a question is about, checked against a registry, and retrieval within it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieval import _top, dense_top_k

#: Confidence of a question whose document the registry doesn't have, and below which the whole corpus is searched.
UNKNOWN, FULL_CORPUS = 0.3, 0.5


def scope(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """requests (question_id, ticker, year, type, sections, confidence) with known, the sections that the document has, and confidence.

    registry: ticker, year, type, known_sections, unique in its first three columns.
    """
    both = requests.join(registry.withColumn("_known", F.lit(True)), ["ticker", "year", "type"], "left")
    known = F.coalesce("_known", F.lit(False))
    return both.select(
        "question_id", "ticker", "year", "type", known.alias("known"), F.when(known, F.array_intersect("sections", "known_sections")).otherwise(F.array().cast("array<string>")).alias("sections"),
        F.when(known, F.col("confidence")).otherwise(F.lit(UNKNOWN)).alias("confidence"),
    )


def scoped_top_k(scoped: DataFrame, questions: DataFrame, points: DataFrame, k: int = 5, within: int | None = None) -> DataFrame:
    """Dense top-k of each question within its ticker, or over all points where its scope is unsure. points: point_id, dense, ticker.

    within: how many a sure scope gives, k if not set; a reranker is given 2 * k. With a column `section` points also have to be of one of the scope's sections; a scope without sections finds nothing.
    """
    within = within or k
    if "section" in points.columns:
        wide = scoped.select("question_id", "ticker", "confidence", F.explode("sections").alias("_s"))
        inside = questions.join(wide, "question_id").where(F.col("confidence") >= FULL_CORPUS).withColumn("_in", F.concat_ws("\1", "ticker", "_s"))
        # a question asks once for each section; the best k of all its sections are among the best k of each
        keyed = inside.select(F.xxhash64("question_id", "_s").alias("_ask"), "question_id", "embedding", "_in")
        found = dense_top_k(keyed.select(F.col("_ask").alias("question_id"), "embedding", "_in"), points.withColumn("_in", F.concat_ws("\1", "ticker", "section")), within, ticker="_in")
        found = found.join(keyed.select(F.col("_ask").alias("_a"), F.col("question_id").alias("_q")), F.col("question_id") == F.col("_a")).select(F.col("_q").alias("question_id"), "point_id", "score")
        outside = dense_top_k(questions.join(scoped.select("question_id", "confidence"), "question_id").where(F.col("confidence") < FULL_CORPUS), points, k)
        return _top(found, within, "score", ["point_id"]).unionByName(outside)
    asked = questions.join(scoped.select("question_id", "ticker", "confidence"), "question_id")
    inside = dense_top_k(asked.where(F.col("confidence") >= FULL_CORPUS), points, within, ticker="ticker")
    outside = dense_top_k(asked.where(F.col("confidence") < FULL_CORPUS), points, k)
    return inside.unionByName(outside)
