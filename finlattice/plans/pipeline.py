"""Questions to verified answers as one plan: route, draft, decompose, verify, regenerate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import claims, routing

NO_CONTEXT = "No relevant context found for your query."


def dispatch(routed: DataFrame, simple: DataFrame, tables: DataFrame, graph: DataFrame) -> DataFrame:
    """question_id, branch, ctx_pos, text: the contexts of each question's strategy, or the simple ones where it has none.

    routed: question_id, strategy. The branches: question_id, ctx_pos, text; contexts without text don't count. The branches
    are one table with a tag, which meets the questions once, so that a routing is worked out once.
    """
    branches = [("graph", 0, graph, "graphrag"), ("table", 0, tables, "multimodal_rag"), ("simple", 1, simple, None)]
    told = None
    for name, order, rows, use in branches:
        rows = rows.where(F.col("text").isNotNull() & (F.col("text") != "")).select("question_id", "ctx_pos", "text")
        part = rows.withColumns({"branch": F.lit(name), "_o": F.lit(order), "_use": F.lit(use).cast("string")})
        told = part if told is None else told.unionByName(part)
    asked = routed.select("question_id", "strategy").dropDuplicates(["question_id"])
    found = told.join(asked, "question_id").where(F.col("_use").isNull() | (F.col("_use") == F.col("strategy")))
    best = F.min("_o").over(Window.partitionBy("question_id"))
    return found.withColumn("_b", best).where("_o = _b").select("question_id", "branch", "ctx_pos", "text")


def answer(questions: DataFrame, drafts: DataFrame, contexts: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """question_id, intent, strategy, answer, confidence, n_claims, n_verified.

    drafts (answer_id, text) and contexts (answer_id, ctx_pos, text) are keyed by question. Questions without a context
    get the fixed sentence; without thresholds the adaptive gate is left out.
    """
    routed = routing.classify(questions)
    routed = routing.gate(routed, thresholds) if thresholds else routed
    verified = claims.regenerate_known(drafts, contexts).withColumnRenamed("answer_id", "question_id")
    out = routed.select("question_id", "intent", "strategy").join(verified, "question_id", "left")
    found = F.col("n_claims").isNotNull()
    return out.select(
        "question_id", "intent", "strategy", F.when(found, F.coalesce("answer", F.lit(claims.REFUSAL))).otherwise(NO_CONTEXT).alias("answer"),
        F.when(found, F.round(F.coalesce("confidence", F.lit(0.0)), 6)).otherwise(0.0).alias("confidence"), F.when(found, F.coalesce("n_claims", F.lit(0))).otherwise(0).alias("n_claims"), F.when(found, F.coalesce("n_verified", F.lit(0))).otherwise(0).alias("n_verified"),
    )
