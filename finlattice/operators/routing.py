"""Routing of questions: weighted pattern scores per intent, arg-max, confidence, strategy and an adaptive gate.

Each intent's patterns become literal predicates over the text, evaluated in one pass without a join or a shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Intents in order of declaration (earlier wins ties), weights, strategies, patterns and reasons.
INTENTS = {
    "numerical_table": (1.0, "multimodal_rag", [
        "revenue", "breakdown", "by segment", "by product", "by region", "quarter", "table", "segment", "division", "million", "billion",
        r"\$[0-9.]+", "gross margin", "operating margin", "net income", "EPS", "earnings per share"]),
    "trend": (1.0, "multimodal_rag", [
        "trend", "growth", "increase", "decrease", "change", "over time", "year-over-year", "YoY", "QoQ", "chart", "graph", "trajectory", "momentum", "pattern"]),
    "comparison": (0.9, "multimodal_rag", [
        "vs", "versus", "compare", "comparison", "difference", "similar", "different", "ratio", "relative", "outperform", "better than", "worse than"]),
    "relationship": (1.0, "graphrag", [
        "supply chain", "suppliers?", "partners?", "competitors?", "subsidiaries?", "affiliates?", "joint venture", "acquisition", "merged", "owns",
        "owns stake in", "invested in", "collaboration", "partnership"]),
    "entity": (0.8, "graphrag", [
        "CEO", "CFO", "COO", "founder", "headquarters", "HQ", "located", "founded", "established", "employees", "market cap", "market capitalization",
        "industry", "sector", "executive"]),
    "general_knowledge": (0.5, "simple_rag", [
        "what is", "what does", "explain", "define", "describe", "tell me about", "overview", "summary", "introduction"]),
}
REASONS = {
    "general_knowledge": "General knowledge question → Using fast semantic search",
    "numerical_table": "Numerical/table query detected ({keywords}) → Extracting tables for accuracy",
    "trend": "Trend analysis query ({keywords}) → Using multimodal retrieval for charts/data",
    "comparison": "Comparison query ({keywords}) → Using multimodal RAG for side-by-side analysis",
    "relationship": "Relationship query ({keywords}) → Traversing knowledge graph",
    "entity": "Entity information query ({keywords}) → Querying entity database",
}
NO_MATCH = "No specific intent detected, using general knowledge search"
THRESHOLDS = {"numerical_table": 0.3, "trend": 0.3, "comparison": 0.3, "relationship": 0.3, "entity": 0.3, "general_knowledge": 0.2}


def display(pattern: str) -> str:
    """How a keyword is shown: the bounded pattern without the characters backslash and b at either end."""
    return rf"\b{pattern}\b".strip(r"\b")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fixed(pattern: str) -> str:
    """What every match of a pattern starts with, in lower case: its plain characters before an optional or repeated one."""
    if "|" in pattern:
        return ""
    return re.match(r"(?:(?:\\\W|[\w -])(?![?*+{]))*", pattern).group().replace("\\", "").lower()


def hits(text: str, low: str, intent: str) -> Column:
    """The displayed keywords of an intent that occur in the text column, in order; one expression, so plans build fast.

    low: a column of the text in lower case, where a pattern's fixed part is looked for before the pattern itself.
    """
    found = [rf"CASE WHEN contains(`{low}`, {_quoted(fixed(p))}) AND `{text}` RLIKE {_quoted(rf'(?i)\b{p}\b')} THEN {_quoted(display(p))} END" for p in INTENTS[intent][2]]
    return F.expr(f"filter(array({', '.join(found)}), k -> k IS NOT NULL)")


def classify(questions: DataFrame, text: str = "text") -> DataFrame:
    """questions with intent, strategy, confidence, reasoning and keywords_matched."""
    names = list(INTENTS)
    # made by a generator, which no later filter is pushed through, so that the patterns are evaluated once whatever is asked of the route
    out = questions.withColumn("_low", F.lower(text))
    out = out.select("*", F.inline(F.array(F.struct(*[hits(text, "_low", name).alias(f"_k{i}") for i, name in enumerate(names)])))).drop("_low")
    score = [F.size(f"_k{i}") / F.lit(float(len(INTENTS[n][2]))) * F.lit(INTENTS[n][0]) for i, n in enumerate(names)]
    out = out.withColumns({f"_s{i}": s for i, s in enumerate(score)})
    total = F.lit(0.0)
    for i in range(len(names)):
        total = total + F.col(f"_s{i}")
    out = out.withColumns({"_best": F.greatest(*[F.col(f"_s{i}") for i in range(len(names))]), "_total": total})

    def pick(values) -> Column:
        chosen = F.when(F.col("_s0") == F.col("_best"), values(0))
        for i in range(1, len(names)):
            chosen = chosen.when(F.col(f"_s{i}") == F.col("_best"), values(i))
        return chosen

    none = F.coalesce(F.col("_best"), F.lit(0.0)) == 0
    share = F.least(F.lit(1.0), F.col("_best") / F.col("_total"))
    sure = F.when(F.col("_best") > 0.3, F.least(F.lit(1.0), share + 0.2)).otherwise(share)
    words = pick(lambda i: F.col(f"_k{i}"))
    reason = pick(lambda i: F.replace(F.lit(REASONS[names[i]]), F.lit("{keywords}"), F.array_join(F.slice(f"_k{i}", 1, 3), ", ")))
    out = out.withColumns({
        "intent": F.when(none, "general_knowledge").otherwise(pick(lambda i: F.lit(names[i]))),
        "strategy": F.when(none, "simple_rag").otherwise(pick(lambda i: F.lit(INTENTS[names[i]][1]))),
        "confidence": F.when(none, 0.5).otherwise(F.bround(sure, 2)),
        "reasoning": F.when(none, NO_MATCH).otherwise(reason),
        "keywords_matched": F.when(none, F.array().cast("array<string>")).otherwise(words),
    })
    return out.drop(*[c for c in out.columns if c.startswith(("_k", "_s")) and c[2:].isdigit()], "_best", "_total")


def gate(routed: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Routes below the threshold of their intent fall back to general search; confidence and keywords stay."""
    limit = F.create_map(*[F.lit(x) for pair in (thresholds or THRESHOLDS).items() for x in pair])
    low = F.col("confidence") < F.element_at(limit, F.col("intent"))
    note = F.concat(F.lit("Low confidence ("), F.col("confidence").cast("string"), F.lit("), using fallback"))
    return routed.withColumns({
        "reasoning": F.when(low, note).otherwise(F.col("reasoning")),
        "strategy": F.when(low, "simple_rag").otherwise(F.col("strategy")),
        "intent": F.when(low, "general_knowledge").otherwise(F.col("intent")),
    })
