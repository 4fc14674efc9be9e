"""Adaptive thresholds over a stream of feedback, with state in the query."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.feedback import GATE, HIGH_RATE, LEAST, LOW_RATE, MOST, STEP
from ..operators.routing import THRESHOLDS


def advance(state: tuple[int, dict[str, list[int]], dict[str, float]], records: list[tuple[str, bool]]) -> tuple[int, dict[str, list[int]], dict[str, float]]:
    """(records so far, helpful and total per intent, thresholds) after more records in order."""
    n, counts, limits = state
    for intent, helpful in records:
        n += 1
        mine = counts.setdefault(intent, [0, 0])
        mine[0] += bool(helpful)
        mine[1] += 1
        if n >= GATE:
            for name, (good, total) in counts.items():
                rate = good / total
                if rate < LOW_RATE:
                    limits[name] = min(MOST, limits.get(name, 0.3) + STEP)
                elif rate > HIGH_RATE:
                    limits[name] = max(LEAST, limits.get(name, 0.3) - STEP)
    return n, counts, limits


def adaptive_thresholds(feedback: DataFrame, start: dict[str, float] | None = None) -> DataFrame:
    """A stream (seq, intent, was_helpful) to updates (n, intent, threshold), one for each intent seen and micro-batch.

    Every record can move every intent's threshold, so the state has one key; it holds counts, not the history.
    """
    first = dict(start or THRESHOLDS)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            n, names, good, total, limits = state.get
            held = (n, {k: [g, t] for k, g, t in zip(names, good, total)}, first | dict(zip(names, limits)))
        else:
            held = (0, {}, dict(first))
        rows = pd.concat(list(batches)).sort_values("seq")
        held = advance(held, list(zip(rows["intent"], rows["was_helpful"])))
        names = sorted(held[1])
        limits = [round(held[2].get(k, 0.3), 6) for k in names]
        state.update((held[0], names, [held[1][k][0] for k in names], [held[1][k][1] for k in names], limits))
        yield pd.DataFrame({"n": held[0], "intent": names, "threshold": limits})

    return feedback.withColumn("one", F.lit(1)).groupBy("one").applyInPandasWithState(
        update, "n long, intent string, threshold double", "n long, names array<string>, good array<long>, total array<long>, limits array<double>", "update", GroupStateTimeout.NoTimeout
    )


def route_stream(questions: DataFrame) -> DataFrame:
    """Routing is stateless, so a stream of questions is routed as a table is."""
    from ..operators.routing import classify, gate

    return gate(classify(questions))


def feedback_windows(feedback: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Success per intent and window of event time; records later than `late` are left out."""
    return feedback.withWatermark("ts", late).groupBy(F.window("ts", width), "intent").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("was_helpful").cast("double")).alias("success_rate"))
