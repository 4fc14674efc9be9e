"""Evaluation: per-class counts, precision, recall, F1, macro averages, latency, distributions, faithfulness, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def scores(counts: DataFrame) -> DataFrame:
    """counts with precision, recall and f1 from tp, fp and fn; 0 where a denominator is 0."""
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r}).withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def per_class(rows: DataFrame, labels: list[str] | None = None, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """label, tp, fp, fn, precision, recall, f1; with labels, also for classes without rows. One pass over the rows."""
    same = F.col(expected) == F.col(predicted)
    both = F.array(F.struct(F.col(expected).alias("label"), same.cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), (~same).cast("long").alias("fn")), F.struct(F.col(predicted).alias("label"), F.lit(0).cast("long").alias("tp"), (~same).cast("long").alias("fp"), F.lit(0).cast("long").alias("fn")))
    counts = rows.select(F.inline(both)).groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    if labels is not None:
        known = rows.sparkSession.createDataFrame([(x,) for x in labels], "label string")
        counts = known.join(counts, "label", "left").fillna(0, ["tp", "fp", "fn"])
    return scores(counts)


def overall(rows: DataFrame, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """n, accuracy and macro-F1 over the classes that occur as expected."""
    ok = rows.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(expected) == F.col(predicted)).cast("double")).alias("accuracy"))
    macro = per_class(rows, None, expected, predicted).where("tp + fn > 0").agg(F.avg("f1").alias("macro_f1"))
    return ok.crossJoin(F.broadcast(macro))


#: Parts that a group is cut into for counting, and values of a group that may be sorted in one task.
PARTS, SORTED = 64, 100_000


def order_statistic(rows: DataFrame, value: str, group: str, share: float) -> DataFrame:
    """group, n, mean, v: the value at place int(n * share) of each group's sorted values (from 0); null values don't count.

    A group of any size is counted, never sorted whole. Approximate quantiles cut it into PARTS, exact counts tell which part
    holds the place, and that part is cut again until it has one value or at most SORTED rows, which are sorted. So rounds
    grow with the logarithm of the rows, whatever the values; each shuffles a row for each part and task.
    """
    rows = rows.select(F.col(group).alias("_g"), F.col(value).alias("_v")).where("_v is not null")
    state = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    state = cut(state.withColumns({"place": F.floor(F.col("n") * share).cast("long"), "left": F.col("n")}))
    wide = (F.col("left") > SORTED) & (F.col("lo") < F.col("hi"))
    grid = [k / PARTS for k in range(1, PARTS)]

    def within(some: DataFrame) -> DataFrame:
        bounds = some.select(F.col("_g").alias("_b"), "lo", "hi")
        return rows.join(bounds, F.col("_g").eqNullSafe(F.col("_b")) & F.col("_v").between(F.col("lo"), F.col("hi"))).drop("_b", "lo", "hi")

    while not state.where(wide).isEmpty():
        inside = within(state.where(wide))
        marks = inside.groupBy(F.col("_g").alias("_b")).agg(F.percentile_approx("_v", grid, 100 * PARTS).alias("_m"))
        part = 2 * F.size(F.filter("_m", lambda m: m < F.col("_v"))) + F.array_contains("_m", F.col("_v")).cast("int")  # a mark is a part of its own
        counts = inside.join(marks, F.col("_g").eqNullSafe(F.col("_b"))).groupBy("_g", part.alias("_p")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        counts = counts.withColumn("_upto", F.sum("_c").over(Window.partitionBy("_g").orderBy("_p")))
        both = counts.withColumnRenamed("_g", "_b").join(state, F.col("_b").eqNullSafe(F.col("_g"))).where((F.col("_upto") > F.col("place")) & (F.col("_upto") - F.col("_c") <= F.col("place")))
        narrowed = both.select("_g", "n", "mean", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), (F.col("place") - (F.col("_upto") - F.col("_c"))).alias("place"), F.col("_c").alias("left"))
        state = cut(state.where(~wide).unionByName(narrowed))
    ranked = within(state.where("lo < hi")).withColumn("_r", F.row_number().over(Window.partitionBy("_g").orderBy("_v")) - 1)
    last = ranked.select(F.col("_g").alias("_b"), F.col("_v").alias("_w"), "_r").join(state, F.col("_b").eqNullSafe(F.col("_g")) & (F.col("_r") == F.col("place")))
    sorted_ones = last.select("_g", "n", "mean", F.col("_w").alias("v"))
    return state.where("lo = hi").select("_g", "n", "mean", F.col("lo").alias("v")).unionByName(sorted_ones).withColumnRenamed("_g", group)


def latency(rows: DataFrame, value: str, group: str) -> DataFrame:
    """Mean and the value at place int(n * 0.95) of the sorted ones (from 0)."""
    return order_statistic(rows, value, group, 0.95).select(group, "mean", F.col("v").alias("p95"))


def distribution(verified: DataFrame, column: str) -> DataFrame:
    """Counts by a column; null is left out, after counting: a filter before would work out the column a second time."""
    return verified.groupBy(column).agg(F.count(column).alias("n")).where("n > 0")


def faithfulness(verified: DataFrame, key: str = "answer_id") -> DataFrame:
    """Verified over all claims of each answer; 0 without claims."""
    return verified.groupBy(key).agg(_ratio(F.count_if("verified"), F.count(F.lit(1))).alias("faithfulness"))


def drift(current: DataFrame, baseline: DataFrame, key: str, least: float = 0.10) -> DataFrame:
    """Metrics that fell by more than a tenth of their baseline. Both: key, value."""
    both = current.withColumnRenamed("value", "current").join(baseline.withColumnRenamed("value", "baseline"), key)
    both = both.withColumn("drop", F.try_divide(F.col("baseline") - F.col("current"), F.col("baseline")))
    return both.withColumn("alert", F.coalesce(F.col("drop") > least, F.lit(False)))


COMPONENTS = ("intent", "verifier", "e2e", "all")


def chosen(component: str) -> list[str]:
    """The components that a name stands for; a ValueError for other names."""
    if component not in COMPONENTS:
        raise ValueError(f"component must be one of {', '.join(COMPONENTS)}")
    return list(COMPONENTS[:-1]) if component == "all" else [component]


def case_checks(cases: DataFrame, verified: DataFrame, key: str = "answer_id") -> DataFrame:
    """Counts of each case against what it expects; a null expectation passes.

    cases: key, expected_claims, expected_verified, expected_unverified. Adds n_claims, n_verified, decomposition_ok, verification_ok.
    """
    counts = verified.groupBy(key).agg(F.count(F.lit(1)).alias("n_claims"), F.count_if("verified").alias("n_verified"))
    both = cases.join(counts, key, "left").fillna(0, ["n_claims", "n_verified"])
    meets = lambda c, expected: F.coalesce(c == F.col(expected), F.lit(True))
    ok = meets(F.col("n_verified"), "expected_verified") & meets(F.col("n_claims") - F.col("n_verified"), "expected_unverified")
    return both.select(key, "n_claims", "n_verified", meets(F.col("n_claims"), "expected_claims").alias("decomposition_ok"), ok.alias("verification_ok"))


def check_totals(checks: DataFrame) -> DataFrame:
    """One row: cases, claims, verified claims and their rate, and the cases whose checks passed."""
    return checks.agg(
        F.count(F.lit(1)).alias("n_cases"), F.sum("n_claims").alias("n_claims"), F.sum("n_verified").alias("n_verified"), _ratio(F.sum("n_verified"), F.sum("n_claims")).alias("rate"),
        F.count_if("decomposition_ok").alias("decomposition_passed"), F.count_if("verification_ok").alias("verification_passed"),
    )


def end_to_end(answers: DataFrame) -> DataFrame:
    """One row over question_id, intent_ok, strategy_ok, faithfulness, answer: shares, mean faithfulness, and whether no answer is empty."""
    return answers.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("intent_ok").cast("double")).alias("intent_accuracy"), F.avg(F.col("strategy_ok").cast("double")).alias("strategy_accuracy"),
        F.avg("faithfulness").alias("faithfulness"), F.bool_and(F.trim(F.coalesce("answer", F.lit(""))) != "").alias("all_answered"),
    )
