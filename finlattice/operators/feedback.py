"""Adaptive thresholds from feedback, in batch: an ordered, clamped fold per intent over running success rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .routing import THRESHOLDS

GATE, STEP, LOW_RATE, HIGH_RATE, LEAST, MOST = 10, 0.05, 0.7, 0.9, 0.1, 0.9
#: Places of the record whose moves one row holds.
BLOCK = 10_000


def numbered(feedback: DataFrame, time: str, tie: str) -> DataFrame:
    """feedback with `place`: 1, 2, ... in order of time and tie. Ranks are taken within hours and shifted by the hours before."""
    rows = feedback.withColumn("_hour", F.date_trunc("hour", time))
    hours = rows.groupBy("_hour").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)  # over hours, a small table
    shift = hours.select("_hour", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_hour").orderBy(time, tie))
    return rows.join(shift, "_hour").withColumn("place", (F.col("_before") + rank).cast("long")).drop("_hour", "_before")


def success(feedback: DataFrame) -> DataFrame:
    """intent, n, success_rate."""
    return feedback.groupBy("intent").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("was_helpful").cast("double")).alias("success_rate"))


def thresholds(feedback: DataFrame, start: dict[str, float] | None = None) -> DataFrame:
    """intent, threshold after all feedback (place, intent, was_helpful); place numbers the records from 1.

    From the tenth record on, every record updates every intent seen so far by its rate of success up to then. Between two
    records of an intent its rate stands still, so each of its records stands for a number of equal steps: rows are kept
    per record, not per record and intent.
    """
    placed = feedback.select("intent", F.col("place").cast("long").alias("place"), F.col("was_helpful").cast("int").alias("good")).withColumn("block", F.floor(F.col("place") / BLOCK))
    last = placed.agg(F.max("place").alias("last"))  # one row
    # counts run within blocks of places, and over the blocks of an intent, of which there are few
    order = Window.partitionBy("intent").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    per = placed.groupBy("intent", "block").agg(F.count("good").alias("n"), F.sum("good").alias("g"), F.min("place").alias("f"))
    per = per.select("intent", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("bn"), F.coalesce(F.sum("g").over(before), F.lit(0)).alias("bg"), F.lead("f").over(order).alias("after"))
    own = Window.partitionBy("intent", "block").orderBy("place")
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = placed.join(per, ["intent", "block"]).crossJoin(F.broadcast(last))
    rate = F.try_divide(F.col("bg") + F.coalesce(F.sum("good").over(upto), F.lit(0)), F.col("bn") + F.count("good").over(upto))
    rows = rows.withColumns({"rate": rate, "next": F.coalesce(F.lead("place").over(own), "after")})
    begin = F.greatest(F.col("place"), F.lit(GATE))
    stop = F.coalesce(F.col("next"), F.col("last") + 1)
    rows = rows.withColumn("steps", F.greatest(stop - begin, F.lit(0)))
    way = F.when(F.col("rate") < LOW_RATE, STEP).when(F.col("rate") > HIGH_RATE, -STEP).otherwise(0.0)
    moves = rows.select("intent", "block", "place", way.alias("way"), "steps").where("steps > 0 and way <> 0")
    # A run of moves is a clamp: t -> least(high, greatest(low, t + shift)). Clamps compose, so moves are folded in blocks of
    # BLOCK places, each a row of three numbers, and then the blocks in order: no row holds more than a block's moves.
    block = moves.groupBy("intent", "block").agg(F.array_sort(F.collect_list(F.struct("place", "way", "steps"))).alias("moves"))
    one = "named_struct('shift', 0D, 'low', double('-infinity'), 'high', double('infinity'))"
    step = f"""(c, m) -> CASE WHEN m.way > 0 THEN named_struct('shift', c.shift + m.way * m.steps, 'low', least({MOST}D, c.low + m.way * m.steps), 'high', least({MOST}D, c.high + m.way * m.steps))
        ELSE named_struct('shift', c.shift + m.way * m.steps, 'low', greatest({LEAST}D, c.low + m.way * m.steps), 'high', greatest({LEAST}D, c.high + m.way * m.steps)) END"""
    clamps = block.select("intent", "block", F.expr(f"aggregate(moves, {one}, {step})").alias("c"))
    folded = clamps.groupBy("intent").agg(F.array_sort(F.collect_list(F.struct("block", "c"))).alias("clamps"))
    first = F.create_map(*[F.lit(x) for pair in (start or THRESHOLDS).items() for x in pair])
    base = placed.select("intent").distinct().join(folded, "intent", "left").withColumn("first", F.coalesce(F.element_at(first, F.col("intent")), F.lit(0.3)))
    value = F.when(F.col("clamps").isNull(), F.col("first")).otherwise(F.expr("aggregate(clamps, first, (t, b) -> least(b.c.high, greatest(b.c.low, t + b.c.shift)))"))
    return base.select("intent", F.round(value, 6).alias("threshold"))
