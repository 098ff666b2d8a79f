"""Before and after a medication event: response, verdict and other drug changes nearby."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as num
from ..sources import dimensions as dim
from .sequences import asof, within_days
from .series import SERIES
from .trends import crossed

LOOK_BACK_DAYS = 180
BEFORE_VALUES = 3
NEARBY_DAYS = 90
EVENT_DAY = [*SERIES, "drug_class", "date"]


def before_and_after(effects: DataFrame, days: DataFrame) -> DataFrame:
    """One row per series, class and event day with the results around it.

    Events are first reduced to one row per class and day, then looked up in the daily series: the last three
    results up to the event, the first result from the start of the window, and the last affecting event before this one, which
    earlier results must not precede. Event days and days are dealt by series once for all of these; each stays a column of its own, so
    what a result does not use is neither looked up nor moved.
    """
    c = F.col
    known = " AND ".join(f"{x} IS NOT NULL" for x in (*SERIES, "date"))
    event_days = effects.filter(known).select(*SERIES, c("date").alias("_t"), "drug_class", "window_start", "window_end", F.lit(1).alias("_side")).distinct()
    both = days.filter(known).select(*SERIES, c("date").alias("_t"), "value", "lab_lo", "lab_hi", F.lit(0).alias("_side")).unionByName(
        event_days, allowMissingColumns=True).repartition(*SERIES)
    # What rows are packed into follows the deal, so that it is not moved.
    is_day, series = c("_side") == 0, Window.partitionBy(*SERIES)
    both = both.withColumns({"_here": F.when(is_day, F.struct(c("_t").alias("day"), "value", "lab_lo", "lab_hi")), "_from": F.coalesce("window_start", "_t")})
    ahead = series.orderBy(c("_from").desc(), "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def result(n: int) -> Column:
        return F.expr(f"lag(_here, {n}) IGNORE NULLS OVER (PARTITION BY {', '.join(SERIES)} ORDER BY _t, _side)").alias(f"b{n}")

    def first_after(x: str, out: str) -> Column:
        return F.last(F.when(is_day, F.struct(c(x).alias("x"))), ignorenulls=True).over(ahead)["x"].alias(out)

    found = both.select(
        *SERIES, "drug_class", c("_t").alias("date"), "window_start", "window_end", "_side", result(1), result(2), result(3),
        F.expr(f"max(if(_side = 1, _t, NULL)) OVER (PARTITION BY {', '.join(SERIES)} ORDER BY _t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)").alias("since"),
        *[first_after(x, f"after_{out}") for x, out in (("_t", "date"), ("value", "value"), ("lab_lo", "lab_lo"), ("lab_hi", "lab_hi"))])
    found = found.filter(c("_side") == 1).drop("_side")
    near = F.filter(F.array("b1", "b2", "b3"), lambda b: b.isNotNull()
                    & (F.datediff("date", b["day"]) <= LOOK_BACK_DAYS)
                    & (F.col("since").isNull() | (b["day"] > F.col("since"))))
    in_window = F.col("after_date") <= F.col("window_end")
    total = F.aggregate("before", F.lit(0.0), lambda acc, b: acc + b["value"])
    out = (found.withColumn("before", near).withColumn("n_before", F.size("before"))
           .withColumn("before_mean", total / F.nullif(F.col("n_before"), F.lit(0)))
           .withColumn("before_lab_lo", F.array_min(F.transform("before", lambda b: b["lab_lo"])))
           .withColumn("before_lab_hi", F.array_max(F.transform("before", lambda b: b["lab_hi"])))
           .withColumn("too_early", F.col("after_date").isNull()))
    for c in ("after_value", "after_lab_lo", "after_lab_hi", "after_date"):
        out = out.withColumn(c, F.when(in_window, F.col(c)))
    return out.drop("b1", "b2", "b3", "since")


def responses(effects: DataFrame, days: DataFrame) -> DataFrame:
    """One row per event and analyte its class moves: status, change, target direction and verdict."""
    spark = effects.sparkSession
    around = before_and_after(effects, days).drop("window_start", "window_end")
    info = dim.analytes(spark).select("analyte_id", "analyte_name", "rcv_percent")
    target = dim.targets(spark).select("analyte_id", "target_low", "target_high")
    rows = effects.join(around, EVENT_DAY).join(info, "analyte_id").join(target, "analyte_id", "left")

    assessed = F.col("status") == "assessed"
    start = F.col("change") == "start"
    change = F.col("change_percent")
    beyond = F.col("beyond_rcv")
    same = F.when(change > 0, "rise").otherwise("fall") == F.col("direction")
    small = F.coalesce(F.col("effect_size") == "small", F.lit(False))
    over = F.coalesce(F.abs(change) > F.col("max_percent"), F.lit(False))
    moved = F.when(F.col("after_value") > F.col("before_mean"), "rise").otherwise("fall")
    status = (F.when(F.col("too_early"), "too early to assess").when(F.col("n_before") == 0, "no baseline")
              .when(F.col("after_date").isNull(), "no result in window").otherwise("assessed"))
    verdict = (F.when(same & over, "above expected").when(same & (F.coalesce(beyond, F.lit(True)) | small), "seen")
               .when(~same & beyond, "opposite").otherwise("not seen"))
    return (rows.withColumn("status", status)
            .withColumn("change_percent", F.when(assessed, num.pct_change(F.col("after_value"), F.col("before_mean"))))
            .withColumn("change_abs", F.when(assessed, F.round(F.col("after_value") - F.col("before_mean"), 4)))
            .withColumn("beyond_rcv", F.abs(change) > F.col("rcv_percent"))
            .withColumn("cross_lab", F.when(assessed, crossed(*[F.col(c) for c in (
                "before_lab_lo", "before_lab_hi", "after_lab_lo", "after_lab_hi")])))
            .withColumn("single_prior", F.col("n_before") == 1)
            .withColumn("effect_shown", assessed & start & change.isNotNull() & (moved == F.col("direction")))
            .withColumn("target_direction", F.when(assessed, num.target_direction(
                F.col("before_mean"), F.col("after_value"), F.col("target_low"), F.col("target_high"))))
            .withColumn("verdict", F.when(assessed & start & change.isNotNull(), verdict))
            .withColumn("until", F.coalesce("after_date", "window_end")))


def verdict_notes(responses_df: DataFrame) -> DataFrame:
    """Sentence for each verdict."""
    move = F.format_string("%s %s %.1f%%", "analyte_name", F.when(F.col("change_percent") > 0, "rose").otherwise("fell"),
                           F.abs("change_percent"))
    text = (F.when(F.col("verdict") == "above expected", F.concat(F.lit("Expected "), "direction",
                                                                  F.lit(" seen, larger than expected: "), move))
            .when(F.col("verdict") == "seen", F.concat(F.lit("Expected "), "direction", F.lit(" seen: "), move))
            .when(F.col("verdict") == "opposite", F.concat(F.lit("The expected "), "direction",
                                                           F.lit(" was not seen, the other way: "), move))
            .otherwise(F.concat(F.lit("Expected "), "direction", F.lit(" not seen: "), move)))
    return responses_df.withColumn("verdict_note", F.when(F.col("verdict").isNotNull(), F.concat(text, F.lit("."))))


def confounders(responses_df: DataFrame, resolved: DataFrame) -> DataFrame:
    """Other events of the patient from 90 days before an event until its result, with the signed distance."""
    others = resolved.select("patient_id", F.col("event_id").alias("other_event"), F.col("drug").alias("other_drug"),
                             F.col("change").alias("other_change"), F.col("date").alias("other_date"))
    spans = responses_df.select("patient_id", "event_id", "analyte_id", F.col("date").alias("event_date"),
                                F.date_sub("date", NEARBY_DAYS).alias("nearby_from"), "until")
    pairs = within_days(others, spans, ["patient_id"], "other_date", "nearby_from", "until")
    return (pairs.filter(F.col("other_event") != F.col("event_id"))
            .withColumn("days_from_event", F.datediff("other_date", "event_date"))
            .drop("nearby_from", "until"))


def confounder_counts(responses_df: DataFrame, resolved: DataFrame) -> DataFrame:
    """Number of other events nearby, from running daily counts: no pairs of events are formed."""
    w = Window.partitionBy("patient_id").orderBy("day")
    running = (resolved.groupBy("patient_id", F.col("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
               .withColumn("running", F.sum("n").over(w)).drop("n"))
    spans = responses_df.select("patient_id", "date", "until").distinct()
    upto = asof(spans, running.withColumnRenamed("running", "upto"), ["patient_id"], F.col("until"), F.col("day"), ["upto"])
    both = asof(upto, running.withColumnRenamed("running", "earlier"), ["patient_id"],
                F.date_sub("date", NEARBY_DAYS + 1), F.col("day"), ["earlier"])
    counts = both.select("patient_id", "date", "until",
                         (F.col("upto") - F.coalesce("earlier", F.lit(0)) - 1).alias("n_confounders"))
    return responses_df.join(counts, ["patient_id", "date", "until"])


def verdict_rollup(responses_df: DataFrame) -> DataFrame:
    """ "k of n expected changes seen" for every event with at least one verdict."""
    return (responses_df.filter(F.col("verdict").isNotNull()).groupBy("patient_id", "event_id")
            .agg(F.count(F.lit(1)).alias("judged"), F.count_if(F.col("verdict") == "seen").alias("seen")))
