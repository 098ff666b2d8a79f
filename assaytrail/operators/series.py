"""Points, day values, medication events and their effect windows: the inputs of every analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as num
from ..functions import text as tx
from ..sources import dimensions as dim

SERIES = ["patient_id", "analyte_id"]
NO_LAB = ""          # a missing lab counts as a lab of its own; printed labs are never empty


def points(observations: DataFrame, reports: DataFrame) -> DataFrame:
    """Confirmed values of confirmed reports. The filters reach both scans."""
    o = observations.filter((F.col("status") == "confirmed") & F.col("canonical_value").isNotNull()
                            & F.col("analyte_id").isNotNull())
    r = reports.filter(F.col("status") == "confirmed").select("report_id", "patient_id", "lab",
                                                              F.col("collected_at").alias("date"))
    return o.join(r, "report_id").select(
        "patient_id", "analyte_id", "observation_id", "report_id", "date", F.col("canonical_value").alias("value"),
        "comparator", "lab", "page", "line")


def day_values(points_df: DataFrame) -> DataFrame:
    """Mean of a date's uncensored values, with the smallest and largest lab name of the date.

    Partial aggregation shrinks a busy patient before the shuffle, and the result holds at most one row per
    calendar day and series; all later windows run on this table. Whether several days share one lab
    follows from the two lab names, so no set of labs is collected. Canonical values carry at most six
    decimals, so the mean is taken over decimals: exact, and the same in whatever order rows arrive.
    """
    lab = F.coalesce("lab", F.lit(NO_LAB))
    return (points_df.filter(F.col("comparator").isNull()).groupBy(*SERIES, "date")
            .agg(F.avg(F.col("value").cast("decimal(24,6)")).cast("double").alias("value"), F.count(F.lit(1)).alias("n_values"),
                 F.min(lab).alias("lab_lo"), F.max(lab).alias("lab_hi"),
                 F.min("report_id").alias("first_report"), F.max("report_id").alias("last_report")))


def resolve_drugs(events: DataFrame) -> DataFrame:
    """Add class and generic name: the whole text first, else the first word that can be a drug name."""
    spark = events.sparkSession
    whole = dim.drug_names(spark).select(F.col("drug_key").alias("_whole"), F.col("drug_class").alias("_c1"),
                                         F.col("generic").alias("_g1"))
    first = dim.drug_names(spark).select(F.col("drug_key").alias("_word"), F.col("drug_class").alias("_c2"),
                                         F.col("generic").alias("_g2"))
    return (events.withColumn("_whole", tx.name_key(F.col("drug")))
            .withColumn("_word", tx.drug_first_word(F.col("drug")))
            .join(whole, "_whole", "left").join(first, "_word", "left")
            .withColumn("drug_class", F.coalesce("_c1", "_c2", F.lit("unknown")))
            .withColumn("generic", F.coalesce("_g1", "_g2"))
            .drop("_whole", "_word", "_c1", "_c2", "_g1", "_g2"))


def event_effects(resolved: DataFrame) -> DataFrame:
    """One row per event and analyte its class moves, with the window the effect is expected in."""
    return (resolved.join(dim.drug_effects(resolved.sparkSession), "drug_class")
            .withColumn("window_start", F.expr("date_add(date, window_from)"))
            .withColumn("window_end", F.expr("date_add(date, window_to)")))


def effect_windows(effects: DataFrame) -> DataFrame:
    return effects.filter(F.col("change") == "start")


def event_bounds(effects: DataFrame) -> DataFrame:
    """Per series: the first event of any kind, and the end of the last window of a start."""
    starts = F.col("change") == "start"
    return effects.groupBy(*SERIES).agg(
        F.min("date").alias("first_event"), F.max(F.when(starts, F.col("window_end"))).alias("cutoff"))


NEIGHBOURS = ("date", "value", "lab_lo", "lab_hi")


def steps(days: DataFrame) -> DataFrame:
    """Day values with their neighbours: the previous two days and the next one."""
    w = Window.partitionBy(*SERIES).orderBy("date")
    near = [F.lag(c, shift).over(w).alias(f"{name}_{c}") for name, shift in (("prev", 1), ("prev2", 2), ("next", -1))
            for c in NEIGHBOURS]
    return days.select("*", *near, F.row_number().over(w).alias("position"))


def frame(days: DataFrame, bounds: DataFrame) -> DataFrame:
    """Day values with neighbours, and on every row the baseline and the straight line of its series.

    Days before the first event are a prefix of the series, so the baseline days are the first two or three
    rows and need no second pass. One shuffle by series feeds the join and all windows.
    """
    whole = Window.partitionBy(*SERIES)
    epoch = F.lit("1970-01-01").cast("date")
    used = F.col("cutoff").isNull() | (F.col("date") > F.col("cutoff"))
    before_event = F.col("first_event").isNull() | (F.col("date") < F.col("first_event"))
    rows = steps(days).join(bounds, SERIES, "left").select(
        "*", F.when(used, num.years(F.datediff("date", epoch))).alias("x"), F.when(used, F.col("value")).alias("y"),
        F.when(used, F.col("date")).alias("used_date"), before_event.alias("before_event"))

    def nth(c: str, n: int):
        return F.max(F.when(F.col("position") == n, F.col(c))).over(whole).alias(f"{c}{n}")

    rows = rows.select(
        "*", F.count(F.lit(1)).over(whole).cast("int").alias("n_days"),
        F.count_if("before_event").over(whole).alias("n_before_event"),
        *[nth(c, n) for n in (1, 2, 3) for c in NEIGHBOURS],
        F.count("x").over(whole).cast("int").alias("n_points"),
        F.min("used_date").over(whole).alias("first_used"), F.max("used_date").over(whole).alias("last_used"),
        F.min_by("y", "used_date").over(whole).alias("first_used_value"),
        F.max_by("y", "used_date").over(whole).alias("last_used_value"),
        F.min(F.when(F.col("x").isNotNull(), F.col("lab_lo"))).over(whole).alias("used_lab_lo"),
        F.max(F.when(F.col("x").isNotNull(), F.col("lab_hi"))).over(whole).alias("used_lab_hi"),
        F.regr_slope("y", "x").over(whole).alias("line_slope"), F.avg("x").over(whole).alias("mean_x"),
        F.avg("y").over(whole).alias("mean_y"), F.regr_sxx("y", "x").over(whole).alias("sxx"),
        F.regr_sxy("y", "x").over(whole).alias("sxy"), F.regr_syy("y", "x").over(whole).alias("syy"))

    enough = F.col("n_days") >= 2
    size = F.when(F.col("n_before_event") >= 2, F.least(F.col("n_before_event"), F.lit(3))).otherwise(
        F.least(F.col("n_days"), F.lit(3)))
    rows = rows.withColumn("baseline_n", F.when(enough, size.cast("int")).otherwise(0))
    third = F.col("baseline_n") == 3
    middle = F.element_at(F.array_sort(F.array("value1", "value2", "value3")), 2)
    return rows.withColumns({
        "baseline": F.when(third, middle).when(enough, (F.col("value1") + F.col("value2")) / 2),
        "baseline_note": F.when(enough & (F.col("n_before_event") < 2), "includes on-treatment results"),
        "baseline_first": F.when(enough, F.col("date1")),
        "baseline_last": F.when(third, F.col("date3")).when(enough, F.col("date2")),
        "baseline_lab_lo": F.when(third, F.least("lab_lo1", "lab_lo2", "lab_lo3")).when(
            enough, F.least("lab_lo1", "lab_lo2")),
        "baseline_lab_hi": F.when(third, F.greatest("lab_hi1", "lab_hi2", "lab_hi3")).when(
            enough, F.greatest("lab_hi1", "lab_hi2")),
    })


def summaries(frame_df: DataFrame) -> DataFrame:
    """One row per series: its latest day with baseline and line."""
    last = frame_df.filter(F.col("next_date").isNull())
    return last.withColumnsRenamed({c: f"latest_{c}" for c in NEIGHBOURS})
