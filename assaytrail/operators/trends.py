"""Change flags, slopes, projections and trend status of every (patient, analyte) series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as num
from ..functions import text as tx
from ..sources import dictionary as d
from ..sources import dimensions as dim
from .sequences import within_days
from .series import NO_LAB, SERIES

SLOPE_MIN_POINTS, SLOPE_MIN_DAYS = 3, 365
RAPID_EGFR_PER_YEAR = -5.0
PROJECTION_MAX_YEARS = 10
CALENDAR_DAYS = 2_900_000          # later dates do not fit the calendar of four-digit years


def crossed(*labs: Column) -> Column:
    """True when the given smallest and largest lab names do not all name one lab."""
    return F.least(*labs) != F.greatest(*labs)


def _with_analyte(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    return (df.join(dim.analytes(spark).select("analyte_id", "analyte_name", "unit", "rcv_percent", "rcv_status"),
                    "analyte_id")
            .join(dim.targets(spark).select("analyte_id", "target_low", "target_high"), "analyte_id", "left"))


def lab_change(rows: DataFrame, applies: Column) -> DataFrame:
    """For steps between two single labs: whether a neighbouring result of one of the labs agrees.

    The next result decides when it is from the earlier lab, else the one before when it is from the later
    lab. ``same_lab_agrees`` is null when there is nothing to compare.
    """
    def single(prefix: str) -> Column:
        lo, hi = F.col(f"{prefix}lab_lo"), F.col(f"{prefix}lab_hi")
        return F.when((lo == hi) & (lo != NO_LAB), lo)

    def within(new: Column, ref: Column) -> Column:
        return F.coalesce(F.abs(num.pct_change(new, ref)) <= F.col("rcv_percent"), F.lit(False))

    rows = rows.withColumns({
        "_changed": applies & single("").isNotNull() & single("prev_").isNotNull() & (single("") != single("prev_")),
        "_next": F.coalesce(single("next_") == single("prev_"), F.lit(False)),
        "_before": F.coalesce(single("prev2_") == single(""), F.lit(False))})
    changed, after, before = F.col("_changed"), F.col("_changed") & F.col("_next"), F.col("_changed") & F.col("_before")
    return rows.withColumns({
        "from_lab": F.when(changed, F.col("prev_lab_lo")), "to_lab": F.when(changed, F.col("lab_lo")),
        "same_lab_agrees": F.when(after, within(F.col("next_value"), F.col("prev_value"))).when(
            before, within(F.col("value"), F.col("prev2_value"))),
        "same_lab_date": F.when(after, F.col("next_date")).when(before, F.col("prev2_date")),
        "same_lab_value": F.when(after, F.col("next_value")).when(before, F.col("prev2_value"))})


FLAG = [*SERIES, "rule_id", "level", "date", "value", "ref_value", "compared_with", "ref_first", "ref_last", "direction",
        "change_percent", "change_abs", "rcv_percent", "target_direction", "cross_lab", "from_lab", "to_lab",
        "same_lab_agrees", "same_lab_date", "same_lab_value", "per_year", "n_points", "span_days"]


RULES = ("RCV_PREV", "RCV_BASELINE", "KDIGO_RAPID_EGFR")


def flags(frame: DataFrame, rules: tuple[str, ...] = RULES) -> DataFrame:
    """All flags of all series in one pass over the daily rows.

    Each day is compared with the day before (RCV_PREV); the latest day also with the baseline, when it is
    after the baseline days (RCV_BASELINE), and an eGFR series' line with the guideline (KDIGO_RAPID_EGFR).
    A change counts when it is strictly beyond the reference change value. With fewer ``rules``, the baseline and the line are
    computed only where a rule needs them.
    """
    c = F.col
    is_last = c("next_date").isNull()

    def against(rule: str, level: str, label: str, **columns: str) -> Column:
        return F.struct(F.lit(rule).alias("rule_id"), F.lit(level).alias("level"), F.lit(label).alias("compared_with"),
                        *[c(column).alias(name) for name, column in columns.items()])

    compared = {
        "RCV_PREV": lambda: F.when(c("prev_date").isNotNull(), against(
            "RCV_PREV", "change", "previous result", ref_value="prev_value", ref_first="prev_date", ref_last="prev_date",
            ref_lo="prev_lab_lo", ref_hi="prev_lab_hi")),
        "RCV_BASELINE": lambda: F.when(is_last & (c("date") > c("baseline_last")), against(
            "RCV_BASELINE", "change", "baseline", ref_value="baseline", ref_first="baseline_first",
            ref_last="baseline_last", ref_lo="baseline_lab_lo", ref_hi="baseline_lab_hi")),
        "KDIGO_RAPID_EGFR": lambda: F.when(is_last & _is_rapid(), against(
            "KDIGO_RAPID_EGFR", "guideline", "slope", ref_value="first_used_value", ref_first="first_used",
            ref_last="last_used", ref_lo="used_lab_lo", ref_hi="used_lab_hi"))}
    compared = F.filter(F.array(*[compared[rule]() for rule in RULES if rule in rules]), lambda x: x.isNotNull())
    rows = _with_analyte(frame.withColumn("compared", F.explode(compared))).select("*", "compared.*")
    guideline = c("level") == "guideline"
    rows = rows.withColumn("change_percent", F.when(~guideline, num.pct_change(c("value"), c("ref_value"))))
    rows = rows.filter(guideline | (F.abs("change_percent") > c("rcv_percent")))
    rows = lab_change(rows, c("rule_id") == "RCV_PREV")
    slope = {"per_year": F.lit(None).cast("double"), "span_days": F.lit(None).cast("int"), "n_points": F.lit(None).cast("bigint")}
    if "KDIGO_RAPID_EGFR" in rules:
        _, span, per_year = _slope_columns()
        slope = {"per_year": F.when(guideline, per_year), "span_days": F.when(guideline, span), "n_points": F.when(guideline, c("n_points"))}
    return rows.withColumns({
        "direction": F.when(c("change_percent") > 0, "rise").otherwise("fall"),
        "change_abs": F.when(~guideline, F.round(c("value") - c("ref_value"), 4)),
        "target_direction": num.target_direction(c("ref_value"), c("value"), c("target_low"), c("target_high")),
        "cross_lab": F.when(guideline, crossed(c("ref_lo"), c("ref_hi"))).otherwise(
            crossed(c("lab_lo"), c("lab_hi"), c("ref_lo"), c("ref_hi"))), **slope}).select(*FLAG)


def rcv_prev(frame: DataFrame) -> DataFrame:
    return flags(frame, ("RCV_PREV",))


def rcv_baseline(frame: DataFrame) -> DataFrame:
    return flags(frame, ("RCV_BASELINE",))


def kdigo_rapid(frame: DataFrame) -> DataFrame:
    return flags(frame, ("KDIGO_RAPID_EGFR",))


def with_expected_effect(flags_df: DataFrame, windows: DataFrame) -> DataFrame:
    """Attach the first drug start (by date, then id) whose window holds the flag and explains its direction.

    Windows of a class have one length, so the first start of a class that can explain a flag is the one with
    the first window end at or after it. Flags and starts (one per series, class and day) are sorted by time
    once and the next window of each class is carried along; flags are not joined with windows.
    """
    starts = windows.groupBy(*SERIES, "drug_class", "date", "direction", "max_percent", "effect_note",
                             "class_short_name", "window_start", "window_end").agg(
        F.min_by(F.struct("event_id", "drug"), "event_id").alias("e"))
    window = F.struct(F.col("date").alias("start_date"), F.col("e.event_id").alias("event_id"), F.col("e.drug").alias("drug"),
                      "drug_class", "direction", "max_percent", "effect_note", "class_short_name", "window_start",
                      "window_end")
    right = starts.select(*SERIES, F.col("window_end").alias("_t"), F.lit(0).alias("_side"), window.alias("_w"))
    # Columns of a flag stay columns, not one packed row: Spark leaves out, down to the series, those that a result does not use.
    left = flags_df.withColumns({"_t": F.col("date"), "_side": F.lit(1)})
    w = Window.partitionBy(*SERIES).orderBy(F.col("_t").desc(), "_side").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    classes = list(d.lists(d.GENERICS))
    both = left.unionByName(right, allowMissingColumns=True).select(*flags_df.columns, "_side", F.array(*[
        F.last(F.when(F.col("_w.drug_class") == name, F.col("_w")), ignorenulls=True).over(w) for name in classes]
    ).alias("_near"))
    holds = F.filter("_near", lambda n: n.isNotNull() & (n["direction"] == F.col("direction"))
                     & (n["window_start"] <= F.col("date")))
    rows = both.filter("_side = 1").select(*flags_df.columns, F.array_min(holds).alias("_w"))
    above = F.abs("change_percent") > F.col("_w.max_percent")
    limit = F.col("_w.max_percent").cast("int").cast("string")
    note = (F.when(F.col("_w.max_percent").isNull(), F.col("_w.effect_note"))
            .when(above, F.concat(F.lit("above the "), "direction", F.lit(" usually expected after "),
                                  "_w.class_short_name", F.lit(" start (up to "), limit, F.lit("%)")))
            .otherwise(F.concat(F.lit("within the ≤"), limit, F.lit("% "), "direction", F.lit(" expected after "),
                                "_w.class_short_name", F.lit(" start"))))
    change = F.col("level") == "change"
    return rows.select(*flags_df.columns, *[F.when(change, v).alias(k) for k, v in {
        "effect_event": F.col("_w.event_id"), "effect_drug": F.col("_w.drug"), "effect_class": F.col("_w.drug_class"),
        "expected_effect": note, "effect_from": F.col("_w.window_start"), "effect_to": F.col("_w.window_end")}.items()])


def events_since_baseline(flags: DataFrame, effects: DataFrame) -> DataFrame:
    """Affecting events after the last baseline day, up to the flagged result. One flag per series."""
    base = flags.filter(F.col("rule_id") == "RCV_BASELINE").select(*SERIES, "ref_last", F.col("date").alias("flag_date"))
    return (effects.select(*SERIES, "event_id", "drug", "drug_class", "change", F.col("date").alias("event_date"))
            .join(base, SERIES).filter((F.col("event_date") > F.col("ref_last"))
                                       & (F.col("event_date") <= F.col("flag_date"))))


def _slope_columns() -> tuple[Column, Column, Column]:
    """Status, span in days and slope per year of a series' line."""
    enough = F.col("n_points") >= SLOPE_MIN_POINTS
    span = F.datediff("last_used", "first_used")
    status = F.when(~enough, "not enough points").when(span >= SLOPE_MIN_DAYS, "ok").otherwise("not enough span")
    return status, F.when(enough, span).otherwise(0), F.when(enough, F.round("line_slope", 3))


def _is_rapid() -> Column:
    """An eGFR line that counts and falls faster than five units a year."""
    status, _, per_year = _slope_columns()
    return (F.col("analyte_id") == "egfr") & (status == "ok") & (per_year < RAPID_EGFR_PER_YEAR)


def slopes(summaries: DataFrame) -> DataFrame:
    """Least-squares slope per year after the last effect window, with the status that says if it counts."""
    status, span, per_year = _slope_columns()
    return summaries.filter(F.col("n_days") >= 2).select(
        *SERIES, "n_points", "first_used", "last_used", "first_used_value", "last_used_value", "used_lab_lo",
        "used_lab_hi", "cutoff", (F.col("n_days") - F.col("n_points")).alias("n_excluded"), span.alias("span_days"),
        per_year.alias("per_year"), status.alias("slope_status"), "line_slope", "mean_x", "mean_y", "sxx", "sxy", "syy")


def projections(slopes_df: DataFrame) -> DataFrame:
    """When a falling eGFR line reaches the next GFR category, with the range its slope allows."""
    falling = ((F.col("analyte_id") == "egfr") & (F.col("slope_status") == "ok") & (F.col("per_year") < 0))
    epoch = F.lit("1970-01-01").cast("date")
    s = slopes_df.filter(falling).withColumn(
        "from_value", F.col("mean_y") + F.col("line_slope")
        * (num.years(F.datediff("last_used", epoch)) - F.col("mean_x")))
    residual = F.greatest(F.col("syy") - F.col("line_slope") * F.col("sxy"), F.lit(0.0))
    error = F.sqrt(residual / (F.col("n_points") - 2) / F.col("sxx"))
    threshold, category = F.lit(None).cast("int"), F.lit(None).cast("string")
    for bound, name in reversed(d.NEXT_G_CATEGORY):
        threshold = F.when(F.col("from_value") > bound, bound).otherwise(threshold)
        category = F.when(F.col("from_value") > bound, name).otherwise(category)
    margin = num.t95(F.col("n_points") - 2) * error
    s = (s.withColumn("threshold", threshold).withColumn("category", category).filter(F.col("threshold").isNotNull())
         .withColumn("fast", F.col("line_slope") - margin).withColumn("slow", F.col("line_slope") + margin)
         .withColumn("gap", F.col("from_value") - F.col("threshold"))
         .filter(F.col("gap") / -F.col("line_slope") <= PROJECTION_MAX_YEARS))

    def days_to(slope: str) -> Column:
        return F.bround(F.col("gap") / -F.col(slope) * num.DAYS_PER_YEAR, 0)

    def reached(slope: str) -> Column:
        ok = (F.col(slope) < 0) & (days_to(slope) < CALENDAR_DAYS)
        return F.when(ok, F.date_add("last_used", F.when(ok, days_to(slope)).otherwise(0).cast("int")))

    latest = F.when(F.col("slow") >= 0, "may not fall").when(days_to("slow") < CALENDAR_DAYS, "dated").otherwise("beyond the calendar")

    return s.select(*SERIES, "threshold", "category", F.col("last_used").alias("from_date"),
                    F.round("from_value", 2).alias("from_value"), F.round("line_slope", 3).alias("per_year"),
                    F.round("fast", 3).alias("per_year_low"), F.round("slow", 3).alias("per_year_high"),
                    reached("line_slope").alias("date"), reached("fast").alias("date_earliest"),
                    reached("slow").alias("date_latest"), latest.alias("latest_status"), "n_points")


def projection_note(proj: DataFrame) -> DataFrame:
    """Sentence for a projection row."""
    span = F.when(F.col("date_latest").isNotNull(),
                  F.concat(F.lit("95% range "), tx.month_year(F.col("date_earliest")), F.lit(" to "),
                           tx.month_year(F.col("date_latest")))).otherwise(
        F.concat(F.lit("95% range from "), tx.month_year(F.col("date_earliest")),
                 F.when(F.col("latest_status") == "may not fall", ", no latest date").otherwise(", latest date beyond the calendar")))
    return proj.withColumn("note", F.concat(
        F.format_string("At %.2f per year over %d results the line reaches %d (KDIGO %s) around ", "per_year", "n_points",
                        "threshold", "category"), tx.month_year(F.col("date")), F.lit(" ("), span,
        F.lit("). A straight line through past results.")))


def last_tests(points: DataFrame, as_of: str) -> DataFrame:
    """Days since the latest result, censored ones included, against the usual interval of the test."""
    latest = points.groupBy(*SERIES).agg(F.max("date").alias("date"))
    days = F.datediff(F.lit(as_of).cast("date"), F.col("date"))
    limit = F.bround(F.col("interval_months") * num.DAYS_PER_YEAR / 12, 0)
    return latest.join(dim.test_intervals(points.sparkSession), "analyte_id").select(
        *SERIES, "date", "interval_months", days.alias("days_since"), (days > limit).alias("longer_than_interval"))


def trend_status(points: DataFrame, days: DataFrame) -> DataFrame:
    """Points, day values and status of every series with at least one point."""
    per_day = points.groupBy(*SERIES, "date").agg(F.count(F.lit(1)).alias("n"), F.count("comparator").alias("c"))
    uncensored = F.count_if(F.col("n") > F.col("c")).cast("int")
    return (per_day.groupBy(*SERIES).agg(F.sum("n").alias("n_points"), F.sum("c").alias("n_censored"),
                                         uncensored.alias("n_days"))
            .withColumn("trend_status", F.when(F.col("n_days") == 0, "censored values only")
                        .when(F.col("n_days") < 2, "insufficient data").otherwise("ok")))


def flag_id() -> Column:
    return F.concat_ws(":", F.col("rule_id"), F.col("analyte_id"), F.col("date").cast("string"))


def all_flags(frame: DataFrame, windows: DataFrame) -> DataFrame:
    """Every flag of every patient with its id and expected effect."""
    return with_expected_effect(flags(frame), windows).withColumn("flag_id", flag_id())


def ordered_flags(flags: DataFrame) -> DataFrame:
    """Newest first inside each patient, as a report shows them."""
    return flags.orderBy("patient_id", F.desc("date"), F.desc("rule_id"), F.desc("analyte_id"))


def evidence_spans(flags: DataFrame) -> DataFrame:
    """The days behind each flag, one row a role: its own day (``to``), and those it was compared with (``from``).

    Baseline days and the days of a slope are those between ``ref_first`` and ``ref_last``.
    """
    roles = F.array_compact(F.array(
        F.when(F.col("rule_id") != "KDIGO_RAPID_EGFR", F.struct(F.lit("to").alias("role"), F.col("date").alias("span_first"), F.col("date").alias("span_last"))),
        F.struct(F.lit("from").alias("role"), F.col("ref_first").alias("span_first"), F.col("ref_last").alias("span_last"))))
    return flags.select(*SERIES, "flag_id", F.explode(roles).alias("_r")).select(*SERIES, "flag_id", "_r.*")


def flag_evidence(flags: DataFrame, points: DataFrame) -> DataFrame:
    """The uncensored results behind each flag, one row per result: those compared with, and the flagged ones.

    The flagged day is a span of one day, so results are dealt and flags are worked out once for both roles.
    """
    values = points.filter(F.col("comparator").isNull()).select(*SERIES, "date", "observation_id", "report_id")
    return within_days(values, evidence_spans(flags), SERIES, "date", "span_first", "span_last", bucket_days=256).select(
        "patient_id", "analyte_id", "flag_id", "role", "date", "observation_id", "report_id")


def lab_change_reports(flags: DataFrame, points: DataFrame) -> DataFrame:
    """(patient, flag, date, report) of the neighbouring results of one lab that a lab change was checked with."""
    checked = flags.filter(F.col("same_lab_date").isNotNull()).select(*SERIES, "flag_id", F.col("same_lab_date").alias("date"))
    values = points.filter(F.col("comparator").isNull()).select(*SERIES, "date", "report_id")
    return checked.join(values, [*SERIES, "date"]).select("patient_id", "flag_id", "date", "report_id").distinct()


def flag_messages(flags: DataFrame) -> DataFrame:
    """Flags with ``message``, ``source``, ``cross_lab_note`` and ``lab_change_note``: the texts a report shows.

    Values have four significant digits and are written out, however large. Notes are null where there is nothing to note.
    """
    c, t = F.col, d.FLAG_TEXTS
    spark = flags.sparkSession
    info = dim.analytes(spark).select("analyte_id", "analyte_name", "unit").join(dim.rcv_sources(spark), "analyte_id")
    guideline = c("level") == "guideline"
    tenth = lambda v: F.format_string("%.1f", F.round(F.abs(v), 1))
    change = tx.filled(t["change"], name=c("analyte_name"), moved=F.when(c("direction") == "rise", "rose").otherwise("fell"),
                       percent=tenth(c("change_percent")), compared=c("compared_with"), before=tx.short_number(c("ref_value")),
                       after=tx.short_number(c("value")), unit=c("unit"), limit=tx.short_number(c("rcv_percent"), 6))
    rapid = tx.filled(t["guideline"], slope=tenth(c("per_year")), unit=c("unit"), span=c("span_days"), n=c("n_points"))
    later = c("same_lab_date") > c("date")
    of_check = {"lab": F.when(later, c("from_lab")).otherwise(c("to_lab")), "other_date": c("same_lab_date"), "other": tx.short_number(c("same_lab_value"))}
    agrees = tx.filled(t["lab_agrees"], **of_check, ref_date=F.when(later, c("ref_last")).otherwise(c("date")),
                       ref=tx.short_number(F.when(later, c("ref_value")).otherwise(c("value"))))
    check = F.when(c("same_lab_agrees"), agrees).when(~c("same_lab_agrees"), tx.filled(t["lab_differs"], **of_check)).otherwise("")
    return flags.join(info, "analyte_id").withColumns({
        "message": F.when(guideline, rapid).otherwise(change),
        "source": F.when(guideline, d.RAPID_EGFR_SOURCE).otherwise(c("source")),
        "cross_lab_note": F.when(c("cross_lab"), F.when(guideline, t["cross_lab_slope"]).otherwise(t["cross_lab"])),
        "lab_change_note": F.when(c("from_lab").isNotNull(), F.concat(tx.filled(t["lab_change"], from_lab=c("from_lab"), to_lab=c("to_lab")), check))})


def slope_exclusions(frame: DataFrame, windows: DataFrame, points: DataFrame) -> DataFrame:
    """The uncensored results that a slope leaves out, one row each, with the drug whose window ends last and the reason.

    Of windows with one end the earliest start counts. Series with fewer than two days have no slope and leave nothing out.
    """
    order = F.struct((-F.datediff("window_end", F.lit("1970-01-01").cast("date"))).alias("e"), "date", "event_id", "drug")
    last = windows.groupBy(*SERIES).agg(F.min_by(F.struct("event_id", "drug", F.col("date").alias("started"), "window_end"), order).alias("w"))
    days = frame.filter((F.col("n_days") >= 2) & (F.col("date") <= F.col("cutoff"))).select(*SERIES, "date")
    values = points.filter(F.col("comparator").isNull()).select(*SERIES, "date", "observation_id", "report_id")
    reason = tx.filled(d.FLAG_TEXTS["left_out"], drug=F.col("w.drug"), started=F.col("w.started"), cutoff=F.col("w.window_end"))
    return days.join(last, SERIES).join(values, [*SERIES, "date"]).select(
        *SERIES, "date", "observation_id", "report_id", F.col("w.event_id").alias("event_id"), reason.alias("reason"))


def points_in_windows(points: DataFrame, windows: DataFrame) -> DataFrame:
    """(point, event) rows for points inside an expected-effect window."""
    spans = windows.select(*SERIES, "event_id", "window_start", "window_end")
    return within_days(points.select(*SERIES, "observation_id", "date"), spans, SERIES, "date", "window_start",
                       "window_end")


def result_table(points: DataFrame, windows: DataFrame, slopes_df: DataFrame) -> DataFrame:
    """Points in order with the raw change from the previous one and their part in the trend.

    Points are dealt by series and day, once. What a day takes from its series (the value before it, the windows that hold it, the line) is
    put on one row a day and comes back to the points by series and day, so points are not dealt by series alone.
    """
    order = ["date", "report_id", "page", "line", "observation_id"]
    day = [*SERIES, "date"]
    # Both ways read the same rows and columns of the dealt points (so the comparator here), or Spark would deal them twice.
    last, end = F.struct("value", "comparator"), F.struct("_end.value").alias("_end")
    dealt = points.filter(" AND ".join(f"{c} IS NOT NULL" for c in day)).repartition(*day)
    rows = dealt.withColumn("_near", F.lag(last).over(Window.partitionBy(*day).orderBy(*order)))
    ends = dealt.groupBy(*day).agg(F.max_by(last, F.struct(*order)).alias("_end")).select(*day, end)
    # Points without a date are no rows of the table; the last of them is the value before the first day.
    undated = points.filter("date IS NULL").groupBy(*day).agg(F.max_by(last, F.struct(*order)).alias("_end")).select(*day, end)
    ends = ends.unionByName(undated)
    earlier = Window.partitionBy(*SERIES).orderBy("date", "_is_day").rowsBetween(Window.unboundedPreceding, -1)
    days = (_windows_held(ends, windows, F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
            .join(slopes_df.select(*SERIES, "first_used", "last_used"), SERIES, "left"))
    prev = F.when(F.col("_near").isNotNull(), F.col("_near.value")).otherwise(F.col("_carry.value"))
    raw = (F.col("value") - prev) / F.nullif(prev, F.lit(0.0)) * 100
    used = F.col("comparator").isNull() & (F.col("date") >= F.col("first_used"))
    part = (F.when(used, "Yes").when(F.col("n_windows") > 0, "Drug window")
            .when(F.col("date") < F.col("first_used"), "Before drug windows").otherwise("No"))
    return rows.join(days, day).withColumns({"prev_value": prev, "change_vs_previous": raw, "in_trend": part}).drop(
        "_near", "_carry", "first_used", "last_used")


def _windows_held(days: DataFrame, windows: DataFrame, *more: Column) -> DataFrame:
    """``days`` (one row a series and day) with ``n_windows``, the windows that hold the day, and ``more``, windows over the days before.

    A running sum of openings minus closings, both counted by day first, as events are not bounded by the calendar."""
    marks = windows.select(*SERIES, F.explode(F.array(
        F.struct(F.col("window_start").alias("date"), F.lit(1).alias("d")), F.struct(F.date_add("window_end", 1).alias("date"), F.lit(-1).alias("d")))).alias("m"))
    marks = marks.groupBy(*SERIES, F.col("m.date").alias("date")).agg(F.sum("m.d").alias("_d"))
    both = days.withColumn("_is_day", F.lit(1)).unionByName(marks.withColumn("_is_day", F.lit(0)), allowMissingColumns=True)
    # The frame ends with the rows of the same day, a day's own openings and closings among them.
    held = F.coalesce(F.sum("_d").over(Window.partitionBy(*SERIES).orderBy("date")), F.lit(0).cast("bigint")).alias("n_windows")
    return both.select(*days.columns, "_is_day", held, *more).filter(F.col("_is_day") == 1).drop("_is_day", "_d", "_end")


def window_days(points: DataFrame, windows: DataFrame) -> DataFrame:
    """How many effect windows hold each day with a point: a running sum of openings minus closings."""
    return _windows_held(points.select(*SERIES, "date").distinct(), windows)
