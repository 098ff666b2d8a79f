"""Roll-ups for a patient page: systems, work list, headlines, report labels, timelines and result grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as num
from ..sources import dictionary as d
from ..sources import dimensions as dim
from .sequences import row_numbers
from .series import SERIES

POINT_ORDER = ["date", "report_id", "page", "line", "observation_id"]


def _flag_counts() -> list[Column]:
    change, expected = F.col("level") == "change", F.col("expected_effect").isNotNull()
    return [F.count_if(F.col("level") == "guideline").alias("guideline"),
            F.count_if(change & ~expected).alias("change"), F.count_if(change & expected).alias("expected")]


def flag_counts(flags: DataFrame, keys: list[str]) -> DataFrame:
    """Guideline flags, unexplained change flags and change flags a drug effect explains."""
    return flags.groupBy(*keys).agg(*_flag_counts())


def review_groups(flags: DataFrame) -> DataFrame:
    """Flags as guideline / change / expected, with the change flags a lab change may explain."""
    group = (F.when(F.col("expected_effect").isNotNull(), "expected").when(F.col("level") == "guideline", "guideline")
             .otherwise("change"))
    return flags.withColumn("review_group", group).groupBy("patient_id", "review_group").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("same_lab_agrees")).alias("lab_explained"))


def system_status(patients: DataFrame, points: DataFrame, flags: DataFrame) -> DataFrame:
    """Status of every body system of every patient: guideline > changed > stable > no_data.

    The seven systems are attached with ``explode`` on the patient row, which is no join at all.
    """
    spark = patients.sparkSession
    of_analyte = dim.analytes(spark).select("analyte_id", "system_id")
    data = (points.select(*SERIES).distinct().join(of_analyte, "analyte_id").groupBy("patient_id", "system_id")
            .agg(F.count(F.lit(1)).alias("analytes_with_data")))
    counts = flag_counts(flags.join(of_analyte, "analyte_id"), ["patient_id", "system_id"])
    every = patients.select("patient_id", F.explode(F.array(*[F.lit(r[0]) for r in d.table(d.SYSTEMS)])).alias("system_id"))
    zero = F.lit(0).cast("bigint")
    out = (every.join(data, ["patient_id", "system_id"], "left").join(counts, ["patient_id", "system_id"], "left")
           .join(dim.systems(spark), "system_id"))
    for c in ("analytes_with_data", "guideline", "change", "expected"):
        out = out.withColumn(c, F.coalesce(F.col(c), zero))
    status = (F.when(F.col("analytes_with_data") == 0, "no_data").when(F.col("guideline") > 0, "guideline")
              .when(F.col("change") + F.col("expected") > 0, "changed").otherwise("stable"))
    return out.withColumn("system_status", status)


def patient_cards(patients: DataFrame, reports: DataFrame, flags: DataFrame) -> DataFrame:
    """Counts shown for each patient in the list, patients without results included."""
    confirmed = reports.filter(F.col("status") == "confirmed").groupBy("patient_id", "lab").agg(
        F.count(F.lit(1)).alias("n"), F.max("collected_at").alias("latest"))
    totals = confirmed.groupBy("patient_id").agg(F.sum("n").alias("report_count"), F.count("lab").alias("lab_count"),
                                                 F.max("latest").alias("latest_report_date"))
    cards = (patients.join(totals, "patient_id", "left").join(flag_counts(flags, ["patient_id"]), "patient_id", "left"))
    for c in ("report_count", "lab_count", "guideline", "change", "expected"):
        cards = cards.withColumn(c, F.coalesce(F.col(c), F.lit(0).cast("bigint")))
    return cards


def sort_cards(cards: DataFrame, by: str = "needs_review") -> DataFrame:
    orders = {
        "needs_review": [F.desc("guideline"), F.desc("change"), F.desc_nulls_last("latest_report_date"), "patient_id"],
        "name": [F.lower("name"), "patient_id"],
        "latest_report": [F.desc_nulls_last("latest_report_date"), "patient_id"],
    }
    return cards.orderBy(*orders[by])


def filter_cards(cards: DataFrame, doctor_id: int | None = None, text: str = "", only: str = "all") -> DataFrame:
    """A doctor's cards, searched by name or code; ``only``: all, review or few (under two reports)."""
    out = cards if doctor_id is None else cards.filter(F.col("doctor_id") == doctor_id)
    needle = text.strip().lower()
    if needle:
        out = out.filter(F.lower("name").contains(needle) | F.lower("patient_code").contains(needle))
    if only == "review":
        out = out.filter(F.col("guideline") + F.col("change") > 0)
    return out.filter(F.col("report_count") < 2) if only == "few" else out


def change_vs_baseline(summaries: DataFrame) -> DataFrame:
    """Latest day against the baseline, only when it is after the baseline days."""
    after = F.col("latest_date") > F.col("baseline_last")
    return summaries.withColumn("change_vs_baseline", F.when(
        after, num.pct_change(F.col("latest_value"), F.round("baseline", 4))))


def headlines(points: DataFrame, summaries: DataFrame, slopes: DataFrame) -> DataFrame:
    """Headline analyte of each system: latest point (censored or not), baseline, change and slope."""
    spark = points.sparkSession
    wanted = dim.systems(spark).select("system_id", F.col("headline_analyte").alias("analyte_id"))
    latest = points.groupBy(*SERIES).agg(F.max_by(F.struct("date", "value", "comparator", "report_id"),
                                                  F.struct(*POINT_ORDER)).alias("latest"))
    base = change_vs_baseline(summaries).select(*SERIES, F.round("baseline", 4).alias("baseline"), "change_vs_baseline")
    target = dim.targets(spark).select("analyte_id", "target_low", "target_high")
    implied = F.col("baseline") * (1 + F.col("change_vs_baseline") / 100)
    return (latest.join(wanted, "analyte_id").join(base, SERIES, "left")
            .join(slopes.select(*SERIES, "per_year", "slope_status"), SERIES, "left").join(target, "analyte_id", "left")
            .select(*SERIES, "system_id", F.col("latest.date").alias("latest_date"),
                    F.col("latest.value").alias("latest_value"), F.col("latest.comparator").alias("latest_comparator"),
                    F.col("latest.report_id").alias("latest_report"), "baseline", "change_vs_baseline", "per_year",
                    "slope_status", num.target_direction(F.col("baseline"), implied, F.col("target_low"),
                                                         F.col("target_high")).alias("target_direction")))


def report_labels(reports: DataFrame) -> DataFrame:
    """R1..Rn over a patient's confirmed reports by (date, id), undated ones first."""
    confirmed = reports.filter(F.col("status") == "confirmed").select("patient_id", "report_id", "collected_at", "lab")
    out = row_numbers(confirmed, ["patient_id"], "collected_at", ["report_id"], "label_number")
    return out.withColumn("label", F.concat(F.lit("R"), F.col("label_number").cast("string")))


def label_runs(numbers: DataFrame, keys: list[str], n: str = "label_number") -> DataFrame:
    """Runs of consecutive numbers per key: inside a run, number minus position is constant.

    Positions are taken inside of a thousand numbers, then over one row a thousand, so a busy key is no single window.
    """
    m = numbers.select(*keys, F.col(n).cast("bigint").alias("n")).distinct().withColumn("_thousand", F.floor(F.col("n") / 1000))
    placed = row_numbers(m, keys, "_thousand", ["n"], "_position")
    runs = placed.withColumn("island", F.col("n") - F.col("_position")).groupBy(*keys, "island").agg(F.min("n").alias("run_start"), F.max("n").alias("run_end"))
    text = F.when(F.col("run_end") > F.col("run_start"),
                  F.format_string("R%d–R%d", "run_start", "run_end")).otherwise(F.format_string("R%d", "run_start"))
    return runs.withColumn("run_text", text).drop("island")


def timeline(points: DataFrame) -> DataFrame:
    """Confirmed values with dictionary order, LOINC code and unit."""
    info = dim.analytes(points.sparkSession).select("analyte_id", "analyte_order", "analyte_name", "loinc", "unit")
    return points.join(info, "analyte_id")


def noise_band(summaries: DataFrame, points: DataFrame) -> DataFrame:
    """Noise of one result (RCV / sqrt 2) and the threshold line on the side the series moved to."""
    latest = points.groupBy(*SERIES).agg(F.max_by("value", F.struct(*POINT_ORDER)).alias("last_value"))
    info = dim.analytes(points.sparkSession).select("analyte_id", "rcv_percent")
    sign = F.when(F.col("last_value") < F.col("baseline"), -1).otherwise(1)
    return (summaries.filter(F.col("baseline").isNotNull()).select(*SERIES, F.round("baseline", 4).alias("baseline"))
            .join(latest, SERIES).join(info, "analyte_id").filter(F.col("rcv_percent").isNotNull())
            .withColumn("noise_percent", F.col("rcv_percent") / F.sqrt(F.lit(2.0)))
            .withColumn("threshold_line", F.col("baseline") * (1 + sign * F.col("rcv_percent") / 100)))


def no_single_step(flags: DataFrame) -> DataFrame:
    """Slope flags with no unexplained step since the first day of the slope.

    Only the latest such step of a series matters, so steps are reduced before the join.
    """
    latest_step = (flags.filter((F.col("rule_id") == "RCV_PREV") & F.col("expected_effect").isNull())
                   .groupBy(*SERIES).agg(F.max("date").alias("latest_step")))
    rapid = flags.filter(F.col("rule_id") == "KDIGO_RAPID_EGFR")
    return (rapid.join(latest_step, SERIES, "left")
            .filter(F.col("latest_step").isNull() | (F.col("latest_step") < F.col("ref_first"))).drop("latest_step"))


def new_guideline_flags(before: DataFrame, after: DataFrame) -> DataFrame:
    """Guideline flags present now that were not there before."""
    guideline = F.col("level") == "guideline"
    known = before.filter(guideline).select("patient_id", "flag_id")
    return after.filter(guideline).join(known, ["patient_id", "flag_id"], "left_anti")


def sort_last_tests(last_tests: DataFrame) -> DataFrame:
    """Position in the patient's list: overdue tests first, then the ones longest ago."""
    order = Window.partitionBy("patient_id").orderBy(F.desc("longer_than_interval"), F.desc("days_since"), "analyte_id")
    return last_tests.withColumn("position", F.row_number().over(order))


def review_order(observations: DataFrame) -> DataFrame:
    """Position of a row in the review of its report: tracked tests first, then as printed."""
    order = Window.partitionBy("report_id").orderBy((F.col("status") == "not_tracked").cast("int"), "page", "line")
    return observations.withColumn("position", F.row_number().over(order))


def newest_documents(documents: DataFrame) -> DataFrame:
    """Documents with their position in the patient's list, newest first: inside of a day (numbers: of a thousand), then over one row a day."""
    timed = documents.schema["created_at"].dataType.typeName() in ("timestamp", "timestamp_ntz", "date")
    stretch = F.to_date("created_at") if timed else F.floor(F.col("created_at") / 1000)
    return row_numbers(documents.withColumn("_stretch", stretch), ["patient_id"], "_stretch", [F.desc("created_at"), F.desc("document_id")], "position",
                       newest_first=True).drop("_stretch")


def latest_summaries(summaries: DataFrame) -> DataFrame:
    """The newest saved summary per patient and period."""
    content = F.struct(*[c for c in summaries.columns if c not in ("patient_id", "period")])
    newest = summaries.groupBy("patient_id", "period").agg(
        F.max_by(content, F.struct("created_at", "summary_id")).alias("s"))
    return newest.select("patient_id", "period", "s.*")
