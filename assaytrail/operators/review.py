"""A reviewer's batch over many reports: edits, rejections, added lines, the confirm gate, and deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import normalise as N

EDITS = ("observation_id bigint, reject boolean, value_text string, unit_text string, sets_analyte boolean, "
         "analyte_id string")
ADDS = ("report_id bigint, page int, line int, test_text string, value_text string, unit_text string, "
        "range_text string, analyte_id string")
STATE = ["analyte_id", "match", "basis", "comparator", "value_number", "canonical_value", "canonical_unit", "status",
         "status_reason"]
REPORT_EDITS = "report_id bigint, collected_at date, lab string"
ENTERED = "Entered by doctor"


def normalise_chosen(rows: DataFrame, chosen: str) -> DataFrame:
    """Normalise rows again; where ``chosen`` is set it is the analyte, whatever the name says."""
    matched = N.match_names(rows.drop(*STATE))
    given = F.col(chosen).isNotNull()
    basis = N.chosen_basis(F.col("test_text"), F.col(chosen), F.col("analyte_id"), F.col("basis"))
    matched = (matched.withColumn("basis", F.when(given, basis).otherwise(F.col("basis")))
               .withColumn("match", F.when(given, "doctor").otherwise(F.col("match")))
               .withColumn("candidates", F.when(given, F.array(chosen)).otherwise(F.col("candidates")))
               .withColumn("analyte_id", F.when(given, F.col(chosen)).otherwise(F.col("analyte_id"))))
    return N.convert(matched).drop("candidates")


def refused_adds(observations: DataFrame, adds: DataFrame) -> DataFrame:
    """Added lines that point to a line already holding a live observation."""
    taken = observations.filter(F.col("status") != "rejected").select("report_id", "page", "line")
    return adds.join(taken, ["report_id", "page", "line"], "left_semi")


def apply_review(observations: DataFrame, edits: DataFrame, adds: DataFrame, reports: DataFrame,
                 patients: DataFrame) -> DataFrame:
    """Observations after the batch, eGFR recomputed. Rows without an edit pass through unchanged."""
    columns = observations.columns
    c = F.col
    e = edits.select("observation_id", *[c(x).alias(f"e_{x}") for x in edits.columns if x != "observation_id"])
    # All rows stay one frame, so that they are dealt by id once; a row without work has no name and no value to normalise.
    rows = observations.join(e, "observation_id", "left").withColumn("_touched", c("e_reject").isNotNull())
    rows = rows.withColumn("_work", c("_touched") & ~c("e_reject"))
    sets = F.coalesce("e_sets_analyte", F.lit(False))
    unmapped = (sets & c("e_analyte_id").isNull()) | (~sets & F.coalesce(c("match") == "doctor", F.lit(False)) & c("analyte_id").isNull())
    texts = {"value_text": F.coalesce(F.trim("e_value_text"), "value_text"), "unit_text": F.coalesce(F.trim("e_unit_text"), "unit_text")}
    kept = [x for x in columns if x in STATE or x == "test_text" or x in texts]
    rows = rows.withColumns({
        "_unmapped": c("_work") & unmapped, "_choice": F.when(c("_work"), F.when(sets, c("e_analyte_id")).when(c("match") == "doctor", c("analyte_id"))),
        **{f"_old_{x}": c(x) for x in kept}, "test_text": F.when(c("_work"), c("test_text")), **{x: F.when(c("_work"), v) for x, v in texts.items()}})
    rows = normalise_chosen(rows, "_choice")
    none, nothing = F.lit(None).cast("string"), F.lit(None).cast("double")
    marks: dict[str, Column] = {"analyte_id": none, "match": F.lit("doctor"), "canonical_unit": none, "canonical_value": nothing,
                                "status": F.lit("not_tracked"), "status_reason": F.lit("marked not tracked by the doctor")}
    refused: dict[str, Column] = {"status": F.lit("rejected"), "status_reason": F.lit("rejected by the doctor"), "canonical_value": nothing}

    def after(x: str) -> Column:
        old = c(f"_old_{x}")
        new = old if x == "test_text" else F.when(c("_unmapped"), marks[x]).otherwise(c(x)) if x in marks else c(x)
        other = F.when(c("_touched"), refused[x]).otherwise(old) if x in refused else old
        return F.when(c("_work"), new).otherwise(other).alias(x)

    out = rows.select(*[after(x) if x in kept else c(x) for x in columns])
    accepted = adds.join(refused_adds(observations, adds), ["report_id", "page", "line"], "left_anti")
    added = normalise_chosen(accepted.withColumnRenamed("analyte_id", "_choice"), "_choice")
    added = added.select(*[c for c in columns if c in added.columns])
    return N.recompute_egfr(out.unionByName(added, allowMissingColumns=True), reports, patients)


def edit_reports(reports: DataFrame, edits: DataFrame, patients: DataFrame, as_of: str) -> DataFrame:
    """Reports after a reviewer's dates and lab names, with ``refused`` where a batch gives a date outside the birth year and ``as_of``.

    ``edits`` has one row a report; null leaves a field as it is, an empty lab name takes the name away. Of a refused batch nothing is taken
    over. A date counts as entered only if it differs from the one on the report.
    """
    e = edits.select("report_id", F.col("collected_at").alias("_date"), F.trim("lab").alias("_lab"))
    base = reports if "date_label" in reports.columns else reports.withColumn("date_label", F.lit(None).cast("string"))
    rows = base.join(e, "report_id", "left").join(patients.select("patient_id", F.col("birth_year").alias("_born")), "patient_id", "left")
    inside = (F.year("_date") >= F.col("_born")) & (F.col("_date") <= F.lit(as_of).cast("date"))
    refused = F.col("_date").isNotNull() & ~F.coalesce(inside, F.lit(False))
    rows = rows.withColumn("refused", F.when(refused, "the date must be between the patient's birth year and today"))
    taken = F.col("refused").isNull()
    dated = taken & F.col("_date").isNotNull() & ~F.col("_date").eqNullSafe(F.col("collected_at"))
    named = taken & F.col("_lab").isNotNull()
    return (rows.withColumn("date_label", F.when(dated, ENTERED).otherwise(F.col("date_label")))
            .withColumn("collected_at", F.when(dated, F.col("_date")).otherwise(F.col("collected_at")))
            .withColumn("lab", F.when(named, F.nullif("_lab", F.lit(""))).otherwise(F.col("lab")))
            .select(*base.columns, "refused"))


def skipped_after(skipped: DataFrame, observations: DataFrame, adds: DataFrame) -> DataFrame:
    """Skipped lines that are left after the batch: a line that an accepted added one points to is used up."""
    place = ["report_id", "page", "line"]
    accepted = adds.join(refused_adds(observations, adds), place, "left_anti").select(*place)
    return skipped.join(accepted, place, "left_anti")


def confirm_gate(observations: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, reports) after confirming every report with a date and nothing left to review."""
    live = F.col("status") != "rejected"
    pending = observations.groupBy("report_id").agg(
        F.count_if(live & (F.col("status") == "needs_review")).alias("pending"))
    gated = (reports.join(pending, "report_id", "left").withColumn("pending", F.coalesce("pending", F.lit(0)))
             .withColumn("_ok", (F.col("pending") == 0) & F.col("collected_at").isNotNull()))
    done = gated.withColumn("status", F.when(F.col("_ok"), "confirmed").otherwise(F.col("status")))
    passed = gated.filter("_ok").select("report_id", F.lit(True).alias("_ok"))
    confirmed = observations.join(passed, "report_id", "left").withColumn(
        "status", F.when(F.col("_ok") & (F.col("status") == "extracted"), "confirmed").otherwise(F.col("status")))
    return confirmed.drop("_ok"), done.drop("_ok")


def plausible_dates(reports: DataFrame, patients: DataFrame, as_of: str) -> DataFrame:
    """Reports dated between the patient's birth year and ``as_of``."""
    born = patients.select("patient_id", "birth_year")
    return reports.join(born, "patient_id").filter(
        (F.year("collected_at") >= F.col("birth_year")) & (F.col("collected_at") <= F.lit(as_of).cast("date")))


def plausible_events(events: DataFrame, patients: DataFrame, as_of: str) -> DataFrame:
    born = patients.select("patient_id", "birth_year")
    return events.join(born, "patient_id").filter(
        (F.year("date") >= F.col("birth_year")) & (F.col("date") <= F.lit(as_of).cast("date")))
