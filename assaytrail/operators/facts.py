"""What a written summary may say, as a long table: one row per fact of a patient and period.

A fact is a small JSON object. Nothing is gathered per patient; the hash of a patient's facts is a sum over
rows, so it does not depend on their order and is computed with partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import dimensions as dim
from .rollup import change_vs_baseline
from .sequences import within_days
from .series import SERIES
from .trends import evidence_spans

ALL, SINCE_LAST_VISIT, RANGE = "all", "since_last_visit", "range"
# --- Fixed values: wording of rules and changes in a summary -------------------------------------------------
RULES = {"RCV_PREV": "change from the previous result larger than the reference change value",
         "RCV_BASELINE": "change from the patient's own baseline larger than the reference change value",
         "KDIGO_RAPID_EGFR": "eGFR falling faster than the KDIGO 2012 threshold of 5 mL/min/1.73 m² per year"}
CHANGE_WORDS = {"start": "started", "stop": "ended", "dose_change": "dose changed"}


def resolve_periods(reports: DataFrame, patients: DataFrame, kind: str, start: str | None = None,
                    end: str | None = None) -> DataFrame:
    """Period per patient, or the reason there is none. ``reports``: confirmed ones."""
    dates = reports.filter(F.col("collected_at").isNotNull()).select("patient_id", F.col("collected_at").alias("d")).distinct()
    span = dates.groupBy("patient_id").agg(F.min("d").alias("first"), F.max("d").alias("last"))
    w = Window.partitionBy("patient_id").orderBy(F.desc("d"))
    second = dates.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= 2).filter(
        F.col("rank") == 2).select("patient_id", F.col("d").alias("second"))
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    inside = dates.filter(F.col("d").between(lo, hi)).select("patient_id", F.lit(True).alias("inside")).distinct()
    rows = (patients.select("patient_id").join(span, "patient_id", "left").join(second, "patient_id", "left")
            .join(inside, "patient_id", "left"))
    none = F.col("last").isNull()
    if kind == ALL:
        begin, finish, problem = F.col("first"), F.col("last"), F.lit(None).cast("string")
    elif kind == SINCE_LAST_VISIT:
        begin, finish = F.col("second"), F.col("last")
        problem = F.when(F.col("second").isNull(), "needs confirmed reports on two dates")
    else:
        begin, finish = lo, hi
        problem = (F.when(lo.isNull() | hi.isNull(), "a range needs both dates").when(lo > hi, "from is after to")
                   .when(F.col("inside").isNull(), "no confirmed report in this range"))
    reason = F.when(none, "no confirmed report yet").otherwise(problem)
    return rows.select("patient_id", F.lit(kind).alias("kind"), F.when(reason.isNull(), begin).alias("period_start"),
                       F.when(reason.isNull(), finish).alias("period_end"), reason.alias("reason"))


def in_period(rows: DataFrame, periods: DataFrame, date: str = "date", flags: bool = False) -> DataFrame:
    """Rows inside their patient's period. Flags of the last visit's own date count as known already."""
    p = periods.filter(F.col("reason").isNull()).select("patient_id", "kind", "period_start", "period_end")
    after = F.col(date) >= F.col("period_start")
    if flags:
        after = F.when(F.col("kind") == SINCE_LAST_VISIT, F.col(date) > F.col("period_start")).otherwise(after)
    return rows.join(p, "patient_id").filter(after & (F.col(date) <= F.col("period_end"))).drop(
        "kind", "period_start", "period_end")


def _quote(value: Column) -> Column:
    """A number as a summary may quote it: at most two decimals, no trailing zeros."""
    text = F.round(value, 2).cast("decimal(38,2)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def _word(column: Column, words: dict[str, str]) -> Column:
    out = column
    for key, text in words.items():
        out = F.when(column == key, text).otherwise(out)
    return out


def _facts(rows: DataFrame, section: str, **fields: Column) -> DataFrame:
    """Rows as JSON facts with fields in alphabetical order; absent fields are left out."""
    body = F.to_json(F.struct(*[fields[k].cast("string").alias(k) for k in sorted(fields)]))
    return rows.select("patient_id", F.lit(section).alias("section"), body.alias("fact"))


def build(patients: DataFrame, periods: DataFrame, reports: DataFrame, points: DataFrame, days: DataFrame,
          events: DataFrame, summaries: DataFrame, slopes: DataFrame, flags: DataFrame, responses: DataFrame,
          as_of: str) -> DataFrame:
    """All facts of all patients. ``reports``: confirmed ones; ``events``: resolved."""
    spark = patients.sparkSession
    info = dim.analytes(spark).join(dim.systems(spark), "system_id").select("analyte_id", "analyte_name", "unit", "rcv_percent", "rcv_status",
                                                                            "system_name")
    c = F.col
    ok = periods.filter(c("reason").isNull())
    who = ok.join(patients, "patient_id")
    person = _facts(who, "patient", code=c("patient_code"), sex=c("sex"),
                    age=F.year(F.lit(as_of).cast("date")) - c("birth_year"),
                    conditions=F.array_join("conditions", ", "))
    inside = in_period(reports.withColumn("date", c("collected_at")), periods)
    counts = inside.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(
        F.coalesce("lab", F.lit("unknown lab"))).alias("labs"))
    period = _facts(ok.join(counts, "patient_id", "left"), "period", kind=c("kind"), start=c("period_start"),
                    end=c("period_end"), reports=c("n"), labs=c("labs"))
    mine = in_period(flags, periods, flags=True).join(info.drop("rcv_percent"), "analyte_id")
    flag_facts = _facts(
        mine, "flag", analyte=c("analyte_name"), system=c("system_name"), level=c("level"), rule=_word(c("rule_id"), RULES), date=c("date"),
        direction=c("direction"), unit=c("unit"), change_percent=_quote(c("change_percent")),
        compared_with=c("compared_with"), from_value=_quote(c("ref_value")), to_value=_quote(c("value")),
        first_date=c("ref_first"), threshold_percent=_quote(c("rcv_percent")), threshold_status=c("rcv_status"),
        slope_per_year=_quote(c("per_year")), results_used=c("n_points"), span_days=c("span_days"),
        expected_effect=c("expected_effect"), labs_differ=c("cross_lab"))
    shown_points = in_period(points, periods)
    shown_series = shown_points.select(*SERIES).distinct()
    named = shown_series.join(info, "analyte_id")
    results = _facts(in_period(days, periods).join(info, "analyte_id"), "result", analyte=c("analyte_name"),
                     date=c("date"), value=_quote(c("value")), unit=c("unit"))
    limits = _facts(shown_points.filter(c("comparator").isNotNull()).join(info, "analyte_id"), "limit",
                    analyte=c("analyte_name"), date=c("date"), comparator=c("comparator"), limit=_quote(c("value")))
    base = change_vs_baseline(summaries).select(*SERIES, "baseline", "baseline_note", "baseline_first", "baseline_last",
                                                "change_vs_baseline")
    line = slopes.select(*SERIES, "per_year", "slope_status", "n_points", "span_days", "first_used", "last_used",
                         "first_used_value", "last_used_value", "n_excluded")
    trends = named.join(base, SERIES, "left").join(line, SERIES, "left")
    trend_facts = _facts(
        trends, "trend", analyte=c("analyte_name"), system=c("system_name"), unit=c("unit"), baseline=_quote(c("baseline")),
        baseline_first=c("baseline_first"), baseline_last=c("baseline_last"), baseline_note=c("baseline_note"),
        change_vs_baseline=_quote(c("change_vs_baseline")),
        beyond_threshold=F.abs("change_vs_baseline") > c("rcv_percent"), slope=_quote(c("per_year")),
        slope_status=F.when(c("per_year").isNotNull(), c("slope_status")), results_used=c("n_points"),
        span_days=c("span_days"), first_date=c("first_used"), last_date=c("last_used"),
        first_value=_quote(c("first_used_value")), last_value=_quote(c("last_used_value")),
        results_left_out=c("n_excluded"), threshold_percent=_quote(c("rcv_percent")), threshold_status=c("rcv_status"))
    my_events = in_period(events, periods)
    event_facts = _facts(my_events, "event", date=c("date"), drug=c("drug"), change=_word(c("change"), CHANGE_WORDS),
                         dose=F.nullif(c("dose_text"), F.lit("")), drug_class=c("drug_class"))
    mine_resp = in_period(responses.drop("unit"), periods).join(info.select("analyte_id", "unit"), "analyte_id")
    response_facts = _facts(
        mine_resp, "response", event=F.concat_ws(" ", "drug", _word(c("change"), CHANGE_WORDS), c("date").cast("string")),
        analyte=c("analyte_name"), unit=c("unit"), status=c("status"), before_mean=_quote(c("before_mean")),
        after_value=_quote(c("after_value")), after_date=c("after_date"), change_percent=_quote(c("change_percent")),
        threshold_percent=_quote(c("rcv_percent")), beyond_threshold=c("beyond_rcv"), labs_differ=c("cross_lab"),
        expected_direction=F.when(c("change") == "start", c("direction")))
    talked = mine.select(*SERIES).unionByName(mine_resp.select(*SERIES)).distinct()
    notes = data_notes(ok, counts, talked.join(named, SERIES, "left_semi").join(info, "analyte_id"), named,
                       shown_points, my_events)
    out = person
    for part in (period, flag_facts, results, limits, trend_facts, event_facts, response_facts, notes):
        out = out.unionByName(part)
    return out


def data_notes(ok: DataFrame, counts: DataFrame, talked: DataFrame, shown: DataFrame, shown_points: DataFrame,
               events: DataFrame) -> DataFrame:
    """Caveats computed from the data: several labs, unverified thresholds, limits, started drugs."""
    def note(rows: DataFrame, text: Column) -> DataFrame:
        return _facts(rows, "note", text=text)

    labs = note(counts.filter(F.col("labs") > 1), F.format_string(
        "Reports in this period come from %d labs; between-lab variation is larger than the change thresholds assume.",
        F.col("labs")))
    unverified = note(talked.filter(F.col("rcv_status") == "unverified"), F.format_string(
        "The %s change threshold (%s%%) is not yet verified against a published source.", "analyte_name",
        _quote(F.col("rcv_percent"))))
    missing = note(shown.filter(F.col("rcv_percent").isNull()), F.format_string(
        "%s has no established change threshold, so its changes are not flagged.", "analyte_name"))
    censored = note(shown_points.filter(F.col("comparator").isNotNull()).select("patient_id").distinct(), F.lit(
        "Some results were printed as a limit (such as \"<5\"); they are not used in calculations."))
    started = note(events.filter(F.col("change") == "start").select("patient_id").distinct(), F.lit(
        "If a treatment was started because of a high value, some change is expected anyway (regression to the mean)."))
    adherence = note(ok, F.lit("Adherence is not recorded."))
    out = labs
    for part in (unverified, missing, censored, started, adherence):
        out = out.unionByName(part)
    return out


def with_clinical(facts: DataFrame, current: DataFrame, criteria: DataFrame, projections: DataFrame) -> DataFrame:
    """Facts plus KDIGO category, guideline criteria and the eGFR projection."""
    c = F.col
    kdigo = _facts(current, "kdigo", g=c("g"), a=c("a"), egfr=_quote(c("egfr")), uacr=_quote(c("uacr")))
    crit = _facts(criteria, "criterion", title=c("title"), status=c("status"), evidence=c("evidence"),
                  recorded=c("recorded"))
    proj = _facts(projections, "projection", threshold=c("threshold"), category=c("category"), date=c("date"),
                  per_year=_quote(c("per_year")))
    known = facts.select("patient_id").distinct()
    extra = kdigo.unionByName(crit).unionByName(proj).join(known, "patient_id", "left_semi")
    return facts.unionByName(extra)


def facts_hash(facts: DataFrame) -> DataFrame:
    """A hash per patient that is equal for equal facts in any order: sums of the four quarters of each row's SHA-256."""
    digest = F.sha2(F.concat_ws("|", "section", "fact"), 256)
    quarter = lambda k: F.sum(F.conv(F.substring(digest, 16 * k + 1, 16), 16, 10).cast("decimal(20,0)"))
    return facts.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n_facts"), *[quarter(k).alias(f"hash_{'abcd'[k]}") for k in range(4)])


def _spans(rows: DataFrame, section: Column, key: Column, first: str, last: str) -> DataFrame:
    return rows.select(*SERIES, section.alias("section"), key.cast("string").alias("fact_key"), F.col(first).alias("span_first"), F.col(last).alias("span_last"))


def _behind(flags: DataFrame, periods: DataFrame, summaries: DataFrame, responses: DataFrame, points: DataFrame, series: DataFrame) -> DataFrame:
    """(patient_id, section, fact_key, report_id): reports of the uncensored results on the days that flags, baselines of ``series`` and responses rest on.

    Only flags and responses of the period are followed to their days, and the days of all are found among the results in one join by series and time."""
    c = F.col
    spans = _spans(evidence_spans(in_period(flags, periods, flags=True)), F.lit("flag"), c("flag_id"), "span_first", "span_last")
    base = summaries.filter(c("baseline").isNotNull()).join(series, SERIES, "left_semi")
    dates = F.concat(F.transform("before", lambda b: F.struct(F.lit("before").alias("section"), b["day"].alias("date"))),
                     F.array_compact(F.array(F.when(c("after_date").isNotNull(), F.struct(F.lit("after").alias("section"), c("after_date").alias("date"))))))
    around = in_period(responses, periods).select(*SERIES, "event_id", F.explode(dates).alias("d"))
    spans = (spans.unionByName(_spans(base, F.lit("baseline"), c("analyte_id"), "baseline_first", "baseline_last"))
             .unionByName(_spans(around, c("d.section"), F.concat_ws(":", "event_id", "analyte_id"), "d.date", "d.date")))
    values = points.filter(c("comparator").isNull()).select(*SERIES, "date", "report_id")
    return within_days(values, spans, SERIES, "date", "span_first", "span_last", 256).select("patient_id", "section", "fact_key", "report_id")


def fact_citations(flags: DataFrame, periods: DataFrame, labels: DataFrame, summaries: DataFrame, responses: DataFrame, points: DataFrame) -> DataFrame:
    """(patient_id, section, fact_key, label): the reports behind each fact, one row a report.

    Keys: ``flag`` the flag's id, ``result`` analyte:date, ``limit`` the observation's id, ``baseline`` the analyte, ``before`` and ``after``
    event:analyte of a medication response. Results are joined by series and time, so that a busy patient is spread over tasks.
    """
    c = F.col
    mine, limit = in_period(points, periods), c("comparator").isNotNull()
    own = mine.select("patient_id", F.when(limit, "limit").otherwise("result").alias("section"), F.when(limit, c("observation_id").cast("string")).otherwise(
        F.concat_ws(":", "analyte_id", c("date").cast("string"))).alias("fact_key"), "report_id")
    ids = own.unionByName(_behind(flags, periods, summaries, responses, points, mine.select(*SERIES).distinct()))
    # Dealt once for what is distinct and for the labels.
    ids = ids.repartition("patient_id", "report_id").distinct()
    return ids.join(labels.select("patient_id", "report_id", "label"), ["patient_id", "report_id"]).select("patient_id", "section", "fact_key", "label")


def used_reports(flags: DataFrame, periods: DataFrame, reports: DataFrame, labels: DataFrame, summaries: DataFrame, responses: DataFrame,
                 points: DataFrame) -> DataFrame:
    """Reports a summary may cite, with their labels: those of the period and those behind its facts."""
    inside = in_period(reports.withColumn("date", F.col("collected_at")), periods).select("patient_id", "report_id")
    series = in_period(points, periods).select(*SERIES).distinct()
    behind = _behind(flags, periods, summaries, responses, points, series).select("patient_id", "report_id")
    ids = inside.unionByName(behind).distinct()
    return ids.join(labels.select("patient_id", "report_id", "label", "label_number", "collected_at", "lab"),
                    ["patient_id", "report_id"])
