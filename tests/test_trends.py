from pyspark.sql import functions as F

from tests import patients as fx
from tests.patients import day
from assaytrail.operators import series as S
from assaytrail.operators import trends as T


def build(spark, points=None, events=None):
    points = fx.points(spark) if points is None else points
    events = fx.events(spark) if events is None else events
    days = S.day_values(points)
    effects = S.event_effects(S.resolve_drugs(events))
    frame = S.frame(days, S.event_bounds(effects))
    return points, days, effects, S.effect_windows(effects), frame, S.summaries(frame)


def series(spark, rows, analyte="hba1c"):
    data = [(1, analyte, i, i, day(date), float(v), comparator, lab, 1, 1)
            for i, (date, v, comparator, lab) in enumerate(rows, 1)]
    return spark.createDataFrame(data, fx.POINTS)


def test_flags_of_the_golden_patient(spark):
    _, _, _, windows, frame, summaries = build(spark)
    flags = T.all_flags(frame, windows).filter("patient_id = 1").collect()
    assert len(flags) == 6
    by = {(f.rule_id, f.analyte_id, str(f.date)): f for f in flags}
    prev = by["RCV_PREV", "creatinine", "2024-04-01"]
    assert prev.change_percent == 16.2 and prev.expected_effect == "within the ≤30% rise expected after ACEi/ARB start"
    assert by["RCV_PREV", "hba1c", "2024-02-15"].change_percent == -14.0
    assert by["RCV_PREV", "hba1c", "2024-02-15"].effect_class == "biguanide"
    assert by["RCV_BASELINE", "creatinine", "2026-03-02"].change_percent == 34.2
    assert by["RCV_BASELINE", "egfr", "2026-03-02"].change_percent == -31.1
    assert by["RCV_BASELINE", "hba1c", "2026-03-02"].change_percent == -19.3
    rapid = by["KDIGO_RAPID_EGFR", "egfr", "2026-03-02"]
    assert (rapid.per_year, rapid.n_points, rapid.span_days) == (-7.081, 4, 503)
    assert all(f.cross_lab for f in flags)
    assert rapid.flag_id == "KDIGO_RAPID_EGFR:egfr:2026-03-02"


def test_nine_reports_give_five_flags_and_no_projection(spark):
    _, _, _, windows, frame, summaries = build(spark, fx.points(spark, 9))
    flags = T.all_flags(frame, windows).filter("patient_id = 1")
    assert flags.count() == 5
    slope = T.slopes(summaries).filter("patient_id = 1 and analyte_id = 'egfr'").first()
    assert (slope.n_points, slope.span_days, slope.slope_status, slope.n_excluded) == (3, 321, "not enough span", 6)
    assert slope.first_used == day("2024-10-15") and round(slope.per_year, 1) == -6.6
    assert T.projections(T.slopes(summaries)).count() == 0


def test_baseline_and_projection(spark):
    _, _, _, _, _, summaries = build(spark)
    egfr = summaries.filter("patient_id = 1 and analyte_id = 'egfr'").first()
    assert round(egfr.baseline, 4) == 78.42 and egfr.baseline_note is None
    p = T.projection_note(T.projections(T.slopes(summaries))).first()
    assert (p.threshold, p.category, p.n_points, p.date) == (45, "G3b", 4, day("2027-06-23"))
    assert (p.from_value, p.per_year_low, p.per_year_high) == (54.28, -8.296, -5.866)
    assert "Jun 2027" in p.note


def test_latest_date_of_a_projection_has_a_status(spark):
    slopes = T.slopes(build(spark)[5]).filter("analyte_id = 'egfr'")
    assert T.projections(slopes).first().latest_status == "dated"
    flat = slopes.withColumn("syy", F.col("syy") * 100)
    may_rise = T.projection_note(T.projections(flat)).first()
    assert (may_rise.latest_status, may_rise.date_latest) == ("may not fall", None) and "no latest date" in may_rise.note
    late = slopes.withColumn("syy", F.col("line_slope") * F.col("sxy") + F.col("sxx") * 2 * F.pow((-F.col("line_slope") - 0.0005) / 4.303, F.lit(2)))
    row = T.projection_note(T.projections(late)).first()
    assert (row.latest_status, row.date_latest) == ("beyond the calendar", None) and "latest date beyond the calendar" in row.note


def test_texts_of_flags(spark):
    _, _, _, windows, frame, _ = build(spark)
    rows = {r.flag_id: r for r in T.flag_messages(T.all_flags(frame, windows)).filter("patient_id = 1").collect()}
    assert len(rows) == 6
    change = rows["RCV_PREV:creatinine:2024-04-01"]
    assert change.message == ("Serum Creatinine rose 16.2% from the previous result (1.11 → 1.29 mg/dL), more than its reference change value of 15%.")
    assert change.source.startswith("CVi: EFLM") and change.cross_lab_note.endswith("larger than the RCV assumes")
    assert rows["RCV_BASELINE:hba1c:2026-03-02"].message == "HbA1c fell 19.3% from the baseline (8.8 → 7.1 %), more than its reference change value of 6.3%."
    assert rows["RCV_BASELINE:hba1c:2026-03-02"].lab_change_note is None
    rapid = rows["KDIGO_RAPID_EGFR:egfr:2026-03-02"]
    assert rapid.message == ("eGFR fell by 7.1 mL/min/1.73m² per year over 503 days (4 results since the last drug window), faster than the KDIGO "
                             "threshold of 5 per year.")
    assert rapid.source.startswith("KDIGO 2012") and rapid.cross_lab_note.endswith("to the slope")


def test_notes_of_a_lab_change(spark):
    none = spark.createDataFrame([], fx.EVENTS)

    def notes(rows):
        points, _, _, windows, frame, _ = build(spark, series(spark, rows), none)
        flags = T.all_flags(frame, windows).filter("rule_id = 'RCV_PREV'")
        return ({str(r.date): r.lab_change_note for r in T.flag_messages(flags).collect()},
                {(str(r.date), r.report_id) for r in T.lab_change_reports(flags, points).collect()})

    begin = "This change coincides with a change of lab, from A to B."
    later, reports = notes([("2024-01-01", 7, None, "A"), ("2024-02-01", 9, None, "B"), ("2024-03-01", 7.1, None, "A")])
    assert later["2024-02-01"] == begin + (" The A result of 2024-03-01 (7.1) is within the reference change value of the A result of 2024-01-01 (7): this "
                                           "change may reflect the difference between the labs rather than the patient.")
    assert ("2024-03-01", 3) in reports
    before, reports = notes([("2024-01-01", 7, None, "B"), ("2024-02-01", 7.1, None, "A"), ("2024-03-01", 9, None, "B")])
    assert before["2024-03-01"] == begin + " Results from B alone show a change as well (2024-01-01: 7)." and reports == {("2024-01-01", 1)}
    alone, reports = notes([("2024-01-01", 7, None, "A"), ("2024-02-01", 9, None, "B")])
    assert alone == {"2024-02-01": begin} and not reports
    unknown, _ = notes([("2024-01-01", 7, None, None), ("2024-02-01", 9, None, "B")])
    assert unknown == {"2024-02-01": None}


def test_results_that_a_slope_leaves_out(spark):
    points, _, _, windows, frame, summaries = build(spark)
    rows = T.slope_exclusions(frame, windows, points).filter("patient_id = 1 and analyte_id = 'egfr'").collect()
    assert len(rows) == T.slopes(summaries).filter("patient_id = 1 and analyte_id = 'egfr'").first().n_excluded == 6
    assert {r.reason for r in rows} == {"on or before the end of the expected-effect window of Empagliflozin started 2024-05-06 (window ends 2024-08-04)"}
    one_day = build(spark, series(spark, [("2024-01-01", 8, None, "A")]), spark.createDataFrame([(1, 1, "Metformin", "start", "", day("2024-03-15"))], fx.EVENTS))
    assert T.slope_exclusions(one_day[4], one_day[3], one_day[0]).count() == 0


def test_baseline_before_an_event_and_on_treatment(spark):
    rows = [("2024-01-01", 9.0, None, "A"), ("2024-02-01", 8.0, None, "A"), ("2024-03-01", 8.6, None, "A"),
            ("2024-06-01", 7.0, None, "A")]
    early = spark.createDataFrame([(1, 1, "Metformin", "stop", "", day("2024-03-15"))], fx.EVENTS)
    late = spark.createDataFrame([(1, 1, "Metformin", "start", "", day("2024-01-15"))], fx.EVENTS)
    first = build(spark, series(spark, rows), early)[5].first()
    assert first.baseline == 8.6 and first.baseline_note is None
    second = build(spark, series(spark, rows), late)[5].first()
    assert second.baseline == 8.6 and second.baseline_note == "includes on-treatment results"


def test_censored_values_are_never_used(spark):
    rows = [("2024-01-01", 300, ">", "A"), ("2024-02-01", 40, None, "A"), ("2024-03-01", 44, None, "A"),
            ("2024-04-01", 60, None, "A")]
    points, days, *_, summaries = build(spark, series(spark, rows, "uacr"))
    assert summaries.first().baseline == 44.0
    assert T.trend_status(points, days).first().trend_status == "ok"
    all_censored = build(spark, series(spark, [("2024-01-01", 5, "<", "A")], "uacr"))
    assert T.trend_status(all_censored[0], all_censored[1]).first().trend_status == "censored values only"


def test_values_of_one_date_are_averaged(spark):
    rows = [("2024-01-01", 1.0, None, "A"), ("2024-01-01", 1.2, None, None), ("2024-02-01", 1.1, None, "A")]
    _, days, *_ = build(spark, series(spark, rows, "creatinine"))
    first = days.orderBy("date").first()
    assert round(first.value, 9) == 1.1 and first.n_values == 2 and first.lab_lo == "" and first.lab_hi == "A"


def test_change_equal_to_the_threshold_is_no_flag(spark):
    rows = [("2024-01-01", 1.0, None, "A"), ("2024-02-01", 1.15, None, "A"), ("2024-03-01", 0.0, None, "A"),
            ("2024-04-01", 2.0, None, "A")]
    _, _, _, windows, frame, summaries = build(spark, series(spark, rows, "creatinine"))
    flags = T.rcv_prev(frame).collect()
    assert [(str(f.date), f.change_percent) for f in flags] == [("2024-03-01", -100.0)]


def test_lab_change_agreement(spark):
    agree = [("2024-01-01", 8.8, None, "A"), ("2024-02-01", 8.4, None, "A"), ("2024-03-01", 3.9, None, "B"),
             ("2024-04-01", 8.1, None, "A")]
    _, _, _, _, frame, _ = build(spark, series(spark, agree, "tsh"))
    assert [f.same_lab_agrees for f in T.rcv_prev(frame).orderBy("date").collect()] == [True, True]
    not_agree = agree[1:3] + [("2024-04-01", 3.5, None, "A")]
    _, _, _, _, frame, _ = build(spark, series(spark, not_agree, "tsh"))
    assert [f.same_lab_agrees for f in T.rcv_prev(frame).collect()] == [False]


def test_thyroid_patient(spark):
    _, _, _, windows, frame, summaries = build(spark)
    flags = T.all_flags(frame, windows).filter("patient_id = 2").collect()
    assert len(flags) == 4
    assert all(f.rule_id == "RCV_PREV" and f.same_lab_agrees for f in flags)
    assert {str(f.date) for f in flags} == {"2025-06-16", "2025-12-15"}


def test_last_test_and_windows(spark, as_of):
    points, _, _, windows, _, summaries = build(spark)
    hba1c = T.last_tests(points, as_of).filter("patient_id = 1 and analyte_id = 'hba1c'").first()
    assert (hba1c.date, hba1c.days_since, hba1c.longer_than_interval) == (day("2026-03-02"), 210, True)
    inside = {(r.analyte_id, str(r.date), r.event_id) for r in T.points_in_windows(points, windows).collect()}
    assert ("creatinine", "2024-04-01", 2) in inside and ("egfr", "2024-06-10", 3) in inside
    counts = {(r.patient_id, r.analyte_id, r.date): r.n_windows for r in T.window_days(points, windows).collect()}
    long_form = {}
    for r in T.points_in_windows(points, windows).select("patient_id", "analyte_id", "date", "event_id").distinct().collect():
        key = (r.patient_id, r.analyte_id, r.date)
        long_form[key] = long_form.get(key, 0) + 1
    assert {k: v for k, v in counts.items() if v} == long_form


def test_evidence_rows(spark):
    points, _, _, windows, frame, summaries = build(spark)
    flags = T.all_flags(frame, windows)
    rows = T.flag_evidence(flags, points).filter("flag_id = 'KDIGO_RAPID_EGFR:egfr:2026-03-02'").collect()
    assert sorted(r.report_id for r in rows) == [7, 8, 9, 10]
    base = T.flag_evidence(flags, points).filter("flag_id = 'RCV_BASELINE:egfr:2026-03-02'").collect()
    assert sorted((r.role, r.report_id) for r in base) == [("from", 1), ("from", 2), ("from", 3), ("to", 10)]


def test_result_table(spark):
    points, _, _, windows, _, summaries = build(spark)
    rows = T.result_table(points, windows, T.slopes(summaries)).filter(
        "patient_id = 1 and analyte_id = 'egfr'").orderBy("date").collect()
    assert rows[0].change_vs_previous is None and round(rows[1].change_vs_previous, 1) == -3.2
    assert [r.in_trend for r in rows] == ["Before drug windows"] * 4 + ["Drug window"] * 2 + ["Yes"] * 4
