from pyspark.sql import functions as F

from assaytrail.operators import response as R
from assaytrail.operators import series as S
from tests import patients as fx
from tests.patients import day


def responses(spark, points, events=None):
    events = S.resolve_drugs(fx.events(spark) if events is None else events)
    return R.responses(S.event_effects(events), S.day_values(points)), events


def test_golden_responses(spark):
    rows, events = responses(spark, fx.points(spark))
    rows = R.verdict_notes(R.confounder_counts(rows, events))
    got = {(r.event_id, r.analyte_id): r for r in rows.collect()}
    metformin = got[1, "hba1c"]
    assert (metformin.status, round(metformin.before_mean, 4), metformin.after_value) == ("assessed", 8.8, 7.4)
    assert metformin.after_date == day("2024-02-15") and metformin.change_percent == -15.9
    assert metformin.beyond_rcv and metformin.cross_lab and metformin.n_confounders == 0
    assert metformin.verdict == "seen" and metformin.verdict_note.startswith("Expected fall seen: HbA1c fell 15.9%")
    ramipril = got[2, "creatinine"]
    assert (round(ramipril.before_mean, 4), ramipril.change_percent, ramipril.beyond_rcv) == (1.1167, 15.5, True)
    assert got[2, "egfr"].change_percent == -16.2 and not got[2, "egfr"].beyond_rcv
    sglt2i = got[3, "egfr"]
    assert sglt2i.single_prior and sglt2i.change_percent == -5.3 and sglt2i.n_confounders == 1
    assert got[3, "creatinine"].change_percent == 4.7
    assert {k: got[k].verdict for k in ((1, "hba1c"), (2, "creatinine"), (2, "egfr"), (3, "egfr"))} == dict.fromkeys(
        ((1, "hba1c"), (2, "creatinine"), (2, "egfr"), (3, "egfr")), "seen")
    assert got[4, "tsh"].verdict == "not seen"
    near = {(r.event_id, r.analyte_id, r.other_event, r.days_from_event) for r in
            R.confounders(responses(spark, fx.points(spark))[0], events).collect()}
    assert (3, "egfr", 2, -63) in near
    assert len(near) == sum(r.n_confounders for r in got.values())
    rolled = {r.event_id: (r.seen, r.judged) for r in R.verdict_rollup(rows).collect()}
    assert rolled[1] == (1, 1) and rolled[4] == (0, 2)


def test_too_early(spark):
    rows, _ = responses(spark, fx.points(spark, 3))
    assert rows.filter("event_id = 1").first().status == "too early to assess"


def test_verdicts(spark):
    values = {1: 8.4, 2: 3.0, 3: 15.0}
    rows, events = [], []
    for patient, after in values.items():
        for i, (date, v) in enumerate((("2024-01-01", 9.0), ("2024-02-01", 9.0), ("2024-04-15", after))):
            rows.append((patient, "tsh", i, i, day(date), v, None, "A", 1, 1))
        events.append((patient, patient, "Levothyroxine", "start", "", day("2024-02-10")))
    events.append((9, 1, "Levothyroxine", "dose_change", "", day("2024-02-10")))
    got, _ = responses(spark, spark.createDataFrame(rows, fx.POINTS), spark.createDataFrame(events, fx.EVENTS))
    assert {r.event_id: r.verdict for r in got.filter("analyte_id = 'tsh'").collect()} == {
        1: "not seen", 2: "seen", 3: "opposite", 9: None}
