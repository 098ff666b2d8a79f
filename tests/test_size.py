"""What a query moves and how often it reads its input, and results beside a plain way to get them."""
import datetime as dt
import itertools
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaytrail.operators import normalise as N
from assaytrail.operators import quality as Q
from assaytrail.operators import tagging as G
from assaytrail.operators import trends as T
from assaytrail.plans.lab import Lab
from assaytrail.plans.queries import QUERIES
from assaytrail.sources import adapters as A
from assaytrail.streaming import alerts, refresh

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tags_of_many_lines_are_those_of_each_line():
    rng = np.random.default_rng(7)
    rows = [rng.integers(0, 3, (n, len(G.TAGS))).astype("float64") for n in (0, 1, 2, 2, 3, 3, 3)]

    def best(scores):
        paths = [p for p in itertools.product(range(len(G.TAGS)), repeat=len(scores)) if all(
            not G.TAGS[t].startswith("I-") or (i and G.TAGS[p[i - 1]][2:] == G.TAGS[t][2:]) for i, t in enumerate(p))]
        return [G.TAGS[t] for t in max(paths, key=lambda p: (sum(scores[i][t] for i, t in enumerate(p)), [-t for t in reversed(p)]))]

    assert G.best_tags_of(rows) == [best(scores) for scores in rows]


def test_entity_scores_with_nulls_and_differing_rows(spark):
    rows = [(["B-TEST", "I-TEST", "B-X"], ["B-TEST", "B-VALUE", "B-X"]), (["B-TEST", None], ["B-TEST", None]), (None, ["B-UNIT"]), (["B-FLAG"], None),
            (["B-VALUE", "I-VALUE"], ["B-VALUE", "I-VALUE"])]
    got = {r.kind: (r.support, r.precision, r.recall) for r in Q.entity_scores(
        spark.createDataFrame(rows, "tags array<string>, predicted array<string>"), [[]]).collect()}
    assert got == {"TEST": (2, 0.5, 0.5), "VALUE": (1, 0.5, 1.0), "UNIT": (0, 0.0, 0.0), "FLAG": (1, 0.0, 0.0), "overall": (4, 0.4, 0.5)}


def test_egfr_reads_its_rows_once_and_null_reports_stay_apart(spark, tmp_path):
    rows = [(1, "creatinine", 1.0), (1, "egfr", None), (None, "creatinine", 1.0), (None, "egfr", None)]
    schema = "report_id bigint, analyte_id string, canonical_value double"
    spark.createDataFrame(rows, schema).selectExpr(
        "*", "1 page", "1 line", "'o' observation_id", "cast(null as string) comparator", "'' canonical_unit", "'extracted' status", "'' status_reason").write.parquet(f"{tmp_path}/rows")
    reports = spark.createDataFrame([(1, 1, dt.date(2020, 1, 1))], "report_id bigint, patient_id bigint, collected_at date")
    patients = spark.createDataFrame([(1, "male", 1960)], "patient_id bigint, sex string, birth_year int")
    out = N.recompute_egfr(spark.read.parquet(f"{tmp_path}/rows"), reports, patients)
    assert _plan(out).count("FileScan") == 1
    assert {(r.report_id, r.status) for r in out.collect() if r.analyte_id == "egfr"} == {(1, "extracted"), (None, "needs_review")}


def test_statuses_in_one_pass_are_those_of_both_parts(spark):
    reports = A.reports(spark, SF)
    twice = reports.unionByName(reports.filter("report_id % 3 = 0"))                     # a report that is listed twice
    args = A.printed_results(spark, SF), twice, A.patients(spark, SF)
    two = N.status_counts(*N.normalise(*args))
    one = N.printed_status_counts(*args)
    assert one.exceptAll(two).count() == two.exceptAll(one).count() == 0 and two.filter("skipped > 0").count() > 0


def test_line_items_are_dealt_before_they_become_results(spark):
    plan = _plan(QUERIES["printed_units"](spark, SF))
    assert 0 <= plan.index("Generate") < plan.index("REPARTITION_BY_NUM")          # the plan is printed from its end
    assert "REPARTITION_BY_NUM" in _plan(A.printed_results(spark, SF)) and _plan(QUERIES["delete_documents"](spark, SF)).count("REPARTITION_BY_NUM") >= 2


@pytest.mark.parametrize("patient", [1, None])
def test_a_batch_of_steps_may_be_repeated(spark, tmp_path, patient):
    def batch(*days):
        return spark.createDataFrame([(patient, "potassium", str(d), d, dt.date(2024, 1, d), float(v), None, "A", 1, 1) for d, v in days], refresh.POINTS)

    folder, days = f"{tmp_path}/steps", f"{tmp_path}/days"
    for k, part in enumerate((batch((1, 1), (9, 2)), batch((5, 3)), batch((9, 4)))):
        for _ in range(2):
            alerts.step_batch(part, k, folder, days)
    got = [(r.version, r.day - 19723, r.total, r.n, r.ref_day - 19723) for r in spark.read.parquet(folder).orderBy("version").collect()]
    assert got == [(1, 8, 2000000, 1, 0), (2, 4, 3000000, 1, 0), (3, 8, 2000000, 1, 4), (4, 8, 6000000, 2, 4)]


def test_each_answer_is_parsed_once_for_all_kinds_of_problems(spark):
    found = QUERIES["answer_problems"](spark, SF)
    assert "from_json" not in _plan(found) and found.count() > 0                  # it reads the parsed answers that are stored


def test_points_of_the_result_table_are_dealt_once(spark, tmp_path):
    def point(k, day, value, patient=1, comparator=None):
        return (patient, "potassium", f"o{k}", k, dt.date(2024, 1, day) if day else None, value, comparator, "A", 1, 1)

    rows = [point(1, None, 4.0), point(2, 3, 5.0), point(3, 3, 6.0, comparator="<"), point(4, 9, 3.0), point(5, 9, 0.0), point(6, 20, 2.0), point(7, 1, 1.0, None),
            point(6, 20, 2.0)]
    spark.createDataFrame(rows, refresh.POINTS).write.parquet(f"{tmp_path}/points")
    windows = spark.createDataFrame([(1, "potassium", dt.date(2024, 1, 9), dt.date(2024, 1, 19)), (1, "potassium", None, None)],
                                    "patient_id bigint, analyte_id string, window_start date, window_end date")
    slopes = spark.createDataFrame([(1, "potassium", dt.date(2024, 1, 9), dt.date(2024, 1, 20))], "patient_id bigint, analyte_id string, first_used date, last_used date")
    out = T.result_table(spark.read.parquet(f"{tmp_path}/points"), windows, slopes).select(
        "observation_id", "prev_value", "change_vs_previous", "n_windows", "in_trend")
    got = sorted((r.observation_id, r.prev_value, r.n_windows, r.in_trend) for r in out.collect())
    assert got == [("o2", 4.0, 0, "Before drug windows"), ("o3", 5.0, 0, "Before drug windows"), ("o4", 6.0, 1, "Yes"), ("o5", 3.0, 1, "Yes"),
                   ("o6", 0.0, 0, "Yes"), ("o6", 2.0, 0, "Yes")]
    assert "ReusedExchange" in _plan(out)


def test_stored_points_feed_every_batch_of_the_streams(spark, monkeypatch):
    reads = []
    monkeypatch.setattr(A, "observations", lambda *args, plain=A.observations: reads.append(1) or plain(*args))
    written = []
    monkeypatch.setattr(refresh, "start_refresh", lambda spark, source, *rest: written.append(source) or SimpleNamespace(awaitTermination=lambda: None))
    monkeypatch.setattr(refresh, "current_flags", lambda spark, folder: spark.read.parquet(f"{folder}/incoming").selectExpr(
        "patient_id", *[f"'' {c}" for c in ("flag_id", "level", "direction", "effect_event", "target_direction", "cross_lab")]))
    out = QUERIES["stream_refresh"](spark, SF)
    points = Lab.from_given_tables(spark, SF).points
    assert len(written) == 4 and len(reads) == 2 and out.count() == points.count()


def test_flags_with_their_effects_read_only_what_a_result_uses(spark, tmp_path):
    day = dt.date(2020, 3, 1)
    flags = [(1, "hba1c", "RCV_PREV", "change", day, "rise", 20.0, "previous result"), (1, "hba1c", "RCV_BASELINE", "guideline", day, "rise", 30.0, "baseline"),
             (None, "hba1c", "RCV_PREV", "change", day, "fall", -20.0, "previous result")]
    spark.createDataFrame(flags, "patient_id bigint, analyte_id string, rule_id string, level string, date date, direction string, change_percent double, "
                                 "compared_with string").write.parquet(f"{tmp_path}/flags")
    windows = spark.createDataFrame(
        [(p, "hba1c", "biguanide", 7, "Metformin", dt.date(2020, 1, 1), way, None, "note", "metformin", dt.date(2020, 2, 1), dt.date(2020, 6, 1))
         for p, way in ((1, "rise"), (None, "fall"))],
        "patient_id bigint, analyte_id string, drug_class string, event_id bigint, drug string, date date, direction string, max_percent double, "
        "effect_note string, class_short_name string, window_start date, window_end date")
    rows = T.with_expected_effect(spark.read.parquet(f"{tmp_path}/flags"), windows)
    assert {(r.patient_id, r.rule_id, r.compared_with, r.expected_effect, r.effect_event) for r in rows.collect()} == {
        (1, "RCV_PREV", "previous result", "note", 7), (1, "RCV_BASELINE", "baseline", None, None), (None, "RCV_PREV", "previous result", "note", 7)}
    read = [x for x in _plan(rows.select("patient_id", "expected_effect")).splitlines() if "ReadSchema" in x]
    assert len(read) == 1 and "compared_with" not in read[0] and "rule_id" not in read[0]


def test_stored_frames_hold_the_columns_that_are_used(spark):
    day = dt.date(2020, 1, 1)
    observations = spark.createDataFrame([(1, None, 1, "confirmed", "a", "tsh", 2.0, 1), (1, "<", 1, "confirmed", "b", "tsh", 1.0, 2)],
                                         "report_id bigint, comparator string, page int, status string, observation_id string, analyte_id string, canonical_value double, line int")
    reports = spark.createDataFrame([(1, 5, "Lab A", day, "confirmed")], "report_id bigint, patient_id bigint, lab string, collected_at date, status string")
    patients = spark.createDataFrame([(5,)], "patient_id bigint")
    lab = Lab(patients, reports, observations, None, "2020-01-01").stored("points", days=["patient_id", "date", "value"])
    assert set(lab.points.columns) >= {"observation_id", "page", "line"} and lab.days.columns == ["patient_id", "date", "value"]
    assert [tuple(r) for r in lab.days.collect()] == [(5, day, 2.0)] and lab.points.count() == 2
