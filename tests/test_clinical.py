import re

from pyspark.sql import functions as F

from assaytrail.functions import numbers as num
from assaytrail.operators import clinical as C
from assaytrail.operators import figures as G
from assaytrail.operators import rollup as U
from assaytrail.operators import series as S
from assaytrail.operators import trends as T
from tests import patients as fx
from tests.patients import day


def test_categories(spark):
    g = spark.createDataFrame([(90.0,), (59.9,), (45.0,), (44.0,), (14.9,)], "v double").select(num.g_category(F.col("v")))
    assert [r[0] for r in g.collect()] == ["G1", "G3a", "G3a", "G3b", "G5"]
    a = spark.createDataFrame([(29.9,), (30.0,), (300.0,), (301.0,)], "v double").select(num.a_category(F.col("v")))
    assert [r[0] for r in a.collect()] == ["A1", "A2", "A2", "A3"]
    rows = [(1.0, 50, "male"), (0.8, 60, "female"), (2.0, 70, "male"), (0.6, 40, "male")]
    e = spark.createDataFrame(rows, "c double, age int, sex string").select(
        F.round(num.ckd_epi_2021(F.col("c"), F.col("age"), F.col("sex")), 1))
    assert [r[0] for r in e.collect()] == [91.7, 84.3, 35.2, 125.1]


def test_kdigo_and_criteria(spark):
    points, patients = fx.points(spark), fx.patients(spark)
    history = C.kdigo_history(points)
    assert history.filter("patient_id = 1").count() == 10
    now = C.kdigo_current(history).filter("patient_id = 1").first()
    assert (now.g, now.a) == ("G3a", "A2")
    assert [(str(r.date), r.g) for r in C.kdigo_path(history).filter("patient_id = 1").orderBy("date").collect()] == [
        ("2023-06-12", "G2"), ("2025-09-01", "G3a")]
    got = {(r.patient_id, r.criterion_id): r for r in C.criteria(points, patients).collect()}
    ckd = got[1, "ckd_kdigo"]
    assert ckd.status == "met" and ckd.recorded and "N18.31" in ckd.codes and "(182 days)" in ckd.evidence
    diabetes = got[1, "diabetes_ada"]
    assert diabetes.status == "met" and "first 8.9% on 12 Jun 2023 and 8.7% on 14 Sep 2023" in diabetes.evidence
    assert got[2, "thyroid_pattern"].title == "Subclinical hypothyroidism pattern"
    assert re.match(r"TSH [0-9.]+ mIU/L on \d\d \w{3} \d{4} above 4 (with free T4 [0-9.]+ within range|\(no free T4 on that report\))\.$",
                    got[2, "thyroid_pattern"].evidence)
    assert all(c.source for c in got.values()) and "ADA Standards of Care" in got[1, "diabetes_ada"].source
    assert got[1, "diabetes_ada"].codes == "ICD-10 E11; SNOMED CT 44054006"
    assert got[4, "ckd_kdigo"].status == "met"
    assert (3, "hyperkalaemia") not in got


def test_figures(spark):
    points, patients = fx.points(spark), fx.patients(spark)
    active = C.active_drugs(S.resolve_drugs(fx.events(spark)))
    rows = G.figures(G.context(patients, points, C.criteria(points, patients), C.kdigo_history(points), active)).collect()
    got = {(r.patient_id, r.group_id, r.item_id): r for r in rows}
    assert got[1, "kidney", "protein_ckd"].amount == 58.0
    energy = got[1, "kidney", "energy_ckd"]
    assert (energy.amount, energy.amount_high) == (1800.0, 2520.0)
    fibre = got[1, "glucose", "fibre"]
    assert (fibre.amount, fibre.amount_high) == (25.0, 35.0)
    assert {g for p, g, _ in got if p == 3} == {"glucose", "lipids"}
    assert got[4, "pressure", "potassium_htn"].superseded_by == "kidney"
    assert (2, "thyroid", "levo_timing") in got
    assert all(r.source and r.title and r.figure for r in rows)
    assert got[1, "kidney", "protein_ckd"].source.count("KDIGO") == 2 and len(got[1, "kidney", "protein_ckd"].report_ids) == 1
    assert got[1, "kidney", "energy_ckd"].report_ids == []


def test_basis_of_figure_groups(spark):
    """Every group with a figure has its facts; cited reports are those of results that exist; no table of patients gives no facts."""
    points, patients = fx.points(spark), fx.patients(spark)
    active = C.active_drugs(S.resolve_drugs(fx.events(spark)))
    ctx = G.context(patients, points, C.criteria(points, patients), C.kdigo_history(points), active)
    basis = G.group_basis(ctx).collect()
    assert {(r.patient_id, r.group_id) for r in G.figures(ctx).collect()} <= {(r.patient_id, r.group_id) for r in basis}
    known = {(r.patient_id, r.analyte_id, r.report_id, r.value) for r in points.collect()}
    for r in basis:
        if r.kind in ("latest result", "first result"):
            assert (r.patient_id, r.name, r.report_id, r.value) in known
        else:
            assert r.report_id is None and r.value is None
    groups = {(r.patient_id, r.group_id): r for r in G.figure_groups(G.group_basis(ctx)).collect()}
    assert groups[1, "kidney"].group_label == "Kidney (CKD)" and groups[1, "kidney"].report_ids
    for (patient, group), r in groups.items():
        mine = {b.report_id for b in basis if (b.patient_id, b.group_id) == (patient, group) and b.cited and b.report_id is not None}
        assert r.report_ids == sorted(mine)
    assert G.group_basis(ctx.limit(0)).count() == 0


def test_active_drugs(spark):
    rows = [(1, 1, "Ramipril", "start", "", day("2024-01-01")), (2, 1, "Ramipril", "stop", "", day("2024-02-01")),
            (3, 2, "Ramipril", "dose_change", "", day("2024-01-01")), (4, 2, "Ramipril", "dose_change", "", day("2024-03-01")),
            (5, 3, "Ramipril", "start", "", day("2024-01-01")), (6, 3, "Telma", "start", "", day("2024-05-01")),
            (7, 3, "Telma", "dose_change", "", day("2024-06-01"))]
    got = {r.patient_id: r.event_id for r in C.active_drugs(S.resolve_drugs(spark.createDataFrame(rows, fx.EVENTS))).collect()}
    assert got == {2: 3, 3: 6}


def test_cards_and_systems(spark):
    points, patients = fx.points(spark, 9), fx.patients(spark)
    effects = S.event_effects(S.resolve_drugs(fx.events(spark)))
    flags = T.all_flags(S.frame(S.day_values(points), S.event_bounds(effects)), S.effect_windows(effects))
    reports = points.select("report_id", "patient_id", F.col("date").alias("collected_at"), "lab",
                            F.lit("confirmed").alias("status")).distinct()
    cards = U.sort_cards(U.patient_cards(patients, reports, flags)).collect()
    assert [c.name for c in cards] == ["B", "A", "D", "C"]
    a = next(c for c in cards if c.name == "A")
    assert (a.guideline, a.change, a.expected, a.report_count, a.lab_count, str(a.latest_report_date)) == (
        0, 3, 2, 9, 3, "2025-09-01")
    status = {(r.patient_id, r.system_id): r.system_status for r in U.system_status(patients, points, flags).collect()}
    assert status[1, "kidney"] == "changed" and status[4, "kidney"] == "stable" and status[3, "liver"] == "no_data"
    labels = U.report_labels(reports)
    assert [r.label for r in labels.filter("patient_id = 1").orderBy("collected_at").collect()] == [f"R{i}" for i in range(1, 10)]
    used = labels.filter("patient_id = 1 and label_number in (1, 2, 3, 5, 9)")
    assert [r.run_text for r in U.label_runs(used, ["patient_id"]).orderBy("run_start").collect()] == ["R1–R3", "R5", "R9"]
