from pyspark.sql import functions as F

from assaytrail.functions import text as tx
from assaytrail.operators import documents as D
from assaytrail.operators import normalise as N
from assaytrail.operators import quality as Q
from assaytrail.operators import review as V
from assaytrail.operators import series as S
from assaytrail.sources import tables
from tests import patients as fx
from tests.patients import day

PRINTED = ("observation_id bigint, report_id bigint, page int, line int, test_text string, value_text string, "
           "unit_text string, range_text string")
REPORTS = "report_id bigint, patient_id bigint, lab string, collected_at date, status string"


def test_values(spark):
    cases = [("92", 92.0, None), ("1,50,000", 150000.0, None), ("6,370", 6370.0, None), ("<0.5", 0.5, "<"),
             (">= 60", 60.0, ">="), ("less than 5", 5.0, "<"), ("Upto 40", 40.0, "<"), ("12.9*", 12.9, None),
             ("Negative", None, None), ("5,1", None, None), ("1.2.3", None, None), ("--", None, None), ("", None, None),
             (" ≤ 7 ", 7.0, "<="), ("+4", 4.0, None), (".5", 0.5, None), ("0,600", None, None)]
    rows = spark.createDataFrame([(c[0],) for c in cases], "t string").select(
        "t", tx.value_number(F.col("t")).alias("n"), tx.value_comparator(F.col("t")).alias("c")).collect()
    assert [(r.t, r.n, r.c) for r in rows] == cases


def test_names_and_drugs(spark):
    names = {"GLUCOSE (FASTING)": "fasting_glucose", "CREATININE - SERUM": "creatinine", "HB A1C": "hba1c", "GLUCOSE": None,
             "VLDL CHOLESTEROL": None, "C.R.P.": None, "TOTAL CHO / HDL RATIO": None, "TRIGLYCERIDES (FASTING)": "triglycerides",
             "Sr Urea": "urea", "bun": "urea", "": None, "Urea Nitrogen - Serum": "urea", "F.B.S.": "fasting_glucose"}
    rows = N.match_names(spark.createDataFrame([(n,) for n in names], "test_text string")).collect()
    assert {r.test_text: r.analyte_id for r in rows} == names
    assert {r.test_text: r.basis for r in rows if r.test_text in ("bun", "Urea Nitrogen - Serum", "Sr Urea")} == {
        "bun": "alternate", "Urea Nitrogen - Serum": "alternate", "Sr Urea": "primary"}
    drugs = {"Tab. Telma 40": "acei_arb", "Metformin SR 500": "biguanide", "Atorvastatin 10": "unknown", "Glycomet GP 1": "biguanide",
             "  jardiance ": "sglt2i", "": "unknown"}
    events = spark.createDataFrame([(i, 1, t, "start", "", day("2024-01-01")) for i, t in enumerate(drugs)], fx.EVENTS)
    assert {r.drug: r.drug_class for r in S.resolve_drugs(events).collect()} == drugs


def printed(spark, rows):
    return spark.createDataFrame([(i, 1, 1, i, *row) for i, row in enumerate(rows, 1)], PRINTED)


def people(spark, date="2025-01-01", sex="male", born=1975):
    reports = spark.createDataFrame([(1, 1, "A", day(date) if date else None, "extracted")], REPORTS)
    patients = spark.createDataFrame([(1, 1, "P", "A", sex, born, [], None)], fx.PATIENTS)
    return reports, patients


def test_units_and_status(spark):
    rows = printed(spark, [("BUN", "14", "mg/dL", ""), ("Platelet Count", "2.41", "Lakhs/cu.mm", ""), ("TSH", "2", "μIU / ml", ""),
                           ("TSH", "2", "mmol/xx", ""), ("TSH", "2", "", "1 - 2"), ("Age / Sex", "44 Y", "", ""),
                           ("Ferritin", "9", "ng/mL", ""), ("HbA1c", "Negative", "%", ""), ("HbA1c", "<5", "%", "")])
    observations, skipped = N.normalise(rows, *people(spark))
    got = {r.line: r for r in observations.collect()}
    assert round(got[1].canonical_value, 4) == 30.0118 and got[2].canonical_value == 241.0 and got[3].canonical_value == 2.0
    assert [got[i].status for i in (4, 5, 7, 8, 9)] == ["needs_review", "needs_review", "not_tracked", "needs_review", "extracted"]
    assert "no unit printed" in got[5].status_reason and got[9].status_reason == "value is censored (<)"
    assert [r.line for r in skipped.collect()] == [6]


def test_egfr(spark):
    ok = N.normalise(printed(spark, [("Creatinine", "1.0", "mg/dL", ""), ("eGFR", ">60", "", "x")]), *people(spark))[0]
    e = ok.filter("analyte_id = 'egfr'").first()
    assert (round(e.canonical_value, 1), e.comparator, e.status) == (91.7, None, "extracted")

    def refusal(rows, **who):
        return N.normalise(printed(spark, rows), *people(spark, **who))[0].filter("analyte_id = 'egfr'").first().status_reason

    egfr, creatinine = ("eGFR", "60", "", "x"), ("Creatinine", "1.0", "mg/dL", "")
    assert "no usable creatinine" in refusal([egfr])
    assert "more than one creatinine" in refusal([egfr, creatinine, ("Creatinine", "1.1", "mg/dL", "")])
    assert "report date needed" in refusal([egfr, creatinine], date=None)
    assert "age 5 " in refusal([egfr, creatinine], born=2020)
    assert "censored" in refusal([egfr, ("Creatinine", "<1.0", "mg/dL", "")])


def test_review(spark):
    reports, patients = people(spark)
    observations, _ = N.normalise(printed(spark, [
        ("Creatinine", "1.0", "mg/dL", ""), ("TSH", "abc", "mIU/L", ""), ("Glucose", "100", "mg/dL", ""), ("Urea", "30", "mg/dL", "")]),
        reports, patients)
    observations = observations.drop("candidates")
    edits = spark.createDataFrame([(2, False, "2.5", None, False, None), (3, False, None, None, True, "fasting_glucose"),
                                   (4, True, None, None, False, None)], V.EDITS)
    adds = spark.createDataFrame([(1, 1, 9, "Sodium", "140", "mEq/L", "", None), (1, 1, 1, "Sodium", "1", "mEq/L", "", None)], V.ADDS)
    done = V.apply_review(observations, edits, adds, reports, patients)
    got = {r.line: r for r in done.collect()}
    assert got[2].canonical_value == 2.5 and got[3].analyte_id == "fasting_glucose" and got[3].match == "doctor"
    assert got[4].status == "rejected" and got[9].analyte_id == "sodium" and got[1].status == "extracted"
    assert V.refused_adds(observations, adds).count() == 1
    confirmed, gated = V.confirm_gate(done, reports)
    assert gated.first().status == "confirmed"
    assert sorted(r.status for r in confirmed.collect()) == ["confirmed"] * 4 + ["rejected"]
    pending, gated = V.confirm_gate(observations, reports)
    assert gated.first().status == "extracted" and gated.first().pending == 1
    clash = V.normalise_chosen(spark.createDataFrame([("BUN level", "14", "mg/dL", "urea")],
                                                     "test_text string, value_text string, unit_text string, c string"), "c").first()
    assert clash.basis == "alternate" and round(clash.canonical_value, 4) == 30.0118


def test_documents(spark, tmp_path):
    for name, content in (("a.pdf", b"%PDF-1 one"), ("b.pdf", b"%PDF-1 one"), ("c.txt", b"hello"), ("d.png", b"\x89PNG data")):
        (tmp_path / name).write_bytes(content)
    files = tables.read_files(spark, str(tmp_path))
    kinds = {r.path.rsplit("/", 1)[1]: r.file_type for r in files.collect()}
    assert kinds == {"a.pdf": "pdf", "b.pdf": "pdf", "c.txt": None, "d.png": "png"}
    existing = files.filter("file_type = 'png'").select("sha256")
    got = {r.path.rsplit("/", 1)[1]: r.accepted for r in D.accept(files, existing, ["sha256"], ["path"], "path").collect()}
    assert got == {"a.pdf": True, "b.pdf": False, "c.txt": False, "d.png": False}


def test_report_edits(spark):
    """Dates and lab names of a reviewer: null leaves a field, an empty name takes it away, a date out of bounds refuses the whole batch."""
    reports = spark.createDataFrame([(i, 1, day("2015-05-01"), "Lab A") for i in range(1, 8)], "report_id bigint, patient_id bigint, collected_at date, lab string")
    patients = spark.createDataFrame([(1, 1950)], "patient_id bigint, birth_year int")
    edits = spark.createDataFrame([(1, day("2015-05-01"), None), (2, day("2015-06-01"), " Lab B "), (3, None, "  "), (4, day("1949-12-31"), "Lab C"),
                                   (5, day("2018-01-02"), "Lab C"), (6, day("1950-01-01"), None)], V.REPORT_EDITS)
    done = {r.report_id: r for r in V.edit_reports(reports, edits, patients, "2018-01-01").collect()}
    assert [done[i].lab for i in range(1, 8)] == ["Lab A", "Lab B", None, "Lab A", "Lab A", "Lab A", "Lab A"]
    assert [done[i].date_label for i in range(1, 8)] == [None, V.ENTERED, None, None, None, V.ENTERED, None]
    assert str(done[2].collected_at) == "2015-06-01" and {i for i in done if done[i].refused} == {4, 5}
    assert V.edit_reports(reports, edits.limit(0), patients, "2018-01-01").filter("refused is null and date_label is null").count() == 7
    unknown = V.edit_reports(reports, edits, patients.limit(0), "2018-01-01").filter("refused is not null").count()
    assert unknown == 5                                                       # nothing says that a date is after the birth of a patient not on file
    read = V.edit_reports(reports.filter("report_id < 4"), edits, patients, "2018-01-01")
    scores = {r.date_label: (r.reports, r.date_correct, r.lab_correct) for r in Q.header_scores(read, reports).collect()}
    assert scores == {None: (6, 2, 1), V.ENTERED: (1, 0, 0)}


def test_skipped_lines_are_used_once(spark):
    place = "report_id bigint, page int, line int"
    skipped = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (2, 1, 2), (3, 1, 2)], place)
    observations = spark.createDataFrame([(2, 1, 2, "extracted"), (3, 1, 2, "rejected")], f"{place}, status string")
    adds = spark.createDataFrame([(1, 1, 2), (2, 1, 2), (3, 1, 2), (9, 1, 1)], place)
    left = {(r.report_id, r.line) for r in V.skipped_after(skipped, observations, adds).collect()}
    assert left == {(1, 1), (2, 2)}
