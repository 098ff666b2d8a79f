"""Four synthetic patients with results worked out by hand, as points and medication events."""

import datetime as dt


def day(text):
    return dt.date.fromisoformat(text)


POINTS = ("patient_id bigint, analyte_id string, observation_id bigint, report_id bigint, date date, value double, "
          "comparator string, lab string, page int, line int")
EVENTS = "event_id bigint, patient_id bigint, drug string, change string, dose_text string, date date"
PATIENTS = ("patient_id bigint, doctor_id bigint, patient_code string, name string, sex string, birth_year int, "
            "conditions array<string>, weight_kg double")

A_COLUMNS = ["creatinine", "egfr", "hba1c", "potassium", "fasting_glucose", "uacr"]
A_ROWS = [
    ("2023-06-12", "A", 1.10, 79.28, 8.9, 4.5, 152, 118), ("2023-09-14", "B", 1.13, 76.76, 8.7, 4.6, 148, 126),
    ("2023-11-16", "A", 1.11, 78.42, 8.6, 4.5, 146, 122), ("2024-02-15", "C", 1.11, 77.94, 7.4, 4.6, 136, 131),
    ("2024-04-01", "A", 1.29, 65.08, 7.2, 4.9, 134, 148), ("2024-06-10", "B", 1.35, 61.62, 7.0, 4.9, 131, 142),
    ("2024-10-15", "C", 1.31, 63.88, 6.9, 4.8, 130, 139), ("2025-03-10", "A", 1.35, 61.24, 7.0, 4.9, 132, 151),
    ("2025-09-01", "B", 1.41, 58.12, 6.9, 5.0, 130, 160), ("2026-03-02", "A", 1.49, 54.06, 7.1, 5.0, 133, 172),
]
B_ROWS = [("2024-07-08", "A", 8.8, 0.86), ("2024-10-14", "A", 9.2, 0.84), ("2025-01-06", "A", 8.4, 0.88),
          ("2025-06-16", "B", 3.9, 1.21), ("2025-12-15", "A", 8.1, 0.90)]
C_ROW = {"fasting_glucose": 142, "hba1c": 7.8, "creatinine": 0.98, "total_cholesterol": 196, "ldl": 118, "hdl": 42,
         "triglycerides": 180}
D_ROWS = [("2024-11-18", 1.24, 139, 4.6, 210), ("2025-05-19", 1.28, 140, 4.8, 245), ("2025-11-20", 1.26, 138, 4.7, 228)]


def point_rows(a_reports=10):
    rows = []

    def add(patient, report, date, lab, values):
        for line, (analyte, value) in enumerate(values, 1):
            rows.append((patient, analyte, report * 100 + line, report, day(date), float(value), None, lab, 1, line))

    for i, (date, lab, *values) in enumerate(A_ROWS[:a_reports], 1):
        add(1, i, date, lab, zip(A_COLUMNS, values))
    for i, (date, lab, tsh, ft4) in enumerate(B_ROWS, 21):
        add(2, i, date, lab, [("tsh", tsh), ("free_t4", ft4)])
    add(3, 31, "2025-08-05", "A", C_ROW.items())
    for i, (date, *values) in enumerate(D_ROWS, 41):
        add(4, i, date, "B", zip(["creatinine", "sodium", "potassium", "uacr"], values))
    return rows


EVENT_ROWS = [
    (1, 1, "Metformin", "start", "", day("2023-10-02")), (2, 1, "Ramipril", "start", "", day("2024-03-04")),
    (3, 1, "Empagliflozin", "start", "", day("2024-05-06")), (4, 2, "Levothyroxine", "start", "", day("2024-11-04")),
]
PATIENT_ROWS = [
    (1, 1, "P-1", "A", "male", 1968, ["type 2 diabetes", "chronic kidney disease"], 72.0),
    (2, 1, "P-2", "B", "female", 1962, ["hypothyroidism"], 64.0),
    (3, 1, "P-3", "C", "male", 1979, ["type 2 diabetes"], 78.0),
    (4, 1, "P-4", "D", "female", 1974, ["hypertension", "chronic kidney disease"], 60.0),
]


def points(spark, a_reports=10):
    return spark.createDataFrame(point_rows(a_reports), POINTS)


def events(spark):
    return spark.createDataFrame(EVENT_ROWS, EVENTS)


def patients(spark):
    return spark.createDataFrame(PATIENT_ROWS, PATIENTS)
