"""Ordered helpers against brute force, with one key that holds most rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from assaytrail.operators import clinical as C
from assaytrail.operators import series as S
from assaytrail.operators import trends as T
from assaytrail.operators.sequences import after_last_break, asof, previous_row, row_numbers, within_days
from assaytrail.sources import dictionary as d
from tests import patients as fx

START = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    return [(1 if i % 3 else rng.randrange(2, 9), START + dt.timedelta(days=rng.randrange(400)), i, rng.random() < 0.1)
            for i in range(600)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "k int, date date, id int, stop boolean").cache()


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_numbers_and_previous(table, rows):
    numbers = {r.id: r.n for r in row_numbers(table, ["k"], "date", ["id"], "n").collect()}
    before = {r.id: r.prev_id for r in previous_row(table, ["k"], "date", ["id"], ["id"]).collect()}
    for group in by_key(rows).values():
        for i, r in enumerate(group):
            assert numbers[r[2]] == i + 1
            assert before[r[2]] == (group[i - 1][2] if i else None)


def test_rows_after_the_last_break(table, rows):
    got = sorted(r.id for r in after_last_break(table, ["k"], "date", ["id"], F.col("stop")).collect())
    want = []
    for group in by_key(rows).values():
        tail = []
        for r in group:
            tail = [] if r[3] else tail + [r[2]]
        want += tail
    assert got == sorted(want)


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
def test_asof(spark, direction, strict):
    rng = random.Random(7)
    left = sorted({(rng.randrange(3), START + dt.timedelta(days=rng.randrange(120))) for _ in range(80)})
    right = sorted({(rng.randrange(3), START + dt.timedelta(days=rng.randrange(120))) for _ in range(40)})
    a, b = spark.createDataFrame(left, "k int, t date"), spark.createDataFrame(right, "k int, u date")
    for r in asof(a, b, ["k"], F.col("t"), F.col("u"), ["u"], direction, strict).collect():
        if direction == "backward":
            hits = [u for k, u in right if k == r.k and (u < r.t if strict else u <= r.t)]
            assert r.u == max(hits, default=None)
        else:
            hits = [u for k, u in right if k == r.k and (u > r.t if strict else u >= r.t)]
            assert r.u == min(hits, default=None)


def test_within_days(spark, table, rows):
    spans = [(1, START + dt.timedelta(days=i * 37), START + dt.timedelta(days=i * 37 + i * 20)) for i in range(9)]
    got = sorted((r.id, r.a) for r in within_days(table, spark.createDataFrame(spans, "k int, a date, b date"), ["k"], "date",
                                                  "a", "b", 16).collect())
    assert got == sorted((r[2], a) for r in rows for k, a, b in spans if r[0] == k and a <= r[1] <= b)


def random_patients(seed, n=40):
    """Points and events of many patients; patient 0 alone has a third of the reports."""
    rng = random.Random(seed)
    typical = {"creatinine": 1.0, "egfr": 60.0, "hba1c": 6.0, "tsh": 2.2}
    points, events, oid = [], [], 0
    generics = [g for gs in d.lists(d.GENERICS).values() for g in gs] + ["something else"]
    for patient in range(n):
        for report in range(n if patient == 0 else rng.choice([0, 1, 2, 3, 4, 6, 9, 14])):
            date = START + dt.timedelta(days=rng.randrange(1500))
            lab = rng.choice(["A", "B", "C", None])
            for analyte, base in typical.items():
                oid += 1
                points.append((patient, analyte, oid, patient * 1000 + report, date, round(base * rng.uniform(0.4, 1.9), 3),
                               rng.choice(["<", ">"]) if rng.random() < 0.15 else None, lab, 1, 1))
        for _ in range(rng.randrange(6)):
            events.append((len(events), patient, rng.choice(generics), rng.choice(["start", "start", "stop", "dose_change"]), "",
                           START + dt.timedelta(days=rng.randrange(1500))))
    return points, events


def brute_flags(points, events):
    """Previous-result and baseline flags straight from their definition, one series at a time."""
    moves = {}
    for cid, aid, *_ in d.table(d.DRUG_EFFECTS):
        moves.setdefault(aid, set()).add(cid)
    classes = {g: cid for cid, gs in d.lists(d.GENERICS).items() for g in gs}
    rcv = {r[0]: d.number(r[5]) for r in d.table(d.ANALYTES)}
    days = {}
    for p, a, _, _, date, v, comparator, *_ in points:
        if comparator is None:
            days.setdefault((p, a), {}).setdefault(date, []).append(v)
    out = set()
    for (p, a), by_date in days.items():
        line = [(t, sum(vs) / len(vs)) for t, vs in sorted(by_date.items())]
        for (_, x), (t, y) in zip(line, line[1:]):
            if abs(round((y - x) / x * 100, 1)) > rcv[a]:
                out.add((p, a, "RCV_PREV", t))
        if len(line) < 2:
            continue
        first = min((e[5] for e in events if e[1] == p and classes.get(e[2]) in moves[a]), default=None)
        base = [x for x in line if first is None or x[0] < first][:3]
        base = base if len(base) >= 2 else line[:3]
        values = sorted(v for _, v in base)
        median = values[1] if len(values) == 3 else sum(values) / 2
        t, y = line[-1]
        if t > base[-1][0] and abs(round((y - median) / median * 100, 1)) > rcv[a]:
            out.add((p, a, "RCV_BASELINE", t))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_flags_of_random_patients(spark, seed):
    points, events = random_patients(seed)

    def run(rows, partitions):
        effects = S.event_effects(S.resolve_drugs(spark.createDataFrame(events, fx.EVENTS)))
        days = S.day_values(spark.createDataFrame(rows, fx.POINTS).repartition(partitions))
        return T.all_flags(S.frame(days, S.event_bounds(effects)), S.effect_windows(effects)).collect()

    got = run(points, 3)
    change = {(r.patient_id, r.analyte_id, r.rule_id, r.date) for r in got if r.level == "change"}
    assert change == brute_flags(points, events)
    shuffled = list(points)
    random.Random(9).shuffle(shuffled)
    assert sorted(map(repr, run(shuffled, 7))) == sorted(map(repr, got))


def test_sustained_runs(spark):
    points, _ = random_patients(3)
    table = spark.createDataFrame(points, fx.POINTS)
    got = {r.patient_id: (r.n_run, r["from"].date, r.to.date)
           for r in C.sustained(C.uncensored(table, "egfr"), F.col("value") < 60).collect()}
    want = {}
    for p in {r[0] for r in points}:
        run = []
        for r in sorted((r for r in points if r[0] == p and r[1] == "egfr" and r[6] is None), key=lambda r: (r[4], r[3], r[2])):
            run = run + [r[4]] if r[5] < 60 else []
        if len(run) >= 2 and (run[-1] - run[0]).days > 90:
            want[p] = (len(run), run[0], run[-1])
    assert got == want
