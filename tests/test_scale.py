"""How work is dealt and how often it is done, on rows of the tests' own."""
import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from assaytrail.operators import facts as K
from assaytrail.operators import metadata as M
from assaytrail.operators import normalise as N
from assaytrail.operators import response as R
from assaytrail.operators import review as V
from assaytrail.operators import textrows as P
from assaytrail.operators import trends as T
from assaytrail.plans.lab import Lab
from assaytrail.plans.queries import CITED, QUERIES
from assaytrail.sources import adapters as A
from assaytrail.streaming import refresh
from tests.test_normalise import people, printed


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _orders(spark, folder, keys, items_each=2):
    day = dt.datetime(1996, 5, 1)
    spark.createDataFrame([(k, k, day, "1-URGENT") for k in keys], "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp, o_orderpriority string").coalesce(1).write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(k, i + 1, 10 * (k or 0) + i, 3, 100.0 * i + 12.34, 0.05, 0.02, "N") for k in keys for i in range(items_each)],
                          "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_extendedprice double, l_discount double, l_tax double, l_returnflag string"
                          ).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_lines_above_a_table_are_read_by_many_tasks_and_tokens_once(spark, tmp_path):
    sf = _orders(spark, tmp_path, [*range(1, 200), None])
    lines = A.header_lines(spark, sf)
    assert lines.rdd.getNumPartitions() > 1 and lines.count() == 600
    for found in (M.labelled_dates(lines, "2018-01-01"), M.labs(lines)):
        assert _plan(found).count("Exchange hashpartitioning") == _plan(found).count("REPARTITION_BY_NUM") > 0       # no second deal after the orders
    name = M.lab_in_line(F.col("text"))
    assert str(name._jc.toString()).count("split(") == 1
    odd = {"Alpha Labs no Beta Clinic Services Pvt. Ltd. x": "Beta Clinic Services Pvt. Ltd.", "Labs": None, "": None, "a (Gamma) Scans:": "Gamma Scans", None: None,
           "One Two Three Four Five Hospital": "Two Three Four Five Hospital", "Delta Labs Mr. Dr X": None, "dr": None}
    rows = spark.createDataFrame([(t,) for t in odd], "text string").select("text", name.alias("lab"))
    assert {r.text: r.lab for r in rows.collect()} == odd


def test_a_review_deals_observations_once(spark, tmp_path):
    reports, patients = people(spark)
    names = [("Creatinine", "1.0", "mg/dL", ""), ("TSH", "abc", "mIU/L", ""), ("Glucose", "100", "mg/dL", ""), ("Urea", "30", "mg/dL", ""), ("Sodium", "140", "mEq/L", ""),
             ("TSH", "2", "mIU/L", "")]
    first = N.normalise(printed(spark, names), reports, patients)[0].drop("candidates").withColumn("edited", F.lit(False))
    first.withColumn("observation_id", F.when(F.col("line") != 5, F.col("observation_id"))).write.parquet(f"{tmp_path}/seen")
    seen = spark.read.parquet(f"{tmp_path}/seen")
    edits = spark.createDataFrame([(2, False, " 2.5 ", None, False, None), (3, False, None, None, True, "fasting_glucose"), (4, True, "9", "x", True, "tsh"),
                                   (6, False, None, None, True, None), (None, True, None, None, False, None)], V.EDITS)
    out = V.apply_review(seen, edits, spark.createDataFrame([], V.ADDS), reports, patients)
    assert _plan(out).count("hashpartitioning(observation_id") <= 2                     # the observations and the edits
    assert out.columns == seen.columns
    got = {r.line: (r.test_text, r.value_text, r.unit_text, r.analyte_id, r.match, r.status, r.canonical_value, r.edited) for r in out.collect()}
    assert got == {1: ("Creatinine", "1.0", "mg/dL", "creatinine", "exact", "extracted", 1.0, False), 2: ("TSH", "2.5", "mIU/L", "tsh", "exact", "extracted", 2.5, False),
                   3: ("Glucose", "100", "mg/dL", "fasting_glucose", "doctor", "extracted", 100.0, False),
                   4: ("Urea", "30", "mg/dL", "urea", "exact", "rejected", None, False), 5: ("Sodium", "140", "mEq/L", "sodium", "exact", "extracted", 140.0, False),
                   6: ("TSH", "2", "mIU/L", None, "doctor", "not_tracked", None, False)}


def test_evidence_reads_points_and_flags_once(spark, tmp_path):
    day = [dt.date(2020, 1, d) for d in range(1, 9)]
    points = [(1, "egfr", f"o{i}", i, day[i], 50.0 - i, "<" if i == 3 else None, "A", 1, 1) for i in range(6)] + [(None, "egfr", "n", 9, day[5], 1.0, None, "A", 1, 1),
                                                                                                              (1, "egfr", "again", 10, day[5], 1.0, None, "A", 1, 1)]
    spark.createDataFrame(points, refresh.POINTS).write.parquet(f"{tmp_path}/points")
    flags = [(1, "egfr", "a", day[5], day[4], day[4], "RCV_PREV"), (1, "egfr", "b", day[5], day[0], day[2], "RCV_BASELINE"), (1, "egfr", "c", day[5], day[1], day[5], "KDIGO_RAPID_EGFR"),
             (None, "egfr", "d", day[5], day[4], day[5], "RCV_PREV"), (1, "egfr", "e", None, None, None, "RCV_PREV")]
    spark.createDataFrame(flags, "patient_id bigint, analyte_id string, flag_id string, date date, ref_first date, ref_last date, rule_id string").write.parquet(f"{tmp_path}/flags")
    out = T.flag_evidence(spark.read.parquet(f"{tmp_path}/flags"), spark.read.parquet(f"{tmp_path}/points"))
    assert _plan(out).count("FileScan") == 2
    assert sorted((r.flag_id, r.role, r.observation_id) for r in out.collect()) == sorted(
        [("a", "from", "o4"), *[(f, "to", o) for f in "ab" for o in ("o5", "again")], *[("b", "from", f"o{i}") for i in range(3)],
         *[("c", "from", o) for o in ("o1", "o2", "o4", "o5", "again")]])


def test_results_around_events_beside_a_plain_search(spark, tmp_path):
    rng = random.Random(5)
    date = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    days = {(p, a): {date(n): float(n) for n in rng.sample(range(300), rng.randint(0, 12))} for p in range(12) for a in ("tsh", "egfr")}
    rows = [(p, a, d, v, f"L{int(v) % 3}", f"L{int(v) % 3}") for (p, a), series in days.items() for d, v in series.items()]
    rows += [(None, "tsh", date(3), 1.0, "x", "x"), (1, "tsh", None, 7.0, "x", "x")]
    spark.createDataFrame(rows, "patient_id bigint, analyte_id string, date date, value double, lab_lo string, lab_hi string").write.parquet(f"{tmp_path}/days")
    events = [(p, a, c, n, date(n), date(n + 20), date(n + 60)) for p in range(12) for a in ("tsh", "egfr") for c, n in {(rng.choice("xy"), rng.randint(0, 300)) for _ in range(5)}]
    events += [(1, "tsh", "x", -1, None, None, None), (None, "tsh", "x", -2, date(3), date(4), date(9)), *events[:3]]
    effects = spark.createDataFrame(events, "patient_id bigint, analyte_id string, drug_class string, n int, date date, window_start date, window_end date")
    stored = spark.read.parquet(f"{tmp_path}/days")
    out = R.before_and_after(effects, stored)

    def plain(p, a, at, start, end):
        earlier = [e[4] for e in events if e[:2] == (p, a) and e[4] and e[4] < at]
        since, series = max(earlier, default=dt.date.min), days[p, a]
        before = [series[d] for d in sorted((d for d in series if d <= at), reverse=True)[:3] if (at - d).days <= R.LOOK_BACK_DAYS and d > since]
        after = min((d for d in series if d >= start), default=None)
        return before, after if after and after <= end else None, after is None

    got = [(r.patient_id, r.analyte_id, r.drug_class, r.date, [b.value for b in r.before], r.after_date, r.too_early, r.after_value) for r in out.collect()]
    expected = {(p, a, c, d): plain(p, a, d, s, e) for p, a, c, _, d, s, e in events if p is not None and d}
    assert len(got) == len(expected)
    assert {g[:4]: g[4:7] for g in got} == expected and all(g[7] == (days[g[:2]][g[5]] if g[5] else None) for g in got)
    reads = [x for x in _plan(out.select("patient_id", "date", "after_date")).splitlines() if "ReadSchema" in x]
    assert len(reads) == 1 and "value" not in reads[0]                              # days are read once, without what is not used


def test_citations_find_all_days_in_one_look_at_the_results(spark, tmp_path):
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    points = [(1, "tsh", f"o{n}", n, day(n), 1.0, "<" if n == 7 else None, "A", 1, 1) for n in range(10)] + [(2, "tsh", "x", 99, day(3), 1.0, None, "A", 1, 1)]
    spark.createDataFrame(points, refresh.POINTS).write.parquet(f"{tmp_path}/points")
    stored = spark.read.parquet(f"{tmp_path}/points")
    flags = spark.createDataFrame([(1, "tsh", "early", "RCV_PREV", day(2), day(1), day(1)), (1, "tsh", "late", "RCV_PREV", day(8), day(4), day(4))],
                                  "patient_id bigint, analyte_id string, flag_id string, rule_id string, date date, ref_first date, ref_last date")
    periods = spark.createDataFrame([(1, K.SINCE_LAST_VISIT, day(6), day(9), None), (2, K.SINCE_LAST_VISIT, None, None, "none")],
                                    "patient_id bigint, kind string, period_start date, period_end date, reason string")
    reports = spark.createDataFrame([(p, r, d, f"R{r}", r, "A") for p, _, _, r, d, *_ in points],
                                    "patient_id bigint, report_id bigint, collected_at date, label string, label_number int, lab string")
    base = spark.createDataFrame([(1, "tsh", 1.0, day(0), day(1)), (2, "tsh", 1.0, day(3), day(3))], "patient_id bigint, analyte_id string, baseline double, baseline_first date, baseline_last date")
    responses = spark.createDataFrame([(1, "tsh", 5, day(6), [(day(5),), (day(3),)], day(9)), (1, "tsh", 6, day(2), [(day(2),)], None), (1, "tsh", 7, day(7), [], None)],
                                      "patient_id bigint, analyte_id string, event_id bigint, date date, before array<struct<day:date>>, after_date date")
    cited = K.fact_citations(flags, periods, reports, base, responses, stored)
    got = sorted((r.section, r.fact_key, r.label) for r in cited.collect())
    assert got == sorted([("flag", "late", "R4"), ("flag", "late", "R8"), ("limit", "o7", "R7"), ("baseline", "tsh", "R0"), ("baseline", "tsh", "R1"), ("before", "5:tsh", "R3"),
                          ("before", "5:tsh", "R5"), ("after", "5:tsh", "R9"), *[("result", f"tsh:{day(n)}", f"R{n}") for n in (6, 8, 9)]])
    used = K.used_reports(flags, periods, reports, reports, base, responses, stored)
    assert _plan(used).count("FileScan") == 2                                       # the series of the period, and the results
    assert sorted(r.report_id for r in used.collect()) == [0, 1, 3, 4, 5, 6, 7, 8, 9]
    assert "observation_id" not in CITED["points"]


def test_words_are_placed_as_by_a_walk_through_the_line(spark):
    rng = random.Random(3)
    cols = [("test", 0.0, -1e9), ("value", 100.0, 90.0), ("unit", 150.0, 140.0), ("value", 200.0, 190.0)]
    lines = []
    for k in range(300):
        x, words = rng.choice((0.0, 60.0, 85.0, 130.0)), []
        for _ in range(rng.randint(0, 6)):
            end = x + rng.choice((10.0, 40.0, 70.0))
            words.append((x, 0.0, end, 9.0, f"w{len(words)}"))
            x = end + rng.choice((2.0, 4.9, 5.0, 30.0))
        lines.append((k, words, ["O"] * len(words), cols if k % 5 else None))

    def column(c, x):
        return next((kind for kind, _, left in reversed(c) if x >= left), None) if c else None

    def walk(words, c):
        out, value = [], next((x for kind, x, _ in c or [] if kind == "value"), None)
        for i, (x0, _, x1, _, _) in enumerate(words):
            own, before = column(c, (x0 + x1) / 2), out[-1] if out else None
            keeps = not i or x0 - words[i - 1][2] >= P.CELL_GAP or own == before or (before == "test" and value is not None and x0 >= value)
            out.append("test" if not i and column(c, x0 + 1) == "test" else own if keeps else before)
        return out

    rows = spark.createDataFrame(lines, f"k int, words array<{P.WORD}>, tags array<string>, cols array<struct<kind:string,x0:double,left:double>>")
    rows = rows.withColumns({"plain": P.own_columns(F.col("words"), F.col("tags"), F.col("cols")),
                             "start": P.column_at(F.col("cols"), F.try_element_at("words", F.lit(1))["x0"] + 1)})
    got = {r.k: [w.col for w in r.placed] for r in rows.select("k", P.place_words(F.col("plain"), F.col("start"), F.col("cols")).alias("placed")).collect()}
    expected = {k: walk(words, c) for k, words, _, c in lines}
    assert got == expected and sum(expected[k] != [column(c, (w[0] + w[2]) / 2) for w in words] for k, words, _, c in lines) > 30
    texts = {"1 - 2": "1 - 2", "M: 1 - 2 F: 3 - 4": "M: 1 - 2 F: 3 - 4", "0.4 - 4.0: normal": "0.4 - 4.0", "5 : high": "5", "Adult: 7": "Adult: 7", "": ""}
    ranges = spark.createDataFrame([(t,) for t in texts], "t string").select("t", P.clean_range(
        F.transform(F.filter(F.split("t", " "), lambda x: x != ""), lambda x: F.struct(x.alias("text")))).alias("r"))
    assert {r.t: r.r for r in ranges.collect()} == texts


def test_counted_facts_store_no_frame_with_more_than_they_count(spark, tmp_path, monkeypatch):
    sf = _orders(spark, tmp_path, range(1, 60), items_each=4)
    spark.createDataFrame([(k, f"c{k}", 1) for k in range(1, 60)], "c_custkey bigint, c_name string, c_nationkey int").write.parquet(f"{sf}/customer.parquet")
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") % 3 + 1).alias("o_custkey"), F.expr("o_orderdate + make_dt_interval(int(o_orderkey) * 30)").alias(
        "o_orderdate"), F.when(F.col("o_orderkey") % 4 == 0, "5-LOW").when(F.col("o_orderkey") % 4 == 1, "2-HIGH").otherwise("1-URGENT").alias("o_orderpriority"))
    orders.write.parquet(f"{tmp_path}/more/orders.parquet")
    for name in ("customer", "lineitem"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/more/{name}.parquet")
    sf, kept = f"{tmp_path}/more", []
    monkeypatch.setattr(Lab, "stored", lambda self, *names, plain=Lab.stored, **columns: kept.append((names, columns)) or plain(self, *names, **columns))
    got = {(r.patient_id, r.section): r.n_facts for r in QUERIES["facts_per_section"](spark, sf).collect()}
    plain = Lab.from_given_tables(spark, sf).facts().collect()
    expected = Counter((r.patient_id, r.section) for r in plain)
    assert got == expected and {s for _, s in got} >= {"patient", "period", "result", "trend", "note"}
    assert [(names, {*columns}) for names, columns in kept] == [((), {"points", "days"})]
