import itertools
import json

import numpy as np
from pyspark.sql import functions as F

from assaytrail.operators import facts as K
from assaytrail.operators import metadata as M
from assaytrail.operators import quality as Q
from assaytrail.operators import tagging as G
from assaytrail.operators import textchecks as X
from assaytrail.operators import textrows as P
from tests.patients import day

WORDS = "doc_id bigint, page int, text string, x0 double, x1 double, top double, bottom double"
X0 = {"test": 30.0, "value": 260.0, "unit": 350.0, "range": 450.0}


def cell(column, text, top, doc=1, page=1):
    out, x = [], X0[column]
    for word in text.split():
        out.append((doc, page, word, x, x + 5.0 * len(word), top, top + 9.0))
        x += 5.0 * len(word) + 3
    return out


HEADER = [("test", "Investigation"), ("value", "Observed Value"), ("unit", "Unit"), ("range", "Reference Range")]


def page(spark, rows, top=100.0, step=14.0, header=True):
    words = [w for c, t in HEADER for w in cell(c, t, top - step)] if header else []
    for i, row in enumerate(rows):
        for column, text in row.items():
            words += cell(column, text, top + i * step)
    lines = P.lines(P.group_rows(spark.createDataFrame(words, WORDS)))
    return G.tag_lines(lines.withColumn("tokens", F.transform("words", lambda w: w["text"])), G.rule_tagger)


def assembled(spark, rows, **kw):
    a = P.assemble(page(spark, rows, **kw)).cache()
    found, skipped = P.results(a).orderBy("line").collect(), P.skipped_lines(a).orderBy("line").collect()
    assert P.unaccounted(a, P.results(a), P.skipped_lines(a)).count() == 0
    return found, skipped


def test_result_with_continuation_lines(spark):
    found, skipped = assembled(spark, [
        {"test": "Fasting Blood Sugar", "value": "87", "unit": "mg/dL", "range": "74 - 99 mg/dl : Normal."},
        {"test": "Method :HEXOKINASE", "range": "100 - 125 mg/dl : Prediabetes"}, {"range": ">= 126 mg/dl : Diabetes"},
        {"test": "Specimen: PLASMA"}, {"test": "Serum Creatinine", "value": "1.1", "unit": "mg/dL", "range": "0.7 - 1.3"}])
    assert [(r.test_text, r.value_text, r.unit_text, r.range_text) for r in found] == [
        ("Fasting Blood Sugar", "87", "mg/dL", "74 - 99 mg/dl"), ("Serum Creatinine", "1.1", "mg/dL", "0.7 - 1.3")]
    assert found[0].notes == ["Method :HEXOKINASE", "Specimen: PLASMA"] and len(found[0].range_lines) == 3
    assert found[0].continuation_lines == [3, 4, 5] and skipped == []


def test_lines_without_a_tagged_value_are_listed(spark):
    found, skipped = assembled(spark, [{"test": "Unknown Marker", "value": "12", "unit": "mg/dL"},
                                       {"test": "Serum Sodium", "value": "140", "unit": "mmol/L"}])
    assert [r.test_text for r in found] == ["Serum Sodium"]
    assert [s.line for s in skipped] == [2] and "the model did not tag the value cell '12' as a value" in skipped[0].reason


def test_big_gap_and_heading_end_a_result(spark):
    rows = [{"test": "Serum Sodium", "value": "140", "unit": "mmol/L"}, {}, {}, {}, {}, {"test": "Some far note"}]
    found, _ = assembled(spark, rows)
    assert found[0].notes == []


def test_without_a_header_tags_decide(spark):
    found, _ = assembled(spark, [{"test": "Serum Sodium", "value": "140", "unit": "mmol/L", "range": "136 - 145"}], header=False)
    assert (found[0].test_text, found[0].value_text, found[0].range_text) == ("Serum Sodium", "140", "136 - 145")


def test_rows_within_three_points(spark):
    words = [(1, 1, "a", 0.0, 5.0, 10.0, 19.0), (1, 1, "b", 9.0, 12.0, 13.0, 22.0), (1, 1, "c", 0.0, 5.0, 13.5, 22.0)]
    got = {r.text: r.line for r in P.group_rows(spark.createDataFrame(words, WORDS)).collect()}
    assert got == {"a": 1, "b": 1, "c": 2}
    assert P.scans(spark.createDataFrame(words, WORDS)).first().n_words == 3


def test_rule_tags():
    tag = G.rule_tagger()
    cases = {
        "Serum Creatinine 1.10 mg/dL 0.7 - 1.3": "B-TEST I-TEST B-VALUE B-UNIT B-RANGE I-RANGE I-RANGE",
        "Platelet Count ..... 1,50,000 H /cumm (1.5-4.1)": "B-TEST I-TEST O B-VALUE B-FLAG B-UNIT B-RANGE",
        "HDL Cholesterol M: 40-60 55 mg/dL": "B-TEST I-TEST B-RANGE I-RANGE B-VALUE B-UNIT",
        "Sodium values are often near to 140": "O O O O O O O", "Some text 5": "O O O", "eGFR CKD-EPI 2021 78": "B-TEST O O B-VALUE",
    }
    for text, tags in cases.items():
        assert " ".join(tag([text.split()])[0]) == tags, text


def test_dates_and_labs(spark):
    cases = {"07-Jul-2025 11:38 AM": "2025-07-07", "12/25/2024": "2024-12-25", "15/01/24": "2024-01-15", "15/01/2408:40": "2024-01-15",
             "2024-03-09": "2024-03-09", "31/02/2024": None, "31/12/2999": None, "01/01/1901": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", M.parse_date(F.col("t"), "2026-09-28").alias("d"))
    assert {r.t: (str(r.d) if r.d else None) for r in rows.collect()} == cases
    lines = [(1, 1, 1, "Reported On : 16/01/2024"), (1, 1, 2, "Sample Collected At Home"), (1, 1, 3, "Collected On : 31/02/2024"),
             (1, 2, 1, "Collected Date and Time: 15 Jan 2024 08:00"), (2, 1, 1, "Reported: 02/03/2024")]
    got = {r.doc_id: (str(r.report_date), r.date_label) for r in M.labelled_dates(
        spark.createDataFrame(lines, "doc_id bigint, page int, line int, text string"), "2026-09-28").collect()}
    assert got == {1: ("2024-01-15", "Collected"), 2: ("2024-03-02", "Reported")}
    names = {"Vedhya Diagnostic Centre": "Vedhya Diagnostic Centre", "Tel No :12345 Sample :EXAMPLE HEALTHCARE LTD": "EXAMPLE HEALTHCARE LTD",
             "Lab Director": None, "Ref by Dr. Sunrise Clinic": None, "Sunrise Labs No: 7": None}
    rows = spark.createDataFrame([(k,) for k in names], "t string").select("t", M.lab_in_line(F.col("t")).alias("lab"))
    assert {r.t: r.lab for r in rows.collect()} == names


def test_lab_name_is_sought_over_the_document(spark):
    """The first 15 lines count over all pages: a cover page does not hide a name, and a later line does not count."""
    lines = [(1, 1, i, "cover") for i in (1, 2, 3)] + [(1, 2, 1, "Vedhya Diagnostic Centre")]
    lines += [(2, 1, i, "x") for i in range(1, 11)] + [(2, 2, i, "x") for i in range(1, 6)] + [(2, 2, 6, "Vedhya Diagnostic Centre")]
    rows = spark.createDataFrame(lines, "doc_id bigint, page int, line int, text string")
    assert [(r.doc_id, r.lab) for r in M.labs(rows).collect()] == [(1, "Vedhya Diagnostic Centre")]
    assert {r.doc_id for r in M.labs(rows, head_lines=None).collect()} == {1, 2}


def test_roundings_have_no_limit(spark):
    def plain(number):
        from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Context, Decimal
        places, context = len(number.partition(".")[2]), Context(prec=200)
        return {format(Decimal(number).quantize(Decimal(1).scaleb(-k), rounding=mode, context=context), "f")
                for k in range(places + 1) for mode in (ROUND_HALF_UP, ROUND_HALF_EVEN)}

    numbers = ["1.23456789012345", "9.9995", "0.5", "2.5", "99.95", "7", "123456789012345678901234567890.25", "0.00000000000000005", "1.2350"]
    rows = spark.createDataFrame([(n,) for n in numbers], "n string").select("n", X.roundings(F.col("n")).alias("r")).collect()
    assert {r.n: set(r.r) for r in rows} == {n: plain(n) for n in numbers}
    forms = X.rounded_forms(spark.createDataFrame([(n, n) for n in numbers], "n string, m string"), ["n"], "m").collect()
    assert {n: {r.number for r in forms if r.n == n} for n in numbers} == {n: plain(n) for n in numbers}
    facts = spark.createDataFrame([(1, "1.23456789012345")], "k int, fact string")
    assert X.number_violations(spark.createDataFrame([(1, "1.2345678901234")], "k int, text string"), facts, ["k"]).count() == 0


def test_numbers_and_wording(spark):
    facts = spark.createDataFrame([(1, '{"slope": -7.08, "value": 78.42}'), (1, "R7 T4 2.5")], "k int, fact string")
    said = "78.42 78.4 78 7.1 7 2.5 3 2 78.5 78.420 7.2 R9 007"
    texts = spark.createDataFrame([(1, said)], "k int, text string")
    assert sorted(r.said for r in X.number_violations(texts, facts, ["k"]).collect()) == ["7.2", "78.420", "78.5"]
    texts = spark.createDataFrame([(1, "Chronic kidney disease is stable; the drug Worked. You should stop, disease")], "k int, text string")
    got = [r.word for r in X.wording(texts, allowed=["chronic kidney disease"]).collect()]
    assert sorted(got) == ["Worked", "disease", "should", "stop"]
    phrases = spark.createDataFrame([(1, ["chronic kidney disease", "a.b"])], "k int, phrases array<string>")
    assert sorted(r.word for r in X.wording_per_patient(texts, phrases, ["k"]).collect()) == sorted(got)
    texts = spark.createDataFrame([(1, "Kidney Disease (x\\E) disease"), (2, "disease"), (3, "disease"), (4, None)], "k int, text string")
    phrases = spark.createDataFrame([(1, ["disease (x\\E)", "kidney disease (x\\E)", None, ""]), (2, []), (4, ["a"])], "k int, phrases array<string>")
    assert sorted((r.k, r.word) for r in X.wording_per_patient(texts, phrases, ["k"]).collect()) == [(1, "disease"), (2, "disease"), (3, "disease")]


def test_summary_checks(spark):
    good = {"key_finding": {"text": "eGFR fell", "report_ids": ["R1", "R9"]}, "sections": [
        {"title": "Kidney", "sentences": [{"text": "x", "report_ids": ["R2"]}]}],
        "medication_rows": [{"date": "2024-03-04", "drug": "Tab RAMIPRIL", "dose": "", "observed": ""},
                            {"date": "2024-03-05", "drug": "Ramipril", "dose": "", "observed": ""}], "data_notes": ["n"]}
    empty = {**good, "key_finding": {"text": " ", "report_ids": []}}
    rows = [(1, json.dumps(good)), (2, "not json"), (3, json.dumps({"key_finding": None})), (4, json.dumps(empty)), (5, json.dumps({**good, "sections": "x"})),
            (6, json.dumps(good)[:-5]), (7, None), (8, "")]
    parsed = X.parse(spark.createDataFrame(rows, "id int, content string"))
    errors = {r.id: r.error for r in parsed.collect()}
    wrong, other = "the answer is not valid JSON", "the JSON does not match the schema"
    assert errors == {1: None, 2: wrong, 3: other, 4: None, 5: other, 6: wrong, 7: wrong, 8: wrong}
    texts = X.summary_texts(parsed, ["id"])
    labels = spark.createDataFrame([(i, f"R{n}", n) for i in (1, 4) for n in (1, 2)], "id int, label string, report_id bigint")
    assert [(r.id, r.label) for r in X.unknown_citations(texts, labels, ["id"]).collect()] == [(1, "R9")]
    assert [r.id for r in X.empty_findings(texts).collect()] == [4]
    events = spark.createDataFrame([(1, day("2024-03-04"), "ramipril"), (4, day("2024-03-04"), "ramipril")], "id int, date date, drug string")
    assert {(r.id, r.position) for r in X.unknown_medication_rows(parsed, events, ["id"]).collect()} == {(1, 1), (4, 1)}
    assert {(r.id, r.report_id) for r in X.labels_to_reports(texts, labels, ["id"]).collect()} == {(1, 1), (1, 2), (4, 2)}


def test_facts_hash_ignores_order(spark):
    rows = [(1, "a", "x"), (1, "b", "y"), (2, "b", "y"), (2, "a", "x"), (3, "a", "z"), (3, "b", "y")]
    df = spark.createDataFrame(rows, "patient_id int, section string, fact string")
    one = {r.patient_id: (r.hash_a, r.hash_b, r.hash_c, r.hash_d) for r in K.facts_hash(df).collect()}
    two = {r.patient_id: (r.hash_a, r.hash_b, r.hash_c, r.hash_d) for r in K.facts_hash(df.orderBy(F.desc("fact")).repartition(3)).collect()}
    assert one == two and one[1] == one[2] != one[3]


def test_best_tags_against_all_sequences():
    rng = np.random.default_rng(5)
    valid = lambda tags: all(not t.startswith("I-") or b[2:] == t[2:] for b, t in zip(["O", *tags], tags))
    for n in (1, 2, 3):
        for _ in range(20):
            scores = rng.normal(size=(n, len(G.TAGS)))
            best = max((s for s in itertools.product(G.TAGS, repeat=n) if valid(s)), key=lambda s: sum(scores[i, G.TAGS.index(t)] for i, t in enumerate(s)))
            assert G.best_tags(scores) == list(best)
    assert G.best_tags(np.zeros((0, len(G.TAGS)))) == [] and G.best_tags(np.zeros((3, len(G.TAGS)))) == ["O"] * 3


def test_tags_of_a_word_scorer_are_valid(spark):
    rows = [(1, ["Serum", "Sodium", "140", "mmol/L", "-", "H"]), (2, []), (3, ["7"] * 200), (4, ["Serum", "Sodium", "140", "mmol/L", "-", "H"])]
    got = G.tag_lines(spark.createDataFrame(rows, "id int, tokens array<string>"), G.constrained(G.word_scorer))
    assert Q.bad_tags(got).count() == 0
    tags = {r.id: r.tags for r in got.collect()}
    assert tags[1] == tags[4] and tags[2] == [] and len(tags[3]) == 200
    free = [[G.TAGS[int(i)] for i in scores.argmax(axis=1)] for scores in G.word_scorer()([tokens for _, tokens in rows if tokens])]
    assert any(t.startswith("I-") and b[2:] != t[2:] for line in free for b, t in zip(["O", *line], line))       # scores alone are not valid tags


def test_words_of_a_document_are_dealt_once(spark):
    """Lines, headers, pitches, repeated texts, results and continuation lines all come from one deal of the words."""
    words = spark.createDataFrame(
        [(d, 1, t, x, x + 40.0, y, y + 9.0) for d in (1, 2) for y, row in ((90.0, ("Investigation", "Result")), (104.0, ("TSH", "2.1")))
         for x, t in zip((30.0, 260.0), row)], "doc_id long, page int, text string, x0 double, x1 double, top double, bottom double").repartition(3, "doc_id")
    lines = P.lines(P.group_rows(words))
    tags = F.when(F.col("line") == 2, F.array(F.lit("B-TEST"), F.lit("B-VALUE"))).otherwise(F.array(F.lit("O"), F.lit("O")))
    found = P.results(P.assemble(lines.withColumn("tags", tags)))
    assert found._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted((r.doc_id, r.line, r.test_text, r.value_text) for r in found.collect()) == [(1, 2, "TSH", "2.1"), (2, 2, "TSH", "2.1")]
