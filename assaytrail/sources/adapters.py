"""The lab data model as views over the given tables, row for row.

customer -> patients, orders -> reports and medication events, lineitem -> observations and printed rows,
documents / conversations -> texts, lines and words. Every row of a source table takes part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import dictionary as d

AS_OF = "2018-01-01"          # the day every time-dependent query is run for

# Two results per line item: (analyte, typical value in thousandths), chosen by part and by supplier.
MAIN_ANALYTES = [("creatinine", 1000), ("egfr", 60000), ("hba1c", 6000), ("potassium", 4300), ("uacr", 20000),
                 ("tsh", 2200)]
SECOND_ANALYTES = [("tsh", 2200), ("free_t4", 1300), ("fasting_glucose", 105000), ("ldl", 90000)]
CONDITION_SETS = ["Type 2 diabetes;Chronic kidney disease", "Hypertension", "Hypothyroidism", "",
                  "Dyslipidaemia;Asthma"]
PRESCRIBED = {"1-URGENT": "Tab. Ramipril 5 mg", "2-HIGH": "Jardiance", "3-MEDIUM": "Metformin SR 500",
              "4-NOT SPECIFIED": "THYRONORM  50 mcg", "5-LOW": "Atorvastatin 10"}
PRINTED_TESTS = [
    ("Serum Creatinine", "mg/dL"), ("CREATININE - SERUM", "mg %"), ("S.Creatinine", "µmol/L"), ("eGFR", "mL/min/1.73m2"),
    ("HB A1C", "%"), ("Glycated  Haemoglobin", "mmol/mol"), ("BUN", "mg/dL"), ("Urea Nitrogen - Serum", "mmol/L"),
    ("GLUCOSE (FASTING)", "mg/dl"), ("GLUCOSE", "mg/dl"), ("TSH (Ultrasensitive)", "μIU/ml"),
    ("serum   potassium", "mEq/L"), ("VLDL CHOLESTEROL", ""), ("Platelet Count", "Lakhs/cu.mm"),
    ("Triglycerides (Fasting)", "mmol/xx"), ("Age / Sex", ""),
]

# Columns of a line item that its printed row is made from, and line items to a task where their rows become words.
PRINTED_FROM = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_tax", "l_returnflag"]
OBSERVED_FROM = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax"]
ROWS_A_TASK = 100_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _choose(selector: Column, options: list) -> Column:
    """The option whose position equals the selector."""
    out = F.lit(options[-1])
    for i, option in reversed(list(enumerate(options[:-1]))):
        out = F.when(selector == i, F.lit(option)).otherwise(out)
    return out


def _scaled_date(col: str = "o_orderdate") -> Column:
    days = F.datediff(F.to_date(col), F.lit("1995-01-01").cast("date"))
    return F.date_add(F.lit("2015-01-01").cast("date"), F.floor(days / 3).cast("int"))


def line_item_id() -> Column:
    """Order and line number do not identify a line item; with part, supplier and price they do."""
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                       F.round(F.col("l_extendedprice") * 100).cast("bigint"))


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    text = _choose(key % 5, CONDITION_SETS)
    return read(spark, sf_dir, "customer").select(
        key.alias("patient_id"), F.col("c_nationkey").cast("bigint").alias("doctor_id"),
        F.concat(F.lit("P-"), key.cast("string")).alias("patient_code"), F.col("c_name").alias("name"),
        F.when(key % 2 == 0, "male").otherwise("female").alias("sex"), (1930 + key % 50).cast("int").alias("birth_year"),
        F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ";")).alias("conditions"),
        F.when(key % 7 != 0, (50 + key % 50).cast("double")).alias("weight_kg"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    lab = (F.when(key % 4 == 0, "Lab A").when(key % 4 == 1, "Lab B").when(key % 4 == 2, "Lab C"))
    return read(spark, sf_dir, "orders").select(
        key.alias("report_id"), F.col("o_custkey").alias("patient_id"), lab.alias("lab"),
        _scaled_date().alias("collected_at"),
        F.when(F.col("o_orderpriority") == "5-LOW", "extracted").otherwise("confirmed").alias("status"))


def med_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    drug = F.lit(None).cast("string")
    for priority, text in PRESCRIBED.items():
        drug = F.when(F.col("o_orderpriority") == priority, text).otherwise(drug)
    change = F.when(key % 4 == 2, "stop").when(key % 4 == 3, "dose_change").otherwise("start")
    return read(spark, sf_dir, "orders").select(
        key.alias("event_id"), F.col("o_custkey").alias("patient_id"), drug.alias("drug"), change.alias("change"),
        F.lit("").alias("dose_text"), _scaled_date().alias("date"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values in whole thousandths, about typical x U(0.4, 1.9); one scan gives both results of a line item."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")

    def result(slot: int, options: list, selector: Column) -> Column:
        analyte = _choose(selector, [a for a, _ in options])
        typical = _choose(selector, [t for _, t in options]).cast("bigint")
        scaled = typical * (F.lit(42000000).cast("bigint") + 15 * cents)
        milli = (scaled - scaled % 105000000) / 105000000
        ident = F.concat_ws("-", line_item_id(), F.lit(slot))
        return F.struct(ident.alias("observation_id"), analyte.alias("analyte_id"),
                        (milli / 1000).alias("canonical_value"), (F.col("l_linenumber") * 2 + slot).alias("line"))

    both = F.array(result(0, MAIN_ANALYTES, F.col("l_partkey") % 6), result(1, SECOND_ANALYTES, F.col("l_suppkey") % 4))
    # Line items are dealt by report, where points meet theirs, before they become two rows with long ids each.
    items = read(spark, sf_dir, "lineitem").select(*OBSERVED_FROM)
    return (dealt(items, items.count(), "l_orderkey")
            .select(F.col("l_orderkey").alias("report_id"),
                    F.when(F.col("l_discount") == 0.0, "<").when(F.col("l_discount") == 0.1, ">").alias("comparator"),
                    F.lit(1).alias("page"),
                    F.when(F.col("l_tax") == 0.08, "rejected").otherwise("confirmed").alias("status"),
                    F.explode(both).alias("r"))
            .select("report_id", "comparator", "page", "status", "r.*"))


def dealt(rows: DataFrame, lines: int, key: str) -> DataFrame:
    """Rows dealt by a key over tasks of about ``ROWS_A_TASK`` of ``lines`` line items: each of them becomes many words later."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, lines // ROWS_A_TASK), key)


def printed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as a lab prints them: names, units and values in many spellings, some of them not results."""
    items = read(spark, sf_dir, "lineitem").select(*PRINTED_FROM)
    return _printed(dealt(items, items.count(), "l_orderkey"))


def _printed(items: DataFrame, *first: str) -> DataFrame:
    """Line items as printed rows, in order within their report; columns in ``first`` come before the line number in that order, and are kept."""
    which = F.col("l_partkey") % len(PRINTED_TESTS)
    style = F.col("l_suppkey") % 9
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    plain = F.concat((cents % 997).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    value = (F.when(style == 0, F.concat(F.lit("<"), plain)).when(style == 1, F.concat(F.lit("less than "), plain))
             .when(style == 2, F.concat(F.lit("1,50,"), F.lpad((cents % 1000).cast("string"), 3, "0")))
             .when(style == 3, F.concat(plain, F.lit("*"))).when(style == 4, F.lit("Negative"))
             .when(style == 5, F.concat(F.lit("5,"), (cents % 10).cast("string")))
             .when(style == 6, F.concat(F.lit(">= "), plain)).otherwise(plain))
    unit = _choose(which, [u for _, u in PRINTED_TESTS])
    place = Window.partitionBy("l_orderkey").orderBy(*first, "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return items.select(
        *first, line_item_id().alias("observation_id"),
        F.col("l_orderkey").alias("report_id"), F.lit(1).alias("page"), F.row_number().over(place).alias("line"),
        _choose(which, [n for n, _ in PRINTED_TESTS]).alias("test_text"), value.alias("value_text"),
        F.when(F.col("l_tax") == 0.01, "").otherwise(unit).alias("unit_text"),
        F.when(F.col("l_returnflag") == "N", "1 - 2").otherwise("").alias("range_text"))


def labelled_rows(spark: SparkSession, sf_dir: str, deal: bool = False) -> DataFrame:
    """Printed rows as labelled tokens, with the tags of a tagger that makes some mistakes. ``deal``: by report, as the printed pages are."""
    items = read(spark, sf_dir, "lineitem")
    printed = _printed(dealt(items.select(*PRINTED_FROM), items.count(), "l_orderkey") if deal else items)
    parts = [("TEST", "test_text"), ("VALUE", "value_text"), ("UNIT", "unit_text"), ("RANGE", "range_text")]

    def tokens(c: str) -> Column:
        return F.filter(F.split(F.col(c), " +"), lambda t: t != "")

    def tags(kind: str, c: str) -> Column:
        return F.transform(tokens(c), lambda t, i: F.concat(F.when(i == 0, "B-").otherwise("I-"), F.lit(kind)))

    gold = F.concat(*[tags(k, c) for k, c in parts])
    miss = F.transform(gold, lambda t: F.when(t.endswith("UNIT") & F.col("value_text").contains("*"), "O").when(
        (t == "B-VALUE") & F.col("value_text").startswith(">"), "B-RANGE").otherwise(t))
    split = F.when(F.col("report_id") % 10 == 0, "val").when(F.col("report_id") % 10 == 1, "test").otherwise("train")
    family = F.concat(F.lit("family "), (F.col("report_id") % 10).cast("string"))
    return printed.select("observation_id", "report_id", "page", "line", split.alias("split"), family.alias("layout_family"),
                          F.concat(*[tokens(c) for _, c in parts]).alias("tokens"), gold.alias("tags"),
                          miss.alias("predicted"), "test_text", "value_text", "unit_text")


def printed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of one page per report: a table header and the printed rows below it, in four columns.

    Line items and orders are dealt by report before they become words, and stay there: words are not dealt again."""
    x0 = {"test_text": 30.0, "value_text": 260.0, "unit_text": 350.0, "range_text": 450.0}
    items = read(spark, sf_dir, "lineitem").select(*PRINTED_FROM, F.lit(False).alias("_head"))
    heads = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(True).alias("_head"))
    printed = _printed(dealt(items.unionByName(heads, allowMissingColumns=True), items.count(), "l_orderkey"), "_head")
    titles = F.array(*[F.struct(F.lit(x).alias("x"), F.array(F.lit(t)).alias("t")) for t, x in (
        ("Investigation", 30.0), ("Result", 260.0), ("Unit", 350.0), ("Reference", 450.0), ("Range", 500.0))])
    pieces = F.array(*[F.struct(F.lit(x).alias("x"), F.split(F.trim(F.regexp_replace(c, " +", " ")), " ").alias("t"))
                       for c, x in x0.items()])
    rows = (printed.select("report_id", "line", "_head", F.explode(F.when(F.col("_head"), titles).otherwise(pieces)).alias("p"))
            .select("report_id", "line", "_head", "p.x", "p.t", F.posexplode("p.t").alias("i", "text")).filter(F.col("text") != ""))
    before = F.aggregate(F.slice("t", F.lit(1), F.col("i")), F.lit(0), lambda n, t: n + F.length(t) + 1)
    start = F.col("x") + before * 5.0
    words_ = rows.select(F.col("report_id").alias("doc_id"), F.lit(1).alias("page"), "text", start.alias("x0"), (start + F.length("text") * 5.0).alias("x1"),
                         F.when(F.col("_head"), F.lit(90.0)).otherwise(100.0 + F.col("line") * 14.0).alias("top"))
    return words_.withColumn("bottom", F.col("top") + 9.0)


def header_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines above a report's table: lab, patient, dates in several forms.

    Orders are dealt by report as the pages are, before they become lines: reading names and dates in them is work, and a scan is one task."""
    date = _scaled_date()
    key = F.col("o_orderkey")
    form = key % 7

    def shown(pattern: str) -> Column:
        return F.date_format(date, pattern)

    collected = (F.when(form == 0, F.concat(F.lit("Sample Collected On : "), shown("dd-MM-yyyy"), F.lit(" 11:38 AM")))
                 .when(form == 1, F.concat(F.lit("Collected: "), shown("yyyy-MM-dd")))
                 .when(form == 2, F.concat(F.lit("Collection Date & Time : "), shown("dd/MM/yy"), F.lit("08:40")))
                 .when(form == 3, F.concat(F.lit("Coll. "), shown("dd.MM.yyyy")))
                 .when(form == 4, F.lit("Collected At Home"))
                 .when(form == 5, F.lit("Sample Collected On : 31/02/2016")).otherwise(F.lit("Age / Sex : 44 Y")))
    reported = F.concat(F.lit("Reported On : "), F.date_format(F.date_add(date, 1), "dd/MM/yyyy"))
    lab = (F.when(key % 5 == 0, "Vedhya Diagnostic Centre").when(key % 5 == 1, "Tel No :12345 Sample :EXAMPLE HEALTHCARE LTD")
           .when(key % 5 == 2, "Lab Director").when(key % 5 == 3, "Ref by Dr. Sunrise Clinic").otherwise("Sai Krupa Path Labs, Pune"))
    rows = F.array(*[F.struct(F.lit(i).alias("line"), t.alias("text")) for i, t in enumerate((lab, collected, reported), 1)])
    orders = dealt(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), read(spark, sf_dir, "lineitem").count(), "o_orderkey")
    return orders.select(key.alias("doc_id"), F.lit(1).alias("page"), F.explode(rows).alias("r")).select("doc_id", "page", "r.line", "r.text")


# --- Sentences about a report: what stands for {v} is a rounding, {w} a wrong number, {n} a label number ----------------
SENTENCES = ["Creatinine rose to {v} (R{n}).", "Values were stable, good news, at {w} (R{n}).", "The drug lowered it; you should recheck {v} (R{n}).",
             "Printed by Metropolis and lal  pathlabs as {w}.", "A better score due to diet, {v} and 007 (R{n}, R1).", "No number here.",
             "THYROCARE sample, must-have result {w} (R{n}); abnormal."]


def written_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One written sentence per order with the fact it is about: report_id, patient_id, fact, text."""
    key = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    whole, part = ((cents - cents % 100) / 100).cast("bigint").cast("string"), F.lpad((cents % 100).cast("string"), 2, "0")
    fact = F.concat(whole, F.lit("."), part)
    rounded = ((cents + 5 - (cents + 5) % 10) / 10).cast("bigint")
    shown = F.concat(((rounded - rounded % 10) / 10).cast("bigint").cast("string"), F.lit("."), (rounded % 10).cast("string"))
    text = F.element_at(F.array(*map(F.lit, SENTENCES)), (key % len(SENTENCES) + 1).cast("int"))
    for mark, value in (("{v}", shown), ("{w}", F.concat(whole, F.lit("."), part, F.lit("7"))), ("{n}", (key % 23 + 1).cast("string"))):
        text = F.replace(text, F.lit(mark), value)
    return read(spark, sf_dir, "orders").select(key.alias("report_id"), F.col("o_custkey").alias("patient_id"), fact.alias("fact"), text.alias("text"))


def second_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled rows read once more: some words differ, some rows are missing and some places have a row that was not there."""
    rows = labelled_rows(spark, sf_dir).select("report_id", "line", "tokens")
    kept = rows.filter((F.col("report_id") + F.col("line")) % 101 != 0)
    changed = F.when((F.col("report_id") + 2 * F.col("line")) % 97 == 0, F.concat(F.array(F.lit("?")), F.slice("tokens", 2, 1000))).otherwise(F.col("tokens"))
    extra = rows.filter((F.col("line") == 1) & (F.col("report_id") % 89 == 0)).withColumn("line", F.lit(1000))
    return kept.withColumn("tokens", changed).unionByName(extra)


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: name (the number), content with the leading bytes of a type, of five every fourth of none that is known."""
    key = F.pmod("doc_id", F.lit(5))
    magic = F.when(key == 1, F.unhex(F.lit("89504E47"))).when(key == 2, F.unhex(F.lit("FFD8FF"))).when(key == 3, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("25504446")))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), F.concat(magic, F.coalesce("text", F.lit("")).cast("binary")).alias("content"))


def all_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every written sentence and every whole document: kind, id, text."""
    sentences = written_texts(spark, sf_dir).select(F.lit("sentence").alias("kind"), F.col("report_id").alias("id"), "text")
    return sentences.unionByName(read(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text"))


def patient_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts about one patient each: a sentence a report that names conditions and lab, and the document with the patient's number."""
    conditions = patients(spark, sf_dir).select("patient_id", F.array_join("conditions", " and ").alias("conditions"))
    sentence = F.concat(F.lit("History of "), F.col("conditions"), F.lit("; "), F.coalesce("lab", F.lit("no lab")),
                        F.lit(" saw kidney disease progress, asthma and hypertension, and a score due to LAB A."))
    about = reports(spark, sf_dir).join(conditions, "patient_id").select(
        F.lit("sentence").alias("kind"), F.col("report_id").alias("id"), "patient_id", sentence.alias("text"))
    return about.unionByName(read(spark, sf_dir, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("doc_id").alias("patient_id"), "text"))


def patient_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conditions and labs of each patient."""
    labs = reports(spark, sf_dir).groupBy("patient_id").agg(F.array_sort(F.collect_set("lab")).alias("labs"))
    return patients(spark, sf_dir).join(labs, "patient_id", "left").select(
        "patient_id", F.concat("conditions", F.coalesce("labs", F.array().cast("array<string>"))).alias("phrases"))


def written_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as a model may write them: answer_id, patient_id, content.

    One a report from its sentence and its medication event, of seven the second cut off, the third with a text for a list and the fourth without a
    field; the sixth has no citation, the seventh names another drug. Then one for each turn of the conversations, about the patient with the
    conversation's number: the whole text is the key finding, or stands there without any JSON.
    """
    texts = written_texts(spark, sf_dir).join(med_events(spark, sf_dir).select(F.col("event_id").alias("report_id"), "drug", "date"), "report_id")
    form = F.col("report_id") % 7
    label = F.concat(F.lit("R"), (F.col("report_id") % 23 + 1).cast("string"))
    cited = F.when(form == 5, F.lit("")).otherwise(F.concat(F.lit('"'), label, F.lit('"')))
    drug = F.when(form == 6, F.lit("Warfarin")).otherwise(F.col("drug"))
    head = F.concat(F.lit('{"key_finding":{"text":"'), F.col("text"), F.lit('","report_ids":['), cited, F.lit(']},"sections":'))
    sections = F.when(form == 2, F.lit('"none"')).otherwise(F.concat(
        F.lit('[{"title":"Results that worked","sentences":[{"text":"'), F.col("text"), F.lit('","report_ids":["R1","'), label,
        F.lit('"]},{"text":"Plain.","report_ids":[]}]}]')))
    rows = F.concat(F.lit(',"medication_rows":[{"date":"'), F.col("date").cast("string"), F.lit('","drug":"'), drug, F.lit(' daily","dose":"","observed":"stable"}]'))
    notes = F.when(form == 3, F.lit("")).otherwise(F.lit(',"data_notes":["One value is poor."]'))
    content = F.concat(head, sections, rows, notes, F.lit("}"))
    content = F.when(form == 1, F.substring(content, F.lit(1), F.length(content) - 9)).otherwise(content)
    reports_ = texts.select(F.concat(F.lit("report "), F.col("report_id").cast("string")).alias("answer_id"), "patient_id", content.alias("content"))
    whole = F.to_json(F.struct(F.struct(F.coalesce("text", F.lit("")).alias("text"), F.array(F.lit("R1")).alias("report_ids")).alias("key_finding"),
                               F.array().cast("array<string>").alias("sections"), F.array().cast("array<string>").alias("medication_rows"),
                               F.array(F.lit("no notes")).alias("data_notes")))
    turns_ = turns(spark, sf_dir).select(
        F.concat(F.lit("turn "), F.col("conv_id").cast("string"), F.lit(" "), F.col("turn").cast("string")).alias("answer_id"),
        F.col("conv_id").alias("patient_id"), F.when(F.col("role") == "user", F.col("text")).otherwise(whole).alias("content"))
    return reports_.unionByName(turns_)


def panel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests of a blood-count or liver panel printed on each order, one per line item."""
    cbc = d.lists(d.PANELS)["CBC"]
    lft = d.lists(d.PANELS)["LFT"]
    cell = F.col("l_partkey") % 13
    liver = F.col("l_partkey") % 9
    panel = F.when(F.col("l_linestatus") == "O", "CBC").otherwise("LFT")
    test = F.when(F.col("l_linestatus") == "O", _choose(cell, cbc)).otherwise(_choose(liver, lft))
    known = [r[0] for r in d.table(d.ANALYTES)]
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("report_id"), panel.alias("panel"), test.alias("test_id"), F.col("l_quantity").alias("value"),
        F.when(test.isin(known), test).alias("analyte_id"))


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as printed lines: 40 lines to a page, 12 points apart."""
    lines = read(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return lines.select("doc_id", (F.floor(F.col("pos") / 40) + 1).cast("int").alias("page"),
                        (F.col("pos") % 40 + 1).cast("int").alias("line"), "text",
                        (F.lit(40.0) + (F.col("pos") % 40) * 12.0).alias("top"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of those lines, six points to a character, with up to two points of jitter in height."""
    tokens = F.filter(F.split("text", "[ \t]+"), lambda t: t != "")
    w = text_lines(spark, sf_dir).select("doc_id", "page", "line", "top",
                                         F.posexplode(tokens).alias("pos", "text"))
    x0 = F.lit(30.0) + F.col("pos") * 60.0
    top = F.col("top") + (F.col("pos") % 3).cast("double")
    return w.select("doc_id", "page", "text", x0.alias("x0"), (x0 + F.least(F.length("text") * 6, F.lit(56))).alias("x1"),
                    top.alias("top"), (top + 9.0).alias("bottom"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations")
