"""Dimension tables built from the dictionary.

The rows are known on the driver, so their number is checked here before a broadcast hint is given: a
dictionary above ``BROADCAST_ROWS`` rows is returned without the hint and Spark chooses the join itself.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import dictionary as d

BROADCAST_ROWS = 10_000


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A typed table from rows the driver already holds, with a broadcast hint while it is small."""
    spark_schema = StructType.fromDDL(schema)
    arrow = pa.Table.from_pylist([dict(zip(spark_schema.names, row)) for row in rows],
                                 schema=to_arrow_schema(spark_schema))
    df = spark.createDataFrame(arrow, schema=spark_schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


def analytes(spark: SparkSession) -> DataFrame:
    rows = [(i, aid, name, loinc, unit, system, d.number(rcv), status)
            for i, (aid, name, loinc, unit, system, rcv, status) in enumerate(d.table(d.ANALYTES))]
    return small_table(spark, rows, "analyte_order int, analyte_id string, analyte_name string, loinc string, "
                                    "unit string, system_id string, rcv_percent double, rcv_status string")


def rcv_sources(spark: SparkSession) -> DataFrame:
    own = dict(d.table(d.RCV_SOURCES))
    return small_table(spark, [(aid, own.get(aid, d.RCV_SOURCE)) for aid, *_ in d.table(d.ANALYTES)], "analyte_id string, source string")


def analyte_names(spark: SparkSession) -> DataFrame:
    """(analyte, printed name, basis). Primary names first, names on another basis after them."""
    own = {aid: name for aid, name, *_ in d.table(d.ANALYTES)}
    synonyms, report, alternate = d.lists(d.SYNONYMS), d.lists(d.REPORT_SYNONYMS), d.lists(d.ALTERNATE_NAMES)
    rows = []
    for aid, name in own.items():
        rows += [(aid, n, "primary") for n in [name, *synonyms[aid], *report.get(aid, [])]]
        rows += [(aid, n, "alternate") for n in alternate.get(aid, [])]
    return small_table(spark, rows, "analyte_id string, printed_name string, basis string")


def synonym_pool(spark: SparkSession) -> DataFrame:
    """Names a data set is expected to cover: synonyms and names on another basis."""
    synonyms, alternate = d.lists(d.SYNONYMS), d.lists(d.ALTERNATE_NAMES)
    rows = [(aid, n) for aid in synonyms for n in [*synonyms[aid], *alternate.get(aid, [])]]
    return small_table(spark, rows, "analyte_id string, synonym string")


def unit_conversions(spark: SparkSession) -> DataFrame:
    rows = []
    for aid, items in d.lists(d.CONVERSIONS).items():
        for order, item in enumerate(items):
            unit, rule = item.rsplit(" = ", 1)
            factor, _, offset = rule.partition(" + ")
            rows.append((aid, order, unit, float(factor), float(offset or 0)))
    return small_table(spark, rows, "analyte_id string, unit_order int, unit string, factor double, offset double")


def reference_ranges(spark: SparkSession) -> DataFrame:
    """One row per (analyte, sex): the sex's own range, else the range for any sex."""
    ranges = {(aid, sex): (d.number(lo), d.number(hi)) for aid, sex, lo, hi in d.table(d.REFERENCE_RANGES)}
    extreme = {aid: (d.number(lo), d.number(hi)) for aid, lo, hi in d.table(d.EXTREME_LIMITS)}
    rows = []
    for aid, *_ in d.table(d.ANALYTES):
        for sex in ("male", "female"):
            rows.append((aid, sex, *(ranges.get((aid, sex)) or ranges[(aid, "any")]), *extreme[aid]))
    return small_table(spark, rows, "analyte_id string, sex string, range_low double, range_high double, "
                                    "extreme_low double, extreme_high double")


def targets(spark: SparkSession) -> DataFrame:
    rows = [(aid, d.number(lo), d.number(hi), label, status) for aid, lo, hi, label, status in d.table(d.TARGETS)]
    return small_table(spark, rows, "analyte_id string, target_low double, target_high double, target_label string, "
                                    "target_status string")


def test_intervals(spark: SparkSession) -> DataFrame:
    return small_table(spark, list(d.TEST_INTERVAL_MONTHS.items()), "analyte_id string, interval_months int")


def systems(spark: SparkSession) -> DataFrame:
    rows = [(sid, name, int(order), headline) for sid, name, order, headline in d.table(d.SYSTEMS)]
    return small_table(spark, rows, "system_id string, system_name string, system_order int, headline_analyte string")


def drug_names(spark: SparkSession) -> DataFrame:
    rows = [(g.lower(), cid, g) for cid, items in d.lists(d.GENERICS).items() for g in items]
    rows += [(brand.strip().lower(), cid, generic.strip()) for cid, items in d.lists(d.BRANDS).items()
             for brand, generic in (item.split("=") for item in items)]
    return small_table(spark, rows, "drug_key string, drug_class string, generic string")


def drug_classes(spark: SparkSession) -> DataFrame:
    rows = [(cid, name, short, int(start), int(end)) for cid, name, short, start, end in d.table(d.DRUG_CLASSES)]
    return small_table(spark, rows, "drug_class string, class_name string, class_short_name string, "
                                    "window_from int, window_to int")


def drug_effects(spark: SparkSession) -> DataFrame:
    """(class, analyte) with direction, limits and the class's window, in catalogue order."""
    windows = {cid: (short, int(start), int(end)) for cid, _, short, start, end in d.table(d.DRUG_CLASSES)}
    rows = [(cid, order, aid, direction, d.number(limit), size, note, *windows[cid])
            for order, (cid, aid, direction, limit, size, note) in enumerate(d.table(d.DRUG_EFFECTS))]
    return small_table(spark, rows, "drug_class string, effect_order int, analyte_id string, direction string, "
                                    "max_percent double, effect_size string, effect_note string, "
                                    "class_short_name string, window_from int, window_to int")


def condition_names(spark: SparkSession) -> DataFrame:
    rows = [(name.strip(), icd, title, snomed, term) for names, icd, title, snomed, term in d.table(d.CONDITIONS)
            for name in names.split(";")]
    return small_table(spark, rows, "condition_key string, icd10 string, icd10_title string, snomed string, "
                                    "snomed_term string")


def ckd_stages(spark: SparkSession) -> DataFrame:
    return small_table(spark, [tuple(r) for r in d.table(d.CKD_STAGE_CODES)],
                       "g_category string, icd10_cm string, icd10_cm_title string")


def panels(spark: SparkSession) -> DataFrame:
    rows = [(panel, test) for panel, tests in d.lists(d.PANELS).items() for test in tests]
    return small_table(spark, rows, "panel string, test_id string")


def required_inputs(spark: SparkSession) -> DataFrame:
    rows = [(test, needed) for test, inputs in d.lists(d.REQUIRES).items() for needed in inputs]
    return small_table(spark, rows, "test_id string, needed_id string")


def condition_synonyms(code: str) -> list[str]:
    """All names recorded for the condition with this ICD-10 code."""
    return [n.strip() for names, icd, *_ in d.table(d.CONDITIONS) if icd == code for n in names.split(";")]


def condition_code(code: str) -> str:
    """ICD-10 and SNOMED CT code of a condition as one text."""
    icd, snomed = next((icd, snomed) for _, icd, _, snomed, _ in d.table(d.CONDITIONS) if icd == code)
    return f"ICD-10 {icd}; SNOMED CT {snomed}"


def target_limits(analyte: str) -> tuple[float | None, float | None, str]:
    """Lower and upper limit of an analyte's target and how it is written."""
    return next((d.number(low), d.number(high), label) for aid, low, high, label, *_ in d.table(d.TARGETS) if aid == analyte)
