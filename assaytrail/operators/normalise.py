"""Printed results to observations in canonical units, with a status and a reason.

Names, units and dictionary keys meet in broadcast joins of fixed size, so a table of printed rows is
normalised where it lies: no shuffle except the one per report that eGFR needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as num
from ..functions import text as tx
from ..sources import dictionary as d
from ..sources import dimensions as dim

NOT_A_RESULT = "test name not in the dictionary and no unit or range printed: not a lab result"
HIT = "array<struct<analyte_id:string,basis:string>>"


def _name_index(names: DataFrame, key: Column, out: str) -> DataFrame:
    """One row per key with every (analyte, basis) it stands for; at most one per dictionary name."""
    return F.broadcast(names.select(key.alias("_key"), F.struct("analyte_id", "basis").alias("_hit"))
                       .filter(F.col("_key") != "").groupBy("_key").agg(F.array_sort(F.collect_set("_hit")).alias(out)))


def match_names(rows: DataFrame, name: str = "test_text") -> DataFrame:
    """Add analyte_id, basis, match and candidates: exact name first, then loose word set or joined words.

    Ambiguity is counted on distinct analytes. Rows keep their number: each index has one row per key.
    """
    names = dim.analyte_names(rows.sparkSession)
    words = tx.loose_words(F.col("printed_name"))
    exact = _name_index(names, tx.name_key(F.col("printed_name")), "_exact").withColumnRenamed("_key", "_k1")
    by_set = _name_index(names, tx.word_set_key(words), "_set").withColumnRenamed("_key", "_k2")
    joined = _name_index(names, tx.joined_key(words), "_joined").withColumnRenamed("_key", "_k3")
    own_words = F.col("_words")                                               # a column of its own, so that it is worked out once
    out = (rows.withColumn("_words", tx.loose_words(F.col(name))).withColumn("_k1", tx.name_key(F.col(name))).withColumn("_k2", tx.word_set_key(own_words))
           .withColumn("_k3", tx.joined_key(own_words)).drop("_words")
           .join(exact, "_k1", "left").join(by_set, "_k2", "left").join(joined, "_k3", "left"))
    none = F.array().cast(HIT)
    loose = F.array_union(F.coalesce("_set", none), F.coalesce("_joined", none))
    hits = F.when(F.col("_exact").isNotNull(), F.col("_exact")).otherwise(loose)
    out = out.withColumn("_hits", hits).withColumn(
        "candidates", F.array_sort(F.array_distinct(F.transform("_hits", lambda h: h["analyte_id"]))))
    one = F.size("candidates") == 1
    alternate = F.forall("_hits", lambda h: h["basis"] == "alternate")
    return (out.withColumn("analyte_id", F.when(one, F.try_element_at("candidates", F.lit(1))))
            .withColumn("match", F.when(one & F.col("_exact").isNotNull(), "exact").when(one, "loose"))
            .withColumn("basis", F.when(one & alternate, "alternate").otherwise("primary"))
            .drop("_k1", "_k2", "_k3", "_exact", "_set", "_joined", "_hits"))


def alternate_only_words() -> list[str]:
    """Words only the alternate names of an analyte use ("bun", "nitrogen")."""
    out = []
    for aid, names in d.lists(d.ALTERNATE_NAMES).items():
        own = {w for n in d.lists(d.SYNONYMS)[aid] for w in n.lower().replace(",", " ").replace(".", " ").split()}
        out += [w for n in names for w in n.lower().split() if w not in own and w not in tx.QUALIFIERS]
    return sorted(set(out))


def chosen_basis(name: Column, analyte_id: Column, matched_id: Column, matched_basis: Column) -> Column:
    """Basis of a value whose analyte a reviewer chose: that of the name's own match, else by its words."""
    has_alternate = analyte_id.isin(list(d.ALTERNATE_MASS_FACTOR))
    uses = F.arrays_overlap(tx.loose_words(name), F.array(*map(F.lit, alternate_only_words())))
    return (F.when(analyte_id.eqNullSafe(matched_id), matched_basis).when(has_alternate & uses, "alternate")
            .otherwise("primary"))


def convert(rows: DataFrame) -> DataFrame:
    """Add value_number, comparator, canonical_value, canonical_unit, status and status_reason.

    Needs analyte_id, basis and candidates. The first listed conversion with an equal unit key counts. An
    eGFR value is never taken from the report; it waits for ``recompute_egfr``.
    """
    spark = rows.sparkSession
    units = (dim.unit_conversions(spark).select("analyte_id", tx.unit_key(F.col("unit")).alias("_unit"), "unit_order",
                                                "factor", "offset")
             .groupBy("analyte_id", "_unit").agg(F.min_by(F.struct("factor", "offset"), "unit_order").alias("_conv")))
    info = dim.analytes(spark).select("analyte_id", F.col("analyte_name"), F.col("unit").alias("canonical_unit"))
    unit = F.coalesce("unit_text", F.lit(""))
    r = (rows.withColumn("value_number", tx.value_number(F.col("value_text")))
         .withColumn("comparator", tx.value_comparator(F.col("value_text")))
         .withColumn("_unit", tx.unit_key(unit))
         .join(F.broadcast(units), ["analyte_id", "_unit"], "left").join(info, "analyte_id", "left"))
    mass = ~F.col("_unit").contains("mol")
    factor = F.lit(1.0)
    for aid, f in d.ALTERNATE_MASS_FACTOR.items():
        factor = F.when((F.col("analyte_id") == aid) & (F.col("basis") == "alternate") & mass, f).otherwise(factor)
    value = F.round((F.col("value_number") * F.col("_conv.factor") + F.col("_conv.offset")) * factor, 6)
    tracked = F.col("analyte_id").isNotNull()
    no_unit = F.trim(unit) == ""
    reasons = [
        (~tracked & (F.size("candidates") > 1), "needs_review",
         F.concat(F.lit("test name matches more than one test: "), F.array_join("candidates", ", "))),
        (~tracked, "not_tracked", F.lit("test is not in the dictionary")),
        (F.col("value_number").isNull(), "needs_review",
         F.concat(F.lit("value '"), F.coalesce("value_text", F.lit("")), F.lit("' is not a number"))),
        (F.col("analyte_id") == "egfr", "needs_review", F.lit("eGFR not computed yet")),
        (no_unit, "needs_review", F.concat(F.lit("no unit printed for "), "analyte_name")),
        (F.col("_conv").isNull(), "needs_review",
         F.concat(F.lit("unit '"), unit, F.lit("' is not a known unit for "), "analyte_name")),
        (F.col("comparator").isNotNull(), "extracted", F.concat(F.lit("value is censored ("), "comparator", F.lit(")"))),
    ]
    outcome = F.struct(F.lit("extracted").alias("status"), F.lit("").alias("reason"))
    for condition, status, reason in reversed(reasons):
        outcome = F.when(condition, F.struct(F.lit(status).alias("status"), reason.alias("reason"))).otherwise(outcome)
    return (r.withColumn("_outcome", outcome).withColumn("status", F.col("_outcome.status"))
            .withColumn("status_reason", F.col("_outcome.reason"))
            .withColumn("canonical_value", F.when(F.col("status") == "extracted", value))
            .drop("_outcome", "_conv", "_unit", "analyte_name"))


def not_a_result(rows: DataFrame) -> Column:
    """An unknown name without unit and range is not a lab result."""
    has_range = F.trim(F.coalesce("range_text", F.lit(""))) != ""
    if "range_lines" in rows.columns:
        has_range = has_range | F.exists(F.coalesce("range_lines", F.array().cast("array<string>")),
                                         lambda t: F.trim(t) != "")
    return (F.col("status") == "not_tracked") & (F.trim(F.coalesce("unit_text", F.lit(""))) == "") & ~has_range


def split_results(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, skipped), the latter with the reason."""
    junk = not_a_result(rows)
    return rows.filter(~junk), rows.filter(junk).withColumn("status_reason", F.lit(NOT_A_RESULT))


def recompute_egfr(rows: DataFrame, reports: DataFrame, patients: DataFrame) -> DataFrame:
    """Set every eGFR row from the report's creatinine, or say why it cannot be computed.

    A confirmed eGFR goes back to extracted, as its creatinine may have changed.
    """
    usable = ((F.col("analyte_id") == "creatinine") & F.col("canonical_value").isNotNull() & F.col("report_id").isNotNull()
              & F.col("status").isin("extracted", "confirmed"))
    # A window over the report, which holds as many rows as are printed on its pages: a join of the rows with themselves would work them out twice.
    report, value = Window.partitionBy("report_id"), F.when(usable, F.col("canonical_value"))
    creatinine = {"_c_lo": F.min(value).over(report), "_c_hi": F.max(value).over(report),
                  "_c": F.min_by(F.struct("canonical_value", "comparator"), F.when(usable, F.struct("page", "line", "observation_id"))).over(report)}
    who = reports.select("report_id", "patient_id", F.col("collected_at").alias("_date")).join(
        patients.select("patient_id", F.col("sex").alias("_sex"), F.col("birth_year").alias("_born")), "patient_id",
        "left").drop("patient_id")
    r = rows.withColumns(creatinine).join(who, "report_id", "left")
    age = F.year("_date") - F.col("_born")
    low, high = d.ADULT_AGE
    value = F.round(num.ckd_epi_2021(F.col("_c.canonical_value"), age, F.col("_sex")), 2)
    refusals = [
        (F.col("_c").isNull(), F.lit("eGFR is recomputed from creatinine, but this report has no usable creatinine")),
        (F.col("_c_lo") != F.col("_c_hi"),
         F.lit("report has more than one creatinine value; cannot tell which one eGFR uses")),
        (F.col("_date").isNull(), F.lit("report date needed to compute age for eGFR")),
        (~F.coalesce(F.col("_sex").isin("male", "female"), F.lit(False)), F.lit("patient sex needed for eGFR")),
        (F.col("_c.comparator").isNotNull(), F.lit("creatinine is censored; eGFR cannot be computed")),
        (F.col("_c.canonical_value") <= 0, F.lit("creatinine must be above 0 to compute eGFR")),
        (~F.coalesce(age.between(low, high), F.lit(False)), F.concat(
            F.lit("age "), age.cast("string"), F.lit(f" at the report date is outside {low}-{high}"))),
    ]
    refusal = F.lit(None).cast("string")
    for condition, reason in reversed(refusals):
        refusal = F.when(condition, reason).otherwise(refusal)
    done = F.concat(F.lit("recomputed with CKD-EPI 2021 from creatinine "),
                    tx.short_number(F.col("_c.canonical_value"), 6), F.lit(" mg/dL, age "), age.cast("string"),
                    F.lit(", "), "_sex")
    mine = (F.col("analyte_id") == "egfr") & (F.col("status") != "rejected")
    mine = F.coalesce(mine, F.lit(False))
    unit = next(r[3] for r in d.table(d.ANALYTES) if r[0] == "egfr")
    return (r.withColumn("_refusal", F.when(mine, refusal))
            .withColumn("canonical_value", F.when(mine, F.when(F.col("_refusal").isNull(), value))
                        .otherwise(F.col("canonical_value")))
            .withColumn("canonical_unit", F.when(mine, unit).otherwise(F.col("canonical_unit")))
            .withColumn("comparator", F.when(~mine, F.col("comparator")))
            .withColumn("status_reason", F.when(mine, F.coalesce("_refusal", done)).otherwise(F.col("status_reason")))
            .withColumn("status", F.when(mine & F.col("_refusal").isNotNull(), "needs_review").when(mine, "extracted")
                        .otherwise(F.col("status")))
            .drop("_refusal", "_c", "_c_lo", "_c_hi", "_date", "_sex", "_born"))


def normalise(printed: DataFrame, reports: DataFrame, patients: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Printed rows to (observations, skipped rows)."""
    observations, skipped = split_results(convert(match_names(printed)))
    return recompute_egfr(observations, reports, patients), skipped


def with_reference_range(rows: DataFrame) -> DataFrame:
    """Add the range for the patient's sex, the H/L flag and the value's class. Needs analyte_id, sex, value."""
    r = rows.join(dim.reference_ranges(rows.sparkSession), ["analyte_id", "sex"], "left")
    v, lo, hi = F.col("value"), F.col("range_low"), F.col("range_high")
    return (r.withColumn("range_flag", num.range_flag(v, lo, hi))
            .withColumn("value_class", num.value_class(v, lo, hi, F.col("extreme_low"), F.col("extreme_high"))))


def to_printed_unit(rows: DataFrame, unit: str = "unit_text") -> DataFrame:
    """The canonical value as it would be printed in a unit: the inverse conversion."""
    units = dim.unit_conversions(rows.sparkSession).select("analyte_id", F.col("unit").alias(unit), "factor", "offset")
    factor = F.lit(1.0)
    for aid, f in d.ALTERNATE_MASS_FACTOR.items():
        molar = tx.unit_key(F.col(unit)).contains("mol")
        factor = F.when((F.col("analyte_id") == aid) & (F.col("basis") == "alternate") & ~molar, f).otherwise(factor)
    return (rows.join(units, ["analyte_id", unit], "left")
            .withColumn("printed_value", (F.col("canonical_value") / factor - F.col("offset")) / F.col("factor"))
            .drop("factor", "offset"))


STATUSES = ["extracted", "needs_review", "not_tracked", "confirmed", "rejected"]


def status_counts(observations: DataFrame, skipped: DataFrame) -> DataFrame:
    """Observations of each report by status, and its skipped lines; a report with skipped lines only has its row, too."""
    rows = observations.select("report_id", "status").unionByName(skipped.select("report_id", F.lit("skipped").alias("status")))
    return rows.groupBy("report_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in [*STATUSES, "skipped"]])


def printed_status_counts(printed: DataFrame, reports: DataFrame, patients: DataFrame) -> DataFrame:
    """:func:`status_counts` of :func:`normalise` in one pass over printed rows. No skipped row has an analyte, so the eGFR is the same beside them.

    Skipped lines are counted before reports are joined: of a report that is listed twice, observations count twice and skipped lines once."""
    rows = convert(match_names(printed))
    rows = rows.withColumn("_skipped", not_a_result(rows)).withColumn("_n", F.count_if("_skipped").over(Window.partitionBy("report_id")))
    kept = ~F.col("_skipped")
    return recompute_egfr(rows, reports, patients).groupBy("report_id").agg(
        *[F.count_if(kept & (F.col("status") == s)).alias(s) for s in STATUSES], F.coalesce(F.max("_n"), F.lit(0)).alias("skipped"))
