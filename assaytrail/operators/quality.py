"""Data-quality checks of labelled rows and accuracy of taggers and of the whole pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as num
from ..functions import text as tx
from ..sources import dictionary as d
from ..sources import dimensions as dim
from .normalise import with_reference_range

KINDS = ["TEST", "VALUE", "UNIT", "RANGE", "FLAG"]
TAGS = ["O"] + [f"{b}-{k}" for k in KINDS for b in ("B", "I")]
REL_TOLERANCE = 1e-6


def _kind(tag):
    """What follows B- or I-."""
    return F.substring(tag, F.lit(3), F.length(tag))


def bad_tags(rows: DataFrame) -> DataFrame:
    """Rows whose tags are not one per token, or where I-X does not follow X."""
    before = F.concat(F.array(F.lit("O")), F.slice("tags", F.lit(1), F.greatest(F.size("tags") - 1, F.lit(0))))
    pairs = F.arrays_zip(F.col("tags").alias("t"), before.alias("b"))
    broken = F.exists(pairs, lambda p: ~p["t"].isin(TAGS) | (p["t"].startswith("I-") & (
        _kind(p["t"]) != _kind(p["b"]))))
    return rows.filter((F.size("tokens") != F.size("tags")) | broken)


def rows_per_analyte(rows: DataFrame, minimum: int = 300) -> DataFrame:
    counts = rows.filter(F.col("analyte_id").isNotNull()).groupBy("analyte_id").agg(F.count(F.lit(1)).alias("n"))
    return (dim.analytes(rows.sparkSession).select("analyte_id").join(counts, "analyte_id", "left")
            .withColumn("n", F.coalesce("n", F.lit(0).cast("bigint"))).withColumn("enough", F.col("n") >= minimum))


def coverage(wanted: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted values (names, units, formats) never used, or used only outside the training split."""
    used = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "train").alias("n_train"))
    return (wanted.join(used, keys, "left").filter(F.coalesce("n_train", F.lit(0)) == 0)
            .withColumn("gap", F.when(F.col("n").isNull(), "never used").otherwise("not in train"))
            .select(*keys, "gap"))


def differing_rows(rows: DataFrame, reread: DataFrame, keys: list[str], content: str = "tokens", bucket_rows: int = 4096) -> DataFrame:
    """(keys, first, second, change) of the rows whose content differs from a second reading of the same place, or that one side lacks.

    Both sides are reduced to one checksum for each bucket of keys by partial aggregation; only rows of buckets whose checksums differ are
    joined. Keys and contents may be null. Keys identify a row; repeated ones are compared by the smallest content each side has there.
    """
    buckets = max(16, rows.count() // bucket_rows)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets))

    def sums(side: DataFrame, name: str) -> DataFrame:
        whole = F.xxhash64(*keys, content)
        return side.groupBy(bucket.alias("_bucket")).agg(F.struct(
            F.count(F.lit(1)), F.bit_xor(whole), F.sum(whole.cast("decimal(38,0)"))).alias(name))

    differ = sums(rows, "_a").join(sums(reread, "_b"), "_bucket", "full").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("_bucket")

    def inside(side: DataFrame, name: str) -> DataFrame:
        near = side.withColumn("_bucket", bucket).join(differ, "_bucket", "left_semi")
        return near.groupBy(*[F.col(k).alias(f"_{name}_{k}") for k in keys]).agg(F.min(F.struct(F.col(content).alias("c"))).alias(f"_{name}"))

    same = [F.col(f"_first_{k}").eqNullSafe(F.col(f"_second_{k}")) for k in keys]
    both = inside(rows, "first").join(inside(reread, "second"), same, "full")
    change = F.when(F.col("_second").isNull(), "missing").when(F.col("_first").isNull(), "extra").otherwise("changed")
    return both.filter(~F.col("_first").eqNullSafe(F.col("_second"))).select(
        *[F.when(F.col("_first").isNotNull(), F.col(f"_first_{k}")).otherwise(F.col(f"_second_{k}")).alias(k) for k in keys],
        F.col("_first.c").alias("first"), F.col("_second.c").alias("second"), change.alias("change"))


def entity_text(tokens: Column, tags: Column, kind: str) -> Column:
    pairs = F.filter(F.arrays_zip(tokens.alias("w"), tags.alias("t")), lambda p: p["t"].endswith("-" + kind))
    return F.array_join(F.transform(pairs, lambda p: p["w"]), " ")


def field_mismatches(rows: DataFrame) -> DataFrame:
    """(row, kind) where the tagged words do not spell the printed field."""
    fields = F.array(*[F.struct(F.lit(k).alias("kind"), entity_text(F.col("tokens"), F.col("tags"), k).alias("got"),
                                F.col(f"truth.{k.lower()}").alias("want")) for k in KINDS])
    return (rows.filter(F.col("truth").isNotNull()).select("report_id", "page", "row", F.explode(fields).alias("f"))
            .select("report_id", "page", "row", "f.*").filter(~F.col("got").eqNullSafe(F.col("want"))))


def value_mismatches(rows: DataFrame) -> DataFrame:
    """Printed values that do not convert back to the stored canonical value."""
    units = dim.unit_conversions(rows.sparkSession).select("analyte_id", F.col("unit").alias("unit_key"), "factor", "offset")
    r = rows.filter(F.col("analyte_id").isNotNull()).select(
        "report_id", "page", "row", "analyte_id", "canonical_value", F.col("truth.value").alias("value"),
        F.col("truth.unit_key").alias("unit_key"), F.col("truth.basis").alias("basis"))
    basis = F.lit(1.0)
    for aid, f in d.ALTERNATE_MASS_FACTOR.items():
        basis = F.when((F.col("analyte_id") == aid) & (F.col("basis") == "alternate")
                       & ~F.lower("unit_key").contains("mol"), f).otherwise(basis)
    got = (tx.value_number(F.col("value")) * F.col("factor") + F.col("offset")) * basis
    bad = F.abs(got - F.col("canonical_value")) > REL_TOLERANCE * F.greatest(F.lit(1.0), F.abs(got))
    return r.join(units, ["analyte_id", "unit_key"], "left").withColumn("got", got).filter(F.coalesce(bad, F.lit(True)))


def flag_mismatches(rows: DataFrame) -> DataFrame:
    """Rows whose printed H/L flag or abnormal mark disagrees with value and range."""
    r = rows.filter(F.col("truth").isNotNull() & F.col("analyte_id").isNotNull()).select(
        "report_id", "page", "row", "analyte_id", F.col("canonical_value").alias("value"), F.col("truth.sex").alias("sex"),
        F.col("truth.abnormal").alias("abnormal"), F.col("truth.flag").alias("flag"),
        F.col("truth.flag_column").alias("flag_column"))
    direction = F.upper(F.substring(F.regexp_replace("flag", r"[^A-Za-z]", ""), 1, 1))
    checked = with_reference_range(r)
    return checked.filter((F.col("abnormal") != (F.col("range_flag") != ""))
                          | (F.col("flag_column") & (direction != F.col("range_flag"))))


def clinical_conflicts(results: DataFrame) -> DataFrame:
    """Reports whose results contradict each other. ``results``: report_id, analyte_id, value, age, sex.

    HbA1c under 5.7 with fasting glucose over 200; eGFR off by more than 1 from its creatinine.
    """
    def of(a: str) -> Column:
        return F.max(F.when(F.col("analyte_id") == a, F.col("value")))

    r = results.groupBy("report_id").agg(of("hba1c").alias("hba1c"), of("fasting_glucose").alias("fpg"),
                                         of("creatinine").alias("creatinine"), of("egfr").alias("egfr"),
                                         F.max("age").alias("age"), F.max("sex").alias("sex"))
    want = num.ckd_epi_2021(F.col("creatinine"), F.col("age"), F.col("sex"))
    problem = (F.when((F.col("hba1c") < 5.7) & (F.col("fpg") > 200), "HbA1c and fasting glucose")
               .when(F.col("egfr").isNotNull() & F.col("creatinine").isNull(), "eGFR without creatinine")
               .when(F.abs(F.col("egfr") - want) > 1, "eGFR and creatinine"))
    return r.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def value_mix(results: DataFrame) -> DataFrame:
    """Share of normal, abnormal and extreme values against the target mix. Needs analyte_id, sex, value."""
    classes = with_reference_range(results).groupBy("value_class").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))           # over the three classes
    target = F.lit(None).cast("double")
    for name, share in d.VALUE_MIX_TARGET.items():
        target = F.when(F.col("value_class") == name, share).otherwise(target)
    return (classes.withColumn("share", F.col("n") / total)
            .withColumn("near_target", F.abs(F.col("share") - target) <= d.VALUE_MIX_TOLERANCE))


def non_dictionary_share(rows: DataFrame) -> DataFrame:
    """Share of tests outside the dictionary by panel. Needs panel, analyte_id."""
    return rows.groupBy("panel").agg(F.count(F.lit(1)).alias("n"), (
        F.count_if(F.col("analyte_id").isNull()) / F.count(F.lit(1))).alias("share"))


def split_problems(rows: DataFrame, held_out: DataFrame) -> DataFrame:
    """Reports in two splits, held-out families outside test, other families inside test."""
    multi = (rows.groupBy("report_id").agg(F.min("split").alias("a"), F.max("split").alias("b"))
             .filter(F.col("a") != F.col("b")).select(F.lit("report in two splits").alias("problem"),
                                                      F.col("report_id").cast("string").alias("item")))
    families = rows.select("split", "layout_family").distinct()
    held = held_out.select("layout_family").distinct().withColumn("_held", F.lit(True))
    marked = families.join(F.broadcast(held), "layout_family", "left")
    leak = marked.filter(F.col("_held") & (F.col("split") != "test")).select(
        F.lit("held-out family outside test").alias("problem"), F.col("layout_family").alias("item"))
    extra = marked.filter(F.col("_held").isNull() & (F.col("split") == "test")).select(
        F.lit("other family in test").alias("problem"), F.col("layout_family").alias("item"))
    return multi.unionByName(leak).unionByName(extra)


def share_threshold(ids: DataFrame, key: Column, id_column: str, share: float, ranked: int = 1 << 20) -> tuple[str, object] | None:
    """(key, id) of the last of the first ``share`` of distinct ids in the order of (key, id); None: none is in it.

    ``key`` is a text of hexadecimal digits. Rows are counted by its first digits, digit by digit where the border lies, until the border's
    group has at most ``ranked`` rows (or the key has no more digits); only that group is ordered.
    """
    rows = ids.select(F.col(id_column).alias("i")).distinct().select(key.alias("k"), "i")
    wanted = int(rows.count() * share + 0.5)
    if not wanted:
        return None
    prefix, size = "", 3
    while True:
        group = F.substring("k", 1, size)
        inside = rows.filter(F.col("k").startswith(prefix)) if prefix else rows
        counts = sorted((r.g, r.n) for r in inside.groupBy(group.alias("g")).agg(F.count(F.lit(1)).alias("n")).collect())   # at most 16**3
        for prefix, n in counts:
            if n >= wanted:
                break
            wanted -= n
        if n <= ranked or size >= 32:
            last = rows.filter(F.col("k").startswith(prefix)).orderBy("k", "i").limit(wanted).agg(F.max(F.struct("k", "i")).alias("m")).first().m
            return last.k, last.i
        size += 3


def assign_splits(reports: DataFrame, held_out: list[str], seed: int = 7, val_share: float = 0.1) -> DataFrame:
    """Held-out families to test; of the other reports exactly ``val_share`` (rounded) to val, the rest to train.

    Reports are taken in the order of a hash of seed and id. Only the border is looked for; no row is moved."""
    key = lambda c: F.md5(F.concat(F.lit(f"{seed}:"), F.col(c).cast("string")).cast("binary"))
    held = F.col("layout_family").isin(held_out)
    border = share_threshold(reports.filter(~held | F.col("layout_family").isNull()), key("i"), "report_id", val_share)
    inside = F.lit(False) if border is None else F.struct(key("report_id").alias("k"), F.col("report_id").alias("i")) <= F.struct(
        F.lit(border[0]).alias("k"), F.lit(border[1]).alias("i"))
    return reports.withColumn("split", F.when(held, "test").when(inside, "val").otherwise("train"))


def forbidden_phrases(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, phrase, n) for every lab brand found in a text, without case."""
    hits = texts.select(*keys, F.explode(F.transform(tx.matches(F.col(text), tx.brand_pattern()), F.lower)).alias("phrase"))
    return hits.groupBy(*keys, "phrase").agg(F.count(F.lit(1)).alias("n"))


def missing_inputs(printed: DataFrame) -> DataFrame:
    """Calculated tests printed without an input. ``printed``: report_id, panel, test_id."""
    need = printed.join(dim.required_inputs(printed.sparkSession), "test_id").select(
        "report_id", "panel", "test_id", "needed_id").distinct()
    have = printed.select("report_id", "panel", F.col("test_id").alias("needed_id")).distinct()
    return need.join(have, ["report_id", "panel", "needed_id"], "left_anti")


def bad_differentials(printed: DataFrame) -> DataFrame:
    """White-cell differentials that are incomplete or do not sum to 100. Needs value."""
    parts = printed.filter(F.col("test_id").isin(d.DIFFERENTIAL)).groupBy("report_id", "panel").agg(
        F.count_distinct("test_id").alias("n_parts"), F.sum("value").alias("total"))
    return parts.filter((F.col("n_parts") != len(d.DIFFERENTIAL)) | (F.col("total") != 100))


def spans_of(tags: str) -> Column:
    """Strict IOB2 spans of a tag array as an array of (kind, first, last).

    A span starts at B-X and goes on over I-X; an I-X without its B-X belongs to none.
    """
    tags = F.col(tags)
    n = F.size(tags)

    def end_of(i: Column) -> Column:
        kind = _kind(F.element_at(tags, i))
        rest = F.slice(tags, i + 1, n)
        stops = F.transform(F.array(F.concat(F.lit("I-"), kind)), lambda more: F.array_position(F.transform(rest, lambda t: t != more), True))
        return F.coalesce(i + F.nullif(stops[0].cast("int"), F.lit(0)) - 1, n)

    at = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.coalesce(F.try_element_at(tags, i).startswith("B-"), F.lit(False)))
    return F.transform(at, lambda i: F.struct(_kind(F.element_at(tags, i)).alias("kind"), i.alias("first"), end_of(i).alias("last")))


def entities(rows: DataFrame, tags: str, keys: list[str]) -> DataFrame:
    """One row (kind, first, last) per span of a tag array."""
    return rows.filter(F.size(tags) > 0).select(*keys, F.explode(spans_of(tags)).alias("s")).select(*keys, "s.*")


def entity_scores(rows: DataFrame, groupings: list[list[str]]) -> DataFrame:
    """Precision, recall and F1 per kind and overall for each of the ``groupings`` (lists of columns; [] is all rows). Needs tags (gold) and predicted.

    Gold and predicted spans stand in one row, so they are compared there; what is shuffled are counts by group. Columns that are not
    in a grouping are null; ``grouping_id`` tells groupings from null values, if there are several.
    """
    columns = list(dict.fromkeys(c for g in groupings for c in g))
    # Each B-X starts a span, so spans are counted by their first tags; they are worked out only where the two sides differ.
    same = F.coalesce(F.col("tags") == F.col("predicted"), F.lit(False))
    hits = F.when(~same, F.transform(F.array_intersect(spans_of("tags"), spans_of("predicted")), lambda s: F.concat(F.lit("B-"), s["kind"])))
    starts = lambda tags: F.filter(tags, lambda t: t.startswith("B-"))
    spans = rows.select(*columns, starts("tags").alias("_gold"), starts("predicted").alias("_found"), hits.alias("_hits"))
    spans = spans.withColumn("_hits", F.coalesce("_hits", "_gold"))

    def of(name: str, kind: str) -> Column:
        return F.sum(F.coalesce(F.size(name) - F.size(F.array_remove(name, f"B-{kind}")), F.lit(0))).alias(f"{name}_{kind}")

    sums = [of(name, kind) for name in ("_gold", "_found", "_hits") for kind in KINDS]
    if len(groupings) == 1:
        counted = spans.groupBy(*groupings[0]).agg(*sums)
        marks = []
    else:
        counted, marks = spans.groupingSets([[F.col(c) for c in g] for g in groupings], *columns).agg(*sums, F.grouping_id().alias("grouping_id")), ["grouping_id"]
    total = lambda name: sum(F.col(f"{name}_{k}") for k in KINDS)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), *[F.col(f"{name}_{k}").alias(out) for name, out in (("_gold", "support"), ("_found", "found"), ("_hits", "hits"))])
                      for k in KINDS], F.struct(F.lit("overall").alias("kind"), total("_gold").alias("support"), total("_found").alias("found"), total("_hits").alias("hits")))
    out = counted.select(*columns, *marks, F.inline(kinds)).filter((F.col("support") > 0) | (F.col("found") > 0))
    precision = F.coalesce(F.col("hits") / F.nullif("found", F.lit(0)), F.lit(0.0))
    recall = F.coalesce(F.col("hits") / F.nullif("support", F.lit(0)), F.lit(0.0))
    f1 = F.coalesce(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)), F.lit(0.0))
    return out.select(*columns, *marks, "kind", "support", F.round(precision, 5).alias("precision"), F.round(recall, 5).alias("recall"),
                      F.round(f1, 5).alias("f1"))


def row_scores(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Rows tagged entirely right, and rows whose value text is exactly the printed one."""
    same = F.col("tags") == F.col("predicted")
    exact = entity_text(F.col("tokens"), F.col("predicted"), "VALUE") == F.col("truth_value")
    return rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(same.cast("double")), 5).alias(
        "row_accuracy"), F.round(F.avg(F.when(F.col("truth_value").isNotNull(), exact.cast("double"))), 5).alias(
        "exact_value_accuracy"))


def error_sample(rows: DataFrame, per_report: int = 2, limit: int = 10) -> DataFrame:
    """Wrongly tagged rows for reading: at most two of a report, ten in all."""
    w = Window.partitionBy("report_id").orderBy("row_id")
    wrong = rows.filter(F.col("tags") != F.col("predicted")).withColumn("rank", F.row_number().over(w))
    return wrong.filter(F.col("rank") <= per_report).orderBy("report_id", "row_id").limit(limit).drop("rank")


def pipeline_causes(truth: DataFrame, observations: DataFrame, skipped: DataFrame,
                    continuation: DataFrame | None = None) -> DataFrame:
    """Every printed dictionary test with ``cause``: "correct" or why its observation is not.

    ``truth``: report_id, page, line, analyte_id, canonical_value, value_text, unit_text.
    """
    place = ["report_id", "page", "line"]
    got = observations.select(*place, F.struct("analyte_id", "canonical_value", "status", "status_reason", "value_text",
                                               "unit_text", "test_text").alias("o"))
    out = truth.join(got, place, "left").join(skipped.select(*place, F.col("reason").alias("skip_reason")), place, "left")
    if continuation is None:
        out = out.withColumn("continued", F.lit(False))
    else:
        out = out.join(continuation.select(*place, F.lit(True).alias("continued")), place, "left")
    c = F.col
    tolerance = F.when(c("analyte_id") == "egfr", 1.0).otherwise(
        REL_TOLERANCE * F.greatest(F.lit(1.0), F.abs("canonical_value")))
    right = (c("o.analyte_id") == c("analyte_id")) & (F.abs(c("o.canonical_value") - c("canonical_value")) <= tolerance)
    cause = (F.when(F.coalesce(right, F.lit(False)), "correct")
             .when(c("o").isNull() & c("skip_reason").isNotNull(), F.concat(F.lit("skipped: "), "skip_reason"))
             .when(c("o").isNull() & F.coalesce("continued", F.lit(False)), "attached to the result above")
             .when(c("o").isNull(), "not a result")
             .when(c("o.analyte_id").isNull() & (c("o.status") == "needs_review"), "name matches two analytes")
             .when(c("o.analyte_id").isNull(), "name not matched")
             .when(c("o.analyte_id") != c("analyte_id"), "wrong analyte")
             .when(c("o.status") == "needs_review", F.concat(
                 F.lit("needs review: "), F.substring_index(c("o.status_reason"), " for ", 1)))
             .when(c("o.value_text") != c("value_text"), "value text differs")
             .when(c("o.unit_text") != c("unit_text"), "unit text differs").otherwise("canonical value differs"))
    return out.withColumn("cause", cause)


def cause_histogram(causes: DataFrame) -> DataFrame:
    return causes.groupBy("cause").agg(F.count(F.lit(1)).alias("n"))


def spurious(observations: DataFrame, truth: DataFrame) -> DataFrame:
    """Tracked observations at a place where no dictionary test was printed."""
    return observations.filter(F.col("analyte_id").isNotNull()).join(
        truth.select("report_id", "page", "line"), ["report_id", "page", "line"], "left_anti")


def header_scores(reports: DataFrame, truth: DataFrame) -> DataFrame:
    """Over all reports: how many there are, and of how many the date and the lab read are those of ``truth`` (report_id, collected_at, lab);
    one row for each label that the date was found by. A report that was not read counts as wrong under no label."""
    read = reports.select("report_id", "date_label", F.struct("collected_at", "lab").alias("_read"))
    both = truth.select("report_id", F.col("collected_at").alias("_date"), F.col("lab").alias("_lab")).join(read, "report_id", "left")
    found = F.col("_read").isNotNull()
    return both.groupBy("date_label").agg(
        F.count(F.lit(1)).alias("reports"), F.count_if(found & F.col("_read.collected_at").eqNullSafe(F.col("_date"))).alias("date_correct"),
        F.count_if(found & F.col("_read.lab").eqNullSafe(F.col("_lab"))).alias("lab_correct"))
