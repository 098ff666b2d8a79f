"""Report date and lab name from the printed lines of every document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- Fixed values: date forms (day first), labels and the words of a lab name ----------------------------------
ISO = r"\d{4}-\d{2}-\d{2}"
NUMERIC = r"\d{1,2}[/.\-]\d{1,2}[/.\-](?:\d{4}(?!:)|\d{2})(?!\d{1,2}[/.\-])"
TEXTUAL = r"\d{1,2}[\s/.\-]*[A-Za-z]{3,9}[\s/.,\-]*(?:\d{4}(?!:)|\d{2})"
DATE = f"(?:{ISO}|{NUMERIC}|{TEXTUAL})"
JOINING = r"(?:\s*(?:on|date|dt|and|time|at|received|recd|&|/))*"
LABELS = {"Collected": rf"(?i)\b(?:sample\s+)?(?:collect(?:ed|ion)|coll\.?){JOINING}\s*:?[\s:]*",
          "Reported": rf"(?i)\breport(?:ed|ing)?{JOINING}\s*:?[\s:]*"}
EARLIEST_YEAR = 1950
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
LAB_SUFFIX = (r"^(?i)(diagnostics?|labs?|laborator(y|ies)|pathology|path|healthcare|clinic|hospital|polyclinic|"
              r"imaging|scans?)$")
LAB_TAIL = r"^(?i)(centre|center|services|lab|labs|laboratory|pvt\.?|private|ltd\.?|limited|llp)$"
LAB_STOP = (r"^(?i)(sample|processed|at|collected|collection|report|reported|patient|name|ref|referred|by|dr\.?|"
            r"tel|phone|no|id|sid|age|sex|investigation|final|test|lab|director|the|of|and|&|"
            r"mr|mrs|ms|miss|master|baby|male|female|m|f|y|yrs|years)\.?$")
FIELD_WORD = r"^(?i)(no|id|code|ref|number|num|#)\.?:?$"
# A lab name has at most so many words before and after its suffix and stands in the first lines of a document.
NAME_WORDS, TAIL_WORDS, HEAD_LINES = 4, 3, 15


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that it names several times; the value is worked out once, also inside a lambda, where no column can be added."""
    return F.element_at(F.transform(F.array(value), use), 1)


def parse_date(text: Column, as_of: str) -> Column:
    """The date a text starts with, or null when it is no calendar date or not plausible at ``as_of``."""
    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(text, "^" + pattern, group).try_cast("int")

    numeric = r"(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4}(?!:)|\d{2})"
    textual = r"(\d{1,2})[\s/.\-]*([A-Za-z]{3})[A-Za-z]{0,6}[\s/.,\-]*(\d{4}(?!:)|\d{2})"
    iso = r"(\d{4})-(\d{2})-(\d{2})"
    month_name = F.lower(F.regexp_extract(text, "^" + textual, 2))
    is_iso, is_num = text.rlike("^" + ISO), text.rlike("^" + NUMERIC)
    first, second = part(numeric, 1), part(numeric, 2)
    swapped = second > 12
    month_no = F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), month_name).cast("int"), F.lit(0))
    day = F.when(is_iso, part(iso, 3)).when(is_num, F.when(swapped, second).otherwise(first)).otherwise(part(textual, 1))
    month = F.when(is_iso, part(iso, 2)).when(is_num, F.when(swapped, first).otherwise(second)).otherwise(month_no)
    short = F.when(is_num, part(numeric, 3)).otherwise(part(textual, 3))
    year = F.when(is_iso, part(iso, 1)).when(short < 100, short + 2000).otherwise(short)

    def date_of(p: Column) -> Column:
        date = F.try_to_timestamp(F.format_string("%04d-%02d-%02d", p["y"], p["m"], p["d"]), F.lit("yyyy-MM-dd")).cast("date")
        return F.when(p["y"].isNotNull() & p["m"].isNotNull() & p["d"].isNotNull(), date)

    return _once(_once(F.struct(year.alias("y"), month.alias("m"), day.alias("d")), date_of), lambda date: F.when(
        (F.year(date) >= EARLIEST_YEAR) & (date <= F.lit(as_of).cast("date")), date))


def labelled_dates(lines: DataFrame, as_of: str) -> DataFrame:
    """Collected and reported date per document, and the one that counts with its label."""
    place = F.struct("page", "line")

    def first_date(label: str) -> Column:
        found = F.regexp_extract_all("text", F.lit(f"{LABELS[label]}({DATE})"), 1)
        return F.try_element_at(F.filter(F.transform(found, lambda t: parse_date(t, as_of)),
                                         lambda x: x.isNotNull()), F.lit(1))

    hits = lines.withColumn("_c", first_date("Collected")).withColumn("_r", first_date("Reported"))
    per_doc = hits.groupBy("doc_id").agg(
        F.min_by("_c", F.when(F.col("_c").isNotNull(), place)).alias("collected_at"),
        F.min_by("_r", F.when(F.col("_r").isNotNull(), place)).alias("reported_at"))
    return (per_doc.withColumn("report_date", F.coalesce("collected_at", "reported_at"))
            .withColumn("date_label", F.when(F.col("collected_at").isNotNull(), "Collected")
                        .when(F.col("reported_at").isNotNull(), "Reported")))


def lab_in_line(text: Column, name_words: int = NAME_WORDS, tail_words: int = TAIL_WORDS) -> Column:
    """First "<Name> Diagnostics/Labs/Healthcare ..." phrase of a line; lines naming a doctor have none."""
    words = F.filter(F.transform(F.split(text, r"\s+"), lambda t: F.regexp_replace(t, r"^[:(),;]+|[:(),;]+$", "")),
                     lambda t: t != "")

    def leading(items: Column, keep) -> Column:
        """Number of leading items for which ``keep`` holds."""
        stop = F.array_position(F.transform(items, lambda t: ~keep(t)), True).cast("int")
        return F.when(stop == 0, F.size(items)).otherwise(stop - 1)

    def names(t: Column) -> Column:
        return t.rlike(r"^\p{Lu}") & ~t.rlike(LAB_STOP) & ~t.rlike(r"\d")

    def first_name(tokens: Column) -> Column:
        n = F.size(tokens)

        def ends(i: Column) -> Column:
            return F.element_at(tokens, i).rlike(LAB_SUFFIX) & ~F.coalesce(F.try_element_at(tokens, i + 1).rlike(FIELD_WORD), F.lit(False))

        def phrase(i: Column) -> Column:
            size = F.least(i - 1, F.lit(name_words))
            before = F.reverse(F.slice(tokens, i - size, size))
            after = F.slice(tokens, i + 1, F.lit(tail_words))
            tail = leading(after, lambda t: t.rlike(LAB_TAIL))
            return _once(leading(before, names), lambda back: F.when(back > 0, F.array_join(F.slice(tokens, i - back, back + 1 + tail), " ")))

        # Names are looked for around the few words that can end one.
        found = F.filter(F.transform(F.filter(F.sequence(F.lit(2), n), ends), phrase), lambda x: x.isNotNull())
        return F.when(n >= 2, F.try_element_at(found, F.lit(1)))

    return F.when(~text.rlike(r"(?i)\bdr\b\.?"), _once(words, first_name))


def labs(lines: DataFrame, head_lines: int | None = HEAD_LINES, name_words: int = NAME_WORDS, tail_words: int = TAIL_WORDS) -> DataFrame:
    """Lab name per document: from page-header lines when they are marked, else from its first ``head_lines`` lines, counted over
    all pages (None: from all lines). The number of lines of each page is summed up, so lines are counted without ordering them."""
    place = F.struct("page", "line")
    rows = lines if "page_header" in lines.columns else lines.withColumn("page_header", F.lit(False))
    found = rows.withColumn("lab", lab_in_line(F.col("text"), name_words, tail_words)).filter(F.col("lab").isNotNull())
    early = F.lit(True)
    if head_lines is not None:
        before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
        pages = (lines.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("_n"), F.min("line").alias("_first"))
                 .select("doc_id", "page", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
        found = found.join(pages, ["doc_id", "page"])
        early = F.col("_before") + F.col("line") - F.col("_first") < head_lines
    per_doc = found.groupBy("doc_id").agg(F.min_by("lab", F.when(F.col("page_header"), place)).alias("_h"),
                                          F.min_by("lab", F.when(early, place)).alias("_e"))
    return per_doc.select("doc_id", F.coalesce("_h", "_e").alias("lab")).filter(F.col("lab").isNotNull())
