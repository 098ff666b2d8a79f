"""Checks on written texts: numbers, wording, citations, medication rows and structure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources import dictionary as d

SUMMARY = ("key_finding struct<text:string,report_ids:array<string>>, "
           "sections array<struct<title:string,sentences:array<struct<text:string,report_ids:array<string>>>>>, "
           "medication_rows array<struct<date:string,drug:string,dose:string,observed:string>>, "
           "data_notes array<string>")
ANSWER = "answer array<struct<text:string,report_ids:array<string>>>"


def parse(texts: DataFrame, column: str = "content", schema: str = SUMMARY) -> DataFrame:
    """Parsed JSON with an error where the text is not JSON or has not the expected fields, each of its type."""
    parsed = texts.withColumn("parsed", F.from_json(column, f"{schema}, _bad string", {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    required = [c.split(" ")[0] for c in ("key_finding", "sections", "medication_rows", "data_notes")] \
        if schema == SUMMARY else ["answer"]
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(f"parsed.{c}").isNull()
    return parsed.withColumn("error", F.when(F.try_parse_json(column).isNull(), "the answer is not valid JSON")
                             .when(F.col("parsed").isNull() | F.col("parsed._bad").isNotNull() | missing, "the JSON does not match the schema"))


def summary_texts(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, place, text, cited) for every text a summary shows."""
    p = F.col("parsed")
    none = F.lit(None).cast("array<string>")

    def at(place: Column, text: Column, cited: Column) -> Column:
        return F.struct(place.alias("place"), text.alias("text"), cited.alias("cited"))

    def n(i: Column) -> Column:
        return (i + 1).cast("string")

    parts = F.flatten(F.array(
        F.array(at(F.lit("key_finding"), p["key_finding"]["text"], p["key_finding"]["report_ids"])),
        F.transform(p["sections"], lambda s, i: at(F.concat(F.lit("section "), n(i), F.lit(" title")), s["title"], none)),
        F.flatten(F.transform(p["sections"], lambda s, i: F.transform(s["sentences"], lambda x, j: at(
            F.concat(F.lit("section "), n(i), F.lit(" sentence "), n(j)), x["text"], x["report_ids"])))),
        F.flatten(F.transform(p["medication_rows"], lambda r, i: F.array(*[
            at(F.concat(F.lit("medication row "), n(i), F.lit(f" {c}")), r[c], none)
            for c in ("date", "drug", "dose", "observed")]))),
        F.transform(p["data_notes"], lambda t, i: at(F.concat(F.lit("data note "), n(i)), t, none))))
    return parsed.filter(F.col("error").isNull()).select(*keys, F.explode(parts).alias("t")).select(*keys, "t.*")


def _increment(digits: Column) -> Column:
    """The next whole number, as digits: trailing nines become zeros, the digit before them goes up."""
    lead = F.regexp_replace(digits, "9+$", "")
    head, last = F.substring(lead, F.lit(1), F.length(lead) - 1), F.substring(lead, F.length(lead), F.lit(1))
    return F.concat(F.when(lead == "", F.lit("1")).otherwise(F.concat(head, (F.coalesce(last.try_cast("int"), F.lit(0)) + 1).cast("string"))),
                    F.repeat(F.lit("0"), F.length(digits) - F.length(lead)))


def _point(digits: Column, places: Column) -> Column:
    whole = F.length(digits) - places
    return F.when(places == 0, digits).otherwise(
        F.concat(F.substring(digits, F.lit(1), whole), F.lit("."), F.substring(digits, whole + 1, places)))


def roundings(number: Column) -> Column:
    """A number written out and all its roundings to fewer decimals, half up and half to even.

    Rounding works on the digits, so neither the decimals nor the length of a number have a limit.
    """
    plain = normal_form(number)
    whole, decimals = F.substring_index(plain, ".", 1), F.regexp_extract(plain, r"\.(.*)$", 1)
    digits = F.concat(whole, decimals)

    def forms(places: Column) -> Column:
        kept, rest = F.substring(digits, F.lit(1), F.length(whole) + places), F.substring(decimals, places + 1, F.length(decimals))
        down, up = _point(kept, places), _point(_increment(kept), places)
        to_odd = kept.rlike("[13579]$") | ~rest.rlike("^50*$")
        return F.array(F.when(rest.rlike("^[5-9]"), up).otherwise(down), F.when(rest.rlike("^[5-9]") & to_odd, up).otherwise(down))

    return F.array_distinct(F.concat(F.array(plain), F.flatten(F.transform(F.sequence(F.lit(0), F.length(decimals)), forms))))


def rounded_forms(numbers: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Distinct (keys, number): each number as in :func:`roundings`. One row a number of places, so all steps are plain columns of a row,
    each worked out once."""
    rows = numbers.select(*keys, normal_form(F.col(column)).alias("_plain")).distinct()
    rows = rows.select(*keys, F.substring_index("_plain", ".", 1).alias("_whole"), F.regexp_extract("_plain", r"\.(.*)$", 1).alias("_dec"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.length("_dec"))).alias("_places"))
    digits = F.concat("_whole", "_dec")
    rows = rows.select(*keys, "_places", F.substring(digits, F.lit(1), F.length("_whole") + F.col("_places")).alias("_kept"),
                       F.substring(F.col("_dec"), F.col("_places") + 1, F.length("_dec")).alias("_rest"))
    upward = F.col("_rest") >= "5"                                            # a first digit of 5 or more
    rows = rows.select(*keys, "_places", "_kept", F.when(upward, _increment(F.col("_kept"))).alias("_up"),
                       (~upward | (F.col("_rest").rlike("^50*$") & F.col("_kept").rlike("[02468]$"))).alias("_stays"))
    down, up = _point(F.col("_kept"), F.col("_places")), _point(F.col("_up"), F.col("_places"))
    both = F.array_compact(F.array(F.when(F.col("_stays"), down), up))
    return rows.select(*keys, F.explode(both).alias("number")).distinct()


def normal_form(number: Column) -> Column:
    """The number without leading zeros, at its own precision."""
    return F.regexp_replace(number, r"^0+(?=\d)", "")


def number_violations(texts: DataFrame, facts: DataFrame, keys: list[str], text: str = "text",
                      fact: str = "fact") -> DataFrame:
    """Numbers of a text that are no number of its facts, nor a rounding of one.

    Both sides become distinct (key, number) rows and meet in an anti join on the number itself, so a key
    with many texts or facts is spread by number.
    """
    numbers = facts.select(*keys, F.explode(F.array_distinct(tx.numbers_in(F.col(fact)))).alias("_f"))
    allowed = rounded_forms(numbers, keys, "_f")
    said = (texts.withColumn("said", F.explode(F.array_distinct(tx.numbers_in(F.col(text)))))
            .withColumn("number", normal_form(F.col("said"))))
    return said.join(allowed, [*keys, "number"], "left_anti").drop("number")


def wording(texts: DataFrame, text: str = "text", allowed: list[str] = (), causal: bool = True) -> DataFrame:
    """(text row, word) for every banned or causal word left after removing the allowed phrases."""
    clean = tx.without_phrases(F.col(text), list(allowed))
    words = F.concat(tx.matches(clean, d.BANNED_WORDS), tx.matches(clean, d.CAUSAL_WORDS)) if causal else tx.matches(
        clean, d.BANNED_WORDS)
    return texts.withColumn("word", F.explode(words))


def wording_per_patient(texts: DataFrame, phrases: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Like ``wording`` where the allowed phrases (conditions and labs) differ by row: column ``phrases``.

    All phrases of a row are one alternation, the longest first, so a text is read once however many there are; where phrases overlap
    the leftmost, then the longest one is taken out. Phrases are literal (quoted by \\Q..\\E) and have no case.
    """
    kept = F.array_sort(F.array_distinct(F.filter("phrases", lambda p: p.isNotNull() & (p != ""))), lambda a, b: F.length(b) - F.length(a))
    quoted = F.transform(kept, lambda p: F.concat(F.lit(r"\Q"), F.replace(p, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    rows = texts.join(phrases.select(*keys, quoted.alias("_quoted")), keys, "left")
    pattern = F.concat(F.lit("(?i)"), F.array_join("_quoted", "|"))
    clean = F.when(F.size("_quoted") > 0, F.regexp_replace(F.col(text), pattern, F.lit(" "))).otherwise(F.col(text))
    return rows.withColumn("_clean", clean).withColumn("word", F.explode(F.concat(
        tx.matches(F.col("_clean"), d.BANNED_WORDS), tx.matches(F.col("_clean"), d.CAUSAL_WORDS)))).drop("_clean", "_quoted")


def cited_labels(text: Column) -> Column:
    """Report labels that a text names, such as R4."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\bR[1-9][0-9]*\b"), 0))


def unknown_citations(texts: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Cited labels that are not reports of the facts."""
    cited = texts.withColumn("label", F.explode("cited"))
    return cited.join(labels.select(*keys, "label").distinct(), [*keys, "label"], "left_anti")


def empty_findings(texts: DataFrame) -> DataFrame:
    """Key findings without a citation or without text."""
    return texts.filter((F.col("place") == "key_finding") & (
        (F.coalesce(F.size("cited"), F.lit(0)) <= 0) | (F.trim("text") == "")))


def unknown_medication_rows(parsed: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """Medication rows that name no event of the facts: same date, drug contained in the row's drug."""
    rows = parsed.filter(F.col("error").isNull()).select(*keys, F.posexplode("parsed.medication_rows").alias("position", "r"))
    rows = rows.select(*keys, "position", F.col("r.date").alias("date"), F.col("r.drug").alias("row_drug"))
    known = events.select(*keys, F.col("date").cast("string").alias("date"), F.lower("drug").alias("_drug")).distinct()
    hit = rows.join(known, [*keys, "date"]).filter(F.lower("row_drug").contains(F.col("_drug"))).select(
        *keys, "position").distinct()
    return rows.join(hit, [*keys, "position"], "left_anti")


def labels_to_reports(texts: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Cited labels of accepted texts as report ids, one row per citation."""
    cited = texts.select(*keys, "place", F.posexplode("cited").alias("position", "label"))
    return cited.join(labels.select(*keys, "label", "report_id"), [*keys, "label"])


def answer_problems(answers: DataFrame, labels: DataFrame, events: DataFrame, keys: list[str], about: list[str], column: str = "content",
                    allowed: list[str] = (), store: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """(keys, place, problem) of written answers: not JSON or of another shape, no cited key finding, banned words, labels and medication rows
    that the facts of ``about`` (columns of the answers) do not have. ``labels``: about, label; ``events``: about, date, drug. ``store`` keeps
    the parsed answers, which every kind of problem reads."""
    parsed = store(parse(answers, column).select(*keys, *about, "error", F.col("parsed").dropFields("_bad").alias("parsed")))
    broken = parsed.filter(F.col("error").isNotNull()).select(*keys, F.lit("answer").alias("place"), F.col("error").alias("problem"))
    own = [*keys, *about]
    shown = summary_texts(parsed, own)
    empty = empty_findings(shown).select(*keys, "place", F.lit("key finding without text or citation").alias("problem"))
    words = wording(shown, allowed=allowed).select(*keys, "place", F.concat(F.lit("word: "), F.lower("word")).alias("problem"))
    unknown = unknown_citations(shown.filter(F.size("cited") > 0), labels, about).select(
        *keys, "place", F.concat(F.lit("unknown report "), "label").alias("problem"))
    ids = [F.col(k) for k in keys]
    known = answers.select(*keys, *about).join(events.select(*about, "date", "drug"), about).select(*keys, "date", "drug")
    rows = unknown_medication_rows(parsed, known, keys).select(
        *ids, F.concat(F.lit("medication row "), (F.col("position") + 1).cast("string")).alias("place"), F.lit("no such medication event").alias("problem"))
    return broken.unionByName(empty).unionByName(words).unionByName(unknown).unionByName(rows).distinct()


def answer_citations(answers: DataFrame, labels: DataFrame, keys: list[str], about: list[str], column: str = "content") -> DataFrame:
    """(keys, place, position, label, report_id) of each citation of an accepted answer that names a report of the facts."""
    shown = summary_texts(parse(answers, column), [*keys, *about]).filter(F.size("cited") > 0)
    cited = shown.select(*keys, *about, "place", F.posexplode("cited").alias("position", "label"))
    return cited.join(labels.select(*about, "label", "report_id"), [*about, "label"]).select(*keys, "place", "position", "label", "report_id")
