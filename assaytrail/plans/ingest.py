"""From the words of uploaded reports to reports, observations and skipped lines, in one job."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metadata as M
from ..operators import normalise as N
from ..operators import textrows as P
from ..session import shared_folder

SKIPPED = ["report_id", "page", "line", "text", "reason"]


def ingest(tagged: DataFrame, files: DataFrame, patients: DataFrame, as_of: str, header_lines: DataFrame | None = None) -> dict[str, DataFrame]:
    """``tagged``: lines with words and tags (doc_id is the file's report_id); ``files``: report_id and patient_id of each file.

    Dates and lab come from the lines themselves, or from ``header_lines`` where those are kept apart. Every line with a tagged
    value is a result, belongs to one, or is among the skipped ones with a reason: ``unaccounted`` has those that are neither,
    and must be empty. Files with hardly any word are scans; they get a reason and no observations.
    """
    folder = f"{shared_folder(tagged.sparkSession)}/ingest-{uuid.uuid4().hex}"
    P.assemble(tagged).select(*P.ASSEMBLED).write.parquet(folder)
    lines = tagged.sparkSession.read.parquet(folder)
    shown = header_lines if header_lines is not None else lines.select(
        "doc_id", "page", "line", "text", F.col("kind").isin("above", "margin").alias("page_header"))
    words = lines.groupBy("doc_id").agg(F.sum("n_words").alias("n_words"))
    reports = (files.join(words.withColumnRenamed("doc_id", "report_id"), "report_id", "left")
               .join(M.labelled_dates(shown, as_of).withColumnRenamed("doc_id", "report_id").withColumnRenamed("collected_at", "printed_at"), "report_id", "left")
               .join(M.labs(shown).withColumnRenamed("doc_id", "report_id"), "report_id", "left")
               .select("report_id", "patient_id", "lab", F.col("report_date").alias("collected_at"), "date_label", "reported_at",
                       F.lit("extracted").alias("status"),
                       F.when(F.coalesce("n_words", F.lit(0)) < P.SCAN_WORDS, "the file has no text: a scan").alias("refused")))
    found = P.results(lines)
    printed = found.withColumnRenamed("doc_id", "report_id").join(reports.filter("refused IS NULL").select("report_id"), "report_id", "left_semi")
    printed = printed.withColumn("observation_id", F.concat_ws("-", "report_id", "page", "line"))
    observations, not_results = N.normalise(printed, reports, patients)
    skipped = P.skipped_lines(lines).withColumnRenamed("doc_id", "report_id").select(*SKIPPED).unionByName(
        not_results.select("report_id", "page", "line", F.col("row_text").alias("text"), F.col("status_reason").alias("reason")))
    return {"reports": reports, "observations": observations, "skipped": skipped,
            "unaccounted": P.unaccounted(lines, found, P.skipped_lines(lines))}
