"""File intake: duplicates, refusals, scoping by owner and deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The usual limit of an upload.
MAX_BYTES = 20 * 1024 * 1024


def first_copies(files: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in order. A hash aggregation, so many copies shrink before the shuffle."""
    rest = [c for c in files.columns if c not in keys]
    return (files.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f"))
            .select(*keys, *[F.col(f"_f.{c}").alias(c) for c in rest]))


def accept(files: DataFrame, existing: DataFrame, keys: list[str], order: list[str], file_id: str, max_bytes: int | None = None) -> DataFrame:
    """Files with ``accepted`` and a reason.

    ``keys`` is ``[sha256]`` for reports (a file counts once for everybody) and ``[doctor_id, sha256]`` for
    other documents. Refused copies are found by their own id, not by joining copies with each other. Files of more than
    ``max_bytes`` are refused, if that is given.
    """
    too_large = F.lit(False) if max_bytes is None else F.col("size") > max_bytes
    usable = ~too_large & F.col("file_type").isNotNull()
    fresh = first_copies(files.filter(usable), keys, order).join(existing.select(*keys).distinct(), keys, "left_anti")
    won = fresh.select(file_id, F.lit(True).alias("_won"))
    reason = (F.when(too_large, f"file is larger than {(max_bytes or 0) // (1024 * 1024)} MB")
              .when(F.col("file_type").isNull(), "file type is not supported")
              .when(F.col("_won").isNull(), "this file was already uploaded").otherwise(""))
    return (files.join(won, file_id, "left").withColumn("reason", reason)
            .withColumn("accepted", F.col("reason") == "").drop("_won"))


def owned(rows: DataFrame, patients: DataFrame, doctor_id: int | None = None) -> DataFrame:
    """Rows with their patient's doctor, optionally of one doctor only."""
    out = rows.join(patients.select("patient_id", "doctor_id"), "patient_id")
    return out if doctor_id is None else out.filter(F.col("doctor_id") == doctor_id)


def delete(documents: DataFrame, reports: DataFrame, observations: DataFrame,
           wanted: DataFrame) -> dict[str, DataFrame]:
    """Tables after deleting ``wanted`` documents with their report and its observations.

    A document whose report is confirmed stays; it is listed in ``refused``.
    """
    asked = documents.join(wanted.select("document_id").distinct(), "document_id", "left_semi")
    confirmed = reports.filter(F.col("status") == "confirmed").select("report_id")
    refused = asked.join(confirmed, "report_id", "left_semi").select("document_id", "report_id")
    gone = asked.join(refused.select("document_id"), "document_id", "left_anti")
    gone_reports = gone.filter(F.col("report_id").isNotNull()).select("report_id").distinct()
    return {"documents": documents.join(gone.select("document_id"), "document_id", "left_anti"),
            "reports": reports.join(gone_reports, "report_id", "left_anti"),
            "observations": observations.join(gone_reports, "report_id", "left_anti"), "refused": refused}
