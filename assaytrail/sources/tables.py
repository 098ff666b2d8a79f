"""Readers for the data model. Schemas are fixed: nothing is inferred from the data."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATIENTS = ("patient_id bigint, doctor_id bigint, patient_code string, name string, sex string, birth_year int, "
            "conditions array<string>, weight_kg double")
REPORTS = ("report_id bigint, patient_id bigint, file_sha256 string, lab string, collected_at date, "
           "date_label string, reported_at date, layout string, pages int, status string, "
           "skipped array<struct<page:int,line:int,text:string,reason:string>>")
OBSERVATIONS = ("observation_id string, report_id bigint, analyte_id string, match string, basis string, "
                "test_text string, value_text string, unit_text string, range_text string, flag_text string, "
                "row_text string, range_lines array<string>, notes array<string>, comparator string, "
                "value_number double, canonical_value double, canonical_unit string, page int, line int, "
                "bbox array<double>, status string, status_reason string, edited boolean")
MED_EVENTS = "event_id bigint, patient_id bigint, drug string, change string, dose_text string, date date"
WORDS = "doc_id bigint, page int, text string, x0 double, x1 double, top double, bottom double"
LABELLED_ROWS = ("report_id string, layout_family string, split string, page int, row int, tokens array<string>, "
                 "tags array<string>, analyte_id string, canonical_value double, "
                 "truth struct<synonym:string,test:string,extra_id:string,panel:string,basis:string,unit_key:string,"
                 "unit:string,value:string,range:string,range_format:string,flag:string,flag_column:boolean,"
                 "value_class:string,abnormal:boolean,sex:string,age:int,profile:string>")
DOCUMENTS = ("document_id bigint, patient_id bigint, kind string, filename string, sha256 string, size bigint, "
             "report_id bigint, document_date date, created_at timestamp")

SCHEMAS = {"patients": PATIENTS, "reports": REPORTS, "observations": OBSERVATIONS, "med_events": MED_EVENTS,
           "words": WORDS, "documents": DOCUMENTS}

# Leading bytes of the accepted file types.
MAGIC = [("25504446", "pdf"), ("89504E47", "png"), ("FFD8FF", "jpg")]


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of the data model from Parquet."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")


def read_labelled_rows(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Labelled rows (JSON lines), optionally of one split."""
    rows = spark.read.schema(LABELLED_ROWS).json(path)
    return rows if split is None else rows.filter(F.col("split") == split)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded files with content hash, size and the type their first bytes name. Spark's file source does not list empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return describe_files(files)


def write_files(files: DataFrame, folder: str) -> int:
    """Write ``content`` of each row as a file ``name`` below ``folder`` from the tasks; returns how many.

    A task that runs again writes the same names; each appears when it is whole."""
    def run(batches):
        fs, path = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        fs.create_dir(path, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                part = f"{path}/.{name}-{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as f:
                    f.write(content)
                fs.move(part, f"{path}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return files.select("name", "content").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n


def describe_files(files: DataFrame) -> DataFrame:
    kind = F.lit(None).cast("string")
    for magic, name in reversed(MAGIC):
        kind = F.when(F.hex(F.substring("content", 1, len(magic) // 2)) == magic, name).otherwise(kind)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"),
                        kind.alias("file_type"))
