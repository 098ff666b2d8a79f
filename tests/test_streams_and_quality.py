import datetime as dt
import hashlib
import time
import uuid

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from assaytrail.operators import quality as Q
from assaytrail.sources import tables
from assaytrail.plans.queries import QUERIES, with_previous_day
from assaytrail.sources import sinks
from assaytrail.streaming import alerts, refresh
from compare import compare, connect
from tests import patients as fx

SF = "/root/testdata/sf0.001"
QUICK = ["day_values", "rcv_prev_flags", "slopes", "unit_convert", "kdigo_history", "ckd_criterion", "report_labels", "entity_f1",
         "document_numbers", "group_rows", "labelled_dates", "lab_names"]


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, name):
    same, message = compare(spark, connect(SF), name, queries()[name], oracle_sql()[name], SF)
    assert same, message


def test_every_query_is_registered_once():
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) - set(oracle_sql()) == {"facts_hash", "rule_tags", "assemble", "unaccounted_lines"}


def test_refresh_equals_batch_also_for_late_reports(spark, tmp_path):
    points = fx.points(spark).withColumn("observation_id", F.col("observation_id").cast("string"))
    late = F.col("date") < "2024-01-01"
    folder, incoming, name = str(tmp_path / "out"), str(tmp_path / "in"), f"refresh-{uuid.uuid4().hex}"
    for i, part in enumerate((points.filter(~late), points.filter(late))):       # the early reports come last
        part.coalesce(1).write.mode("append").parquet(incoming)
        refresh.start_refresh(spark, incoming, fx.events(spark), folder, name, 1, 4).awaitTermination()
    got = {(r.patient_id, r.flag_id) for r in refresh.current_flags(spark, folder).collect()}
    assert got == {(r.patient_id, r.flag_id) for r in refresh.compute_flags(points, fx.events(spark)).collect()}


def test_refresh_drops_flags_that_a_late_value_removes(spark, tmp_path):
    """4.0 then 4.8 is a change beyond the threshold; a late 4.4 between them takes it away."""
    folder, incoming, name = str(tmp_path / "out"), str(tmp_path / "in"), f"refresh-{uuid.uuid4().hex}"
    rows = [(1, "potassium", "a", 1, "2024-01-01", 4.0), (1, "potassium", "b", 2, "2024-03-01", 4.8), (1, "potassium", "c", 3, "2024-02-01", 4.4)]
    points = spark.createDataFrame(rows, "patient_id bigint, analyte_id string, observation_id string, report_id bigint, date string, value double").selectExpr(
        "patient_id", "analyte_id", "observation_id", "report_id", "cast(date as date) date", "value", "cast(null as string) comparator", "'A' lab", "1 page", "1 line")
    events = fx.events(spark).limit(0)
    seen = []
    for part in (points.filter("observation_id <> 'c'"), points.filter("observation_id = 'c'")):
        part.coalesce(1).write.mode("append").parquet(incoming)
        refresh.start_refresh(spark, incoming, events, folder, name, 1, 4).awaitTermination()
        seen.append(refresh.current_flags(spark, folder).count())
    assert seen == [refresh.compute_flags(points.filter("observation_id <> 'c'"), events).count(), refresh.compute_flags(points, events).count()]
    assert seen[0] > seen[1] == 0
    refresh.compact(spark, folder, f"{folder}-2", 10, 4)
    assert refresh.current_flags(spark, f"{folder}-2").count() == 0 and refresh.stored_points(spark, f"{folder}-2").count() == 3


def test_result_table_written_again_keeps_no_old_bucket(spark, tmp_path):
    rows = spark.range(100).withColumnRenamed("id", "patient_id")
    sinks.write_results(rows, str(tmp_path / "t"), 8)
    sinks.write_results(rows.filter("patient_id < 2"), str(tmp_path / "t"), 8)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def _point(k, date, value, lab="A"):
    return (1, "potassium", str(k), k, dt.date.fromisoformat(date), value, None, lab, 1, 1)


def _arrive(spark, folder, parts, name):
    """Steps after each part has arrived, every part by a stream that starts anew from the checkpoint."""
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(refresh.POINTS).parquet(f"{folder}/in")
        assert alerts.start_steps(stream, f"{folder}/steps", name).awaitTermination(60)
    return spark.read.parquet(f"{folder}/steps")


def test_alerts_on_arrival(spark, tmp_path):
    points = fx.points(spark).withColumn("observation_id", F.col("observation_id").cast("string")).filter("patient_id = 1 and analyte_id = 'creatinine'")
    steps = _arrive(spark, str(tmp_path), [points.coalesce(1)], f"alerts-{uuid.uuid4().hex}")
    assert [(r.date, r.change_percent, r.direction) for r in alerts.alerts(alerts.current(steps)).collect()] == [(dt.date(2024, 4, 1), 16.2, "rise")]


def test_late_days_are_compared_anew_after_a_restart(spark, tmp_path):
    rows = [_point(1, "2024-01-01", 1.0), _point(2, "2024-02-01", 2.0), _point(3, "2024-01-15", 1.5, "B"), _point(4, "2024-02-01", 4.0), _point(5, "2023-12-01", 1.0)]
    steps = _arrive(spark, str(tmp_path), [spark.createDataFrame([r], refresh.POINTS) for r in rows], f"late-{uuid.uuid4().hex}")
    seen = [(r.version, r.day - 19723, r.total / r.n / 1e6, r.ref_day - 19723) for r in steps.orderBy("version").collect()]
    assert seen == [(1, 31, 2.0, 0), (2, 14, 1.5, 0), (3, 31, 2.0, 14), (4, 31, 3.0, 14), (5, 0, 1.0, -31)]
    together = _arrive(spark, str(tmp_path / "once"), [spark.createDataFrame(rows, refresh.POINTS)], f"once-{uuid.uuid4().hex}")
    assert sorted(map(tuple, alerts.current(steps).collect())) == sorted(map(tuple, alerts.current(together).collect()))
    assert {r.date.isoformat(): r.cross_lab for r in alerts.alerts(alerts.current(steps)).collect()} == {"2024-01-15": True, "2024-02-01": True}


@pytest.mark.parametrize("idle_ms, steps", [(1, 0), (10**9, 1)])
def test_idle_series_are_forgotten(spark, tmp_path, idle_ms, steps):
    folder = str(tmp_path)
    spark.createDataFrame([], refresh.POINTS).coalesce(1).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(refresh.POINTS).parquet(f"{folder}/in")
    query = alerts.start_steps(stream, f"{folder}/steps", f"idle-{uuid.uuid4().hex}", idle_ms, "100 milliseconds")
    try:
        rows = 0
        for k, date in enumerate(("2024-01-01", "2024-02-01")):
            spark.createDataFrame([_point(k, date, 1.0 + k)], refresh.POINTS).write.mode("append").parquet(f"{folder}/in")
            rows += 1
            seen, deadline = 0, time.time() + 40
            while time.time() < deadline and (seen < rows or query.lastProgress["batchId"] < last + 3):
                time.sleep(0.2)
                progress = list(query.recentProgress)
                seen = sum(p["numInputRows"] for p in progress)
                last = max([p["batchId"] for p in progress if p["numInputRows"]], default=1 << 30)
    finally:
        query.stop()
    assert seen == 2 and spark.read.schema(alerts.STEP).parquet(f"{folder}/steps").count() == steps


def test_labelled_rows(spark, tmp_path):
    def row(report, split, tags, analyte="potassium", value="4.2", canonical=4.2, unit="mmol/L", flag="", abnormal=False):
        return {"report_id": report, "layout_family": "a", "split": split, "page": 1, "row": 1, "tokens": ["K+", value, unit], "tags": tags,
                "analyte_id": analyte, "canonical_value": canonical, "truth": {
                    "test": "K+", "value": value, "unit": unit, "unit_key": unit, "range": "", "flag": flag, "basis": "primary",
                    "sex": "male", "abnormal": abnormal, "flag_column": True}}

    import json
    good = ["B-TEST", "B-VALUE", "B-UNIT"]
    rows = [row("r1", "train", good), row("r2", "test", ["B-TEST", "I-VALUE", "B-UNIT"]), row("r3", "train", good, canonical=4.3),
            row("r4", "train", good, value="6.0", canonical=6.0, flag="", abnormal=False), row("r1", "val", good)]
    (tmp_path / "rows.jsonl").write_text("\n".join(map(json.dumps, rows)))
    df = tables.read_labelled_rows(spark, str(tmp_path / "rows.jsonl"))
    assert tables.read_labelled_rows(spark, str(tmp_path / "rows.jsonl"), "train").count() == 3
    assert [r.report_id for r in Q.bad_tags(df).collect()] == ["r2"]
    assert [r.report_id for r in Q.value_mismatches(df).collect()] == ["r3"]
    assert [r.report_id for r in Q.flag_mismatches(df).collect()] == ["r4"]
    assert Q.field_mismatches(df).count() == 0
    held = spark.createDataFrame([("a",)], "layout_family string")
    assert {r.problem for r in Q.split_problems(df, held).collect()} == {"report in two splits", "held-out family outside test"}
    other = df.withColumn("tokens", F.when(F.col("report_id") == "r4", F.array(F.lit("x"))).otherwise(F.col("tokens")))
    assert [r.report_id for r in Q.differing_rows(df.filter("split <> 'val'"), other.filter("split <> 'val'"), ["report_id"]).collect()] == ["r4"]
    counts = {r.split: r.n for r in Q.assign_splits(spark.range(2000).select(F.col("id").alias("report_id"), F.when(
        F.col("id") % 10 == 0, "held").otherwise("x").alias("layout_family")), ["held"]).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert counts == {"test": 200, "val": 180, "train": 1620}


@pytest.mark.parametrize("ranked", [1, 7, 1 << 20])
def test_shares_are_exact_and_do_not_depend_on_the_way(spark, ranked):
    ids = spark.createDataFrame([(f"r{k % 300}",) for k in range(900)], "i string")
    key = F.md5(F.col("i").cast("binary"))
    place = sorted((hashlib.md5(f"r{k}".encode()).hexdigest(), f"r{k}") for k in range(300))
    for share in (0.0, 0.001, 0.1, 0.5, 1.0):
        wanted = int(300 * share + 0.5)
        assert Q.share_threshold(ids, key, "i", share, ranked) == (place[wanted - 1] if wanted else None)


def test_second_reading_with_nulls_and_repeats(spark):
    first = [(1, 1, "a"), (1, 2, None), (None, 1, "n"), (2, 1, "gone"), (3, 1, "r"), (3, 1, "r")]
    second = [(1, 1, "a"), (1, 2, "x"), (None, 1, "n"), (3, 1, "r"), (4, 1, None)]
    schema = "k int, line int, tokens string"
    for rows in (1, 1 << 12):
        got = Q.differing_rows(spark.createDataFrame(first, schema), spark.createDataFrame(second, schema), ["k", "line"], bucket_rows=rows).collect()
        assert sorted(map(tuple, got), key=str) == [(1, 2, None, "x", "changed"), (2, 1, "gone", None, "missing"), (4, 1, None, None, "extra")]
    empty = spark.createDataFrame([], schema)
    assert Q.differing_rows(empty, empty, ["k", "line"]).count() == 0


def test_bucketed_points_need_no_exchange(spark, tmp_path):
    points = fx.points(spark).withColumn("observation_id", F.col("observation_id").cast("string"))
    version = sinks.write_bucketed(points, str(tmp_path), ["patient_id"], ["analyte_id", "date"], 8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for attempt in range(2):
        stored = sinks.open_bucketed(spark, str(tmp_path), version)
        assert stored.count() == points.count()
        plan = with_previous_day(stored)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" in plan
        spark.sql(f"DROP TABLE bucketed_{version}")                           # the second time it is read from its manifest
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
    with pytest.raises(ValueError):
        sinks.open_bucketed(spark, str(tmp_path), "v0")


def test_files_are_taken_in_once_over_restarts(spark, tmp_path):
    folder, name, schema = str(tmp_path), f"files-{uuid.uuid4().hex}", refresh.FILES
    existing = spark.createDataFrame([("old",)], "sha256 string")
    seen = []
    for part in ([(1, "a", 3, "pdf"), (2, "a", 3, "pdf"), (3, "old", 1, "pdf")], [(4, "a", 3, "pdf"), (5, "b", 2, "png"), (6, "c", 2, None), (7, None, 2, "pdf")], [(8, "b", 2, "png")]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{folder}/in")
        assert refresh.start_intake(spark, f"{folder}/in", existing, f"{folder}/out", name).awaitTermination(60)
        seen.append(sorted(r.sha256 for r in spark.read.schema(schema).parquet(f"{folder}/out").collect()))
    assert seen == [["a"], ["a", "b"], ["a", "b"]]


def test_files_written_by_tasks_are_read_with_their_type(spark, tmp_path):
    rows = [("1", b"%PDF-x"), ("2", b"\x89PNG..."), ("3", b"\xff\xd8\xff"), ("4", b""), ("5", b"plain")]
    assert tables.write_files(spark.createDataFrame(rows, "name string, content binary").repartition(3), f"{tmp_path}/f") == 5
    got = {r.path.rsplit("/", 1)[1]: (r.size, r.file_type) for r in tables.read_files(spark, f"{tmp_path}/f").collect()}
    assert got == {"1": (6, "pdf"), "2": (7, "png"), "3": (3, "jpg"), "5": (5, None)}      # empty files are not listed


def test_entity_scores_of_groupings(spark):
    rows = [("t", "a", ["B-TEST", "I-TEST", "B-VALUE"], ["B-TEST", "O", "B-VALUE"]), ("t", None, ["B-UNIT"], ["B-UNIT"]), ("v", "a", [], []), ("v", "a", ["I-TEST"], ["O"])]
    df = spark.createDataFrame(rows, "split string, family string, tags array<string>, predicted array<string>")
    got = {(r.split, r.family, r.grouping_id, r.kind): (r.support, r.precision, r.recall) for r in Q.entity_scores(df, [["split", "family"], ["split"], []]).collect()}
    assert got["t", "a", 0, "TEST"] == (1, 0.0, 0.0) and got["t", "a", 0, "overall"] == (2, 0.5, 0.5) and got["t", None, 0, "UNIT"] == (1, 1.0, 1.0)
    assert got["t", None, 1, "overall"] == got[None, None, 3, "overall"] == (3, 0.66667, 0.66667) and not any(k[0] == "v" for k in got)
