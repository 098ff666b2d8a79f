"""Change alerts as results arrive, late ones included, by (patient, analyte): a job over all series of a batch, or a stateful processor for each.

The job keeps the days of each batch as files; where series are forgotten after some time, a processor keeps them. The state of a series is the list of its days in order: day, sum and count of its values, smallest and largest lab. A batch that is newer than
all of them is compared with the last day alone, which is kept apart, and appended; the list is not read. A batch with an earlier day
or with more results for a known one reads the list, puts the days where they belong and compares each changed day, and the day after it, anew.
Every comparison has a ``version``, counted by series: of several for one day the highest holds (:func:`current`). So the comparisons that
hold after any order of arrival are those of a run over all results at once.

A series without results for ``idle_ms`` is forgotten by a timer, if that is given: its next result then has nothing to be compared with.
Sums are whole millionths, as canonical values have at most six decimals, so they do not depend on the order of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import numbers as num
from ..operators.series import NO_LAB, SERIES
from ..operators.trends import crossed
from ..session import ship_package, shared_folder
from ..sources import dimensions as dim

_DAY = "day int, total bigint, n bigint, lo string, hi string"
_LAST = f"{_DAY}, version bigint"
_REF = "ref_day int, ref_total bigint, ref_n bigint, ref_lo string, ref_hi string"
STEP = f"patient_id bigint, analyte_id string, {_DAY}, {_REF}, version bigint"
_NAMES = [c.split(" ")[0] for c in STEP.split(", ")]
_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _joined(a: tuple, b: tuple) -> tuple:
    """Two parts of one day."""
    return a[0], a[1] + b[1], a[2] + b[2], min(a[3], b[3]), max(a[4], b[4])


class Series(StatefulProcessor):
    """The days of one series and how they compare."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getListState("days", _DAY)
        self.last = handle.getValueState("last", _LAST)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new: dict[int, tuple] = {}
        for r in rows:
            one = (r.day, r.micros, 1, r.lab, r.lab)
            new[r.day] = _joined(new[r.day], one) if r.day in new else one
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        known = self.last.get()
        last, version = (tuple(known)[:5], known[5]) if known else (None, 0)
        changed = sorted(new)
        if last is None or changed[0] > last[0]:
            days = [new[d] for d in changed]
            pairs = list(zip([last, *days], days))
            self.days.appendList(days)
        else:
            every = {d[0]: tuple(d) for d in self.days.get()}
            for d in changed:
                every[d] = _joined(every[d], new[d]) if d in every else new[d]
            days = [every[d] for d in sorted(every)]
            touched = [i for i, d in enumerate(days) if d[0] in new or (i and days[i - 1][0] in new)]
            pairs = [(days[i - 1] if i else None, days[i]) for i in touched]
            self.days.put(days)
        for before, day in pairs:
            if before is not None:
                version += 1
                yield Row(**dict(zip(_NAMES, (*key, *day, *before, version))))
        self.last.update((*days[-1], version))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.days.clear()
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside use the state store that this kind of state needs."""
    before = spark.conf.get(_STATE_STORE, None)
    spark.conf.set(_STATE_STORE, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STATE_STORE)
        else:
            spark.conf.set(_STATE_STORE, before)


def _values(points: DataFrame) -> DataFrame:
    """Uncensored values of points: series, day, whole millionths, lab."""
    return points.filter(F.col("comparator").isNull()).select(
        *SERIES, F.unix_date("date").alias("day"), F.round(F.col("value") * 1e6).cast("bigint").alias("micros"),
        F.coalesce("lab", F.lit(NO_LAB)).alias("lab"))


def steps_on_arrival(points: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Comparisons of days with the day before them (STEP) for a stream of points; start its query inside :func:`state_store`."""
    ship_package(points.sparkSession)
    return _values(points).groupBy(*SERIES).transformWithState(Series(idle_ms), STEP, "Append", "None" if idle_ms is None else "ProcessingTime")


def _same_series(a: DataFrame, b: DataFrame) -> list[Column]:
    return [a[c].eqNullSafe(b[c]) for c in SERIES]


def step_batch(points: DataFrame, batch_id: int, folder: str, days: str) -> None:
    """Compare the days of one batch of points as :class:`Series` does, for all its series at once, and write the comparisons to ``folder``.

    ``days`` holds the days of each batch, added up by series and day; a day that came in several batches is the sum of its parts. Both
    folders are written by batch and overwritten when a batch is repeated.
    """
    spark = points.sparkSession
    parts = [F.sum("total").alias("total"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    values = _values(points).select(*SERIES, "day", F.col("micros").alias("total"), F.lit(1).cast("bigint").alias("n"), F.col("lab").alias("lo"), F.col("lab").alias("hi"))
    values.groupBy(*SERIES, "day").agg(*parts).write.mode("overwrite").parquet(f"{days}/batch={batch_id}")
    stored = spark.read.schema(f"patient_id bigint, analyte_id string, {_DAY}").parquet
    new = stored(f"{days}/batch={batch_id}")
    rows, counted = new.withColumn("_new", F.lit(True)), None
    if batch_id:
        earlier, touched = stored(*[f"{days}/batch={k}" for k in range(batch_id)]), new.select(*SERIES).distinct()
        rows = rows.unionByName(earlier.join(touched, _same_series(earlier, touched), "left_semi").withColumn("_new", F.lit(False)))
        before = spark.read.schema(STEP).parquet(*[f"{folder}/batch={k}" for k in range(batch_id)])
        counted = before.groupBy(*SERIES).agg(F.max("version").alias("_before"))
    order = Window.partitionBy(*SERIES).orderBy("day")
    every = rows.repartition(*SERIES).groupBy(*SERIES, "day").agg(*parts, F.max("_new").alias("_new"))
    steps = every.withColumn("_ref", F.lag(F.struct("day", "total", "n", "lo", "hi", "_new")).over(order))
    steps = steps.filter(F.col("_ref").isNotNull() & (F.col("_new") | F.col("_ref._new"))).withColumn("version", F.row_number().over(order).cast("bigint"))
    if counted is not None:
        steps = steps.join(counted, _same_series(steps, counted), "left").select(*[steps[c] for c in steps.columns if c != "version"], (
            F.col("version") + F.coalesce("_before", F.lit(0))).alias("version"))
    steps.select(*SERIES, "day", "total", "n", "lo", "hi", *[F.col(f"_ref.{c}").alias(f"ref_{c}") for c in ("day", "total", "n", "lo", "hi")], "version").write.mode(
        "overwrite").parquet(f"{folder}/batch={batch_id}")


def current(steps: DataFrame) -> DataFrame:
    """The comparison that holds for each day."""
    rest = [c for c in steps.columns if c not in (*SERIES, "day", "version", "batch")]
    best = steps.groupBy(*SERIES, "day").agg(F.max_by(F.struct(*rest), "version").alias("_s"))
    return best.select(*SERIES, "day", "_s.*")


def alerts(steps: DataFrame) -> DataFrame:
    """Steps beyond the reference change value, as the flags against the previous result have them."""
    spark = steps.sparkSession
    limits = dim.analytes(spark).select("analyte_id", "rcv_percent").join(
        dim.targets(spark).select("analyte_id", "target_low", "target_high"), "analyte_id", "left")
    mean = lambda total, n: F.expr(f"cast(cast(cast({total} as decimal(24,0)) / 1000000 as decimal(24,6)) / {n} as decimal(28,10))").cast("double")
    rows = steps.select(*SERIES, F.date_from_unix_date("day").alias("date"), mean("total", "n").alias("value"), F.date_from_unix_date("ref_day").alias("prev_date"),
                        mean("ref_total", "ref_n").alias("prev_value"), crossed(*map(F.col, ("lo", "hi", "ref_lo", "ref_hi"))).alias("cross_lab"),
                        *[c for c in ("version",) if c in steps.columns])
    rows = rows.join(limits, "analyte_id").withColumn("change_percent", num.pct_change(F.col("value"), F.col("prev_value")))
    return rows.filter(F.abs("change_percent") > F.col("rcv_percent")).withColumns({
        "direction": F.when(F.col("change_percent") > 0, "rise").otherwise("fall"),
        "target_direction": num.target_direction(F.col("prev_value"), F.col("value"), F.col("target_low"), F.col("target_high"))}).drop(
        "rcv_percent", "target_low", "target_high")


def start_steps(points: DataFrame, folder: str, name: str, idle_ms: int | None = None, every: str = "10 seconds") -> StreamingQuery:
    """Write the comparisons of a stream of points to ``folder`` until all that is there is read; run again under the same ``name`` to go on.

    Without ``idle_ms`` each batch is one job over its series (:func:`step_batch`), below ``folder`` by batch. With ``idle_ms`` a stateful
    processor takes the series one by one and the query goes on until it is stopped, with a batch ``every`` so often: timers need a running query."""
    spark = points.sparkSession
    checkpoint = f"{shared_folder(spark)}/{name}"
    if idle_ms is None:
        return (points.writeStream.foreachBatch(lambda df, i: step_batch(df, i, folder, f"{checkpoint}-days"))
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    with state_store(spark):
        return (steps_on_arrival(points, idle_ms).writeStream.format("parquet").option("path", folder).outputMode("append")
                .option("checkpointLocation", checkpoint).trigger(processingTime=every).start())
