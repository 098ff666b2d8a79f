"""The frames of a lab data set, each built once and only when a query needs it."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators import clinical as C
from ..operators import facts as K
from ..operators import figures as G
from ..operators import response as R
from ..operators import rollup as U
from ..operators import series as S
from ..operators import trends as T
from ..session import shared_folder
from ..sources import adapters as A
from ..sources import tables


class Lab:
    """Base tables plus everything derived from them, as lazy DataFrames."""

    def __init__(self, patients: DataFrame, reports: DataFrame, observations: DataFrame, med_events: DataFrame,
                 as_of: str):
        self.patients, self.reports, self.observations = patients, reports, observations
        self.med_events, self.as_of = med_events, as_of

    @classmethod
    def from_given_tables(cls, spark: SparkSession, sf_dir: str) -> Lab:
        return cls(A.patients(spark, sf_dir), A.reports(spark, sf_dir), A.observations(spark, sf_dir),
                   A.med_events(spark, sf_dir), A.AS_OF)

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str, as_of: str) -> Lab:
        """Tables of the data model stored as Parquet."""
        names = ("patients", "reports", "observations", "med_events")
        return cls(*[tables.read_table(spark, folder, n) for n in names], as_of)

    @cached_property
    def confirmed_reports(self) -> DataFrame:
        return self.reports.filter("status = 'confirmed'")

    @cached_property
    def points(self) -> DataFrame:
        return S.points(self.observations, self.reports)

    @cached_property
    def days(self) -> DataFrame:
        return S.day_values(self.points)

    @cached_property
    def events(self) -> DataFrame:
        return S.resolve_drugs(self.med_events)

    @cached_property
    def effects(self) -> DataFrame:
        return S.event_effects(self.events)

    @cached_property
    def windows(self) -> DataFrame:
        return S.effect_windows(self.effects)

    @cached_property
    def frame(self) -> DataFrame:
        return S.frame(self.days, S.event_bounds(self.effects))

    @cached_property
    def summaries(self) -> DataFrame:
        return S.summaries(self.frame)

    @cached_property
    def slopes(self) -> DataFrame:
        return T.slopes(self.summaries)

    @cached_property
    def projections(self) -> DataFrame:
        return T.projections(self.slopes)

    @cached_property
    def flags(self) -> DataFrame:
        return T.all_flags(self.frame, self.windows)

    @cached_property
    def evidence(self) -> DataFrame:
        return T.flag_evidence(self.flags, self.points)

    @cached_property
    def responses(self) -> DataFrame:
        return R.responses(self.effects, self.days)

    @cached_property
    def history(self) -> DataFrame:
        return C.kdigo_history(self.points)

    @cached_property
    def criteria(self) -> DataFrame:
        return C.criteria(self.points, self.patients)

    @cached_property
    def active(self) -> DataFrame:
        return C.active_drugs(self.events)

    @cached_property
    def figure_context(self) -> DataFrame:
        return G.context(self.patients, self.points, self.criteria, self.history, self.active)

    @cached_property
    def figures(self) -> DataFrame:
        return G.figures(self.figure_context)

    @cached_property
    def labels(self) -> DataFrame:
        return U.report_labels(self.reports)

    def periods(self, kind: str = K.ALL, start: str | None = None, end: str | None = None) -> DataFrame:
        return K.resolve_periods(self.confirmed_reports, self.patients, kind, start, end)

    def facts(self, kind: str = K.SINCE_LAST_VISIT, start: str | None = None, end: str | None = None) -> DataFrame:
        return K.build(self.patients, self.periods(kind, start, end), self.confirmed_reports, self.points, self.days,
                       self.events, self.summaries, self.slopes, self.flags, self.responses, self.as_of)

    def stored(self, *frames: str, **columns: list[str]) -> Lab:
        """Write some frames to the shared folder and read them back: each is computed once, however many
        results use it, and a lost executor costs its own partitions only. ``columns``: frames of which the results use these
        columns only; no others are computed and written."""
        spark = self.patients.sparkSession
        folder = f"{shared_folder(spark)}/lab-{uuid.uuid4().hex}"
        for name in [*frames, *columns] or ("points", "days", "summaries", "flags", "responses"):
            getattr(self, name).select(*columns.get(name, ["*"])).write.parquet(f"{folder}/{name}")
            setattr(self, name, spark.read.parquet(f"{folder}/{name}"))
        return self
