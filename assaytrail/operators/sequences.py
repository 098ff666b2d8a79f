"""Ordered computations that stay spread out when one key holds a large part of the rows.

Two shapes are used. Daily tables have one row per calendar day and series, so a window over a series is
bounded by the calendar. Row-level tables are not bounded, so their order is computed in two steps: inside
a chunk (a day), then over one row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_on: Column, right_on: Column,
         columns: list[str], direction: str = "backward", strict: bool = False) -> DataFrame:
    """Attach the nearest right row at or before (``backward``) or at or after (``forward``) each left row.

    Both sides are sorted once by key and time and the last right row seen is carried along; no pairs are
    formed. Both sides hold at most one row per key and day, which bounds the sort of one key. Missing
    matches give nulls. ``right`` columns keep their names; ``strict`` leaves out equal times.
    """
    packed = F.struct(*columns)
    side = {"left": 0, "right": 1} if strict else {"left": 1, "right": 0}
    left_columns = left.columns
    a = left.select(*keys, left_on.alias("_t"), F.lit(side["left"]).alias("_side"), F.struct(*left_columns).alias("_left"),
                    F.lit(None).cast(right.select(packed.alias("p")).schema["p"].dataType).alias("_right"))
    b = right.select(*keys, right_on.alias("_t"), F.lit(side["right"]).alias("_side"),
                     F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), packed.alias("_right"))
    time_order = F.col("_t").asc() if direction == "backward" else F.col("_t").desc()
    w = Window.partitionBy(*keys).orderBy(time_order, F.col("_side").asc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b).withColumn("_match", F.last("_right", ignorenulls=True).over(w))
    return both.filter(F.col("_left").isNotNull()).select("_left.*", *[F.col("_match")[c].alias(c) for c in columns])


def within_days(days: DataFrame, spans: DataFrame, keys: list[str], date: str, start: str, end: str,
                bucket_days: int = 64) -> DataFrame:
    """All (day, span) matches with ``start <= date <= end``.

    The join key carries a time bucket besides the equality keys, so only rows close in time meet and one
    busy key is spread over many tasks.
    """
    epoch = F.lit("1970-01-01").cast("date")

    def bucket(c: Column) -> Column:
        return F.floor(F.datediff(c, epoch) / bucket_days).cast("int")

    spread = spans.withColumn("_bucket", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end)))))
    return (days.withColumn("_bucket", bucket(F.col(date))).join(spread, [*keys, "_bucket"])
            .filter(F.col(date).between(F.col(start), F.col(end))).drop("_bucket"))


def row_numbers(df: DataFrame, keys: list[str], chunk: str, order: list, out: str, newest_first: bool = False) -> DataFrame:
    """1-based position per key in (chunk, order); ranks inside chunks plus the size of earlier chunks. ``newest_first``: large chunks come first."""
    sizes = df.groupBy(*keys, chunk).agg(F.count(F.lit(1)).alias("_n"))
    by_chunk = F.col(chunk).desc_nulls_last() if newest_first else F.col(chunk).asc_nulls_first()
    earlier = Window.partitionBy(*keys).orderBy(by_chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(k).alias(f"_{k}") for k in [*keys, chunk]],
                           F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, chunk]]
    inside = Window.partitionBy(*keys, chunk).orderBy(*order)
    return (df.withColumn("_rank", F.row_number().over(inside)).join(offsets, same)
            .withColumn(out, (F.col("_rank") + F.col("_offset")).cast("int"))
            .drop("_rank", "_offset", *[f"_{k}" for k in [*keys, chunk]]))


def previous_row(df: DataFrame, keys: list[str], chunk: str, order: list[str], columns: list[str]) -> DataFrame:
    """``lag`` of some columns per key in (chunk, order): inside a chunk, else from the last earlier chunk."""
    packed = F.struct(*columns)
    inside = Window.partitionBy(*keys, chunk).orderBy(*order)
    ends = df.groupBy(*keys, chunk).agg(F.max_by(packed, F.struct(*order)).alias("_end"))
    by_chunk = Window.partitionBy(*keys).orderBy(chunk)
    before = ends.select(*keys, chunk, F.lag("_end").over(by_chunk).alias("_carry"))
    out = df.withColumn("_near", F.lag(packed).over(inside)).join(before, [*keys, chunk])
    prev = F.coalesce("_near", "_carry")
    return out.select(*df.columns, *[prev[c].alias(f"prev_{c}") for c in columns])


def after_last_break(df: DataFrame, keys: list[str], chunk: str, order: list[str], is_break: Column) -> DataFrame:
    """Rows after the last row of each key for which ``is_break`` holds, in (chunk, order)."""
    place = F.struct(*order)
    inside = Window.partitionBy(*keys, chunk)
    rows = df.withColumn("_break", F.max(F.when(is_break, place)).over(inside))
    chunks = df.groupBy(*keys, chunk).agg(F.bool_or(is_break).alias("_has"))
    last = F.max(F.when(F.col("_has"), F.col(chunk))).over(Window.partitionBy(*keys))
    kept = chunks.withColumn("_last", last).filter(F.col("_last").isNull() | (F.col(chunk) >= F.col("_last")))
    return (rows.join(kept.select(*keys, chunk), [*keys, chunk])
            .filter(F.col("_break").isNull() | (place > F.col("_break"))).drop("_break"))
