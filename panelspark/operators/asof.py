"""Joins in time: what was known on a date, what traded next, what happened within a range of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def validity(df: DataFrame, by: list[str], at: str, until: str = "valid_to") -> DataFrame:
    """Adds the end of each row's half-open validity: the next row's start."""
    return df.withColumn(until, F.lead(at).over(Window.partitionBy(*by).orderBy(at)))


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, direction: str = "backward", strict: bool = False) -> DataFrame:
    """Each left row with the nearest right row of its keys at or before (after) its time; NULLs where there is none.

    Both sides are united, sorted once for each key, and the nearest right row is carried over: one shuffle, no range join.
    A right table may hold one row for each key and time; of several the last in order of all columns counts.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(direction)
    payload = [c for c in right.columns if c not in by and c != right_on]
    r = right.groupBy(*by, right_on).agg(F.max(F.struct(*(payload or [right_on]))).alias("__p")) if payload else right.select(*by, right_on).distinct().withColumn("__p", F.struct(right_on))
    keep = F.struct(F.col(right_on).alias("__at"), "__p")
    rs = r.select(*by, F.col(right_on).alias("__t"), F.lit(1).alias("__side"), keep.alias("__r"), F.lit(None).cast(left.schema.simpleString()).alias("__l"))
    ls = left.select(*by, F.col(left_on).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(rs.schema["__r"].dataType).alias("__r"), F.struct(*left.columns).alias("__l"))
    first = (F.col("__side") == 1) if not strict else (F.col("__side") == 0)
    back = direction == "backward"
    order = [F.col("__t") if back else F.col("__t").desc(), F.when(first, 0).otherwise(1)]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = ls.unionByName(rs).withColumn("__r", F.last("__r", True).over(w)).where("__side = 0")
    cols = [F.col(f"__l.`{c}`").alias(c) for c in left.columns]
    name = right_on if right_on not in left.columns else f"{right_on}_right"
    return found.select(*cols, F.col("__r.__at").alias(name), *(F.col(f"__r.__p.`{c}`").alias(c if c not in left.columns else f"{c}_right") for c in payload))


def membership_asof(dates: DataFrame, membership: DataFrame) -> DataFrame:
    """(dates' columns, code): members by the latest snapshot on or before each date; none before the first."""
    snaps = membership.select("snap_date").distinct().withColumn("next_snap", F.lead("snap_date").over(Window.orderBy("snap_date")))
    # one row a snapshot, so the interval join is a broadcast; the members then join by equality
    at = dates.join(F.broadcast(snaps), (F.col("snap_date") <= F.col("date")) & (F.col("next_snap").isNull() | (F.col("date") < F.col("next_snap"))))
    return at.drop("next_snap").join(membership, "snap_date").drop("snap_date")


def restrict_to_universe(panel: DataFrame, members: DataFrame, values: list[str]) -> DataFrame:
    """The panel with the values of non-members NULL. members: (date, code)."""
    m = members.select("date", "code", F.lit(True).alias("__in")).distinct()
    d = panel.join(m, ["date", "code"], "left")
    return d.select(*(F.when(F.col("__in"), F.col(c)).alias(c) if c in values else F.col(c) for c in panel.columns))


def exposure_asof(dates: DataFrame, exposure: DataFrame, default: float = 1.0) -> DataFrame:
    """dates with the latest exposure that isn't NULL on or before each date. exposure: (date, exposure)."""
    d = asof_join(dates.withColumn("__k", F.lit(1)), exposure.where("exposure is not null").select(F.lit(1).alias("__k"), F.col("date").alias("at"), "exposure"), ["__k"], "date", "at")
    return d.withColumn("exposure", F.coalesce("exposure", F.lit(default))).drop("__k", "at")


def report_asof(dates: DataFrame, reports: DataFrame, value: str) -> DataFrame:
    """(dates' columns, value): known by publication; of reports published together the latest period counts. dates: (code, date)."""
    one = reports.groupBy("code", "pub_date").agg(F.max_by(value, "stat_date").alias(value))
    return asof_join(dates, one, ["code"], "date", "pub_date").drop("pub_date")


def next_trading_row(events: DataFrame, calendar: DataFrame, at: str = "date", strict: bool = True) -> DataFrame:
    """events with entry_date and entry_pos of the first calendar row after (or at) each; events past the end, or without a date, are dropped.

    The calendar becomes a map from each day to its row, which events meet by equality: no sort of all events.
    """
    c = calendar.select(F.col("date").alias("entry_date"), F.col("pos").alias("entry_pos"))
    gap = 0 if strict else 1  # days from the row before to the day before this one, or from the day after it to this one
    c = c.withColumn("__before", F.lag("entry_date").over(Window.orderBy("entry_date")))  # a row a trading day
    days = c.where("__before is not null").select(F.explode(F.sequence(F.date_add("__before", gap), F.date_add("entry_date", gap - 1))).alias("__day"), F.struct("entry_date", "entry_pos").alias("__row"))
    first = c.agg(F.min(F.struct("entry_date", "entry_pos")).alias("__first"))
    early = F.col(at) < F.col("__first.entry_date") if strict else F.col(at) <= F.col("__first.entry_date")
    met = events.crossJoin(F.broadcast(first)).join(F.broadcast(days), F.col(at).cast("date") == F.col("__day"), "left")  # a row a calendar day
    row = F.when(early, F.col("__first")).otherwise(F.col("__row"))
    return met.withColumn("__row", row).where("__row is not null").select(*events.columns, "__row.entry_date", "__row.entry_pos")


def positional_range(events: DataFrame, panel: DataFrame, pos: str, horizon: int) -> DataFrame:
    """Each event with the panel rows pos+1 .. pos+horizon of its code. panel: (code, pos, ...)."""
    e = events.withColumn("__at", F.explode(F.sequence(F.col(pos) + 1, F.col(pos) + horizon)))
    return e.join(panel.withColumnRenamed("pos", "__at"), ["code", "__at"]).withColumnRenamed("__at", "row")


def close_mismatch(pairs: DataFrame, tol: float = 0.005) -> DataFrame:
    """(rows, rate, worst) of the relative difference of close_a and close_b; rate 1 without rows."""
    rel = F.abs(F.col("close_a") - F.col("close_b")) / F.col("close_b")
    g = pairs.agg(F.count("*").alias("rows"), F.avg((rel > tol).cast("double")).alias("rate"), F.max(rel).alias("worst"))
    return g.withColumn("rate", F.coalesce("rate", F.lit(1.0)))


def revision_jump_matched(values: DataFrame, revisions: DataFrame, window: int = 3, frac: float = 0.5) -> DataFrame:
    """revisions with `matched`: whether a daily jump near the effective date is at least `frac` of what the price change implies; NULL where that can't be told.

    values: (code, date, value); revisions: (code, effective_date, old_price, new_price).
    """
    w = Window.partitionBy("code").orderBy("date")
    v = values.withColumn("row", F.row_number().over(w)).withColumn("jump", F.try_divide(F.col("value"), F.lag("value").over(w)) - 1)
    at = asof_join(revisions, v.select("code", "date", "row"), ["code"], "effective_date", "date", "forward")
    last = at.where("row > 1 and old_price > 0 and new_price > 0 and new_price < old_price")
    near = positional_range(last.withColumn("from", F.col("row") - window - 1).drop("row", "date"), v.select("code", F.col("row").alias("pos"), "jump"), "from", 2 * window + 1)
    keys = ["code", "effective_date", "old_price", "new_price"]
    best = near.groupBy(*keys).agg((F.max("jump") >= frac * (F.first("old_price") / F.first("new_price") - 1)).alias("matched"))
    return revisions.join(best, keys, "left")


def ffill_onto_calendar(calendar: DataFrame, series: DataFrame, value: str, before: float = 0.0) -> DataFrame:
    """calendar with the series' last value on or before each date, `before` until the first."""
    d = asof_join(calendar.withColumn("__k", F.lit(1)), series.select(F.lit(1).alias("__k"), F.col("date").alias("at"), value), ["__k"], "date", "at")
    return d.withColumn(value, F.coalesce(value, F.lit(before))).drop("__k", "at")
