"""Operators along time, per security, on the dense panel. Frames count calendar rows; a thin window is NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from panelspark.operators.order import sliding_quantiles


def by_code(*more: str) -> WindowSpec:
    return Window.partitionBy(*more, "code").orderBy("pos")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def densify_panel(bars: DataFrame, calendar: DataFrame, codes: DataFrame) -> DataFrame:
    """Every calendar row for every code, NULL where there is no bar. The calendar has a few thousand rows: it is the broadcast side."""
    return codes.crossJoin(F.broadcast(calendar)).join(bars, ["date", "code"], "left")


def gate(value: Column, counted, frame: WindowSpec, least: int) -> Column:
    """The value where at least `least` rows of the frame have one."""
    return F.when(F.count(_c(counted)).over(frame) >= least, value)


def trailing(fn, x, window: int, least: int | None = None, w: WindowSpec | None = None) -> Column:
    """An aggregate over the last `window` rows, this one included."""
    frame = (w or by_code()).rowsBetween(-(window - 1), 0)
    return gate(fn(_c(x)).over(frame), x, frame, window if least is None else least)


def daily_return(close="close", w=None) -> Column:
    prev = F.lag(_c(close)).over(w or by_code())
    return F.try_divide(_c(close), prev) - 1


def trailing_return(close="close", lookback: int = 20, w=None) -> Column:
    return F.try_divide(_c(close), F.lag(_c(close), lookback).over(w or by_code())) - 1


def momentum(close="close", lookback: int = 120, skip: int = 20, w=None) -> Column:
    w = w or by_code()
    return F.try_divide(F.lag(_c(close), skip).over(w), F.lag(_c(close), lookback).over(w)) - 1


def low_vol(ret="ret", window: int = 120, least: int | None = None) -> Column:
    return -trailing(F.stddev_samp, ret, window, least)


def low_turnover(turn="turn", window: int = 20) -> Column:
    return -trailing(F.avg, F.when(_c(turn) > 0, _c(turn)), window, max(1, window // 2))


def low_turnover_vol(turn="turn", window: int = 20) -> Column:
    return -trailing(F.stddev_samp, F.when(_c(turn) > 0, _c(turn)), window, max(2, window // 2))


def amihud(ret="ret", amount="amount", window: int = 20) -> Column:
    return trailing(F.avg, F.when(_c(amount) > 0, F.abs(_c(ret)) / _c(amount)), window, window // 2)


def prior_traded_days(close="close") -> Column:
    return F.count(_c(close)).over(by_code().rowsBetween(Window.unboundedPreceding, -1))


def moving_average_regime(close="close", window: int = 200, w=None) -> Column:
    ma = trailing(F.avg, close, window, window, w)
    return F.when(ma.isNotNull(), F.when(_c(close) >= ma, 1.0).otherwise(0.0))


def double_ma_signal(close="close", fast: int = 20, slow: int = 60, w=None) -> Column:
    a, b = trailing(F.avg, close, fast, fast, w), trailing(F.avg, close, slow, slow, w)
    return F.when(b.isNotNull(), (a > b).cast("int"))


def rolling_box(close="close", window: int = 120, lo: float = 0.1, hi: float = 0.9, light: float = 0.3, least: int | None = None) -> Column:
    """Target of a box trader: 1 near the floor of the prior window, `light` near its top (the floor wins), carried on otherwise, 1 before any box."""
    frame = by_code().rowsBetween(-window, -1)
    floor, top = F.min(_c(close)).over(frame), F.max(_c(close)).over(frame)
    at = F.try_divide(_c(close) - floor, top - floor)
    ok = F.count(_c(close)).over(frame) >= (window if least is None else least)
    return F.when(ok, F.when(at <= lo, 1.0).when(at >= hi, light))


def carried(signal, before: float = 1.0, w=None) -> Column:
    """The last signal that isn't NULL; `before` until the first."""
    return F.coalesce(F.last(_c(signal), True).over((w or by_code()).rowsBetween(Window.unboundedPreceding, 0)), F.lit(before))


def valuation_mark(close="close") -> Column:
    """The last close, up to the code's final bar; NULL before the first and after the last."""
    w = by_code()
    last = F.max(F.when(_c(close).isNotNull(), F.col("pos"))).over(Window.partitionBy("code"))
    return F.when(F.col("pos") <= last, F.last(_c(close), True).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def alive(close="close") -> Column:
    p = Window.partitionBy("code")
    at = F.when(_c(close).isNotNull(), F.col("pos"))
    return F.col("pos").between(F.min(at).over(p), F.max(at).over(p))


def state_hold(enter: Column, exit_: Column, start: bool = False, w=None) -> Column:
    """Held or not: the last of enter and exit stands; exit wins on the same row."""
    sig = F.when(F.coalesce(exit_, F.lit(False)), 0).when(F.coalesce(enter, F.lit(False)), 1)
    return F.coalesce(F.last(sig, True).over((w or by_code()).rowsBetween(Window.unboundedPreceding, 0)), F.lit(int(start)))


def fresh_streak(flag, direction: int, w=None) -> Column:
    return F.coalesce(_c(flag) == direction, F.lit(False)) & ~F.coalesce(F.lag(_c(flag)).over(w or by_code()) == direction, F.lit(False))


def fresh_mask(mask, w=None) -> Column:
    m = F.coalesce(_c(mask), F.lit(False))
    return m & ~F.coalesce(F.lag(m).over(w or by_code()), F.lit(False))


def threshold_reversal_state(df: DataFrame, x: str = "x", arm: float = 0.2, sell: float = 0.8, lookback: int = 60, reversal: int = 5, least: int = 20, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Adds `state`: armed at or below the low quantile, bought on the first positive `reversal`-row change from then on, sold at or above the high one."""
    w = Window.partitionBy(*keys).orderBy("pos")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    d = sliding_quantiles(df, {"q_lo": (x, arm, lookback, least), "q_hi": (x, sell, lookback, least)}, keys)
    d = d.withColumn("chg", F.col(x) - F.lag(x, reversal).over(w))
    d = d.withColumn("armed", F.max(F.when(F.col(x) <= F.col("q_lo"), F.col("pos"))).over(upto)).withColumn("up", F.max(F.when(F.col("chg") > 0, F.col("pos"))).over(before))
    buy = (F.col("chg") > 0) & F.col("armed").isNotNull() & (F.col("armed") > F.coalesce("up", F.lit(-1)))
    return d.withColumn("state", state_hold(buy, F.col(x) >= F.col("q_hi"), w=w)).drop("armed", "up")


def drawdown_episodes(df: DataFrame, close: str = "close", dd: float = 0.2, peak_window: int = 500, rearm: float = 0.95, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Rows that open an episode: `dd` below the rolling peak, with none open; one is over when `rearm` of the peak is back."""
    w = Window.partitionBy(*keys).orderBy("pos")
    d = df.where(F.col(close).isNotNull()).withColumn("peak", F.max(close).over(w.rowsBetween(-(peak_window - 1), 0)))
    d = d.withColumn("mark", F.when(F.col(close) <= (1 - dd) * F.col("peak"), 1).when(F.col(close) >= rearm * F.col("peak"), 0))
    d = d.withColumn("prev", F.coalesce(F.last("mark", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return d.where("mark = 1 and prev = 0").drop("mark", "prev")


def centered_peak(close="close", half: int = 12, w=None) -> Column:
    frame = (w or by_code()).rowsBetween(-half, half)
    return (F.count(_c(close)).over(frame) == 2 * half + 1) & (_c(close) == F.max(_c(close)).over(frame))


def forward_sum(x, window: int, least: int | None = None) -> Column:
    frame = by_code().rowsBetween(1, window)
    return gate(F.sum(_c(x)).over(frame), x, frame, window if least is None else least)


def drawdown(equity="equity", w: WindowSpec | None = None) -> Column:
    w = w or Window.partitionBy("series_id").orderBy("date")
    return _c(equity) / F.max(_c(equity)).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1


def lagged_position_cost(df: DataFrame, state: str, ret: str, buy: float, sell: float, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Adds pos2, trade and net: the state is traded a row later and earns from the row after that."""
    w = Window.partitionBy(*keys).orderBy("pos")
    now, before = F.coalesce(F.lag(state, 1).over(w), F.lit(0)), F.coalesce(F.lag(state, 2).over(w), F.lit(0))
    d = df.withColumn("pos2", before).withColumn("trade", now - before)
    cost = F.when(F.col("trade") > 0, F.col("trade") * buy).otherwise(-F.col("trade") * sell)
    return d.withColumn("net", F.col("pos2") * F.coalesce(F.col(ret), F.lit(0.0)) - cost)


def first_entry(by: str = "code", order: str = "date") -> Column:
    return F.row_number().over(Window.partitionBy(by).orderBy(order)) == 1
