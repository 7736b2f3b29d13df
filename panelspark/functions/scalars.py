"""Column expressions of the panel: prices, factors, costs, limits. NULL is the only missing value."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


@dataclass(frozen=True)
class CostSpec:
    """Trading costs: commission rate and minimum, transfer and stamp rates, slippage in basis points."""

    commission: float = 0.00025
    minimum: float = 5.0
    transfer: float = 0.00001
    stamp: float = 0.0005
    slippage_bps: float = 5.0

    def __post_init__(self) -> None:
        if min(self.commission, self.minimum, self.transfer, self.stamp, self.slippage_bps) < 0:
            raise ValueError("costs can't be negative")

    def buy_fee(self, turnover) -> Column:
        t = _c(turnover)
        return F.when(t > 0, F.greatest(t * self.commission, F.lit(self.minimum)) + t * self.transfer).otherwise(0.0)

    def sell_fee(self, turnover) -> Column:
        t = _c(turnover)
        return F.when(t > 0, F.greatest(t * self.commission, F.lit(self.minimum)) + t * (self.transfer + self.stamp)).otherwise(0.0)

    @property
    def rates(self) -> tuple[float, float]:
        """Cost of a unit bought and sold, without the minimum."""
        slip = self.slippage_bps * 1e-4
        return self.commission + self.transfer + slip, self.commission + self.transfer + self.stamp + slip


ZERO_COSTS = CostSpec(0.0, 0.0, 0.0, 0.0, 0.0)


@dataclass(frozen=True)
class StopSpec:
    """Exit levels against the entry basis: loss and gain as fractions, checked at the close or within the day."""

    stop: float | None = None
    take: float | None = None
    mode: str = "close"

    def __post_init__(self) -> None:
        if self.mode not in ("close", "intraday") or (self.stop is None and self.take is None):
            raise ValueError("mode is close or intraday, and a level is needed")
        if (self.stop is not None and not 0 < self.stop < 1) or (self.take is not None and self.take <= 0):
            raise ValueError("levels are fractions: 0 < stop < 1, take > 0")

    def exit_price(self, basis, close, low, high) -> Column:
        """Fill price where the bar breaches a level; NULL where it doesn't. The stop goes before the gain."""
        basis, close, low, high = map(_c, (basis, close, low, high))
        stop_px = basis * (1 - self.stop) if self.stop is not None else F.lit(None).cast("double")
        take_px = basis * (1 + self.take) if self.take is not None else F.lit(None).cast("double")
        if self.mode == "close":
            out = F.when((close <= stop_px) | (close >= take_px), close)
        else:
            out = F.when(low <= stop_px, F.least(stop_px, close)).when(high >= take_px, take_px)
        return F.when((basis > 0) & close.isNotNull(), out)


def board_of(code) -> Column:
    d = F.substring_index(_c(code), ".", -1)
    return F.when(d.startswith("688"), "STAR").when(d.startswith("300") | d.startswith("301"), "ChiNext").when(d.rlike("^(4|8|920)"), "BSE").otherwise("Main")


def limit_width(code, date) -> Column:
    """Daily price limit by board; the growth board's widened on 2020-08-24."""
    b = board_of(code)
    return F.when(b == "STAR", 0.20).when(b == "BSE", 0.30).when((b == "ChiNext") & (_c(date) >= F.lit(dt.date(2020, 8, 24))), 0.20).otherwise(0.10)


def limit_flag(close, preclose, width, tol: float = 5e-4) -> Column:
    """+1 locked up, -1 locked down, 0 neither or both; NULL without a close."""
    close, preclose, width = _c(close), _c(preclose), _c(width)
    up = F.coalesce(close >= F.bround(preclose * (1 + width), 2) * (1 - tol), F.lit(False)).cast("int")
    down = F.coalesce(close <= F.bround(preclose * (1 - width), 2) * (1 + tol), F.lit(False)).cast("int")
    return F.when(close.isNotNull(), up - down)


def csrc_class(industry) -> Column:
    return F.nullif(F.regexp_extract(_c(industry), r"^([A-Z]\d{2})", 1), F.lit(""))


#: The classes of the five buckets.
BUCKETS = {
    "finance": ("J66",),
    "livelihood": ("D44", "G54"),
    "consumption": ("C36", "C38", "C15"),
    "tech": ("C34", "C35", "C39", "I64", "I65"),
    "infrastructure": ("E47", "E48", "C30"),
}


def bucket_of(industry) -> Column:
    """The bucket of an industry's class; NULL for classes of none."""
    out = F.lit(None).cast("string")
    for name, classes in BUCKETS.items():
        out = F.when(csrc_class(industry).isin(*classes), name).otherwise(out)
    return out


def swap_code(code, style: str = "ts") -> Column:
    """sh.600000 as 600000.SH, 600000.XSHG or sh600000; bonds by their first digits."""
    p = F.split(_c(code), r"\.")
    market, number = p[0], p[1]
    if style == "ts":
        return F.concat(number, F.lit("."), F.upper(market))
    if style == "rq":
        return F.concat(number, F.when(market == "sh", ".XSHG").otherwise(".XSHE"))
    if style == "sina":
        return F.concat(market, number)
    raise ValueError(style)


def bond_market(number) -> Column:
    return F.concat(F.when(_c(number).startswith("11"), "sh").otherwise("sz"), _c(number))


def inverse_positive(x) -> Column:
    """1/x where x > 0: earnings, book and sales yields."""
    return F.when(_c(x) > 0, 1 / _c(x))


def roe_ratio(pb, pe) -> Column:
    return F.when((_c(pb) > 0) & (_c(pe) > 0), _c(pb) / _c(pe))


def float_cap(amount, turn) -> Column:
    return F.when(_c(turn) > 0, _c(amount) / (_c(turn) / 100))


def small_size(cap) -> Column:
    return F.when(_c(cap) > 0, -F.log(_c(cap)))


def lot_target_shares(gross, weight, scale, price, slip: float = 0.0, lot: int = 100) -> Column:
    p = _c(price)
    return F.when(p > 0, F.floor(_c(gross) * _c(weight) * _c(scale) / (p * (1 + slip) * lot)) * lot).cast("long")


def rebased(old, new, rtol: float = 1e-4) -> Column:
    """Whether an overlapping close moved; a missing one counts as moved."""
    old, new = _c(old), _c(new)
    return F.coalesce(F.abs(new - old) > F.greatest(F.lit(1e-6), F.abs(old) * rtol), F.lit(True))


def double_low(price, premium) -> Column:
    return _c(price) + _c(premium)


def eligible(*conditions: Column) -> Column:
    """All conditions, an unknown one as false."""
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out
