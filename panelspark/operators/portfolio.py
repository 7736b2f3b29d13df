"""Rebalanced portfolios, timing books and ledgers as plans of windows and joins: no day waits for the one before.

Signals at a date trade on the next calendar row and earn from the row after it. A variant is a column, so a sweep is one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.asof import asof_join
from panelspark.sources.files import written

BY = ("variant",)


def rebalance_blocks(signals: DataFrame, calendar: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """(by, date, exec_pos, block, next_exec): signal dates with a next row. The last block runs to the end of the data."""
    c = calendar.select("date", (F.col("pos") + 1).alias("exec_pos"))
    last = calendar.agg(F.max("pos").alias("last"))
    d = signals.select(*by, "date").distinct().join(F.broadcast(c), "date").crossJoin(F.broadcast(last)).where("exec_pos <= last")
    w = Window.partitionBy(*by).orderBy("exec_pos")
    return d.withColumn("block", F.row_number().over(w)).withColumn("next_exec", F.coalesce(F.lead("exec_pos").over(w), F.col("last"))).drop("last")


def ew_portfolio(targets: DataFrame, signals: DataFrame, rets: DataFrame, calendar: DataFrame, rates: tuple[float, float] | DataFrame = (0.0, 0.0), by: tuple[str, ...] = BY, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(daily, rebalances) of a rebalanced long book.

    targets: (by, date, code[, weight]) chosen at each signal; signals: all signal dates, empty ones too; rets: (code, pos, ret).
    Weights are equal (or `weight`, the rest cash) at the exec row and drift in the block; a NULL return counts 0. Costs are
    one-sided on the changes against the drifted weights, booked on the exec row, which still earns the block before. rates: of buys and
    sells, or a table (by, buy, sell) with a row for each book.
    daily: by, pos, gross, cost, net. rebalances: by, block, exec_pos, n_held, turnover.

    Blocks, holdings and daily positions are read many times below, so they are written to the shared folder once.
    """
    b = written(rebalance_blocks(signals, calendar, by), "blocks")
    keys = [*by, "block"]
    held = targets.join(F.broadcast(b), [*by, "date"])  # a row for each rebalance
    w0 = F.col(weight) if weight else 1 / F.count("*").over(Window.partitionBy(*keys))
    held = written(held.withColumn("w0", w0).select(*keys, "code", "exec_pos", "next_exec", "w0"), "held")
    days = held.withColumn("pos", F.explode(F.sequence(F.col("exec_pos") + 1, F.greatest(F.col("next_exec"), F.col("exec_pos") + 1)))).where("pos <= next_exec")
    d = days.join(rets.select("code", "pos", "ret"), ["code", "pos"], "left")
    w = Window.partitionBy(*keys, "code").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = written(d.withColumn("g", F.product(1 + F.coalesce("ret", F.lit(0.0))).over(w)), "positions")
    cash = held.groupBy(*keys).agg((1 - F.sum("w0")).alias("cash"))
    value = d.groupBy(*keys, "pos").agg(F.sum(F.col("w0") * F.col("g")).alias("v")).join(cash, keys).withColumn("v", F.col("v") + F.col("cash")).drop("cash")
    gross = value.withColumn("gross", F.col("v") / F.lag("v", 1, 1.0).over(Window.partitionBy(*keys).orderBy("pos")) - 1)
    end_v = value.groupBy(*keys).agg(F.max_by("v", "pos").alias("v_end"))
    end = d.where("pos = next_exec").join(end_v, keys).select(*by, (F.col("block") + 1).alias("block"), "code", (F.col("w0") * F.col("g") / F.col("v_end")).alias("w_end"))
    delta = held.select(*keys, "code", "w0").join(end, [*keys, "code"], "full").withColumn("dw", F.coalesce("w0", F.lit(0.0)) - F.coalesce("w_end", F.lit(0.0)))
    turn = delta.groupBy(*keys).agg(F.sum(F.when(F.col("dw") > 0, F.col("dw")).otherwise(0.0)).alias("buys"), F.sum(F.when(F.col("dw") < 0, -F.col("dw")).otherwise(0.0)).alias("sells"), F.count("w0").alias("n_held"))
    reb = b.join(turn, keys, "left").select(*keys, "date", "exec_pos", F.coalesce("n_held", F.lit(0)).alias("n_held"), F.coalesce("buys", F.lit(0.0)).alias("buys"), F.coalesce("sells", F.lit(0.0)).alias("sells"))
    if isinstance(rates, DataFrame):
        reb = reb.join(rates.select(*by, F.col("buy").alias("__buy"), F.col("sell").alias("__sell")), list(by))
    else:
        reb = reb.withColumn("__buy", F.lit(rates[0])).withColumn("__sell", F.lit(rates[1]))
    reb = reb.withColumn("turnover", (F.col("buys") + F.col("sells")) / 2).withColumn("cost", F.col("buys") * F.col("__buy") + F.col("sells") * F.col("__sell")).drop("__buy", "__sell")
    start = b.groupBy(*by).agg(F.min("exec_pos").alias("first"))
    grid = start.crossJoin(F.broadcast(calendar.select("pos"))).where("pos >= first").drop("first")
    daily = grid.join(gross.select(*by, "pos", "gross"), [*by, "pos"], "left").join(reb.select(*by, F.col("exec_pos").alias("pos"), "cost"), [*by, "pos"], "left")
    daily = daily.select(*by, "pos", F.coalesce("gross", F.lit(0.0)).alias("gross"), F.coalesce("cost", F.lit(0.0)).alias("cost"))
    return daily.withColumn("net", (1 + F.col("gross")) * (1 - F.col("cost")) - 1), reb.drop("buys", "sells")


def limit_blocked(targets: DataFrame, blocks: DataFrame, flags: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """targets as they can trade at the exec row: no new name that is locked up, and a held name that is locked down stays."""
    t = targets.join(F.broadcast(blocks.select(*by, "date", "block", "exec_pos")), [*by, "date"])
    prev = t.select(*by, (F.col("block") + 1).alias("block"), "code", F.lit(True).alias("was"))
    at = blocks.select(*by, "date", "block", "exec_pos")
    both = t.select(*by, "block", "code", F.lit(True).alias("now")).join(prev, [*by, "block", "code"], "full").join(F.broadcast(at), [*by, "block"])
    f = both.join(flags.select("code", F.col("pos").alias("exec_pos"), "flag"), ["code", "exec_pos"], "left")
    now, was, flag = F.coalesce("now", F.lit(False)), F.coalesce("was", F.lit(False)), F.coalesce("flag", F.lit(0))
    return f.where((now & (was | (flag != 1))) | (was & (flag == -1))).select(*by, "date", "code")


def fractional_target(df: DataFrame, target: str = "target", ret: str = "ret", rates: tuple[float, float] = (0.0, 0.0), keys: tuple[str, ...] = ("code",)) -> DataFrame:
    """Adds gross, traded, net of a book that trades a name only when its target fraction changes; it drifts in between, and the first row is free."""
    w = Window.partitionBy(*keys).orderBy("pos")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    change = F.coalesce((F.col(target) != F.lag(target).over(w)).cast("int"), F.lit(0))
    d = df.withColumn("__r", F.coalesce(ret, F.lit(0.0))).withColumn("__c", change).withColumn("__s", F.sum("__c").over(up))
    seg = Window.partitionBy(*keys, "__s").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(Window.partitionBy(*keys, "__s").orderBy("pos")) == 1
    d = d.withColumn("__n1", first).withColumn("__G", F.product(F.when(F.col("__n1"), 1.0).otherwise(1 + F.col("__r"))).over(seg))
    d = d.withColumn("__f", F.col(target) * F.col("__G") / (1 - F.col(target) + F.col(target) * F.col("__G")))
    before = F.coalesce(F.lag("__f").over(w), F.lit(0.0))
    d = d.withColumn("gross", before * F.col("__r")).withColumn("__pre", before * (1 + F.col("__r")) / (1 + F.col("gross")))
    d = d.withColumn("traded", F.when(F.col("__c") == 1, F.col(target) - F.col("__pre")).otherwise(0.0))
    cost = F.when(F.col("traded") > 0, F.col("traded") * rates[0]).otherwise(-F.col("traded") * rates[1])
    return d.withColumn("net", F.col("gross") - cost).drop("__r", "__c", "__s", "__n1", "__G", "__f", "__pre")


def rotation(picks: DataFrame, rets: DataFrame, calendar: DataFrame, cost: float = 0.0015) -> DataFrame:
    """(pos, held, gross, net): each pick is held from two rows after its signal until the next; a switch costs, the first entry doesn't."""
    w = Window.orderBy("pos")  # a row for each rebalance of one book
    p = picks.join(F.broadcast(calendar), "date").select((F.col("pos") + 2).alias("pos"), "pick").withColumn("until", F.lead("pos").over(w))
    days = calendar.select("pos").join(F.broadcast(p.withColumnRenamed("pos", "from")), (F.col("pos") >= F.col("from")) & (F.col("until").isNull() | (F.col("pos") < F.col("until"))), "left")
    d = days.select("pos", F.col("pick").alias("held")).join(rets.select(F.col("code").alias("held"), "pos", "ret"), ["held", "pos"], "left")
    o = Window.partitionBy(F.lit(1)).orderBy("pos")
    d = d.withColumn("__p", F.lag("held").over(o)).withColumn("gross", F.coalesce("ret", F.lit(0.0)))
    return d.select("pos", "held", "gross", (F.col("gross") - F.when(F.col("held") != F.col("__p"), cost).otherwise(0.0)).alias("net"))


def sleeve_mix(daily: DataFrame, weights: DataFrame, key: str = "sleeve", ret: str = "net") -> DataFrame:
    """(pos, ret): fixed-weight sum of sleeves. weights: (key, w), a row for each."""
    return daily.join(F.broadcast(weights), key).groupBy("pos").agg(F.sum(F.col("w") * F.coalesce(ret, F.lit(0.0))).alias("ret"))


def hedged(book: str, index: str, ratio: float, carry: float = 0.0) -> Column:
    """Book return less a short of the index with a yearly carry."""
    return F.col(book) - ratio * F.coalesce(index, F.lit(0.0)) - ratio * carry / 252


def ledger(fills: DataFrame, marks: DataFrame, seed: float = 1e6) -> DataFrame:
    """(account, date, cash, value, equity): running cash and positions at each date's marks; a missing mark counts 0."""
    flow = fills.groupBy("account", "date").agg(F.sum(F.col("shares") * F.col("price") + F.col("fee")).alias("out"))
    dates = marks.select("date").union(fills.select("date")).distinct()
    grid = fills.select("account").distinct().crossJoin(F.broadcast(dates))  # one row a trading date
    w = Window.partitionBy("account").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    cash = grid.join(flow, ["account", "date"], "left").withColumn("cash", F.lit(seed) - F.sum(F.coalesce("out", F.lit(0.0))).over(w)).select("account", "date", "cash")
    value = held_values(position_runs(fills), marks).groupBy("account", "date").agg(F.sum(F.col("shares") * F.col("close")).alias("value"))
    return cash.join(value, ["account", "date"], "left").withColumn("value", F.coalesce("value", F.lit(0.0))).withColumn("equity", F.col("cash") + F.col("value"))


def position_runs(fills: DataFrame) -> DataFrame:
    """(account, code, since, until, shares): spans of dates, the last open, in which a position that isn't flat stays the same. Rows grow with the changes."""
    daily = fills.groupBy("account", "code", "date").agg(F.sum("shares").alias("d"))
    w = Window.partitionBy("account", "code").orderBy("date")
    shares = F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = daily.withColumn("shares", shares).withColumn("until", F.lead("date").over(w))
    return runs.where("shares <> 0").select("account", "code", F.col("date").alias("since"), "until", "shares")


def held_values(runs: DataFrame, marks: DataFrame) -> DataFrame:
    """(account, code, date, shares, close): each run with the marks of its span. They meet by equality, on the code and a month of the span."""
    ends = marks.groupBy("code").agg(F.max("date").alias("__last"))
    r = runs.join(ends, "code").withColumn("__end", F.least(F.coalesce(F.date_sub("until", 1), F.col("__last")), F.col("__last"))).where("__end >= since")
    r = r.withColumn("__month", F.explode(F.sequence(F.trunc("since", "month"), F.trunc("__end", "month"), F.expr("INTERVAL 1 MONTH"))))
    m = marks.where("close is not null").select("code", "date", "close", F.trunc("date", "month").alias("__month"))
    return r.join(m, ["code", "__month"]).where("date between since and __end").select("account", "code", "date", "shares", "close")


def equity_by_marks(fills: DataFrame, marks: DataFrame, seed: float = 1e6) -> DataFrame:
    """(account, date, equity) the other way round, to hold the ledger against: each mark looks up the position that was last left in its name, each day what was last spent."""
    total = lambda by, c: F.sum(c).over(Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    names = ["account", "code"]
    left = fills.groupBy(*names, "date").agg(F.sum("shares").alias("d")).withColumn("left", total(names, "d")).select(*names, F.col("date").alias("at"), "left")
    spent = fills.groupBy("account", "date").agg(F.sum(F.col("shares") * F.col("price") + F.col("fee")).alias("d")).withColumn("spent", total(["account"], "d")).select("account", F.col("date").alias("at"), "spent")
    first = left.groupBy(*names).agg(F.min("at").alias("first"))
    days = marks.join(first, "code").where("date >= first").select(*names, "date", "close")
    each = asof_join(days, left, names, "date", "at").groupBy("account", "date").agg(F.sum(F.col("left") * F.coalesce("close", F.lit(0.0))).alias("value"))
    return asof_join(each, spent, ["account"], "date", "at").select("account", "date", (F.lit(seed) - F.col("spent") + F.col("value")).alias("equity"))


def cost_basis(fills: DataFrame) -> DataFrame:
    """(account, code, shares, basis): average cost of what is held; a full exit drops it, a part sale leaves it.

    Order matters only within an episode from flat to flat, and only the last one's fills are folded.
    """
    w = Window.partitionBy("account", "code").orderBy("date", "fill_id")
    run = F.sum("shares").over(w.rowsBetween(Window.unboundedPreceding, 0))
    flat = fills.withColumn("run", run)
    ep = flat.withColumn("episode", F.sum((F.coalesce(F.lag("run").over(w), F.lit(0)) == 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = ep.withColumn("__m", F.max("episode").over(Window.partitionBy("account", "code"))).where("episode = __m")
    x = F.array_sort(F.collect_list(F.struct("date", "fill_id", "shares", "price")))
    state = lambda n, c: F.struct(n.cast("double").alias("n"), c.cast("double").alias("c"))

    def step(s: Column, f: Column) -> Column:
        n = s["n"] + f["shares"]
        avg = F.when((f["shares"] > 0) & (n > 0) & (s["n"] >= 0), (s["n"] * s["c"] + f["shares"] * f["price"]) / n).when((f["shares"] > 0) & (n > 0), f["price"]).otherwise(s["c"])
        return state(n, F.when(n == 0, F.lit(0.0)).otherwise(avg))

    return last.groupBy("account", "code").agg(F.aggregate(x, state(F.lit(0), F.lit(0)), step).alias("s")).select("account", "code", F.col("s.n").alias("shares"), F.col("s.c").alias("basis")).where("shares <> 0")


def stop_outcome(entries: DataFrame, panel: DataFrame, spec, horizon: int) -> DataFrame:
    """entries (code, pos, basis) with exit_row and exit_price: the first later bar that breaches, or the last close within the horizon."""
    from panelspark.operators.asof import positional_range

    r = positional_range(entries, panel.select("code", "pos", "close", "low", "high"), "pos", horizon).withColumn("fill", spec.exit_price("basis", "close", "low", "high"))
    keys = ["code", "pos", "basis"]
    hit = F.min(F.when(F.col("fill").isNotNull(), F.struct("row", "fill")))
    mark = F.max(F.when(F.col("close").isNotNull(), F.struct("row", "close")))
    g = r.groupBy(*keys).agg(hit.alias("h"), mark.alias("m"))
    return g.select(*keys, F.col("h").isNotNull().alias("stopped"), F.coalesce("h.row", "m.row").alias("exit_row"), F.coalesce("h.fill", "m.close").alias("exit_price"))
