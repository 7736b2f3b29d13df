"""Feature tables and walk-forward learning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators import xsection as X
from panelspark.sources.files import written

#: Parts of a unit of return that targets and predictions are kept in: sums of whole numbers don't depend on their order, so a run repeats itself.
PARTS = 10**9
#: Standard deviations on either side that the bins of a feature cover; what is beyond falls into the last ones.
REACH = 3.0


def build_dataset(scores: DataFrame, features: list[str], fwd: str = "fwd") -> DataFrame:
    """(date, code, features, fwd): standardised per date, rows with a gap dropped, returns against the date's mean."""
    d = scores
    for f in features:
        d = X.standardize(d, f, f)
    return d.na.drop(subset=[*features, fwd]).withColumn(fwd, X.cross_demean(fwd)).select("date", "code", *features, fwd)


def fold_rows(data: DataFrame, features: list[str], folds: list, min_train: int, window: int, least_rows: int, bins: int, fwd: str) -> DataFrame:
    """(fold, train, date, code, bins, y, p, fwd): each row in the folds that learn from it, and in its own, which it tests.

    A fold is an evaluation date; it learns from the `window` dates before it. Bins are fixed, so no row tells a fold of others.
    """
    k = data.sparkSession.createDataFrame([(d, i) for i, d in enumerate(folds)], f"date {data.schema['date'].dataType.simpleString()}, k int")
    binned = F.array(*(F.least(F.greatest(F.floor((F.col(f) + REACH) * (bins / (2 * REACH))), F.lit(0)), F.lit(bins - 1)).cast("tinyint") for f in features))
    d = data.join(F.broadcast(k), "date").select("k", "date", "code", binned.alias("bins"), F.round(F.col(fwd) * PARTS).cast("long").alias("y"), fwd)
    d = d.withColumn("fold", F.explode(F.sequence("k", F.least(F.col("k") + window, F.lit(len(folds) - 1))))).where(F.col("fold") >= min_train)
    d = d.withColumn("train", F.col("fold") > F.col("k")).drop("k")
    enough = d.groupBy("fold").agg(F.count_if("train").alias("n"), F.count_if(~F.col("train")).alias("tests")).where((F.col("n") >= least_rows) & (F.col("tests") > 0))
    return d.join(F.broadcast(enough.select("fold")), "fold").withColumn("p", F.lit(0).cast("long"))  # a row a fold


def best_splits(rows: DataFrame, least_leaf: int, shrink: float) -> DataFrame:
    """(fold, node, feature, bin): for each node of each fold the cut with the largest gain. Only histograms are shuffled: a row for each fold, node, feature and bin."""
    hist = rows.where("train").select("fold", "node", F.posexplode("bins").alias("feature", "bin"), (F.col("y") - F.col("p")).alias("g"))
    hist = hist.groupBy("fold", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.count("*").alias("n"))
    node = Window.partitionBy("fold", "node", "feature")
    upto = node.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    d = hist.select("fold", "node", "feature", "bin", F.sum("g").over(upto).alias("gl"), F.sum("n").over(upto).alias("nl"), F.sum("g").over(node).alias("ga"), F.sum("n").over(node).alias("na"))
    d = d.withColumns({"gr": F.col("ga") - F.col("gl"), "nr": F.col("na") - F.col("nl")}).where((F.col("nl") >= least_leaf) & (F.col("nr") >= least_leaf))
    score = lambda g, n: F.pow(F.col(g) / PARTS, 2) / (F.col(n) + shrink)
    d = d.withColumn("gain", score("gl", "nl") + score("gr", "nr") - score("ga", "na")).where("gain > 0")
    best = F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b")))
    return d.groupBy("fold", "node").agg(best.alias("x")).select("fold", "node", (-F.col("x.f")).alias("feature"), (-F.col("x.b")).alias("bin"))


def walk_forward_predict(data: DataFrame, features: list[str], folds: list, min_train: int = 24, window: int = 36, least_rows: int = 200, fwd: str = "fwd", trees: int = 12, depth: int = 3, rate: float = 0.15, least_leaf: int = 20, shrink: float = 1.0, bins: int = 32) -> DataFrame:
    """(date, code, pred, fwd): each date predicted by boosted trees that learnt from the dates before it.

    All folds grow together: a level of a tree is one aggregation of gradient histograms by (fold, node, feature, bin) and one join with
    the cuts, a tree is one job, and the number of jobs is that of the trees, however many folds there are. folds: the evaluation dates, a short list;
    those with fewer than `least_rows` rows to learn from, or none to predict, are left out. Features are standardised scores. After each tree the rows are
    written to the shared folder, so no tree carries the plan of those before it.
    """
    rows = written(fold_rows(written(data, "dataset"), features, folds, min_train, window, least_rows, bins, fwd), "folds")
    names = rows.columns
    for k in range(trees):
        d = rows.withColumn("node", F.lit(1))
        for _ in range(depth):
            cut = best_splits(d, least_leaf, shrink).withColumnRenamed("bin", "edge")
            right = F.coalesce((F.element_at("bins", F.col("feature") + 1) > F.col("edge")).cast("int"), F.lit(0))  # a node without a cut passes on whole
            d = d.join(cut, ["fold", "node"], "left").withColumn("node", F.col("node") * 2 + right).drop("feature", "edge")
        leaf = d.where("train").groupBy("fold", "node").agg(F.round(rate * F.sum(F.col("y") - F.col("p")) / (F.count("*") + shrink)).cast("long").alias("step"))
        d = d.join(leaf, ["fold", "node"], "left").withColumn("p", F.col("p") + F.coalesce("step", F.lit(0)))
        rows = written(d.select(*names), f"tree{k}")
    return rows.where("not train").select("date", "code", (F.col("p") / PARTS).alias("pred"), fwd)


def evaluated(scores: DataFrame, fwd: str = "fwd", top: int = 5) -> DataFrame:
    """(strategy, months, mean_ic, ir, t, hit, excess, spread) of (strategy, date, code, v, fwd): rank correlation, the return of the `top` best over the universe's, best fifth less worst."""
    by = ("strategy", "date")
    ic = X.ic_summary(X.rank_ic(scores, "v", fwd, by).withColumn("ic", F.round("ic", 9)), ("strategy",)).select("strategy", F.col("n").alias("months"), "mean_ic", "ir", "t", "hit")
    picked = X.selection_excess(scores, "v", fwd, top, by=by).groupBy("strategy").agg(F.avg("excess").alias("excess"), F.avg("spread").alias("spread"))
    return ic.join(picked, "strategy", "left")
