"""Ordered-sequence operators: calendars, smoothing, anomalies, change points, forecasts and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def daily(df: DataFrame, name: str, day: Column) -> DataFrame:
    """(name, day, n) with a row for every day between the first and the last day of all names, 0 where nothing was."""
    counts = df.select(F.col(name), day.alias("day")).where(F.col("day").isNotNull()).groupBy(name, "day").agg(F.count("*").alias("n"))
    ends = counts.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    names = counts.select(name).distinct()
    grid = names.join(F.broadcast(ends)).select(name, F.explode(F.sequence("a", "b")).alias("day"))
    return grid.join(counts, [name, "day"], "left").select(name, "day", F.coalesce("n", F.lit(0)).alias("n"))


def smoothed(series: DataFrame, name: str, order: str, value: str, alpha: float) -> DataFrame:
    """Exponential moving average per name, started at the first value: a fold over the ordered values inside the JVM.
    Meant for aggregated series (one row per name and period)."""
    ordered = series.groupBy(name).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("t"), F.col(value).cast("double").alias("v")))).alias("s"))
    ema = F.aggregate(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), F.element_at("s", 1)["v"], lambda e, x: e * (1 - alpha) + x["v"] * alpha)
    return ordered.select(name, F.size("s").alias("periods"), ema.alias("ema"), F.array_max(F.transform("s", lambda x: x["v"])).alias("peak"), F.element_at("s", -1)["v"].alias("last"))


def anomalies(series: DataFrame, name: str, order: str, value: str, history: int = 21, recent: int = 3) -> DataFrame:
    """z-score of every value against the ``history`` values before it, and its ratio to the mean of the last ``recent``.
    Null until there are three earlier values; 0 where those don't vary."""
    past = W.partitionBy(name).orderBy(order).rowsBetween(-history, -1)
    near = W.partitionBy(name).orderBy(order).rowsBetween(-recent, -1)
    seen, mean, spread = F.count(value).over(past), F.avg(value).over(past), F.stddev_pop(value).over(past)
    base = F.avg(value).over(near)
    rows = series.select(name, order, value, seen.alias("seen"), mean.alias("mean"), spread.alias("spread"), base.alias("base"))
    z = F.when(F.col("seen") >= 3, F.when(F.col("spread") > 1e-12, (F.col(value) - F.col("mean")) / F.col("spread")).otherwise(F.lit(0.0)))
    return rows.select(name, order, value, z.alias("z"), F.when(F.col("base") > 0, F.col(value) / F.col("base")).alias("burst"))


def change_points(series: DataFrame, name: str, order: str, value: str, edge: int = 2) -> DataFrame:
    """Per name the split with the largest distance of the means before and from it (the first on ties), and whether it
    exceeds the spread of the whole series."""
    up = W.partitionBy(name).orderBy(order)
    before, whole = up.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(name)
    rows = series.select(name, order, F.row_number().over(up).alias("i"), F.count("*").over(whole).alias("n"), F.sum(F.col(value).cast("double")).over(before).alias("left"), F.sum(F.col(value).cast("double")).over(whole).alias("all"), F.stddev_pop(value).over(whole).alias("spread"))
    k = F.col("i") - 1
    inside = rows.where((k >= edge) & (k <= F.col("n") - edge)).withColumn("shift", F.abs((F.col("all") - F.col("left")) / (F.col("n") - k) - F.col("left") / k))
    best = inside.groupBy(name).agg(F.max(F.struct(F.round("shift", 9).alias("shift"), (-k).alias("k"), F.col(order).alias("at"), "spread")).alias("b"))
    return best.select(name, F.col("b.at").alias("at"), F.col("b.shift").alias("shift"), (F.col("b.shift") > F.col("b.spread")).alias("significant"))


def forecast(series: DataFrame, name: str, order: str, value: str) -> DataFrame:
    """Least-squares line per name over its numbered periods: next value, fit and a 95 % half-width from the residuals."""
    x = F.row_number().over(W.partitionBy(name).orderBy(order)) - 1
    rows = series.select(name, x.cast("double").alias("x"), F.col(value).cast("double").alias("y"))
    fit = rows.groupBy(name).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.covar_pop("x", "y").alias("sxy"), F.var_pop("x").alias("sxx"), F.var_pop("y").alias("syy"))
    slope = F.when(F.col("sxx") > 0, F.col("sxy") / F.col("sxx")).otherwise(F.lit(0.0))
    fitted = fit.withColumn("slope", slope)
    following = F.col("my") + F.col("slope") * (F.col("n") - F.col("mx"))
    left = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    return fitted.select(name, "n", "slope", following.alias("next"), F.when(F.col("syy") > 1e-12, 1 - left / F.col("syy")).otherwise(F.lit(0.0)).alias("r2"), (1.96 * F.sqrt(left)).alias("half_width"))


def gaps(df: DataFrame, who: str, at: Column, kind: str) -> DataFrame:
    """Per ``who``: events, mean seconds between neighbours, and how often the kind changes from one to the next."""
    order = W.partitionBy(who).orderBy("t", kind)
    rows = df.select(who, at.alias("t"), kind).select(who, (F.col("t") - F.lag("t").over(order)).alias("gap"), (F.col(kind) != F.lag(kind).over(order)).cast("int").alias("switch"))
    return rows.groupBy(who).agg(F.count("*").alias("events"), F.avg("gap").alias("mean_gap"), F.coalesce(F.sum("switch"), F.lit(0)).alias("switches"))


def sessions(df: DataFrame, who: str, at: Column, pause: float) -> DataFrame:
    """(who, session, events, seconds): a new session begins after a pause of more than ``pause`` seconds."""
    order = W.partitionBy(who).orderBy("t")
    rows = df.select(who, at.alias("t")).withColumn("new", (F.col("t") - F.lag("t").over(order) > pause).cast("int"))
    numbered = rows.withColumn("session", F.coalesce(F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))
    return numbered.groupBy(who, "session").agg(F.count("*").alias("events"), (F.max("t") - F.min("t")).alias("seconds"))


def lagged_correlation(series: DataFrame, name: str, order: str, value: str, lag: int) -> DataFrame:
    """Pearson correlation of each series with itself ``lag`` periods earlier, 0 where undefined."""
    rows = series.select(name, F.col(value).cast("double").alias("v"), F.lag(F.col(value).cast("double"), lag).over(W.partitionBy(name).orderBy(order)).alias("p")).where("p is not null")
    return rows.groupBy(name).agg(F.count("*").alias("n"), F.coalesce(F.corr("v", "p"), F.lit(0.0)).alias("correlation"))


def velocity(series: DataFrame, name: str, order: str, value: str, frame: int = 10, still: float = 1e-3) -> DataFrame:
    """Per name the mean change of the last ``frame`` steps, the mean change of that change, sign changes, and whether the
    series has come to rest."""
    w = W.partitionBy(name).orderBy(order)
    rows = series.select(name, order, (F.col(value) - F.lag(value).over(w)).cast("double").alias("d"), F.row_number().over(W.partitionBy(name).orderBy(F.desc(order))).alias("back"))
    rows = rows.withColumns({"dd": F.col("d") - F.lag("d").over(w), "turn": (F.signum("d") * F.signum(F.lag("d").over(w)) < 0).cast("int")}).where(F.col("back") <= frame)
    out = rows.groupBy(name).agg(F.avg("d").alias("velocity"), F.avg("dd").alias("acceleration"), F.coalesce(F.sum("turn"), F.lit(0)).alias("turns"))
    return out.withColumn("at_rest", F.abs("velocity") < still)


def within_rate(df: DataFrame, who: str, at: Column, seconds: float, most: int) -> DataFrame:
    """Rows of ``who`` with how many rows the ``seconds`` up to it hold, and whether that exceeds ``most``."""
    w = W.partitionBy(who).orderBy("t").rangeBetween(-int(seconds * 1_000_000), 0)
    return df.select(who, at.alias("t")).select(who, "t", F.count("*").over(w).alias("recent")).withColumn("exceeded", F.col("recent") > most)
