"""Model-quality analytics: confusion, calibration, drift, information and lift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(df: DataFrame, truth: Column, predicted: Column, *by: str) -> DataFrame:
    """tp, fp, tn, fn with accuracy, precision, recall and f1 (0 where undefined); rows with a null on either side are
    left out."""
    rows = df.where(truth.isNotNull() & predicted.isNotNull())
    n = rows.groupBy(*by).agg(F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"), F.count_if(~truth & ~predicted).alias("tn"), F.count_if(truth & ~predicted).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return n.select("*", ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def calibration(df: DataFrame, prediction: str, truth: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_prediction, actual_rate); a prediction of 1 falls into the last bin."""
    place = F.least(F.floor(F.col(prediction) * bins).cast("int"), F.lit(bins - 1))
    rows = df.where(F.col(prediction).isNotNull() & F.col(truth).isNotNull())
    return rows.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg(prediction).alias("mean_prediction"), F.avg(F.col(truth).cast("double")).alias("actual_rate"))


def calibration_error(bins: DataFrame) -> DataFrame:
    """Expected calibration error: mean distance of prediction and rate, weighted by rows."""
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("mean_prediction") - F.col("actual_rate"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def cusum(df: DataFrame, group: str, order: list[str], value: Column, target: float, slack: float) -> DataFrame:
    """One-sided CUSUM s = max(0, s + value - target - slack) in closed form: the running sum less its running minimum."""
    steps = W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    summed = df.withColumn("p", F.sum(value - target - slack).over(steps))
    return summed.withColumn("cusum", F.col("p") - F.least(F.lit(0.0), F.min("p").over(steps))).drop("p")


def _plogp(p: Column) -> Column:
    return F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0))


def mutual_information(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mutual information in bits of two columns, from one contingency table."""
    cells = df.groupBy(x, y).agg(F.count("*").alias("n"))
    px, py, all_ = W.partitionBy(x), W.partitionBy(y), W.partitionBy(F.lit(1))
    # cells has one row per pair of values
    parts = cells.select("n", F.sum("n").over(px).alias("nx"), F.sum("n").over(py).alias("ny"), F.sum("n").over(all_).alias("total"))
    return parts.agg(F.sum(F.col("n") / F.col("total") * F.log2(F.col("n") * F.col("total") / (F.col("nx") * F.col("ny")))).alias("bits"))


def feature_information(df: DataFrame, key: str, features: Column, label: Column) -> DataFrame:
    """For every feature of an array column: rows that have it, fire rate, precision, and its mutual information in bits
    with a boolean label. Margins come from one aggregate; the 2x2 table is completed from them."""
    rows = df.where(label.isNotNull()).select(F.col(key).alias("k"), F.array_distinct(features).alias("f"), label.cast("int").alias("y"))
    totals = rows.agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    seen = rows.select(F.explode("f").alias("feature"), "y").groupBy("feature").agg(F.count("*").alias("have"), F.sum("y").alias("hit"))
    t = seen.join(F.broadcast(totals))  # one row
    n = F.col("n")
    cells = [(F.col("hit"), F.col("have"), F.col("pos")), (F.col("have") - F.col("hit"), F.col("have"), n - F.col("pos")), (F.col("pos") - F.col("hit"), n - F.col("have"), F.col("pos")), (n - F.col("have") - F.col("pos") + F.col("hit"), n - F.col("have"), n - F.col("pos"))]
    bits = sum((F.when(c > 0, c / n * F.log2(c * n / (a * b))).otherwise(F.lit(0.0)) for c, a, b in cells), F.lit(0.0))
    return t.select("feature", "have", (F.col("have") / n).alias("fire_rate"), (F.col("hit") / F.col("have")).alias("precision"), bits.alias("bits"))


def pair_lift(df: DataFrame, key: str, items: Column, least: int) -> DataFrame:
    """(a, b, together, lift) of items of one array that occur together in at least ``least`` rows. Pairs are built
    within a row only."""
    rows = df.select(F.col(key).alias("k"), F.array_sort(F.array_distinct(items)).alias("s"))
    total = rows.agg(F.count("*").alias("n"))
    single = rows.select(F.explode("s").alias("i")).groupBy("i").agg(F.count("*").alias("c"))
    pairs = rows.select(F.explode(F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.greatest(F.size("s") - i - 1, F.lit(0))), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
    both = pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("together")).where(F.col("together") >= least)
    out = both.join(single.select(F.col("i").alias("a"), F.col("c").alias("ca")), "a").join(single.select(F.col("i").alias("b"), F.col("c").alias("cb")), "b").join(F.broadcast(total))
    return out.select("a", "b", "together", (F.col("together") * F.col("n") / (F.col("ca") * F.col("cb"))).alias("lift"))


def distribution_shift(before: DataFrame, after: DataFrame, name: str, weight: str, smooth: float = 1e-9) -> DataFrame:
    """Per name the share before and after (0 where missing) and its parts of the Jensen-Shannon divergence (bits) and of
    the smoothed Kullback-Leibler divergence (nats)."""
    a = before.groupBy(name).agg(F.sum(weight).alias("wa"))
    b = after.groupBy(name).agg(F.sum(weight).alias("wb"))
    both = a.join(b, name, "full_outer").select(name, F.coalesce("wa", F.lit(0)).alias("wa"), F.coalesce("wb", F.lit(0)).alias("wb"))
    whole = W.partitionBy(F.lit(1))  # one row per name
    p, q = F.col("wa") / F.sum("wa").over(whole), F.col("wb") / F.sum("wb").over(whole)
    shares = both.select(name, p.alias("p"), q.alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    return shares.select(name, "p", "q", ((part(F.col("p")) + part(F.col("q"))) / 2).alias("jsd"), ((F.col("q") + smooth) * F.log((F.col("q") + smooth) / (F.col("p") + smooth))).alias("kl"))


def conditional_information(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """Mutual information in bits of two columns given a third, from one three-way contingency table."""
    cells = df.groupBy(x, y, z).agg(F.count("*").alias("n"))
    over = lambda *c: F.sum("n").over(W.partitionBy(*c))
    # cells has one row per combination of values
    parts = cells.select("n", over(x, z).alias("nxz"), over(y, z).alias("nyz"), over(z).alias("nz"), F.sum("n").over(W.partitionBy(F.lit(1))).alias("total"))
    return parts.agg(F.sum(F.col("n") / F.col("total") * F.log2(F.col("n") * F.col("nz") / (F.col("nxz") * F.col("nyz")))).alias("bits"))


def minimal_set(df: DataFrame, features: dict[str, Column], label: Column, share: float = 0.9, most: int = 8) -> list[tuple[str, float]]:
    """Greedy choice of features: each time the one that adds most information about the label given the chosen ones,
    until ``share`` of all features' joint information is reached. Every step is one aggregate over the combinations that
    occur; the driver sees one number per candidate. ``features`` are boolean expressions."""
    bits = df.groupBy(*[c.cast("int").alias(n) for n, c in features.items()], label.cast("int").alias("_y")).agg(F.count("*").alias("_n"))

    def information(names: list[str]) -> Column:
        key = F.concat_ws(",", *[F.coalesce(F.col(n).cast("string"), F.lit("-")) for n in names]) if names else F.lit("")
        return key

    def joint(names: list[str]) -> float:
        cells = bits.groupBy(information(names).alias("x"), "_y").agg(F.sum("_n").alias("n"))
        w = lambda *c: F.sum("n").over(W.partitionBy(*c))
        row = cells.select("n", w("x").alias("a"), w("_y").alias("b"), F.sum("n").over(W.partitionBy(F.lit(1))).alias("t")).agg(F.sum(F.col("n") / F.col("t") * F.log2(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).alias("v")).head()
        return row["v"] or 0.0

    whole, chosen, have = joint(list(features)), [], 0.0
    while len(chosen) < min(most, len(features)) and have < share * whole - 1e-12:
        gains = [(joint([c for c, _ in chosen] + [n]), n) for n in sorted(features) if n not in {c for c, _ in chosen}]
        best, name = max(gains, key=lambda g: (round(g[0], 12), [-ord(c) for c in g[1]]))
        if best - have < 1e-9:
            break
        chosen.append((name, best))
        have = best
    return chosen


def gap_ratio(df: DataFrame, items: Column, missed: Column) -> DataFrame:
    """(item, caught, missed, ratio): how often items stand in missed and in caught positives; ratio is missed over
    caught + 1. Items of one side only are kept."""
    rows = df.select(F.explode(F.array_distinct(items)).alias("item"), missed.alias("m")).where("m is not null")
    n = rows.groupBy("item").agg(F.count_if(~F.col("m")).alias("caught"), F.count_if(F.col("m")).alias("missed"))
    return n.select("*", (F.col("missed") / (F.col("caught") + 1)).alias("ratio"))


def cascade_preview(df: DataFrame, old: Column, new: Column, level) -> DataFrame:
    """What another scoring changes: rows, rows that move to another level, mean and spread of the difference, largest
    rise and fall. ``level`` maps a score to its level."""
    rows = df.select(old.alias("o"), new.alias("n")).where("o is not null and n is not null").select("o", "n", (level(F.col("o")) != level(F.col("n"))).alias("moved"), (F.col("n") - F.col("o")).alias("d"))
    return rows.agg(F.count("*").alias("rows"), F.count_if("moved").alias("moved"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("spread"), F.max("d").alias("rise"), F.min("d").alias("fall"))


def leading_digits(df: DataFrame, value: str) -> DataFrame:
    """Benford test of the first significant digits: (digit, n, share, expected). Zero, null and NaN values are left out;
    all nine digits come out."""
    v = F.abs(F.col(value).cast("double"))
    digit = F.floor(v / F.pow(F.lit(10.0), F.floor(F.log10(v)))).cast("int")
    rows = df.where(v.isNotNull() & ~F.isnan(v) & (v > 0)).select(F.least(F.greatest(digit, F.lit(1)), F.lit(9)).alias("digit"))
    seen = rows.groupBy("digit").agg(F.count("*").alias("n"))
    all_digits = df.sparkSession.range(1, 10).select(F.col("id").cast("int").alias("digit"))
    joined = all_digits.join(seen, "digit", "left").select("digit", F.coalesce("n", F.lit(0)).alias("n"))
    whole = F.sum("n").over(W.partitionBy(F.lit(1)))  # nine rows
    return joined.select("digit", "n", ratio(F.col("n"), whole).alias("share"), F.log10(1 + 1 / F.col("digit")).alias("expected"))


def beta_posteriors(df: DataFrame, items: Column, label: Column, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """(item, hits, misses, mean, lower): Beta posterior of the precision of every item with its mean and mean less two
    standard deviations."""
    n = df.where(label.isNotNull()).select(F.explode(F.array_distinct(items)).alias("item"), label.alias("y")).groupBy("item").agg(F.count_if("y").alias("hits"), F.count_if(~F.col("y")).alias("misses"))
    a, b = F.col("hits") + alpha, F.col("misses") + beta
    return n.select("*", (a / (a + b)).alias("mean"), (a / (a + b) - 2 * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))).alias("lower"))


def committee(df: DataFrame, key: str, scores: list[str], n: int) -> DataFrame:
    """The ``n`` rows most worth a label: 0.6 of the spread of several scores and 0.4 of the closeness of their mean to
    one half; ties by key."""
    parts = F.array(*[F.col(c).cast("double") for c in scores])
    mean = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / len(scores)
    rows = df.select(key, parts.alias("p"), mean.alias("mean")).where(F.col("mean").isNotNull())
    spread = F.sqrt(F.aggregate("p", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / len(scores))
    value = F.round(0.6 * spread + 0.4 * (1 - F.abs(F.col("mean") - 0.5) * 2), 6)
    return rows.select(key, value.alias("value")).orderBy(F.desc("value"), key).limit(n)


def snapshot_difference(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change): added, removed or changed rows between two versions of a table."""
    a, b = before.select(key, F.struct(*columns).alias("x")), after.select(key, F.struct(*columns).alias("y"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(~F.col("x").eqNullSafe(F.col("y")), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def chi_square(cells: DataFrame, a: str, b: str) -> DataFrame:
    """(chi_square, freedom) of two columns of counts over the same classes, a row per class; empty classes are left out."""
    total = cells.agg(F.sum(a).alias("ta"), F.sum(b).alias("tb"))  # one row
    rows = cells.where(F.col(a) + F.col(b) > 0).join(F.broadcast(total)).withColumn("t", F.col(a) + F.col(b))
    ea, eb = F.col("t") * F.col("ta") / (F.col("ta") + F.col("tb")), F.col("t") * F.col("tb") / (F.col("ta") + F.col("tb"))
    return rows.agg(F.sum((F.col(a) - ea) * (F.col(a) - ea) / ea + (F.col(b) - eb) * (F.col(b) - eb) / eb).alias("chi_square"), (F.count("*") - 1).alias("freedom"))


def leading_digits_test(digits: DataFrame) -> DataFrame:
    """(chi_square, deviation) of the result of ``leading_digits``: the statistic on eight degrees of freedom and the mean
    absolute deviation of the shares."""
    total = digits.agg(F.sum("n").alias("t"))  # one row
    e = F.col("t") * F.col("expected")
    return digits.join(F.broadcast(total)).agg(F.sum((F.col("n") - e) * (F.col("n") - e) / e).alias("chi_square"), F.avg(F.abs(F.col("share") - F.col("expected"))).alias("deviation"))


def disagreement(df: DataFrame, key: str, scores: list[str]) -> DataFrame:
    """(key, spread, entropy): largest less smallest of the scores, and their mean binary entropy in bits."""
    safe = [F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.col(s))) for s in scores]
    entropy = sum((-p * F.log2(p) - (1 - p) * F.log2(1 - p) for p in safe), F.lit(0.0)) / len(scores)
    return df.select(key, (F.greatest(*safe) - F.least(*safe)).alias("spread"), entropy.alias("entropy"))


def consensus(df: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """(key, value, agreement): weighted mean of the scores, and one less twice their standard deviation, 0 at least."""
    n, total = len(weights), sum(weights.values())
    value = sum((F.col(s) * w for s, w in weights.items()), F.lit(0.0)) / total
    mean = sum((F.col(s) for s in weights), F.lit(0.0)) / n
    spread = F.sqrt(sum(((F.col(s) - mean) * (F.col(s) - mean) for s in weights), F.lit(0.0)) / n)
    return df.select(key, value.alias("value"), F.greatest(F.lit(0.0), 1 - 2 * spread).alias("agreement"))
