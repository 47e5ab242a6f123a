"""Declarative row signals, log-odds scores, risk levels and attributions, all as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import matches

#: Bounds between the risk levels; a score on a bound belongs above it (fixed values).
LEVELS = (("safe", 0.2), ("low", 0.4), ("suspicious", 0.6), ("high", 0.8))
EDGE = 1e-6


@dataclass(frozen=True)
class Signal:
    """A named predicate with its weight (a probability: above 0.5 raises the score) and the confidence in it."""

    name: str
    category: str
    weight: float
    confidence: float
    fires: Column


def logit(weight: Column) -> Column:
    w = F.least(F.greatest(weight, F.lit(EDGE)), F.lit(1 - EDGE))
    return F.log(w / (1 - w))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def fired(signals: list[Signal], learned: dict[str, float] | None = None) -> Column:
    """Array of the signals that fire, in the order given. ``learned`` replaces weights by name."""
    learned = learned or {}
    rows = [F.when(F.coalesce(s.fires, F.lit(False)), F.struct(F.lit(s.name).alias("name"), F.lit(s.category).alias("category"), F.lit(float(learned.get(s.name, s.weight))).alias("weight"), F.lit(s.confidence).alias("confidence"))) for s in signals]
    return F.array_compact(F.array(*rows))


def total(signals: Column) -> Column:
    """Sum of the log-odds."""
    return F.aggregate(signals, F.lit(0.0), lambda a, s: a + logit(s["weight"]))


def score(signals: Column) -> Column:
    return F.when(F.size(signals) == 0, 0.0).otherwise(sigmoid(total(signals)))


def confidence(signals: Column) -> Column:
    """Grows with the number of signals and with how much they agree."""
    n = F.size(signals)
    good = F.size(F.filter(signals, lambda s: s["category"] == "positive"))
    return F.when(n == 0, 0.0).otherwise((1 - F.exp(-0.3 * n)) * F.greatest(good, n - good) / n)


def risk(value: Column) -> Column:
    return reduce(lambda c, l: c.when(value < l[1], l[0]), LEVELS[1:], F.when(value < LEVELS[0][1], LEVELS[0][0])).otherwise("scam")


def attribution(signals: Column) -> Column:
    """For every signal how much the score falls without it (closed form; the empty set scores 0)."""
    whole = total(signals)
    without = lambda s: F.when(F.size(signals) == 1, 0.0).otherwise(sigmoid(whole - logit(s["weight"])))
    return F.transform(signals, lambda s: F.struct(s["name"].alias("name"), (sigmoid(whole) - without(s)).alias("share")))


def ensemble(signals: Column) -> Column:
    """0.6 log-odds score + 0.2 confidence-weighted mean weight + 0.2 share of signals against, with their spread."""
    n = F.size(signals)
    mean = F.aggregate(signals, F.lit(0.0), lambda a, s: a + s["weight"] * s["confidence"]) / F.aggregate(signals, F.lit(0.0), lambda a, s: a + s["confidence"])
    against = F.size(F.filter(signals, lambda s: (s["weight"] >= 0.5) & (s["category"] != "positive"))) / n
    parts = F.array(score(signals), mean, against)
    centre = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 3
    spread = F.sqrt(F.aggregate(parts, F.lit(0.0), lambda a, x: a + (x - centre) * (x - centre)) / 3)
    return F.when(n > 0, F.struct((0.6 * score(signals) + 0.2 * mean + 0.2 * against).alias("value"), spread.alias("spread")))


def occurs(low: Column, pattern: str) -> Column:
    """Does one of the alternatives of ``pattern`` occur? Plain alternatives are looked for as strings, which is many times
    cheaper than a regular expression; only those with special signs go to one."""
    parts = pattern.split("|")
    plain = [p for p in parts if p.isascii() and all(c.isalnum() or c in " :/-" for c in p)]
    rest = [p for p in parts if p not in plain]
    tests = [low.contains(p) for p in plain] + ([low.rlike("|".join(rest))] if rest else [])
    return reduce(lambda x, y: x | y, tests)


def prepared(df: DataFrame, title: str, text: str) -> DataFrame:
    """``df`` with ``_both`` (title and text) and ``_low`` (in lower case), made once for all signals."""
    both = F.concat_ws(" ", F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    return df.withColumn("_both", both).withColumn("_low", F.lower("_both"))


def text_signals(both: Column, low: Column) -> list[Signal]:
    """A general registry over the text of a record (own patterns; pass another list for other domains). ``low`` is
    ``both`` in lower case."""
    words = matches(both, r"[^\s]+")
    has = lambda p: occurs(low, p)
    return [
        Signal("asks_for_payment", "red_flag", 0.9, 0.85, has("refundable deposit|registration charge|training charge|starter kit fee|equipment advance|background check payment|visa handling fee|courier bond")),
        Signal("asks_for_bank_access", "red_flag", 0.92, 0.88, has("bank login|bank details up front|form for bank data|request for passwords")),
        Signal("untraceable_payment", "red_flag", 0.88, 0.85, has("gift card|crypto|prepaid voucher|wire to a personal account|money sent through a stranger")),
        Signal("easy_money", "warning", 0.8, 0.75, has("earn while you sleep|easy money|no experience needed|daily pay")),
        Signal("skips_interview", "red_flag", 0.78, 0.8, has("no interview|offer before any interview")),
        Signal("moves_to_private_channel", "warning", 0.66, 0.68, has("private messenger|encrypted chat|chat app|unlisted group|text message only|voice note")),
        Signal("hurries", "warning", 0.6, 0.65, has("answer within [0-9]+ hours|only [0-9]+ seats left|expires in [0-9]+ hours|start tonight")),
        Signal("short_text", "warning", 0.55, 0.6, words < 20),
        Signal("shouting", "structural", 0.58, 0.55, (matches(both, "[A-Z]{4,}") >= 5) | (matches(both, "[!?]{2,}") >= 1)),
        Signal("carries_link", "structural", 0.52, 0.5, has("http://|https://")),
        Signal("states_requirements", "positive", 0.35, 0.7, has("knowledge of|you bring [0-9]+ years|experience with")),
        Signal("states_benefits", "positive", 0.3, 0.72, has("matched pension|health check|paid study days|childcare voucher|profit sharing")),
        Signal("describes_process", "positive", 0.32, 0.65, has("probation lasts|meets every candidate|round closes")),
    ]


def scored(df: DataFrame, key: str, title: str, text: str, signals: list[Signal] | None = None) -> DataFrame:
    """(key, signals, score, confidence, risk) of every row; null texts count as empty."""
    found = fired(signals or text_signals(F.col("_both"), F.col("_low")))
    rows = prepared(df, title, text).select(F.col(key), found.alias("signals"))
    return rows.select(key, "signals", score(F.col("signals")).alias("score"), confidence(F.col("signals")).alias("confidence")).withColumn("risk", risk(F.col("score")))


def interactions(signals: Column) -> Column:
    """Array of structs (a, b, effect) of every two signals of a row in the order of their names: what both together move
    the score beyond the sum of what each moves alone."""
    whole, n = total(signals), F.size(signals)

    def without(left: Column, *gone: Column) -> Column:
        return F.when(n == len(gone), 0.0).otherwise(sigmoid(left))

    def effect(x: Column, y: Column) -> Column:
        a, b = logit(x["weight"]), logit(y["weight"])
        return sigmoid(whole) - without(whole - a, x) - without(whole - b, y) + without(whole - a - b, x, y)

    ordered = F.array_sort(signals, lambda x, y: F.when(x["name"] < y["name"], -1).when(x["name"] > y["name"], 1).otherwise(0))
    pairs = F.transform(ordered, lambda x: F.transform(F.filter(ordered, lambda y: y["name"] > x["name"]), lambda y: F.struct(x["name"].alias("a"), y["name"].alias("b"), effect(x, y).alias("effect"))))
    return F.flatten(pairs)


def least_removals(signals: Column) -> Column:
    """The least number of signals whose removal brings a score of one half or more below one half; null where the score is
    lower already or no removals do. Log-odds add up, so taking the greatest first is optimal."""
    whole = total(signals)
    falling = F.reverse(F.array_sort(F.filter(F.transform(signals, lambda s: logit(s["weight"])), lambda w: w > 0)))
    state = F.aggregate(falling, F.struct(whole.alias("left"), F.lit(0).cast("long").alias("k")), lambda a, w: F.when(a["left"] >= -1e-9, F.struct((a["left"] - w).alias("left"), (a["k"] + 1).alias("k"))).otherwise(a))
    return F.when((F.size(signals) > 0) & (whole >= 0) & (state["left"] < -1e-9), state["k"])
