"""How a score bears changes of its text: seeded perturbations and ablation of keywords."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters and the signs that stand in for them (fixed values).
STAND_INS = {"a": "@", "e": "3", "i": "1", "o": "0", "s": "$"}


def perturbed(text: str, kind: str, r: random.Random) -> str:
    """One changed form of a text; the same seed gives the same form."""
    if not text:
        return text
    chars = list(text)
    i = r.randrange(len(chars))
    if kind == "swap" and len(chars) > 1:
        i = min(i, len(chars) - 2)
        chars[i], chars[i + 1] = chars[i + 1], chars[i]
    elif kind == "insert":
        chars.insert(i, r.choice("abcdefghijklmnopqrstuvwxyz"))
    elif kind == "delete":
        del chars[i]
    elif kind == "case":
        return "".join(c.upper() if r.random() < 0.3 else c for c in text)
    elif kind == "signs":
        return "".join(STAND_INS.get(c, c) if r.random() < 0.5 else c for c in text)
    elif kind == "spaces":
        return "".join(c + " " if c.isalpha() and r.random() < 0.1 else c for c in text)
    elif kind == "order":
        parts = text.split(". ")
        r.shuffle(parts)
        return ". ".join(parts)
    return "".join(chars)


KINDS = ("swap", "insert", "delete", "case", "signs", "spaces", "order")


def variants(df: DataFrame, key: str, text: str, n: int = 2, kinds: tuple[str, ...] = KINDS, seed: int = 0) -> DataFrame:
    """(key, kind, number, text): the text itself (kind 'original') and ``n`` forms of each kind. Seeded by key, so every
    run gives the same; null texts have no forms."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, t in zip(frame[key], frame[text]):
                if t is None:
                    continue
                out.append((k, "original", 0, t))
                r = random.Random(f"{seed}/{k}")
                out += [(k, kind, i, perturbed(t, kind, r)) for kind in kinds for i in range(n)]
            yield pd.DataFrame(out, columns=[key, "kind", "number", text])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, kind string, number int, `{text}` string")


def robustness(forms: DataFrame, key: str, score: Column) -> DataFrame:
    """Per key the score of the original, and mean, spread, least and largest score of its forms."""
    rows = forms.select(key, "kind", score.alias("s"))
    return rows.groupBy(key).agg(F.max(F.when(F.col("kind") == "original", F.col("s"))).alias("original"), F.avg(F.when(F.col("kind") != "original", F.col("s"))).alias("mean"), F.stddev_samp(F.when(F.col("kind") != "original", F.col("s"))).alias("spread"), F.min(F.when(F.col("kind") != "original", F.col("s"))).alias("least"), F.max(F.when(F.col("kind") != "original", F.col("s"))).alias("most"))


def survival(forms: DataFrame, key: str, fires: dict[str, Column]) -> DataFrame:
    """(signal, kind, kept): of the rows whose original fires a signal, the share of forms of each kind that still do."""
    rows = forms.select(key, "kind", *[F.coalesce(c, F.lit(False)).cast("int").alias(n) for n, c in fires.items()])
    base = rows.where("kind = 'original'").select(key, *[F.col(n).alias(f"o_{n}") for n in fires])
    both = rows.where("kind != 'original'").join(base, key)
    stacked = both.select("kind", F.explode(F.array(*[F.struct(F.lit(n).alias("signal"), F.col(n).alias("now"), F.col(f"o_{n}").alias("then")) for n in fires])).alias("x"))
    return stacked.where("x.then = 1").groupBy("x.signal", "kind").agg(F.avg("x.now").alias("kept"))


def ablation(df: DataFrame, key: str, text: str, words: list[str], score: Callable[[Column], Column]) -> DataFrame:
    """(key, word, fall): how much a score falls when a word is taken out of the text; only words that occur."""
    rows = df.select(key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("t")).withColumn("s", score(F.col("t")))
    tries = rows.select(key, "t", "s", F.explode(F.array(*[F.lit(w) for w in words])).alias("word")).where(F.col("t").contains(F.col("word")))
    return tries.withColumn("u", F.replace("t", F.col("word"), F.lit(""))).select(key, "word", (F.col("s") - score(F.col("u"))).alias("fall"))
