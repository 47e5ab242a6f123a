"""Problem 2: mixed timestamp formats and zones to one UTC instant.

Every value is read under every format whose shape and calendar allow it. A value that only one format allows is an
observation of its source's habits; one that several allow (month or day first) is shared out: expectation-maximisation
over the formats of each source alternates between posteriors per combination of allowed formats and mixture weights.
Only the counts per (source, combination) enter, so the state is tiny whatever the table. A stated date order of the
source rules the other order out beforehand. The likeliest reading is taken; below ``certain`` the value is marked
ambiguous and gets no instant.

Clock times without zone are on the source's clock. A time that was skipped or occurs twice takes the offset before the
change; a zone abbreviation picks standard or daylight time of the source's zone.

Results: null, blank, meaningless and impossible values have a null instant; rows of an unknown source keep only values
that name their zone or are absolute; years outside 1900..2200 are impossible; repeated rows are resolved alike.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.session import written

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Abbreviations of daylight time; all others are the zone's standard time (fixed values).
DAYLIGHT = ("EDT", "CDT", "MDT", "PDT", "AKDT", "ADT", "NDT", "BST", "CEST", "EEST", "WEST", "AEDT", "ACDT", "NZDT", "IDT", "HDT")
UNIVERSAL = ("Z", "UTC", "GMT", "UT")
FORMATS = ("iso", "compact", "epoch", "dotted", "month_first", "day_first", "named_dmy", "named_mdy", "relative")
#: Rows of the table of posteriors that are broadcast; a longer one is joined by a shuffle.
MAX_BROADCAST_ROWS = 100_000

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_ZONE = r"(Z|UTC|GMT|UT|[+-]\d{2}:?\d{2}|[A-Z]{2,5})?(?:\[[A-Za-z_/+-]+\])?"
#: Shapes by format; groups as named in _GROUPS (fixed values).
_SHAPES = {
    "iso": rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:[T ]{_CLOCK}\s*{_ZONE})?$",
    "compact": r"^(\d{4})(\d{2})(\d{2})(?:T(\d{2})(\d{2})(\d{2})(?:\.(\d{1,9}))?\s*(Z|[+-]\d{2}:?\d{2})?)?$",
    "dotted": rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:,?\s+{_CLOCK}\s*{_ZONE})?$",
    "slashed": rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,?\s+{_CLOCK}\s*([AaPp]\.?[Mm]\.?)?\s*{_ZONE})?$",
    "named_dmy": rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})\s+([A-Za-z]{{3,9}})\.?,?\s+(\d{{4}})(?:,?\s+{_CLOCK}\s*([AaPp]\.?[Mm]\.?)?\s*{_ZONE})?$",
    "named_mdy": rf"^(?:[A-Za-z]{{3,9}},\s+)?([A-Za-z]{{3,9}})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})(?:,?\s+{_CLOCK}\s*([AaPp]\.?[Mm]\.?)?\s*{_ZONE})?$",
}
_GROUPS = {
    "iso": "ymdhisfz",
    "compact": "ymdhisfz",
    "dotted": "dmyhisfz",
    "slashed": "12yhisfaz",
    "named_dmy": "dbyhisfaz",
    "named_mdy": "bdyhisfaz",
}
_AGO = r"(?i)^(?:posted\s+)?(\d+|an?|one)\+?\s+(second|sec|minute|min|hour|hr|day|week|month|year)s?\s+ago$"
_NOW = r"(?i)^(?:just\s+(?:now|posted)|now|(?:posted\s+)?today)$"
_YESTERDAY = r"(?i)^(?:posted\s+)?yesterday$"
DAY = 86_400_000_000
#: Seconds from 1970 to the end of the year 2200; later instants, and phrases of 100,000 units and more, are impossible.
LAST_SECOND = 7_289_654_400
#: Microseconds by unit of a relative phrase (fixed values).
UNITS = {"sec": 1_000_000, "min": 60_000_000, "hou": 3_600_000_000, "hr": 3_600_000_000, "day": DAY, "wee": 7 * DAY, "mon": 30 * DAY, "yea": 365 * DAY}


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970 of a date, null when it isn't in the calendar."""
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    longest = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.when(y.between(1900, 2200) & m.between(1, 12) & (d >= 1) & (d <= longest), F.unix_date(F.make_date(y, m, d)).cast("long"))


def _clock(h: Column, m: Column, s: Column, fraction: Column, half: Column) -> Column:
    """Microseconds of the day; midnight without a time, null when the time is impossible."""
    hour = F.when(half == "", h).when(h.between(1, 12), h % 12 + F.when(F.lower(F.substring(half, 1, 1)) == "p", 12).otherwise(0))
    micros = F.when(fraction == "", 0).otherwise(F.rpad(F.substring(fraction, 1, 6), 6, "0").cast("int"))
    return F.when((hour <= 23) & (m <= 59) & (s <= 59), ((hour * 60 + m) * 60 + s).cast("long") * 1_000_000 + micros)


def _to_utc(local: Column, zone: Column) -> Column:
    """From microseconds on a zone's clock; the offset before the change where the clock time is skipped or doubled."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), zone))


def _chain(pairs: list[tuple[Column, Column]], otherwise: Column) -> Column:
    return reduce(lambda c, p: c.when(*p), pairs, F.when(F.lit(False), otherwise)).otherwise(otherwise)


def readings(rows: DataFrame) -> DataFrame:
    """From (row_id, v, source, zone, date_order, ref): row_id, source and microseconds since 1970 UTC under each format,
    null where it doesn't allow the value. Every step is a projection of its own, so no part is evaluated twice."""
    value = F.trim(F.regexp_replace("v", r"\s+", " "))
    step = rows.select("row_id", "source", "zone", "date_order", "ref", value.alias("v"))
    step = step.withColumn("shape", _chain([(F.col("v").rlike(p), F.lit(name)) for name, p in _SHAPES.items()], F.lit(None).cast("string")))

    def part(group: str) -> Column:
        return _chain([(F.col("shape") == name, F.regexp_extract("v", _SHAPES[name], groups.index(group) + 1)) for name, groups in _GROUPS.items() if group in groups], F.lit(""))

    step = step.withColumns({f"p_{g}": part(g) for g in "ymdb12hisfaz"})

    def number(text: str, missing: int | None = None) -> Column:
        return F.when(F.col(text) != "", F.col(text).cast("int")).otherwise(F.lit(missing).cast("int"))

    month = reduce(lambda c, i: c.when(F.lower(F.substring("p_b", 1, 3)) == MONTHS[i], i + 1), range(12), F.when(F.lit(False), 0))
    first, second = number("p_1"), number("p_2")
    step = step.withColumns(
        {
            "y": number("p_y"),
            "m": F.coalesce(F.when(F.col("p_b") != "", month).otherwise(number("p_m")), first),
            "d": F.coalesce(number("p_d"), second),
            "time": _clock(number("p_h", 0), number("p_i", 0), number("p_s", 0), F.col("p_f"), F.col("p_a")),
            "mark": F.regexp_replace("p_z", ":", ""),
        }
    )
    # One reading as written (month first for slashes), one with day and month exchanged (slashes only).
    step = step.withColumns({"days": _days(F.col("y"), F.col("m"), F.col("d")), "turned": F.when(F.col("shape") == "slashed", _days(F.col("y"), F.col("d"), F.col("m")))})
    # Standard and daylight offset of the zone in that year: the smaller and the larger of January's and July's.
    at = [F.unix_date(F.make_date(F.when(F.col("y").between(1900, 2200), F.col("y")), F.lit(m), F.lit(1))).cast("long") * DAY for m in (1, 7)]
    named = (F.col("mark") != "") & ~F.col("mark").isin(*UNIVERSAL) & ~F.col("mark").rlike(r"^[+-]\d{4}$")
    step = step.withColumns({f"a{i}": F.when(named, a) for i, a in enumerate(at)})
    step = step.withColumns({f"s{i}": F.col(f"a{i}") - _to_utc(F.col(f"a{i}"), F.col("zone")) for i in (0, 1)})
    minutes = (F.substring("mark", 2, 2).cast("int") * 60 + F.substring("mark", 4, 2).cast("int")).cast("long") * F.when(F.col("mark").startswith("-"), -1).otherwise(1)
    shift = (
        F.when(F.col("mark").rlike(r"^[+-]\d{4}$"), minutes * 60_000_000)
        .when(F.col("mark").isin(*UNIVERSAL), F.lit(0).cast("long"))
        .when(F.col("mark").isin(*DAYLIGHT), F.greatest("s0", "s1"))
        .when(F.col("mark") != "", F.least("s0", "s1"))
    )
    step = step.withColumns({"shift": shift, "local": F.col("days") * DAY + F.col("time"), "local_turned": F.col("turned") * DAY + F.col("time")})
    step = step.withColumns({f"utc_{c}": F.when(F.col("mark") == "", _to_utc(F.col(c), F.col("zone"))).otherwise(F.col(c) - F.col("shift")) for c in ("local", "local_turned")})

    digits = F.when(F.col("v").rlike(r"^\d{9,}$"), F.col("v").try_cast("long"))
    count, unit = F.regexp_extract("v", _AGO, 1), F.lower(F.substring(F.regexp_extract("v", _AGO, 2), 1, 3))
    size = _chain([(unit == u, F.lit(n).cast("long")) for u, n in UNITS.items()], F.lit(None).cast("long"))
    many = F.when(count.rlike(r"^\d+$"), count.try_cast("long")).when(~count.rlike(r"\d"), F.lit(1).cast("long"))
    back = F.when(F.col("v").rlike(_AGO), F.when(many < 100_000, many) * size).when(F.col("v").rlike(_NOW), F.lit(0).cast("long")).when(F.col("v").rlike(_YESTERDAY), F.lit(DAY).cast("long"))
    order = F.coalesce("date_order", F.lit(""))
    out = {
        "epoch": F.when(F.length("v") <= 11, F.when(digits < LAST_SECOND, digits) * 1_000_000).otherwise(F.when(digits < LAST_SECOND * 1000, digits) * 1000),
        "relative": F.when(back >= 0, F.unix_micros("ref") - back),
        "month_first": F.when((F.col("shape") == "slashed") & (order != "DMY"), F.col("utc_local")),
        "day_first": F.when((F.col("shape") == "slashed") & (order != "MDY"), F.col("utc_local_turned")),
    } | {f: F.when(F.col("shape") == f, F.col("utc_local")) for f in ("iso", "compact", "dotted", "named_dmy", "named_mdy")}
    return step.select("row_id", "source", *[out[f].alias(f) for f in FORMATS])


def mixture(counts: pd.DataFrame, certain: float, rounds: int = 200) -> pd.DataFrame:
    """EM for one source. counts: source, allowed (list of format numbers), rows. Returns the chosen format and its
    posterior for every combination."""
    allowed = [list(a) for a in counts["allowed"]]
    rows = counts["rows"].to_numpy(float)
    weight = {f: 1.0 for a in allowed for f in a}
    for _ in range(rounds):
        total = dict.fromkeys(weight, 1e-3)
        for a, n in zip(allowed, rows):
            s = sum(weight[f] for f in a)
            for f in a:
                total[f] += n * weight[f] / s
        scale = sum(total.values())
        new = {f: t / scale for f, t in total.items()}
        moved = max(abs(new[f] - weight[f]) for f in new)
        weight = new
        if moved < 1e-9:
            break
    best = [max(a, key=lambda f: (weight[f], -f)) for a in allowed]
    posterior = [weight[b] / sum(weight[f] for f in a) for a, b in zip(allowed, best)]
    return pd.DataFrame({"source": counts["source"], "allowed": counts["allowed"], "format": best, "posterior": posterior, "sure": [p >= certain for p in posterior]})


def resolved(df: DataFrame, key: str, value: str, source: str, feeds: DataFrame, reference: str | None = None, certain: float = 0.9) -> DataFrame:
    """(row_id, utc_us, format, posterior, ambiguous) of every row. ``feeds`` has source, zone and date_order (MDY, DMY or
    null when not known); ``reference`` is the timestamp column that relative phrases count back from."""
    rows = df.select(F.col(key).cast("long").alias("row_id"), F.col(value).alias("v"), F.col(source).alias("source"), (F.col(reference) if reference else F.lit(None).cast("timestamp")).alias("ref"))
    known = feeds.select("source", "zone", "date_order").dropDuplicates(["source"])
    # A broadcast keeps a source with a third of all rows from being one task; a long list of feeds is joined by a shuffle.
    rows = rows.join(F.broadcast(known) if known.count() <= MAX_BROADCAST_ROWS else known, "source", "left")
    # Written once: a filter on it would otherwise be pushed through all the projections and repeat them.
    read_rows = written(readings(rows), "readings")
    allowed = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.lit(i)) for i, f in enumerate(FORMATS)]))
    read_rows = read_rows.withColumn("allowed", allowed)
    counts = read_rows.where(F.size("allowed") > 0).groupBy("source", "allowed").agg(F.count("*").alias("rows"))
    schema = "source string, allowed array<int>, format int, posterior double, sure boolean"
    chosen = written(counts.groupBy("source").applyInPandas(lambda pdf: mixture(pdf, certain), schema), "formats")
    small = chosen.count() <= MAX_BROADCAST_ROWS
    picked = read_rows.alias("r").join(F.broadcast(chosen) if small else chosen, F.col("r.source").eqNullSafe(chosen.source) & (F.col("r.allowed") == chosen.allowed), "left")
    instant = F.element_at(F.array(*[F.col(f) for f in FORMATS]), F.col("format") + 1)
    name = F.element_at(F.array(*[F.lit(f) for f in FORMATS]), F.col("format") + 1)
    return picked.select("row_id", F.when(F.col("sure"), instant).alias("utc_us"), name.alias("format"), "posterior", (~F.col("sure")).alias("ambiguous"))
