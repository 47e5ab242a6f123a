"""Text functions as Column expressions (JVM-side, code-generated)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Look-alike characters and what they stand for (fixed values).
LOOKALIKES = ("аеорсухіјѕԁɡАВЕКМНОРСТХ", "aeopcyxijsdgABEKMHOPCTX")
#: Characters without width (fixed values).
INVISIBLE = "​‌‍⁠﻿­"


def squeezed(text: Column) -> Column:
    """Lower case, runs of white space as one space, no outer space; null is empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def unmasked(text: Column) -> Column:
    """Text without invisible characters, look-alike letters replaced, long runs of one character cut to two."""
    visible = F.translate(F.translate(F.coalesce(text, F.lit("")), INVISIBLE, ""), *LOOKALIKES)
    return F.trim(F.regexp_replace(F.regexp_replace(visible, r"(.)\1{2,}", "$1$1"), r"\s+", " "))


def tokens(text: Column) -> Column:
    """Lower-cased ASCII words."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """How many times ``pattern`` occurs; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def sentences(text: Column) -> Column:
    """How many sentence ends there are, at least 1 for a text with words."""
    return F.greatest(F.lit(1), matches(text, r"[.!?]+(\s|$)"))


def syllables(text: Column) -> Column:
    return matches(F.lower(text), "[aeiouy]+")


def grade_level(text: Column) -> Column:
    """Flesch-Kincaid grade from words, sentences and vowel groups; null without words."""
    words = F.size(tokens(text))
    return F.when(words > 0, 0.39 * words / sentences(text) + 11.8 * syllables(text) / words - 15.59)


def lexical_variety(text: Column, first: int = 200) -> Column:
    """Different words over words, among the first ``first`` words."""
    head = F.slice(tokens(text), 1, first)
    return F.when(F.size(head) > 0, F.size(F.array_distinct(head)) / F.size(head))


def ngrams(words: Column, n: int) -> Column:
    """All runs of ``n`` neighbouring words, joined by spaces. The words are bound to a variable first: inside a lambda the
    expression itself would be computed again for every run."""

    def runs(w: Column) -> Column:
        last = F.size(w) - n + 1
        every = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(last >= 1, every).otherwise(F.array().cast("array<string>"))

    return F.get(F.transform(F.array(words), runs), F.lit(0))


def char_shingles(text: Column, k: int) -> Column:
    """Distinct runs of ``k`` characters of the squeezed text; the text itself when it is shorter, nothing when empty."""
    t = squeezed(text)
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - k + 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(k))))
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(runs)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) > 0, both / (F.size(F.array_union(a, b)))).otherwise(F.lit(0.0))


def content_hash(text: Column) -> Column:
    return F.sha2(squeezed(text), 256)


def domain_of(url: Column) -> Column:
    """Host of a url in lower case without port and www; empty when there is none."""
    host = F.regexp_extract(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]+)", 1)
    return F.regexp_replace(host, r"^www\.", "")


def top_level(domain: Column) -> Column:
    return F.substring_index(domain, ".", -1)


def first_case(text: Column, cases: list[tuple[str, str]], otherwise: str) -> Column:
    """The name of the first pattern that occurs in the lower-cased text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda c, p: c.when(low.rlike(p[1]), p[0]), cases[1:], F.when(low.rlike(cases[0][1]), cases[0][0])).otherwise(otherwise)


#: Levels of experience by the words that state them, most senior first (own wording).
LEVELS = [("executive", r"\b(chief|vp|vice president|director|head of)\b"), ("lead", r"\b(lead|principal|staff)\b"), ("senior", r"\b(senior|sr)\b"), ("entry", r"\b(junior|jr|trainee|intern|graduate|entry)\b")]
#: Kinds of employment by their words (own wording).
EMPLOYMENT = [("contract", r"contract|freelance"), ("part_time", r"part.?time"), ("temporary", r"\btemp(orary)?\b|seasonal"), ("internship", r"intern"), ("full_time", r"full.?time|permanent")]


def experience_level(text: Column) -> Column:
    return first_case(text, LEVELS, "mid")


def employment_type(text: Column) -> Column:
    return first_case(text, EMPLOYMENT, "unknown")


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
URL = r"https?://[^\s<>()\"']+"


def emails(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(EMAIL), F.lit(0)), F.lower)))


def urls(text: Column) -> Column:
    """Distinct links in the order they appear, without closing punctuation."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(URL), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:!?]+$", "")))


def days_ago(text: Column) -> Column:
    """Days that a phrase such as '3 weeks ago' counts back (week 7, month 30), or null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    n = F.regexp_extract(low, r"(\d+)\s*(day|week|month|hour|minute)s?\s+ago", 1)
    unit = F.regexp_extract(low, r"(\d+)\s*(day|week|month|hour|minute)s?\s+ago", 2)
    size = F.when(unit == "day", 1).when(unit == "week", 7).when(unit == "month", 30).otherwise(0)
    return F.when(n != "", n.cast("int") * size).when(low.rlike("today|just (now|posted)"), 0).when(low.rlike("yesterday"), 1)


def unleet(word: Column) -> Column:
    """A word whose digits and signs stand for letters, with the letters; words without letters stay."""
    return F.when(word.rlike("[A-Za-z]") & word.rlike("[013457@$]"), F.translate(word, "013457@$", "oieastas")).otherwise(word)
