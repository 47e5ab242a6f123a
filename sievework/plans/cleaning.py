"""Queries of the two general problems: instants (p2) and yearly amounts (p7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import timestamps, units
from sievework.session import ship, table


def _instants(spark: SparkSession, root: str) -> DataFrame:
    feeds = table(ship(spark), root, "feeds", "source", "zone", "date_order")
    jobs = timestamps.resolved(table(spark, root, "jobs", "id", "analyzed_at", "source"), "id", "analyzed_at", "source", feeds)
    postings = timestamps.resolved(table(spark, root, "postings", "posting_id", "posted_date", "source", "fetched_at"), "posting_id", "posted_date", "source", feeds, "fetched_at")
    return jobs.withColumn("tbl", F.lit("jobs")).unionByName(postings.withColumn("tbl", F.lit("postings")))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return _instants(spark, root).where(F.col("utc_us").isNotNull()).select("tbl", "row_id", "utc_us").distinct()


def p2_habits(spark: SparkSession, root: str) -> DataFrame:
    """How often each format was chosen."""
    return _instants(spark, root).groupBy("tbl", "format").agg(F.count("*").alias("n"), F.count("utc_us").alias("resolved"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    jobs = table(ship(spark), root, "jobs", "id", "salary_min", "salary_max", "salary_currency", "description")
    # Without any statement the amount is whole units a year, so the prior has that unit only.
    found = units.yearly(jobs, "id", "salary_min", "salary_max", "salary_currency", "description", prior={"year": 1.0})
    return found.select("id", "currency", "year_min", "year_max")


def p7_uncertain(spark: SparkSession, root: str) -> DataFrame:
    """Amounts whose unit the mixture can't tell, with open priors."""
    jobs = table(ship(spark), root, "jobs", "id", "salary_min", "salary_max", "salary_currency", "description")
    found = units.yearly(jobs, "id", "salary_min", "salary_max", "salary_currency", "description")
    return found.groupBy("currency", "unit", "uncertain").agg(F.count("*").alias("n"))


QUERIES = {"p2_found": p2_found, "p2_habits": p2_habits, "p7_found": p7_found, "p7_uncertain": p7_uncertain}


# ---- oracle SQL -------------------------------------------------------------------------------------------------


def _case(text: str, options: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN {v}" for p, v in options) + " END"


_CUR = [(r"a\$|aud|australian dollar", "'AUD'"), (r"c\$|cad|canadian dollar", "'CAD'"), ("zł|pln|zlot", "'PLN'"), (r"inr|₹|rupee|\blpa\b|(^|[^a-z])k?rs\b", "'INR'"), ("gbp|£|pound|sterling|pence|penny", "'GBP'"), ("eur|€", "'EUR'"), (r"usd|\$|dollar", "'USD'")]
_SCALE = [("crore", "1e7"), (r"lakh|\blacs?\b|\blpa\b", "1e5"), (r"thousand|''000|,000s|\b000s|(^|[^a-z])k([^a-z]|$)|(^|[^a-z])k(usd|gbp|eur|aud|cad|pln|inr|rs|us\$|a\$|c\$)", "1e3"), (r"\bcents?\b|pence|penny", "1e-2")]
_PERIOD = [(r"hour|/\s*hr?\b|\bp\.?\s?h\b", "2080"), (r"\bday|daily|/\s*d\b|\bp\.?\s?d\b", "260"), (r"week|/\s*wk\b|\bp\.?\s?w\b", "52"), (r"month|/\s*mo\b|\bpcm\b|\bp\.?\s?m\b", "12"), (r"year|annual|annum|/\s*yr\b|\bp\.?\s?a\b|\blpa\b", "1")]
# The sentence about pay is found by parting the text, not by the operator's pattern.
_CUE = r"\b(?:pay|salary|salaries|compensation|amount|amounts|figures|numbers|range|rate|rates|wage|wages)\b"
_MONEY = r"\b(?:usd|gbp|eur|inr|aud|cad|pln|dollars?|euros?|pounds?|pence|cents?|rupees?|lakhs?|zlot(?:y|ys|ych)|lpa)\b|[$£€₹]|zł"
P7 = f"""
WITH j AS (SELECT id, CASE WHEN salary_min > 0 AND NOT isnan(salary_min) THEN salary_min ELSE 0 END AS a, CASE WHEN salary_max > 0 AND NOT isnan(salary_max) THEN salary_max ELSE 0 END AS b, lower(trim(coalesce(salary_currency, ''))) AS u, description AS t FROM jobs),
k AS (SELECT *, {_case("u", _CUR)} AS uc, {_case("u", _SCALE)} AS us, {_case("u", _PERIOD)} AS up FROM j WHERE a > 0 OR b > 0),
n AS (SELECT *, us IS NULL AND up IS NULL AS bare, coalesce(regexp_extract(list_filter(regexp_split_to_array(lower(coalesce(t, '')), '[.!?\n]'), lambda x: regexp_matches(x, '{_CUE}.*({_MONEY})'))[1], '{_CUE}.*$', 0), '') AS n FROM k),
f AS (SELECT id, a, b, coalesce(uc, {_case("n", _CUR)}) AS currency, (CASE WHEN bare THEN coalesce({_case("n", _SCALE)}, 1) ELSE coalesce(us, 1) END) * (CASE WHEN bare THEN coalesce({_case("n", _PERIOD)}, 1) ELSE coalesce(up, 1) END) AS x FROM n)
SELECT id, currency, CAST(round(a * x) AS BIGINT) AS year_min, CAST(round(b * x) AS BIGINT) AS year_max FROM f WHERE currency IS NOT NULL"""
SQL = {"p7_found": P7}
