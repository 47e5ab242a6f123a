"""Sources of postings: JSON with many spellings of its fields, pages of HTML, free text and labelled CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names under which sources deliver each field; the first that is present counts (fixed values).
ALIASES = {
    "url": "url link job_url jobUrl job_link".split(),
    "title": "title job_title jobTitle position role name".split(),
    "company": "company company_name companyName employer organization".split(),
    "location": "location city place jobLocation job_location".split(),
    "description": "description body content text details job_description jobDescription full_description".split(),
    "salary_min": "salary_min salaryMin min_salary salary_from compensation_min pay_min".split(),
    "salary_max": "salary_max salaryMax max_salary salary_to compensation_max pay_max".split(),
    "salary_currency": "salary_currency currency salaryCurrency pay_currency".split(),
    "salary": "salary pay compensation".split(),
    "posted_date": "posted_date postedDate date_posted datePosted date listed_at created_at".split(),
    "applicant_count": "applicant_count applicantCount applicants applications num_applicants".split(),
    "experience_level": "experience_level experienceLevel seniority level experience seniority_level".split(),
    "employment_type": "employment_type employmentType job_type jobType type work_type".split(),
    "industry": "industry sector job_function".split(),
    "company_size": "company_size companySize employees employee_count company_employees".split(),
    "company_linkedin_url": "company_linkedin_url companyLinkedinUrl company_url companyUrl org_url".split(),
    "recruiter_name": "recruiter_name recruiterName recruiter posted_by hiring_manager contact".split(),
    "is_remote": "is_remote isRemote remote work_from_home wfh remote_ok".split(),
    "is_repost": "is_repost isRepost repost reposted".split(),
    "source": "source platform origin".split(),
}
TRUE_WORDS = ("true", "yes", "1", "remote", "y")
CURRENCIES = {"£": "GBP", "€": "EUR", "₹": "INR", "$": "USD"}


def _picked(fields: Column, names: list[str]) -> Column:
    """The value of the first name that is a key of the map, even an empty one."""
    out = F.lit(None).cast("string")
    for name in reversed(names):
        out = F.when(F.map_contains_key(fields, name), F.element_at(fields, name)).otherwise(out)
    return out


def posting_columns(fields: Column) -> list[Column]:
    """Typed posting columns from a map of delivered fields; missing text is '', missing numbers 0. Where no lowest pay is
    delivered, a written salary gives both bounds and the currency."""
    get = lambda name: F.coalesce(_picked(fields, ALIASES[name]), F.lit(""))
    text = [get(c).alias(c) for c in ("url", "title", "company", "location", "description", "posted_date", "industry", "company_size", "company_linkedin_url", "recruiter_name", "source")]
    low = [F.lower(get(c)).alias(c) for c in ("experience_level", "employment_type")]
    number = lambda name: F.coalesce(F.regexp_replace(get(name), "[^0-9.]", "").try_cast("double"), F.lit(0.0))
    least, most, said = number("salary_min"), number("salary_max"), pay_in_text(get("salary"))
    bare = (least == 0) & (said["low"] > 0)
    currency = F.coalesce(*[F.when(get("salary").contains(sign), code) for sign, code in CURRENCIES.items()], F.upper(get("salary_currency")))
    pay = [F.when(bare, said["low"]).otherwise(least).alias("salary_min"), F.when(bare, said["high"]).otherwise(most).alias("salary_max"), F.when(bare, currency).otherwise(F.upper(get("salary_currency"))).alias("salary_currency")]
    flags = [F.lower(F.trim(get(c))).isin(*TRUE_WORDS).alias(c) for c in ("is_remote", "is_repost")]
    return [*text, *low, *pay, F.coalesce(get("applicant_count").try_cast("int"), F.lit(0)).alias("applicant_count"), *flags]


def from_json_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Postings from one JSON object a line; lines that aren't objects are left out."""
    fields = F.from_json(column, T.MapType(T.StringType(), T.StringType()))
    return lines.select(fields.alias("f")).where("f is not null and size(f) > 0").select(*posting_columns(F.col("f")))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Postings from files that hold a JSON array, one object, or an object a line. Files of lines are split and read line
    by line; only a file whose first sign is '[', or whose first line isn't an object of its own, is read whole."""
    fields = T.MapType(T.StringType(), T.StringType())
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
    # The first line of a file tells its kind; it stands in the file's first block.
    heads = lines.where((F.col("at") == 0) & (F.trim("value") != "")).groupBy("file").agg(F.first("value").alias("head"))
    whole_files = heads.where(F.ltrim("head").startswith("[") | (F.ltrim("head").startswith("{") & ~F.rtrim("head").endswith("}"))).select("file")
    single = lines.join(whole_files, "file", "left_anti").select(F.from_json("value", fields).alias("f"))
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value").join(whole_files, "file", "left_semi")
    many = F.when(F.ltrim("value").startswith("["), F.from_json("value", T.ArrayType(fields))).otherwise(F.array(F.from_json("value", fields)))
    rows = single.unionByName(text.select(F.explode(many).alias("f")))
    return rows.where("f is not null and size(f) > 0").select(*posting_columns(F.col("f")))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labelled CSV with header: (url string, is_scam int); rows without a 0/1 label are left out."""
    rows = spark.read.schema("url string, is_scam string").csv(path, header=True, enforceSchema=False)
    return rows.select(F.trim("url").alias("url"), F.trim("is_scam").try_cast("int").alias("is_scam")).where("is_scam in (0, 1) and url != ''")


_LD = r"(?is)<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
_LD_SCHEMA = "struct<`@type`:string,title:string,description:string,datePosted:string,employmentType:string,hiringOrganization:struct<name:string>,jobLocation:struct<address:struct<addressLocality:string,addressRegion:string>>>"


def plain_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles and tags removed, common entities resolved, white space squeezed."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def from_html(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(url, title, company, location, description, posted_date, way) of pages: from the first JobPosting block of linked
    data if there is one, else from the title, headings and visible text."""
    blocks = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(_LD), F.lit(1))
    parsed = F.flatten(F.transform(blocks, lambda b: F.when(F.ltrim(b).startswith("["), F.from_json(b, f"array<{_LD_SCHEMA}>")).otherwise(F.array(F.from_json(b, _LD_SCHEMA)))))
    job = F.get(F.filter(parsed, lambda j: j["@type"] == "JobPosting"), F.lit(0))
    rows = pages.select(F.col(url).alias("url"), F.col(html).alias("html"), job.alias("ld"))
    head = F.coalesce(F.nullif(plain_text(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1)), F.lit("")), plain_text(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)))
    pick = lambda ld, other: F.coalesce(ld, other)
    return rows.select(
        "url",
        pick(F.col("ld.title"), head).alias("title"),
        pick(F.col("ld.hiringOrganization.name"), F.lit("")).alias("company"),
        pick(F.nullif(F.concat_ws(", ", "ld.jobLocation.address.addressLocality", "ld.jobLocation.address.addressRegion"), F.lit("")), F.lit("")).alias("location"),
        F.when(F.col("ld.description").isNotNull(), plain_text(F.col("ld.description"))).otherwise(plain_text(F.col("html"))).alias("description"),
        pick(F.col("ld.datePosted"), F.lit("")).alias("posted_date"),
        F.when(F.col("ld").isNotNull(), "linked_data").otherwise("text").alias("way"),
    )


_NUMBER = r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*([kK]?)"


def pay_in_text(text: Column) -> Column:
    """Struct (low, high, period) of the first range or amount with a currency sign in a text; 0 when there is none.
    Amounts are as written, 'k' meaning thousands."""
    t = F.coalesce(text, F.lit(""))
    span = rf"[$£€]\s*{_NUMBER}\s*(?:-|–|to)\s*[$£€]?\s*{_NUMBER}"
    one = rf"[$£€]\s*{_NUMBER}"

    def amount(pattern: str, number: int, thousands: int) -> Column:
        digits = F.regexp_replace(F.regexp_extract(t, pattern, number), ",", "").try_cast("double")
        return F.coalesce(digits * F.when(F.regexp_extract(t, pattern, thousands) != "", 1000).otherwise(1), F.lit(0.0))

    ranged = t.rlike(span)
    after = F.lower(F.regexp_extract(t, rf"(?:{span}|{one})[^.\n]*", 0))
    period = F.when(after.rlike("hour|/ ?hr|/ ?h\\b"), "hour").when(after.rlike("day"), "day").when(after.rlike("week"), "week").when(after.rlike("month|/ ?mo"), "month").otherwise("year")
    low = F.when(ranged, amount(span, 1, 2)).otherwise(amount(one, 1, 2))
    high = F.when(ranged, amount(span, 3, 4)).otherwise(amount(one, 1, 2))
    return F.struct(low.alias("low"), high.alias("high"), F.when(low > 0, period).alias("period"))


def write_partitioned(df: DataFrame, path: str, by: str, files: int = 1) -> None:
    """Parquet sink by a column of few values; the rows of one value are spread over ``files`` files, so a value with a
    third of all rows isn't one task."""
    df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(files))).repartition(F.col(by), F.col("_salt")).drop("_salt").write.mode("overwrite").partitionBy(by).parquet(path)
