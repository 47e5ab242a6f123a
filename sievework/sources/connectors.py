"""Saved responses of job boards as postings: every board is a declaration of where its records and fields stand."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.sources.postings import plain_text

TEXT_FIELDS = ("url", "title", "company", "location", "description", "posted_date", "experience_level", "employment_type", "industry")
#: Per board: the path of the list of records ('' when the response is the list), and the path of each field in a record.
#: 'a[].b' joins the b of every element by ', '; 'a[0].b' is the first; 'a+b' joins two paths; '=x' is a constant and
#: 'path|x' the value of a path or else x (fixed values: the boards' own field names).
BOARDS: dict[str, tuple[str, dict[str, str]]] = {
    "remoteok": ("", {"url": "url", "title": "position", "company": "company", "location": "location|Remote", "description": "description", "salary_min": "salary_min", "salary_max": "salary_max", "posted_date": "date", "is_remote": "=true"}),
    "adzuna": ("results", {"url": "redirect_url", "title": "title", "company": "company.display_name", "location": "location.display_name", "description": "description", "salary_min": "salary_min", "salary_max": "salary_max", "posted_date": "created"}),
    "themuse": ("results", {"url": "refs.landing_page", "title": "name", "company": "company.name", "location": "locations[].name", "description": "contents", "experience_level": "levels[0].name", "posted_date": "publication_date"}),
    "usajobs": ("SearchResult.SearchResultItems", {f: p and f"MatchedObjectDescriptor.{p}" for f, p in {"url": "PositionURI", "title": "PositionTitle", "company": "OrganizationName", "location": "PositionLocation[].LocationName", "description": "QualificationSummary", "salary_min": "PositionRemuneration[0].MinimumRange", "salary_max": "PositionRemuneration[0].MaximumRange", "posted_date": "PublicationStartDate"}.items()}),
    "remotive": ("jobs", {"url": "url", "title": "title", "company": "company_name", "location": "candidate_required_location|Remote", "description": "description", "posted_date": "publication_date", "industry": "category", "is_remote": "=true"}),
    "greenhouse": ("jobs", {"url": "absolute_url", "title": "title", "location": "location.name", "description": "content", "posted_date": "updated_at"}),
    "lever": ("", {"url": "hostedUrl", "title": "text", "location": "categories.location", "description": "description", "posted_date": "createdAt", "industry": "categories.team"}),
    "ashby": ("jobs", {"url": "jobUrl", "title": "title", "location": "location", "description": "descriptionHtml", "posted_date": "publishedAt", "employment_type": "employmentType"}),
    "smartrecruiters": ("content", {"url": "ref", "title": "name", "company": "company.name", "location": "location.city+location.country", "posted_date": "releasedDate"}),
}


def _at(record: Column, path: str) -> Column:
    """The text at a path of the small language of BOARDS; '' where there is none."""
    if path.startswith("="):
        return F.lit(path[1:])
    path, _, other = path.partition("|")
    if "+" in path:
        return F.concat_ws(", ", *[F.nullif(_at(record, p), F.lit("")) for p in path.split("+")])
    if "[]" in path:
        head, _, tail = path.partition("[].")
        items = F.from_json(F.get_json_object(record, f"$.{head}"), "array<string>")
        return F.coalesce(F.concat_ws(", ", F.transform(items, lambda x: F.get_json_object(x, f"$.{tail}"))), F.lit(other))
    return F.coalesce(F.nullif(F.get_json_object(record, f"$.{path}"), F.lit("")), F.lit(other))


def from_responses(responses: DataFrame, board: str, column: str = "value", company: Column | None = None) -> DataFrame:
    """Postings from saved responses of a board, one response a row. Records without a title and a url (such as the notice at
    the head of some lists) are left out; HTML becomes text; salaries that are no numbers are 0; dates in milliseconds become
    UTC days. ``company`` is the firm of boards that belong to one."""
    where, fields = BOARDS[board]
    body = F.col(column) if not where else F.get_json_object(column, f"$.{where}")
    records = responses.select(F.explode(F.from_json(body, "array<string>")).alias("r"), *([company.alias("_company")] if company is not None else []))
    text = {f: _at(F.col("r"), fields[f]) if f in fields else F.lit("") for f in TEXT_FIELDS}
    text["description"] = plain_text(text["description"])
    text["posted_date"] = F.when(text["posted_date"].rlike(r"^\d{12,13}$"), F.date_format(F.timestamp_millis(text["posted_date"].try_cast("long")), "yyyy-MM-dd")).otherwise(text["posted_date"])
    if company is not None:
        text["company"] = F.coalesce(F.nullif(text["company"], F.lit("")), F.col("_company"))
    pay = [F.coalesce(_at(F.col("r"), fields[f]).try_cast("double"), F.lit(0.0)).alias(f) if f in fields else F.lit(0.0).alias(f) for f in ("salary_min", "salary_max")]
    remote = F.lit(fields.get("is_remote") == "=true") | text["location"].ilike("%remote%")
    return records.select(*[c.alias(f) for f, c in text.items()], *pay, remote.alias("is_remote"), F.lit(board).alias("source")).where("title != '' or url != ''")


def read_board(spark: SparkSession, path: str, board: str, company: str | None = None) -> DataFrame:
    """Postings from files of saved responses, one response a file."""
    return from_responses(spark.read.text(path, wholetext=True), board, company=None if company is None else F.lit(company))


def matching(postings: DataFrame, words: str, location: str = "", columns: tuple[str, ...] = ("title", "company", "description")) -> DataFrame:
    """Postings that hold every word of a search in one of the columns, and the place in their location."""
    low = F.lower(F.concat_ws(" ", *columns))
    hit = reduce(lambda a, w: a & low.contains(w), words.lower().split(), F.lit(True))
    return postings.where(hit & F.lower("location").contains(location.lower()))
