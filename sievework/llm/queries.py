"""The pN_ queries of the problems tagged llm, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.session import shared_dir, ship, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """All batches of jobs, one after another, through a history of hashes in the shared folder. A bucket takes about
    250,000 rows of jobs (some 15 hashes a row)."""
    import uuid

    from sievework.llm.history import repeats_by_batch

    jobs = table(ship(spark), root, "jobs", "id", "batch_no", "source", "url", "external_id", "description")
    buckets = max(8, -(-table(spark, root, "jobs").count() // 250_000))
    return repeats_by_batch(jobs, f"{shared_dir(spark)}/sievework/history-{uuid.uuid4().hex}", buckets=buckets)


def _findings(spark: SparkSession, root: str) -> DataFrame:
    from sievework.llm.pii import findings

    jobs = findings(table(ship(spark), root, "jobs", "id", "description"), "id", "description").withColumnRenamed("id", "row_id")
    reports = findings(table(spark, root, "user_reports", "report_id", "reason"), "report_id", "reason").withColumnRenamed("report_id", "row_id")
    return jobs.withColumn("tbl", F.lit("jobs")).unionByName(reports.withColumn("tbl", F.lit("user_reports")))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return _findings(spark, root).select("tbl", "row_id", "kind", "pii_text").distinct()


def p3_masked(spark: SparkSession, root: str) -> DataFrame:
    """(tbl, row_id, text): descriptions and reports with placeholders in place of personal data."""
    from sievework.llm.pii import masked

    jobs = masked(table(ship(spark), root, "jobs", "id", "description"), "id", "description").toDF("row_id", "text")
    reports = masked(table(spark, root, "user_reports", "report_id", "reason"), "report_id", "reason").toDF("row_id", "text")
    return jobs.withColumn("tbl", F.lit("jobs")).unionByName(reports.withColumn("tbl", F.lit("user_reports"))).select("tbl", "row_id", "text")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    from sievework.llm.canonical import Places, Titles, mapped

    jobs = table(ship(spark), root, "jobs", "id", "location", "title")
    places = mapped(jobs, "id", "location", table(spark, root, "ref_places", "place_id", "city", "region", "region_code", "country"), Places)
    titles = mapped(jobs, "id", "title", table(spark, root, "ref_titles", "title_id", "title"), Titles)
    return places.select("id", F.lit("location").alias("field"), "ref_id").unionByName(titles.select("id", F.lit("title").alias("field"), "ref_id"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    from sievework.llm.names import linked_rows

    jobs, companies = table(ship(spark), root, "jobs", "id", "company"), table(spark, root, "companies", "company_id", "name")
    rows = jobs.select(F.lit("jobs").alias("tbl"), F.col("id").alias("row_id"), F.col("company").alias("name"))
    rows = rows.unionByName(companies.select(F.lit("companies").alias("tbl"), F.col("company_id").alias("row_id"), "name"))
    return linked_rows(rows, companies)


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    from sievework.llm.neardup import expanded, near_duplicates

    links, members = near_duplicates(table(ship(spark), root, "jobs", "id", "title", "description"), "id", "title", "description")
    return expanded(links, members)


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    from sievework.llm.tokenizer import encode

    return encode(table(ship(spark), root, "documents", "doc_id", "text"), "doc_id", "text")


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    from sievework.llm.leakage import leaks

    docs, items = table(ship(spark), root, "documents", "doc_id", "text"), table(spark, root, "eval_items", "item_id", "text")
    return leaks(docs, "doc_id", "text", items, "item_id", "text").select("doc_id", "item_id").distinct()


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    from sievework.llm.spam import stuffed

    return stuffed(table(ship(spark), root, "documents", "doc_id", "text"), "doc_id", "text").where("spam").select("doc_id")


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p3_found": p3_found,
        "p3_masked": p3_masked,
        "p4_found": p4_found,
        "p5_found": p5_found,
        "p6_found": p6_found,
        "p8_ids": p8_ids,
        "p9_found": p9_found,
        "p10_found": p10_found,
    }
