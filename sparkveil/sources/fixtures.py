"""Stand-ins for a disclosure corpus, derived from the standard tables. Each is one SELECT that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkveil.config import SAMPLE
from sparkveil.functions.text import plain_text
from sparkveil.operators import jobs, markup, spans

EMAILS = """
SELECT doc_id AS id, source AS mbox_source, doc_id AS mbox_index, substr(text, 1, 60) AS subject,
       concat('User ', cast(doc_id % 97 AS string)) AS from_name,
       concat('user', cast(doc_id % 97 AS string), CASE WHEN doc_id % 3 = 0 THEN '@Example.org ' WHEN doc_id % 3 = 1 THEN '@sub.example.org' ELSE '@other.test' END) AS from_addr,
       concat('user', cast(doc_id % 89 AS string), '@example.org') AS to_addr,
       CASE WHEN doc_id % 4 = 0 THEN concat('clerk', cast(doc_id % 11 AS string), '@city.test') END AS cc_addr,
       CASE WHEN doc_id % 17 = 0 THEN NULL ELSE concat('2024-', lpad(cast(doc_id % 12 + 1 AS string), 2, '0'), '-', lpad(cast(doc_id % 28 + 1 AS string), 2, '0'), 'T08:00:00+00:00') END AS date_sent,
       '2025-01-01T00:00:00+00:00' AS ingested_at, text AS body_text, doc_id % 5 AS case_id,
       CASE WHEN doc_id % 23 = 0 THEN '2025-02-01T00:00:00+00:00' END AS excluded_at
FROM documents
"""
ATTACHMENTS = """
SELECT page_id AS id, page_id % (SELECT count(*) FROM documents) AS email_id, concat('page', cast(page_id AS string), '.html') AS filename,
       CASE page_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'IMAGE/png' WHEN 2 THEN 'text/html' ELSE 'image/jpeg' END AS content_type,
       cast(length(html) AS bigint) AS size_bytes, page_id % 3 = 0 AS is_inline, page_id % 5 = 0 AS is_nested_eml, html,
       CASE page_id % 6 WHEN 0 THEN 'empty' WHEN 1 THEN 'failed' ELSE 'ok' END AS extraction_status
FROM pages
"""
#: Documents as HTML bodies: a paragraph for each line, references for what markup needs, and for the @ of every other one.
HTML_MAILS = """
SELECT doc_id AS id, concat('<div class="m"><p>', replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '@', CASE WHEN doc_id % 2 = 0 THEN '&#64;' ELSE '@' END), chr(10), '</p><p>'), '</p><!-- end --></div>') AS html
FROM documents
"""
TABLES = "documents pages events conversations labels benchmark customer orders lineitem nation".split()


class Corpus:
    """DataFrames over one folder of the standard tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def keys(self, name: str, key: str) -> DataFrame:
        """One column of a table, dealt out over all cores: a few MB of keys would be one task, however much is made of each row."""
        return self.table(name).select(key).repartition(2 * self.spark.sparkContext.defaultParallelism, key)

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        for name in TABLES:
            if name in text:
                frames.setdefault(name, self.table(name))
        for name in frames:
            text = text.replace(f"FROM {name}", "FROM {" + name + "}")
        return self.spark.sql(text, **frames)

    @property
    def emails(self) -> DataFrame:
        return self.sql(EMAILS)

    @property
    def attachments(self) -> DataFrame:
        return self.sql(ATTACHMENTS)

    @property
    def html_mails(self) -> DataFrame:
        """HTML bodies with their text and its runs."""
        return markup.html_sources(self.sql(HTML_MAILS))

    @property
    def bodies(self) -> DataFrame:
        return self.table("documents").selectExpr("'email_body_text' AS source_type", "doc_id AS source_id", "text")

    @property
    def files(self) -> DataFrame:
        """Attachments with their texts."""
        rows = self.attachments
        return rows.withColumn("extracted_text", plain_text(rows["html"]))

    @property
    def sources(self) -> DataFrame:
        """Every text that is scanned: subjects, bodies and attachments' texts."""
        return jobs.text_sources(self.emails, self.files).where("text <> ''")

    @property
    def printed(self) -> DataFrame:
        """Every text that is printed: a blank body takes its lines, too, though nothing is scanned for there."""
        part = lambda rows, kind, text: rows.select(F.lit(kind).alias("source_type"), F.col("id").alias("source_id"), F.col(text).alias("text"))
        parts = part(self.emails, "email_subject", "subject").unionByName(part(self.files.where("extraction_status = 'ok'"), "attachment_text", "extracted_text"))
        return self.bodies.where("text IS NOT NULL").unionByName(parts.where("text <> ''"))

    @property
    def detections(self) -> DataFrame:
        """What is found in the bodies, searched anew by every query that uses it."""
        return spans.detect(self.bodies, SAMPLE)
