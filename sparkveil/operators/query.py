"""The filtered, counted and paged surface. A filter that is None is left out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkveil.functions.text import contains_fold, starts_fold


def all_of(*tests: Column | None) -> Column:
    return reduce(lambda a, b: a & b, (t for t in tests if t is not None), F.lit(True))


def page(rows: DataFrame, order: list, limit: int = 50, offset: int = 0) -> DataFrame:
    """``order`` ends with a unique key."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit is 1 to 500, offset at least 0")
    return rows.orderBy(*order).offset(offset).limit(limit)


def with_total(rows: DataFrame, order: list, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page whose rows carry ``total``, the number of all rows before paging (one count; it is a number by then, not a join)."""
    total = rows.count()
    return page(rows, order, limit, offset).withColumn("total", F.lit(total).cast("long"))


def one(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of a key; LookupError if there is none."""
    found = rows.where(F.col(key) == value).limit(1)
    if not found.take(1):
        raise LookupError(f"{key} {value}")
    return found


def having(rows: DataFrame, others: DataFrame, on: list, wanted: bool | None) -> DataFrame:
    """Rows with (True) or without (False) a partner."""
    return rows if wanted is None else rows.join(others, on, "left_semi" if wanted else "left_anti")


def list_emails(emails: DataFrame, attachments: DataFrame, detections: DataFrame, *, subject=None, sender=None, case_id=None, after=None, before=None, excluded=None, has_attachments=None, has_pii=None, mbox_source=None) -> DataFrame:
    """The conjunction of the filters that are given; dates are half-open ISO texts."""
    rows = emails.where(all_of(
        None if subject is None else contains_fold(F.col("subject"), subject),
        None if sender is None else contains_fold(F.col("from_addr"), sender),
        None if case_id is None else F.col("case_id") == case_id,
        None if mbox_source is None else F.col("mbox_source") == mbox_source,
        None if after is None else F.col("date_sent") >= after,
        None if before is None else F.col("date_sent") < before,
        None if excluded is None else F.col("excluded_at").isNotNull() == F.lit(excluded),
    ))
    rows = having(rows, attachments.select(F.col("email_id").alias("id")), ["id"], has_attachments)
    return having(rows, detections.where(F.col("source_type").startswith("email_")).select(F.col("source_id").alias("id")), ["id"], has_pii)


def summaries(emails: DataFrame, attachments: DataFrame, detections: DataFrame) -> DataFrame:
    """E-mails with has_attachments, pii_count and is_excluded, from tables aggregated beforehand."""
    a = attachments.groupBy(F.col("email_id").alias("id")).agg(F.lit(True).alias("_has"))
    d = detections.where(F.col("source_type").startswith("email_")).groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    rows = emails.join(a, "id", "left").join(d, "id", "left")
    return rows.select(*emails.columns, F.coalesce("_has", F.lit(False)).alias("has_attachments"), F.coalesce("_n", F.lit(0)).alias("pii_count"), F.col("excluded_at").isNotNull().alias("is_excluded"))


def newest_first() -> list:
    return [F.desc_nulls_last("date_sent"), F.desc("id")]


def list_attachments(attachments: DataFrame, *, type_prefix=None, email_id=None, is_inline=None, status=None) -> DataFrame:
    return attachments.where(all_of(
        None if type_prefix is None else starts_fold(F.col("content_type"), type_prefix),
        None if email_id is None else F.col("email_id") == email_id,
        None if is_inline is None else F.col("is_inline") == F.lit(is_inline),
        None if status is None else F.col("extraction_status") == status,
    ))


def list_detections(detections: DataFrame, *, entity=None, source_type=None, min_score=None) -> DataFrame:
    return detections.where(all_of(
        None if entity is None else F.col("entity_type") == entity,
        None if source_type is None else F.col("source_type") == source_type,
        None if min_score is None else F.col("score") >= min_score,
    ))


def list_redactions(redactions: DataFrame, *, source_type=None, source_id=None, status=None, origin=None, exemption_code=None) -> DataFrame:
    """In order: ``by_place``."""
    wanted = {"source_type": source_type, "source_id": source_id, "status": status, "origin": origin, "exemption_code": exemption_code}
    return redactions.where(all_of(*(None if v is None else F.col(c) == v for c, v in wanted.items())))


def by_place() -> list:
    return ["source_type", "source_id", "start", "exemption_code"]


def email_redactions(redactions: DataFrame, email_id: int) -> DataFrame:
    """The redactions of one e-mail's own texts."""
    return redactions.where(F.col("source_type").startswith("email_") & (F.col("source_id") == email_id)).orderBy(*by_place())


def list_flags(flags: DataFrame, *, review_status=None, source_type=None, source_id=None, entity_type=None, provider=None, qa_run_id=None) -> DataFrame:
    """In order: the newest (largest id) first."""
    wanted = {"review_status": review_status, "source_type": source_type, "source_id": source_id, "entity_type": entity_type, "provider": provider, "qa_run_id": qa_run_id}
    return flags.where(all_of(*(None if v is None else F.col(c) == v for c, v in wanted.items())))


def attachments_with_text(attachments: DataFrame, texts: DataFrame) -> DataFrame:
    """Attachments and what was extracted of them; null where nothing was tried yet."""
    t = texts.select("id", "extraction_status", "extraction_method", "character_count", "extracted_text")
    return attachments.drop("extraction_status", "extraction_method", "character_count", "extracted_text").join(t, "id", "left")


def content_of(rows: DataFrame, value, name: str = "filename", content: str = "content") -> DataFrame:
    """What a download of one row holds: file name, type and bytes."""
    return one(rows, "id", value).select(F.coalesce(F.col(name), F.lit("download")).alias("filename"), "content_type", F.col(content).alias("content"))


def entity_counts(detections: DataFrame, min_score: float | None = None) -> DataFrame:
    rows = list_detections(detections, min_score=min_score).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.orderBy(F.desc("n"), "entity_type")


def audit(log: DataFrame, *, event_type=None, actor=None, after=None, before=None) -> DataFrame:
    """Both bounds exclusive; the payload that is no JSON becomes null."""
    rows = log.where(all_of(
        None if event_type is None else F.col("event_type") == event_type,
        None if actor is None else F.col("actor") == actor,
        None if after is None else F.col("event_at") > after,
        None if before is None else F.col("event_at") < before,
    ))
    return rows.withColumn("payload", F.from_json("payload_json", "map<string,string>", {"mode": "PERMISSIVE"}))


def events_since(events: DataFrame, since: int, limit: int = 500) -> DataFrame:
    return page(events.where(F.col("id") > since), ["id"], limit)


def case_stats(emails: DataFrame, attachments: DataFrame, detections: DataFrame, redactions: DataFrame) -> DataFrame:
    """All counts of every case. Attachments count for e-mails not excluded; detections and redactions count on e-mail sources."""
    base = emails.groupBy("case_id").agg(F.count_if(F.col("excluded_at").isNull()).alias("emails"), F.count_if(F.col("excluded_at").isNotNull()).alias("emails_excluded"))
    case_of = emails.select(F.col("id").alias("_id"), "case_id", "excluded_at")
    on_mail = lambda df: df.where(F.col("source_type").startswith("email_")).join(case_of, F.col("source_id") == F.col("_id")).groupBy("case_id")
    att = attachments.join(case_of.where("excluded_at IS NULL"), F.col("email_id") == F.col("_id")).groupBy("case_id").agg(F.count(F.lit(1)).alias("attachments"))
    pii = on_mail(detections).agg(F.count(F.lit(1)).alias("pii_detections"))
    red = on_mail(redactions).agg(F.count(F.lit(1)).alias("redactions"), F.count_if(F.col("status") == "accepted").alias("redactions_accepted"))
    rows = base.join(att, "case_id", "left").join(pii, "case_id", "left").join(red, "case_id", "left")
    return rows.select("case_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("emails", "emails_excluded", "attachments", "pii_detections", "redactions", "redactions_accepted")))


def email_details(emails: DataFrame, attachments: DataFrame, detections: DataFrame) -> DataFrame:
    """E-mails with their attachments and detections nested."""
    a = attachments.groupBy(F.col("email_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("attachment_id"), "filename", "content_type", "size_bytes"))).alias("attachments"))
    d = detections.where(F.col("source_type").startswith("email_")).groupBy(F.col("source_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("source_type", "start", "end", "entity_type", "score"))).alias("detections"))
    return emails.join(a, "id", "left").join(d, "id", "left")


def dedup_by_content(rows: DataFrame, content: Column) -> DataFrame:
    """sha256, size and number of rows of each distinct content, under the smallest id."""
    return rows.groupBy(F.sha2(content, 256).alias("sha256")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
