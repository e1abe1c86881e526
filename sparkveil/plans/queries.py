"""The registered queries: thin calls of the operators over the fixture corpus."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkveil.config import SAMPLE
from sparkveil.functions.text import is_internal, json_block, plain_text, truncated
from sparkveil.operators import ai, cases, markup, produce, query, redact, resolve, search, spans
from sparkveil.operators.index import StoredIndex
from sparkveil.operators.snippets import snippet
from sparkveil.sources import generator
from sparkveil.sources.fixtures import Corpus
from sparkveil.sources.store import Store, scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SPAN = {"start": "start_offset", "end": "end_offset"}


def registered(f: Callable[[Corpus], DataFrame]):
    QUERIES[f.__name__] = lambda spark, folder: f(Corpus(spark, folder))
    return f


# --- spans


@registered
def pii_entity_counts(c: Corpus) -> DataFrame:
    return query.entity_counts(spans.detect(c.bodies, SAMPLE))


def _spans_of(recognizer: str):
    def run(c: Corpus) -> DataFrame:
        rows = spans.scan(c.bodies, [p for p in SAMPLE.patterns if p.recognizer == recognizer], resolve=False)
        return rows.select("source_id", "start", "end", "matched_text").withColumnsRenamed(SPAN)

    return run


for _name in ("email", "phone", "card", "ip", "token"):
    _f = _spans_of(_name)
    _f.__name__ = f"pii_spans_{_name}"
    registered(_f)


@registered
def pii_overlap_resolved(c: Corpus) -> DataFrame:
    return query.list_detections(c.detections, entity="CREDIT_CARD").select("source_id", "start", "end", "recognizer", "score").withColumnsRenamed(SPAN)


@registered
def pii_by_source(c: Corpus) -> DataFrame:
    return spans.detect(c.sources, SAMPLE).groupBy("source_type", "entity_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_id").alias("n_sources"))


@registered
def sources_scan(c: Corpus) -> DataFrame:
    return c.sources.groupBy("source_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))


@registered
def detections_min_score(c: Corpus) -> DataFrame:
    return query.list_detections(c.detections, min_score=0.8).select("source_id", "entity_type", "start", "end", "score").withColumnsRenamed(SPAN)


def _accepted(c: Corpus) -> DataFrame:
    return c.detections.where("source_id % 2 = 0")


@registered
def accepted_only_mask(c: Corpus) -> DataFrame:
    return spans.masked(c.bodies, _accepted(c)).select("source_id", F.sha2(F.encode("masked", "UTF-8"), 256).alias("masked_sha256"), F.length("masked").alias("n_chars"))


@registered
def segments(c: Corpus) -> DataFrame:
    return spans.segmented(c.bodies, c.detections).select("source_id", "start", "end", "marked").withColumnsRenamed(SPAN)


@registered
def wrap_lines(c: Corpus) -> DataFrame:
    return spans.wrapped(c.bodies, produce.WIDTH).select("source_id", F.col("line_no").cast("long").alias("line_no"), "start", "line").withColumnsRenamed(SPAN)


def _clips(c: Corpus) -> DataFrame:
    return spans.clipped(spans.wrapped(c.bodies, produce.WIDTH), _accepted(c))


@registered
def line_clips(c: Corpus) -> DataFrame:
    return _clips(c).select("source_id", F.col("line_no").cast("long").alias("line_no"), "span_start", "span_end", "from_col", "to_col")


# --- the relational surface


@registered
def emails_page(c: Corpus) -> DataFrame:
    rows = query.list_emails(c.emails, c.attachments, c.detections, subject="th", case_id=1, excluded=False)
    return query.page(rows, query.newest_first(), 50, 10).select("id", "subject", "date_sent")


@registered
def emails_total(c: Corpus) -> DataFrame:
    rows = query.list_emails(c.emails, c.attachments, c.detections, mbox_source="src0", excluded=False)
    return query.with_total(rows, query.newest_first(), 25, 2).select("id", "date_sent", "total")


@registered
def email_details(c: Corpus) -> DataFrame:
    rows = query.email_details(c.emails, c.attachments, c.detections)
    size = lambda x: F.coalesce(F.when(F.col(x).isNotNull(), F.size(x)), F.lit(0))
    return rows.select("id", size("attachments").alias("n_attachments"), F.get("attachments", F.lit(0))["filename"].alias("first_file"), size("detections").alias("n_detections"), F.coalesce(F.get("detections", F.lit(0))["start"], F.lit(-1)).alias("first_start"))


@registered
def attachments_with_text(c: Corpus) -> DataFrame:
    texts = c.files.where("extraction_status = 'ok'").select("id", "extraction_status", F.lit("html").alias("extraction_method"), F.length("extracted_text").alias("character_count"), "extracted_text")
    return query.attachments_with_text(c.attachments, texts).select("id", "filename", "extraction_status", F.coalesce("character_count", F.lit(-1)).alias("character_count"))


@registered
def run_counts(c: Corpus) -> DataFrame:
    rows = spans.run_counts(c.bodies, c.detections)
    return rows.select("sources_scanned", "sources_skipped", "detections_written", F.array_join(F.transform(F.array_sort(F.map_entries("by_entity")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",").alias("by_entity"))


def _mail_ids(name: str, **filters):
    def run(c: Corpus) -> DataFrame:
        return query.list_emails(c.emails, c.attachments, c.detections, **filters).select("id", "date_sent", "case_id")

    run.__name__ = name
    registered(run)


_mail_ids("emails_with_attachments", has_attachments=True)
_mail_ids("emails_without_attachments", has_attachments=False)
_mail_ids("emails_with_pii", has_pii=True)
_mail_ids("emails_without_pii", has_pii=False)
_mail_ids("emails_date_range", after="2024-03-01", before="2024-06-01", sender="OTHER.test")


@registered
def emails_summary_columns(c: Corpus) -> DataFrame:
    return query.summaries(c.emails, c.attachments, c.detections).select("id", "has_attachments", "pii_count", "is_excluded")


@registered
def attachments_by_type_prefix(c: Corpus) -> DataFrame:
    return query.list_attachments(c.attachments, type_prefix="image/", is_inline=False).select("id", "email_id", "content_type", "size_bytes")


@registered
def dedupe_attachments_sha(c: Corpus) -> DataFrame:
    return query.dedup_by_content(c.attachments, F.encode("html", "UTF-8"))


def _log(c: Corpus) -> DataFrame:
    return c.table("events").selectExpr("event_id AS id", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") AS event_at", "event_type", "cast(user_id AS string) AS actor", "props AS payload_json")


@registered
def audit_query(c: Corpus) -> DataFrame:
    rows = query.audit(_log(c), event_type="error", after="2024-01-05T00:00:00", before="2024-01-20T00:00:00")
    return query.page(rows, [F.desc("id")], 200).select("id", "event_at", "actor", F.col("payload")["k"].alias("k"))


@registered
def events_since(c: Corpus) -> DataFrame:
    return query.events_since(_log(c), 500, 100).select("id", "event_at", "event_type")


def _redactions(c: Corpus) -> DataFrame:
    rows = redact.proposals(c.detections, c.bodies, None, SAMPLE).where("outcome = 'proposed'")
    status = F.when(F.col("source_id") % 3 == 0, "accepted").when(F.col("source_id") % 3 == 1, "rejected").otherwise("proposed")
    return rows.withColumn("status", status)


@registered
def redactions_filtered(c: Corpus) -> DataFrame:
    return _redactions(c).where("status = 'accepted' AND exemption_code = 'PII'").select("source_type", "source_id", "start", "end", "exemption_code").withColumnsRenamed(SPAN)


@registered
def redactions_page(c: Corpus) -> DataFrame:
    rows = query.list_redactions(_redactions(c), status="rejected", origin="auto", source_type="email_body_text")
    return query.with_total(rows, query.by_place(), 50, 3).select("source_id", "start", "end", "exemption_code", "total").withColumnsRenamed(SPAN)


def _cases(c: Corpus) -> tuple[DataFrame, DataFrame]:
    rows = c.table("nation").selectExpr("n_nationkey AS id", "n_name AS name", "CASE n_nationkey % 3 WHEN 0 THEN 'ready' WHEN 1 THEN 'failed' ELSE 'processing' END AS status",
                                        "cast(null AS string) AS error_message", "cast(null AS string) AS failed_stage", "concat('2024-01-', lpad(cast(n_nationkey % 9 + 10 AS string), 2, '0')) AS created_at", "cast(null AS string) AS updated_at")
    jobs = c.table("customer").selectExpr("c_custkey AS id", "c_nationkey AS case_id", "CASE c_custkey % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' ELSE 'succeeded' END AS status")
    return rows, jobs


@registered
def cases_list(c: Corpus) -> DataFrame:
    return query.with_total(cases.list_cases(_cases(c)[0], "ready"), cases.newest_first(), 5, 1).select("id", "name", "created_at", "total")


@registered
def cases_detail(c: Corpus) -> DataFrame:
    rows, jobs = _cases(c)
    stats = jobs.groupBy("case_id").agg(F.count(F.lit(1)).alias("emails"))
    return cases.case_details(rows, jobs, stats).select("id", "emails", F.col("job_id").cast("long").alias("job_id"), "job_status")


@registered
def case_status_change(c: Corpus) -> DataFrame:
    return cases.with_status(_cases(c)[0], 4, "failed", "2024-02-02", "no space", "extract").select("id", "status", "error_message", "failed_stage", "updated_at")


@registered
def job_retry(c: Corpus) -> DataFrame:
    jobs = _cases(c)[1].selectExpr("*", "CASE WHEN id % 4 = 0 THEN 'detect' END AS failed_stage", "CASE WHEN id % 4 = 0 THEN 'no space' END AS error_message", "'2024' AS started_at", "'2025' AS finished_at", "'detect' AS current_stage")
    return cases.retried(jobs, 8).select("id", "status", "failed_stage", "finished_at")


@registered
def session_states(c: Corpus) -> DataFrame:
    e = c.table("events")
    sessions = e.selectExpr("event_id AS id", "sha2(cast(event_id AS string), 256) AS token_hash", "user_id", "date_format(ts + interval 8 hours, \"yyyy-MM-dd'T'HH:mm:ss\") AS expires_at",
                            "CASE WHEN event_type = 'error' THEN '2024-01-09' END AS revoked_at", "CASE WHEN event_id % 5 > 0 THEN date_format(ts + make_interval(0, 0, 0, 0, event_id % 7), \"yyyy-MM-dd'T'HH:mm:ss\") END AS last_group_check_at")
    users = e.select("user_id").distinct().selectExpr("user_id AS id", "user_id % 10 <> 0 AS is_active")
    tokens = e.selectExpr("cast(event_id + 5 AS string) AS token")
    return cases.verified(tokens, sessions, users, "2024-01-20T12:00:00").select("token", F.coalesce("session_id", F.lit(-1)).alias("session_id"), "state")


@registered
def rows_tagged_to_case(c: Corpus) -> DataFrame:
    mails = c.emails.withColumn("case_id", F.when(F.col("id") % 3 > 0, F.col("case_id")))
    return redact.tagged(mails, "src1", 77).select("id", F.coalesce("case_id", F.lit(-1)).alias("case_id"))


@registered
def orphans_removed(c: Corpus) -> DataFrame:
    return redact.without_orphans(c.attachments, c.emails.where("excluded_at IS NULL"), "email_id").select("id", "email_id")


@registered
def parents_set_null(c: Corpus) -> DataFrame:
    return redact.without_parent(c.attachments.select("id", "email_id"), c.emails.where("excluded_at IS NULL"), "email_id").select("id", F.coalesce("email_id", F.lit(-1)).alias("email_id"))


@registered
def rows_inserted_once(c: Corpus) -> DataFrame:
    own = c.table("orders").selectExpr("o_custkey AS k", "o_orderstatus AS s", "o_orderkey AS v")
    return redact.inserted(own.where("k % 2 = 0"), own, ["k", "s"], ["v"]).groupBy("k", "s").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v"))


@registered
def rows_upserted(c: Corpus) -> DataFrame:
    old = c.table("customer").selectExpr("c_custkey AS k", "c_name AS name", "c_mktsegment AS segment")
    new = c.table("customer").selectExpr("c_custkey + 100 AS k", "CASE WHEN c_custkey % 2 = 0 THEN concat(c_name, '!') END AS name")
    return redact.upserted(old, new, ["k"])


@registered
def case_stats(c: Corpus) -> DataFrame:
    return query.case_stats(c.emails, c.attachments, c.detections, _redactions(c))


@registered
def corpus_stats(c: Corpus) -> DataFrame:
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    parts = [
        count(c.emails, "emails"), count(c.attachments, "attachments"), count(query.list_attachments(c.attachments, status="ok"), "attachments_with_text"),
        count(c.detections, "pii_detections"), count(c.emails.select(F.lower(F.trim("from_addr"))).distinct(), "senders"),
        count(_redactions(c), "redactions"), count(_redactions(c).where("status = 'accepted'"), "redactions_accepted"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@registered
def orders_semi(c: Corpus) -> DataFrame:
    late = c.table("lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return query.having(c.table("orders"), late, ["o_orderkey"], True).select("o_orderkey", "o_custkey", "o_totalprice")


@registered
def orders_anti(c: Corpus) -> DataFrame:
    own = c.table("orders").select(F.col("o_custkey").alias("c_custkey"))
    return query.having(c.table("customer"), own, ["c_custkey"], False).select("c_custkey", "c_name", "c_mktsegment")


@registered
def orders_scalar_count(c: Corpus) -> DataFrame:
    n = c.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("most"))
    return c.table("customer").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), "most")


@registered
def label_tallies(c: Corpus) -> DataFrame:
    rows = c.table("labels").join(c.table("documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("n_good"), F.count_if(F.col("toxic") == 1).alias("n_toxic"))


# --- persons


def _messages(c: Corpus) -> DataFrame:
    e = c.emails
    one = lambda x: F.when(F.col(x).isNull(), F.array().cast("array<string>")).otherwise(F.array(x))
    sender = F.concat("from_name", F.lit(" <"), F.trim("from_addr"), F.lit(">"))
    return e.select("id", sender.alias("from_addr"), one("to_addr").alias("to_addrs"), one("cc_addr").alias("cc_addrs"), F.array().cast("array<string>").alias("bcc_addrs"), "body_text", "date_sent", "ingested_at")


@registered
def persons_list(c: Corpus) -> DataFrame:
    return resolve.persons(resolve.sightings(_messages(c)), SAMPLE.email_domains).select("email", "first_seen", "n_sightings", "is_internal")


@registered
def person_roles(c: Corpus) -> DataFrame:
    return resolve.occurrences(resolve.sightings(_messages(c))).groupBy("email", "role").agg(F.count(F.lit(1)).alias("n"))


@registered
def person_display_name(c: Corpus) -> DataFrame:
    return resolve.persons(resolve.sightings(_messages(c))).select("email", "display_name", F.array_join("names", "|").alias("names"))


@registered
def person_merge(c: Corpus) -> DataFrame:
    people = c.table("customer").select(F.col("c_custkey").alias("person"), F.col("c_name").alias("display_name"), F.array("c_name", "c_mktsegment").alias("names"))
    merges = people.where("person % 3 = 1").select(F.col("person").alias("loser"), (F.col("person") - 1).alias("winner")).where("winner > 0")
    return resolve.merged_names(people, merges).select("person", "display_name", F.array_join("names", "|").alias("names"))


@registered
def internal_flag(c: Corpus) -> DataFrame:
    return c.emails.select("id", is_internal(F.trim("from_addr"), SAMPLE.email_domains).alias("is_internal"))


@registered
def signature_emails(c: Corpus) -> DataFrame:
    found = resolve.signature_emails(F.col("text"))
    return c.table("documents").select("doc_id", F.array_join(found, "|").alias("emails")).where("emails <> ''")


def _facts(c: Corpus) -> DataFrame:
    return c.table("events").where("event_type <> 'error'").select("user_id", "ts", "event_type", "event_id")


@registered
def affiliation_asof(c: Corpus) -> DataFrame:
    probes = c.table("events").where("event_type = 'error'").select(F.col("event_id").alias("probe"), "user_id", "ts")
    return resolve.as_of(probes, _facts(c), ["user_id"], "ts", "event_type", "event_id").select("probe", "user_id", "event_type")


def _domains(c: Corpus) -> DataFrame:
    return resolve.affiliations(resolve.sightings(_messages(c))).withColumnsRenamed({"email": "person", "source_email_id": "id"})


def _people(c: Corpus) -> DataFrame:
    return resolve.persons(resolve.sightings(_messages(c)), SAMPLE.email_domains).withColumnRenamed("email", "person")


@registered
def internal_asof(c: Corpus) -> DataFrame:
    return resolve.internal_at(_people(c), _domains(c), "2024-06-01", SAMPLE.email_domains).select("person", F.col("internal_then").cast("string").alias("internal_then"))


@registered
def affiliations_list(c: Corpus) -> DataFrame:
    return _domains(c).select("person", "affiliation_type", "affiliation_value", "observed_at", "id")


@registered
def persons_page(c: Corpus) -> DataFrame:
    seen = resolve.sightings(_messages(c))
    rows = resolve.listed(_people(c), resolve.addresses(seen), resolve.occurrences(seen).withColumnRenamed("email", "person"), is_internal=True, email_domain="sub.example.org", name_contains="USER")
    return query.with_total(rows, resolve.most_seen_first(), 20, 5)


@registered
def person_details(c: Corpus) -> DataFrame:
    seen = resolve.sightings(_messages(c))
    rows = resolve.details(_people(c), resolve.addresses(seen), resolve.occurrences(seen).withColumnRenamed("email", "person"))
    roles = F.array_join(F.transform(F.array_sort(F.map_entries("occurrences_by_type")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    mails = F.array_join(F.transform("emails", lambda x: F.concat(x["email"], F.lit(" "), x["first_seen"])), ",")
    return rows.select("person", mails.alias("emails"), roles.alias("roles"))


def _merges(c: Corpus) -> DataFrame:
    """user30 to user39 of one domain go to user40 to user49, which go to user50 to user59: chains."""
    m = c.spark.range(30, 50).select(F.concat(F.lit("user"), F.col("id").cast("string"), F.lit("@example.org")).alias("loser"), F.concat(F.lit("user"), (F.col("id") + 10).cast("string"), F.lit("@example.org")).alias("winner"))
    return resolve.checked_merges(m, _people(c))


@registered
def merged_occurrences(c: Corpus) -> DataFrame:
    rows = resolve.occurrences(resolve.sightings(_messages(c))).withColumnRenamed("email", "person")
    return resolve.merged_rows(rows, _merges(c), "person", ["role", "email_id"]).groupBy("person").agg(F.count(F.lit(1)).alias("n"))


@registered
def merged_affiliations(c: Corpus) -> DataFrame:
    return resolve.merged_rows(_domains(c), _merges(c), "person", ["affiliation_type", "affiliation_value", "id"]).groupBy("person").agg(F.count(F.lit(1)).alias("n"))


@registered
def merged_addresses(c: Corpus) -> DataFrame:
    return resolve.merged_addresses(resolve.addresses(resolve.sightings(_messages(c))), _merges(c), "person").select("person", "email", "is_primary")


@registered
def person_renamed(c: Corpus) -> DataFrame:
    rows = resolve.renamed(_people(c), "person", "user7@example.org", "The Clerk")
    return rows.select("person", "display_name", F.array_join("names", "|").alias("names"))


@registered
def affiliation_latest(c: Corpus) -> DataFrame:
    return resolve.classified(_facts(c), "2024-01-20 00:00:00", ["user_id"], "ts").select("user_id", "event_type", "event_id")


@registered
def affiliation_history(c: Corpus) -> DataFrame:
    return resolve.history(_domains(c)).select("person", "affiliation_value", "id", F.col("nth").cast("long").alias("nth"))


@registered
def lockout_window(c: Corpus) -> DataFrame:
    rows = resolve.recent_failures(c.table("events").where("event_type = 'error'"), 24 * 60)
    return rows.select("event_id", "user_id", "n_recent", (F.col("n_recent") >= 3).alias("locked"))


# --- redactions


@registered
def propose_redactions(c: Corpus) -> DataFrame:
    rows = redact.proposals(c.detections, c.bodies, None, SAMPLE).where("outcome = 'proposed'")
    return rows.select("source_type", "source_id", "start", "end", "exemption_code", "status", "origin").withColumnsRenamed(SPAN)


@registered
def propose_skip_reasons(c: Corpus) -> DataFrame:
    existing = redact.proposals(c.detections.where("source_id % 4 = 0"), c.bodies, None, SAMPLE).where("outcome = 'proposed'")
    return redact.proposals(c.detections, c.bodies, existing, SAMPLE).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@registered
def validate_redactions(c: Corpus) -> DataFrame:
    d = F.col("doc_id")
    rows = c.table("documents").select(
        d.alias("case_no"), F.when(d % 13 == 0, "fax").otherwise("email_body_text").alias("source_type"), F.when(d % 11 == 0, d + 1000000000).otherwise(d).alias("source_id"),
        (d % 7 - 1).cast("int").alias("start"), (d % 5 * 40).cast("int").alias("end"), F.when(d % 3 == 0, "PII").when(d % 3 == 1, "NOPE").otherwise("FIN").alias("exemption_code"),
        F.when(d % 2 == 0, "accepted").otherwise("proposed").alias("status"), F.lit("manual").alias("origin"), F.when(d % 4 == 0, "ann").alias("reviewer_id"),
    )
    return redact.validated(rows, c.bodies, SAMPLE).select("case_no", F.coalesce("reason", F.lit("ok")).alias("reason"))


@registered
def redactions_reviewed(c: Corpus) -> DataFrame:
    rows = redact.proposals(c.detections, c.bodies, None, SAMPLE).where("outcome = 'proposed'")
    say = F.when(F.col("source_id") % 3 == 0, "accepted").otherwise("rejected").alias("new_status")
    decisions = rows.where("source_id % 5 <> 0").select(*redact.KEY, say, F.when(F.col("source_id") % 2 == 0, "ann").alias("reviewer"))
    return redact.reviewed(rows, decisions).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@registered
def emails_excluded(c: Corpus) -> DataFrame:
    ids = c.emails.where("id % 10 = 3").select("id")
    rows = redact.included(redact.excluded(c.emails, ids, "2025-03-01T00:00:00+00:00"), c.emails.where("id % 46 = 0").select("id"))
    return rows.select("id", "excluded_at")


# --- productions


def _documents(c: Corpus) -> DataFrame:
    lines = spans.wrapped(c.bodies, produce.WIDTH).groupBy("source_id").agg(F.count(F.lit(1)).alias("lines"))
    return c.emails.where("excluded_at IS NULL").join(lines, F.col("id") == F.col("source_id"), "left").select("id", "date_sent", F.coalesce("lines", F.lit(0)).alias("lines"), F.lit(3).alias("headers"))


@registered
def bates_pages(c: Corpus) -> DataFrame:
    return produce.laid_out(_documents(c), SAMPLE.bates).select("id", "pages", "first_page", "last_page")


def _mails(c: Corpus) -> DataFrame:
    return c.emails.withColumns({"cc_addrs": F.when(F.col("cc_addr").isNull(), F.array().cast("array<string>")).otherwise(F.array("cc_addr")), "to_addrs": F.array("to_addr")})


def _places(c: Corpus) -> DataFrame:
    return produce.produced(_mails(c), c.files.where("extraction_status = 'ok'"))


@registered
def production_places(c: Corpus) -> DataFrame:
    """The page on which every subject, body and attachment begins."""
    return _places(c).select("source_type", "source_id", "source_label", "page", "used", "pages")


def _full_log(c: Corpus) -> tuple[DataFrame, DataFrame]:
    places = _places(c)
    accepted = _redactions(c).where("status = 'accepted'").select("source_type", "source_id", "start", "end", (F.col("source_id") * 100000 + F.col("start")).alias("id"), "exemption_code", "reviewer_id", F.lit("2025-05-05").alias("accepted_at"))
    return places, produce.full_log(spans.clipped(spans.wrapped(c.sources, produce.WIDTH), accepted), accepted, places, SAMPLE.bates)


@registered
def redaction_log_full(c: Corpus) -> DataFrame:
    return _full_log(c)[1]


@registered
def production_manifest(c: Corpus) -> DataFrame:
    return produce.manifest(*_full_log(c), SAMPLE.bates)


@registered
def production_lines(c: Corpus) -> DataFrame:
    return produce.production_lines(c.bodies, _accepted(c)).select("source_id", F.col("line_no").cast("long").alias("line_no"), "line")


@registered
def production_print(c: Corpus) -> DataFrame:
    """Every line of every text on its page of the production, without what is redacted."""
    rows = produce.printed_text(c.printed, _redactions(c).where("status = 'accepted'"), _places(c))
    boxes = F.coalesce(F.array_join(F.transform("boxes", lambda b: F.concat_ws(" ", b["from_col"].cast("string"), b["to_col"].cast("string"), b["code"])), ","), F.lit(""))
    return rows.select("page", "used", "text", boxes.alias("boxes"))


@registered
def redaction_log(c: Corpus) -> DataFrame:
    return produce.redaction_log(_clips(c), produce.laid_out(_documents(c), SAMPLE.bates), SAMPLE.bates)


# --- quality


def _gold(c: Corpus) -> tuple[DataFrame, DataFrame]:
    """Texts rendered from customers, with the spans that were written into them: (sources, gold)."""
    k = F.col("c_custkey")
    ssn = F.format_string("%03d-%02d-%04d", k % 600 + 10, k % 90 + 1, k % 9000 + 1)
    date = F.format_string("%02d/%02d/2024", k % 12 + 1, k % 28 + 1)
    phone = F.format_string("(%03d) 555-%04d", k % 700 + 200, k % 10000)
    mail = F.concat(F.lit("c"), k.cast("string"), F.lit("@example.org"))
    parts = [("US_SSN", "SSN ", ssn), ("DATE_TIME", " born ", date), ("PHONE_NUMBER", " call ", phone), ("EMAIL_ADDRESS", " or write ", mail)]
    text, marks = F.lit(""), []
    for entity, lead, value in parts:
        start = F.length(F.concat(text, F.lit(lead)))
        marks.append(F.struct(F.lit(entity).alias("entity_type"), start.alias("start"), (start + F.length(value)).alias("end")))
        text = F.concat(text, F.lit(lead), value)
    rows = c.keys("customer", "c_custkey").select(k.alias("source_id"), F.lit("rendered").alias("source_type"), F.concat(text, F.lit(" by 1-800.")).alias("text"), F.array(*marks).alias("marks"))
    gold = rows.select(F.col("source_id").alias("doc_id"), F.inline("marks")).where("NOT (entity_type = 'PHONE_NUMBER' AND doc_id % 10 = 0)")
    return rows.select("source_type", "source_id", "text"), gold


@registered
def pii_builtin_spans(c: Corpus) -> DataFrame:
    """Every built-in recogniser over texts that hold each of their formats, with near misses."""
    from sparkveil.config import BUILTIN

    k = F.col("c_custkey")
    text = F.concat(
        F.format_string("SSN %03d-%02d-%04d, itin 9%02d-7%d-%04d. ", k % 900, k % 100, k % 10000, k % 100, k % 10, k), F.format_string("A1234 4111 1111 1111 1111 or 4111 1111 1111 111%d; ", k % 10),
        F.format_string("B%07d C%08d MD%07d acct %010d x%010d ", k, k, k, k, k), F.format_string("DE89%018d http://h%d.org/p?q=%d ", k, k, k), F.format_string("10.0.%d.%d and %d/%d/2024 May %d, 2024 ", k % 256, k % 300, k % 12 + 1, k % 28 + 1, k % 28 + 1),
        F.format_string("+1 (%03d) 555-%04d, %03d.555.%04d", k % 1000, k, k % 1000, k),
    )
    rows = c.keys("customer", "c_custkey").select(F.lit("rendered").alias("source_type"), k.alias("source_id"), text.alias("text"))
    return spans.scan(rows, list(BUILTIN.values()), resolve=False).select("source_id", "recognizer", "start", "end", "matched_text").withColumnsRenamed(SPAN)


def _matched(c: Corpus) -> DataFrame:
    from sparkveil.config import BUILTIN

    sources, gold = _gold(c)
    found = spans.scan(sources, [BUILTIN[e] for e in ("US_SSN", "DATE_TIME", "PHONE_NUMBER", "EMAIL_ADDRESS")]).withColumnRenamed("source_id", "doc_id")
    return spans.matched_greedily(found, gold)


@registered
def eval_prf(c: Corpus) -> DataFrame:
    rows = spans.with_rates(_matched(c))
    return rows.select("entity_type", "tp", "fp", "fn", *(F.round(x, 4).alias(x) for x in ("precision", "recall", "f1")))


@registered
def eval_micro(c: Corpus) -> DataFrame:
    rows = spans.with_rates(_matched(c).agg(*(F.sum(x).alias(x) for x in ("tp", "fp", "fn"))))
    return rows.select("tp", "fp", "fn", *(F.round(x, 4).alias(x) for x in ("precision", "recall", "f1")))


@registered
def eval_generated(c: Corpus) -> DataFrame:
    """Seven entities over a generated letter for every order: what the recognisers find of what was written. No recogniser looks for names."""
    letters = generator.labelled(c.keys("orders", "o_orderkey"), "o_orderkey", 7)
    sources = letters.select(F.lit("letter").alias("source_type"), F.col("doc_id").alias("source_id"), "text")
    found = spans.scan(sources, generator.SCORED).withColumnRenamed("source_id", "doc_id")
    rows = spans.with_rates(spans.matched_greedily(found, generator.gold(letters)))
    return rows.select("entity_type", "tp", "fp", "fn", *(F.round(x, 4).alias(x) for x in ("precision", "recall", "f1")))


# --- search, HTML, flags, streams


def _searchable(c: Corpus) -> DataFrame:
    """Mails with their text and attachments with their markup."""
    mails = c.emails.selectExpr("'email' AS scope", "id", "subject AS title", "body_text AS text", "CAST(NULL AS STRING) AS html")
    files = c.attachments.selectExpr("'attachment' AS scope", "id", "filename AS title", "CAST(NULL AS STRING) AS text", "html")
    return mails.unionByName(files)


def _with_text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("text", F.when(F.col("scope") == "attachment", plain_text(F.col("html"))).otherwise(F.col("text"))).drop("html")


def _searched(c: Corpus) -> DataFrame:
    return _with_text(_searchable(c))


@registered
def search_bm25(c: Corpus) -> DataFrame:
    return search.search(_searched(c), ["title", "text"], "and Thé").select("scope", "id", F.round("score", 6).alias("score"))


@registered
def search_by_index(c: Corpus) -> DataFrame:
    """The query of search_bm25 again, answered from an index."""
    docs, columns = _searched(c), ["title", "text"]
    return search.search_index(search.index(docs, columns), search.sizes(docs, columns), "and Thé").select("scope", "id", F.round("score", 6).alias("score"))


@registered
def search_folded(c: Corpus) -> DataFrame:
    """Marked letters on either side, beyond those of Western Europe."""
    docs = c.emails.selectExpr("'email' AS scope", "id", "CASE id % 3 WHEN 0 THEN 'Dvořák' WHEN 1 THEN 'DVORAK' ELSE 'Łódź' END AS title", "substr(body_text, 1, 40 + id % 50) AS text")
    return search.search(docs, ["title", "text"], "dvořak").select("id", F.round("score", 6).alias("score"))


@registered
def search_scope(c: Corpus) -> DataFrame:
    rows = search.search(_searched(c), ["title", "text"], '"of-the"', "email").select("id", F.round("score", 6).alias("score"))
    return query.page(rows, ["score", "id"], 50)


@registered
def search_snippets(c: Corpus) -> DataFrame:
    """Hits of two words with their titles, how many there are, and the windows that show most of them, whichever column they are in."""
    docs, words = _searchable(c), "and Thé"
    found = search.search(_with_text(docs), ["title", "text"], words).withColumn("score", F.round("score", 6))
    page = F.broadcast(query.with_total(found, ["score", "id", "scope"], 100))  # a hundred rows; markup becomes text for these only
    shown = _with_text(docs.join(page, ["scope", "id"]))
    return shown.select("scope", "id", "total", search.titled(F.col("title"), F.col("scope")).alias("title"), snippet(words)(F.col("title"), F.col("text")).alias("snippet"))


@registered
def search_stored(c: Corpus) -> DataFrame:
    """A kept index after additions, a replacement, deletions and a merge, asked for what search_bm25 asks."""
    store = Store(c.spark, f"{scratch(c.spark)}/index-{uuid.uuid4().hex}")
    docs, kept = _searched(c), StoredIndex(store, "fts", ["title", "text"], buckets=16)
    kept.add(docs.where("id % 3 = 0"))
    kept.add(docs.where("id % 3 <> 0"))
    kept.delete(docs.where("id % 5 = 0"))
    kept.add(docs.where("id % 10 = 0 OR id % 7 = 1"))  # what was deleted comes back, what is there is replaced
    kept.merge()
    kept.sweep()
    kept.delete(docs.where("id % 9 = 2"))
    return kept.search("and Thé").select("scope", "id", F.round("score", 6).alias("score"))


@registered
def fts_backfill_missing(c: Corpus) -> DataFrame:
    docs = _searched(c)
    held = search.document_sizes(docs.where("id % 3 <> 0"), ["title", "text"])  # an index's members
    return search.unindexed(docs, held).groupBy("scope").agg(F.count(F.lit(1)).alias("n"))


@registered
def html_to_text(c: Corpus) -> DataFrame:
    return c.table("pages").select("page_id", plain_text(F.col("html")).alias("text"))


@registered
def html_sanitized(c: Corpus) -> DataFrame:
    from sparkveil.functions import html

    return c.table("pages").select("page_id", html.sanitize_html("html").alias("safe"), html.html_to_text("html").alias("text"))


def _html_addresses(c: Corpus, bodies: DataFrame) -> DataFrame:
    return spans.scan(bodies, [p for p in SAMPLE.patterns if p.entity == "EMAIL_ADDRESS"])


@registered
def html_body_spans(c: Corpus) -> DataFrame:
    """Addresses in the text of HTML bodies, and where they stand in the markup."""
    bodies = c.html_mails
    rows = markup.placed(_html_addresses(c, bodies), bodies)
    return rows.select("source_id", "start", "end", "matched_text", "mark_start", "mark_end").withColumnsRenamed(SPAN)


@registered
def html_bodies_burned(c: Corpus) -> DataFrame:
    """The markup of every HTML body with its addresses burned out."""
    bodies = c.html_mails
    return markup.burned(bodies, _html_addresses(c, bodies)).select("source_id", F.sha2("html", 256).alias("burned_sha256"))


@registered
def html_proposals(c: Corpus) -> DataFrame:
    """Everything that is found in HTML bodies, proposed and validated against their texts."""
    bodies = c.html_mails.select("source_type", "source_id", "text")
    rows = redact.proposals(spans.detect(bodies, SAMPLE), bodies, None, SAMPLE).where("outcome = 'proposed'")
    return rows.select("source_type", "source_id", "start", "end", "exemption_code", "status").withColumnsRenamed(SPAN)


@registered
def html_search(c: Corpus) -> DataFrame:
    docs = c.html_mails.select(F.lit("html").alias("scope"), F.col("source_id").alias("id"), "text")
    return search.search(docs, ["text"], "and Thé").select("id", F.round("score", 6).alias("score"))


@registered
def ai_reanchor(c: Corpus) -> DataFrame:
    flags = c.table("documents").select(
        F.lit("email_body_text").alias("source_type"), F.col("doc_id").alias("source_id"), "text", F.concat(F.lit(" "), F.substring("text", 11, 12), F.lit(" ")).alias("matched_text"), F.lit(" name ").alias("entity_type"),
        F.when(F.col("doc_id") % 3 == 0, "high").when(F.col("doc_id") % 3 == 1, "7.5").otherwise("0.25").alias("confidence"), F.lit("seen").alias("rationale"), F.lit(None).cast("string").alias("suggested_exemption"),
    )
    return ai.anchored(flags).select("source_id", "entity_type", "start", "end", "confidence").withColumnsRenamed(SPAN)


def _flags(c: Corpus) -> DataFrame:
    return c.detections.select((F.col("source_id") * 100000 + F.col("start")).alias("id"), "source_type", "source_id", "start", "end", "entity_type", F.lit("local").alias("provider"), F.lit("q1").alias("qa_run_id"),
                               F.when(F.col("source_id") % 2 == 0, "open").otherwise("dismissed").alias("review_status"), F.when(F.col("source_id") % 4 == 0, "FIN").alias("suggested_exemption"),
                               F.lit(None).cast("string").alias("review_actor"), F.lit(None).cast("string").alias("reviewed_at"))


@registered
def flags_page(c: Corpus) -> DataFrame:
    rows = query.list_flags(_flags(c), review_status="open", entity_type="EMAIL_ADDRESS", provider="local")
    return query.with_total(rows, [F.desc("id")], 30, 2).select("id", "source_id", "total")


@registered
def flags_promoted(c: Corpus) -> DataFrame:
    ids = c.emails.where("id % 3 = 0").select("id")
    flags = _flags(c)
    chosen = flags.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select("id")
    return redact.promoted(flags, chosen, "ann", "2025-01-01", SAMPLE)[1].select("source_id", "start", "end", "exemption_code", "status", "origin").withColumnsRenamed(SPAN)


@registered
def flags_dismissed(c: Corpus) -> DataFrame:
    return redact.dismissed(_flags(c), _flags(c).where("start % 2 = 0").select("id"), "ann", "2025-01-01").groupBy("review_status", "review_actor").agg(F.count(F.lit(1)).alias("n"))


@registered
def prompts_truncated(c: Corpus) -> DataFrame:
    return c.table("documents").select("doc_id", truncated(F.col("text"), 200).alias("prompt"))


@registered
def ai_json_extract(c: Corpus) -> DataFrame:
    said = F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```"))
    return c.table("events").select("event_id", F.get_json_object(json_block(said), "$.k").alias("k"))


@registered
def event_tail_stream(c: Corpus) -> DataFrame:
    """The events file followed as a stream to its end, then counted."""
    from sparkveil.streaming.events import tail

    schema = c.table("events").schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", ")
    name = "event_tail"
    flow = tail(c.spark, f"{c.folder}/events.parquet*", schema).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    writer = flow.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True)
    run = writer.option("checkpointLocation", f"{scratch(c.spark)}/tail-{uuid.uuid4().hex}").start()
    run.awaitTermination()
    return c.spark.table(name)


@registered
def lockout_stream(c: Corpus) -> DataFrame:
    """lockout_window by a stream with state: failures that are the third or a later one of their user within a day."""
    from sparkveil.streaming.events import lockouts

    name = f"lockouts_{uuid.uuid4().hex}"
    flow = c.spark.readStream.schema(c.table("events").schema).parquet(f"{c.folder}/events.parquet*").where("event_type = 'error'")
    run = lockouts(flow, 3, 24 * 60).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True)
    run.option("checkpointLocation", f"{scratch(c.spark)}/{name}").start().awaitTermination()
    return c.spark.table(name)
