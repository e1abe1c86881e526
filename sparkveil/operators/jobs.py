"""The import of a mailbox as a job: five stages over the store's tables, each with events, and the state of job and case.

Every job has a partition (``job_id``) of its own in each table of rows that come with messages, and writes no other: an import costs
what its own messages cost, however much is there. A job that failed is run again as a whole, and its partitions are written anew.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkveil.config import Config
from sparkveil.functions.html import html_to_text
from sparkveil.operators import cases, markup, redact, resolve, spans
from sparkveil.sources import mail
from sparkveil.sources.store import Store

EVENT = "id long, job_id long, stage string, kind string, message string, payload_json string, event_at string"
JOB = "id long, case_id long, status string, label string, upload_path string, propose_redactions boolean, current_stage string, failed_stage string, error_message string, started_at string, finished_at string"
CASE = "id long, name string, status string, error_message string, failed_stage string, created_at string, updated_at string"


def utc_now() -> str:
    return datetime.now(timezone.utc).isoformat()


def text_sources(emails: DataFrame, attachments: DataFrame | None = None) -> DataFrame:
    """source_type, source_id, text of subjects, bodies, HTML bodies (their text; ``markup`` places spans of it) and, where text was extracted, attachments."""
    part = lambda kind, text: emails.select(F.lit(kind).alias("source_type"), F.col("id").alias("source_id"), text.alias("text"))
    out = part("email_subject", F.col("subject")).unionByName(part("email_body_text", F.col("body_text")))
    if "body_html_sanitized" in emails.columns:
        some = emails.where("body_html_sanitized <> ''").select("id", "body_html_sanitized")
        out = out.unionByName(some.select(F.lit(markup.SOURCE_TYPE).alias("source_type"), F.col("id").alias("source_id"), html_to_text("body_html_sanitized").alias("text")))
    if attachments is not None:
        ok = attachments.where("extraction_status = 'ok'")
        out = out.unionByName(ok.select(F.lit("attachment_text").alias("source_type"), F.col("id").alias("source_id"), F.col("extracted_text").alias("text")))
    return out.where(F.coalesce(F.trim("text"), F.lit("")) != "")


class Import:
    """One job. ``clock`` gives the times of events."""

    def __init__(self, store: Store, config: Config, job_id: int, actor: str = "system", clock: Callable[[], str] = utc_now):
        self.store, self.spark, self.config, self.job_id, self.actor, self.clock = store, store.spark, config, job_id, actor, clock
        job = store.read("jobs").where(F.col("id") == job_id).first()
        self.case_id, self.path, self.label, self.proposes = job["case_id"], job["upload_path"], job["label"] or job["upload_path"].rsplit("/", 1)[-1], job["propose_redactions"]

    def emit(self, stage: str, kind: str, message: str, payload: dict | None = None) -> None:
        old = self.store.read("events")
        last = (old.agg(F.max("id").alias("m")).first()["m"] or 0) if old is not None else 0
        row = (last + 1, self.job_id, stage, kind, message[:400], json.dumps(payload or {}, sort_keys=True), self.clock())
        self.store.append("events", self.spark.createDataFrame([row], EVENT))

    def _job(self, **fields) -> None:
        jobs = self.store.read("jobs")
        hit = F.col("id") == self.job_id
        self.store.replace("jobs", jobs.select(*(F.when(hit, F.lit(fields[c])).otherwise(F.col(c)).cast(jobs.schema[c].dataType).alias(c) if c in fields else F.col(c) for c in jobs.columns)))

    def _case(self, status: str, **more) -> None:
        self.store.replace("cases", cases.with_status(self.store.read("cases"), self.case_id, status, self.clock(), **more))

    def run(self) -> bool:
        """True if all stages ended well."""
        self._job(status="running", started_at=self.clock())
        for name in ("ingest", "extract", "detect", "resolve", "propose"):
            try:
                self._job(current_stage=name)
                if name == "propose" and not self.proposes:
                    self.emit(name, "finished", "skipped", {"skipped": True})
                    continue
                self.emit(name, "started", name)
                stats = getattr(self, name)()
                self.emit(name, "finished", ", ".join(f"{k} {v}" for k, v in stats.items()), stats)
            except Exception as e:
                self.emit(name, "failed", str(e), {"error": str(e)[:400]})
                self._job(status="failed", failed_stage=name, error_message=str(e)[:400], finished_at=self.clock())
                self._case("failed", error_message=str(e)[:400], failed_stage=name)
                return False
        self._job(status="succeeded", current_stage=None, finished_at=self.clock())
        self._case("ready")
        self.store.log("import.run", self.actor, {"job_id": self.job_id, "case_id": self.case_id}, self.clock())
        self.emit("done", "finished", "all stages are done", {"case_id": self.case_id})
        return True

    def _put(self, table: str, rows: DataFrame) -> None:
        self.store.write_part(table, rows.drop("job_id").withColumn("job_id", F.lit(self.job_id).cast("long")), "job_id")

    def _own(self, table: str) -> DataFrame:
        return self.store.read(table).where(F.col("job_id") == self.job_id)

    def ingest(self) -> dict:
        """New messages become e-mails of the case, their attachments rows of their own; an unreadable one is counted and left out.

        A message is there already if one of its mailbox, place and content is. Numbers go on from the largest, mailbox by mailbox.
        """
        old = self.store.read("emails")
        old = None if old is None else old.where(F.col("job_id") != self.job_id)
        messages = mail.parsed(mail.read_mbox(self.spark, self.path, self.label))
        if old is not None:
            key = ["mbox_source", "mbox_index", "raw_sha256"]
            messages = messages.join(old.select(*key), key, "left_anti")
        messages = messages.withColumns({"case_id": F.lit(self.case_id).cast("long"), "excluded_at": F.lit(None).cast("string"), "ingested_at": F.lit(self.clock())})
        self._put("messages", messages)
        messages = self._own("messages")
        base = (old.agg(F.max("id").alias("m")).first()["m"] or 0) if old is not None else 0
        ends = messages.groupBy("mbox_source").agg((F.max("mbox_index") + 1).alias("n"))  # a row per mailbox
        before = ends.select("mbox_source", F.coalesce(F.sum("n").over(Window.orderBy("mbox_source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        messages = messages.join(before, "mbox_source").withColumn("id", (F.col("mbox_index") + F.col("before") + base + 1).cast("long")).drop("before")
        good = messages.where("error IS NULL")
        self._put("emails", good.drop("attachments", "error"))
        files = good.select(F.col("id").alias("email_id"), F.posexplode("attachments").alias("pos", "a")).select((F.shiftleft("email_id", 20) + F.col("pos")).alias("id"), "email_id", "a.*")
        self._put("attachments", files)
        return {"emails_ingested": self._own("emails").count(), "attachments_saved": self._own("attachments").count(), "errors": messages.where("error IS NOT NULL").count()}

    def extract(self) -> dict:
        self._put("attachments_text", mail.extract(self._own("attachments")))
        return {r["extraction_status"]: r["n"] for r in self._own("attachments_text").groupBy("extraction_status").agg(F.count(F.lit(1)).alias("n")).orderBy("extraction_status").collect()}

    def _sources(self) -> DataFrame:
        return text_sources(self._own("emails"), self._own("attachments_text"))

    def detect(self) -> dict:
        """Texts that came with this job. Those of earlier ones are searched again by ``rescan``."""
        self._put("detections", spans.detect(self._sources(), self.config))
        counts = spans.run_counts(self._sources(), self._own("detections")).first()
        return {"sources_scanned": counts["sources_scanned"], "detections_written": counts["detections_written"], "by_entity": dict(counts["by_entity"])}

    def resolve(self) -> dict:
        seen = resolve.sightings(self._own("emails"))
        self._put("occurrences", resolve.occurrences(seen))
        self._put("affiliations", resolve.affiliations(seen))
        self.store.replace("persons", resolve.persons(resolve.sightings(self.store.read("emails")), self.config.email_domains))  # as long as the people
        return {"persons": self.store.read("persons").count(), "occurrences": self._own("occurrences").count()}

    def propose(self) -> dict:
        old = self.store.read("redactions")
        old = None if old is None else old.where(F.col("job_id") != self.job_id)
        rows = redact.proposals(self._own("detections"), self._sources(), old, self.config)
        tally = {r["outcome"]: r["n"] for r in rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).orderBy("outcome").collect()}
        self._put("redactions", rows.where("outcome = 'proposed'").select(*redact.KEY, "status", "origin", "reviewer_id"))
        return tally


def rescan(store: Store, config: Config, actor: str = "system", clock: Callable[[], str] = utc_now) -> dict:
    """All texts searched anew, as after a change of recognisers: every job's partition is written anew."""
    emails, files = store.read("emails"), store.read("attachments_text")
    sources = text_sources(emails, files)
    of_mail = emails.select(F.col("id").alias("source_id"), F.lit(False).alias("file"), "job_id")
    owners = of_mail if files is None else of_mail.unionByName(files.select(F.col("id").alias("source_id"), F.lit(True).alias("file"), "job_id"))
    found = spans.detect(sources, config).withColumn("file", F.col("source_type") == "attachment_text").join(owners, ["source_id", "file"]).drop("file")
    store.replace("detections", found.select(*(c for c in found.columns if c != "job_id"), "job_id"), by=("job_id",))
    n = store.read("detections").count()
    store.log("detection.run", actor, {"detections": n}, clock())
    return {"detections_written": n}


def queued(store: Store, case_id: int, path: str, label: str | None = None, propose: bool = True) -> int:
    """A new job for a mailbox; the case is being processed from now on."""
    old = store.read("jobs")
    number = (old.agg(F.max("id").alias("m")).first()["m"] or 0) + 1 if old is not None else 1
    store.append("jobs", store.spark.createDataFrame([(number, case_id, "queued", label, path, propose, None, None, None, None, None)], JOB))
    return number


def retry(store: Store, config: Config, job_id: int, actor: str = "system", clock: Callable[[], str] = utc_now) -> bool:
    """A failed job is run again as a whole."""
    store.replace("jobs", cases.retried(store.read("jobs"), job_id))
    job = Import(store, config, job_id, actor, clock)
    job._case("processing")
    job.emit("job", "started", "retried")
    store.log("import.retried", actor, {"job_id": job_id}, clock())
    return job.run()
