"""Cases, jobs and sessions: lists, states, and what is derived from times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkveil.operators import query

#: States of a case (fixed values).
STATUSES = ("processing", "ready", "failed", "exported", "archived")


class CaseError(ValueError):
    pass


def list_cases(cases: DataFrame, status: str | None = None) -> DataFrame:
    """In order: ``newest_first``."""
    return cases if status is None else cases.where(F.col("status") == status)


def newest_first() -> list:
    return [F.desc("created_at"), F.desc("id")]


def with_status(cases: DataFrame, case_id: int, status: str, at: str, error_message: str | None = None, failed_stage: str | None = None) -> DataFrame:
    """One case in a new state; message and stage of a failure are replaced along with it."""
    if status not in STATUSES:
        raise CaseError(f"no such status: {status}")
    hit, new = F.col("id") == case_id, {"status": status, "error_message": error_message, "failed_stage": failed_stage, "updated_at": at}
    return cases.select(*(F.when(hit, F.lit(new[c]).cast("string")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in cases.columns))


def list_jobs(jobs: DataFrame, case_id: int | None = None) -> DataFrame:
    return (jobs if case_id is None else jobs.where(F.col("case_id") == case_id)).orderBy(F.desc("id"))


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """The last job of each case."""
    names = [c for c in jobs.columns if c != "case_id"]
    return jobs.groupBy("case_id").agg(F.max_by(F.struct(*names), "id").alias("job")).select("case_id", "job.*")


def case_details(cases: DataFrame, jobs: DataFrame, stats: DataFrame) -> DataFrame:
    """Cases with their counts (``query.case_stats``) and the state of their last job."""
    last = latest_jobs(jobs).select(F.col("case_id").alias("id"), F.col("status").alias("job_status"), F.col("id").alias("job_id"))
    counts = [c for c in stats.columns if c != "case_id"]
    rows = cases.join(stats.withColumnRenamed("case_id", "id"), "id", "left").join(last, "id", "left")
    return rows.select(*cases.columns, *(F.coalesce(c, F.lit(0)).alias(c) for c in counts), "job_id", "job_status")


def job_events(events: DataFrame, job_id: int, since: int = 0) -> DataFrame:
    """A job's events after ``since``, in order, with the payload as a map (null if it is no JSON)."""
    rows = events.where((F.col("job_id") == job_id) & (F.col("id") > since))
    return rows.withColumn("payload", F.from_json("payload_json", "map<string,string>", {"mode": "PERMISSIVE"})).orderBy("id")


def retried(jobs: DataFrame, job_id: int) -> DataFrame:
    """A failed job, queued again; any other state is refused."""
    found = query.one(jobs, "id", job_id).first()
    if found["status"] != "failed":
        raise CaseError(f"the job is {found['status']}")
    cleared = ("current_stage", "error_message", "failed_stage", "started_at", "finished_at")
    hit = F.col("id") == job_id
    return jobs.select(*(F.when(~hit, F.col(c)).otherwise(F.lit("queued") if c == "status" else F.lit(None)).alias(c) if c in (*cleared, "status") else F.col(c) for c in jobs.columns))


def session_state(now: str, recheck_minutes: int) -> Column:
    """The first that holds: revoked, disabled, expired, recheck (the directory has to be asked again), active."""
    at = F.lit(now).cast("timestamp")
    checked = F.col("last_group_check_at").try_cast("timestamp")
    due = checked.isNull() | (F.unix_micros(at) - F.unix_micros(checked) >= recheck_minutes * 60_000_000)
    states = F.when(F.col("revoked_at").isNotNull(), "revoked").when(~F.col("is_active"), "disabled")
    return states.when(F.col("expires_at").cast("timestamp") <= at, "expired").when(due, "recheck").otherwise("active")


def verified(tokens: DataFrame, sessions: DataFrame, users: DataFrame, now: str, recheck_minutes: int = 15) -> DataFrame:
    """``tokens`` (token) with session_id, user_id and state; the session is found by the token's hash, and "unknown" if there is none."""
    known = sessions.select("token_hash", F.col("id").alias("session_id"), "user_id", "expires_at", "revoked_at", "last_group_check_at")
    known = known.join(users.select(F.col("id").alias("user_id"), "is_active"), "user_id").withColumn("state", session_state(now, recheck_minutes))
    asked = tokens.withColumn("token_hash", F.sha2(F.col("token"), 256))
    return asked.join(known, "token_hash", "left").select(*tokens.columns, "session_id", "user_id", F.coalesce("state", F.lit("unknown")).alias("state"))


def revoked(sessions: DataFrame, users: DataFrame, at: str) -> DataFrame:
    """Sessions of ``users`` (user_id) end; those that have ended keep their time."""
    hit = users.select("user_id", F.lit(at).alias("_at")).distinct()
    return sessions.join(hit, "user_id", "left").withColumn("revoked_at", F.coalesce("revoked_at", "_at")).drop("_at").select(*sessions.columns)
