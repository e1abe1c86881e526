"""Redactions: proposals from detections, validation, review, and keyed writes that can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkveil.config import Config

SOURCE_TYPES = ("email_subject", "email_body_text", "email_body_html", "attachment_text")
STATUSES = ("proposed", "accepted", "rejected")
ORIGINS = ("auto", "manual")
KEY = ["source_type", "source_id", "start", "end", "exemption_code"]


def exemption(entity: Column, config: Config) -> Column:
    if not config.entity_exemptions:
        return F.lit(config.default_exemption)
    mapped = F.create_map(*(F.lit(x) for kv in config.entity_exemptions.items() for x in kv))
    return F.coalesce(F.try_element_at(mapped, entity), F.lit(config.default_exemption))


def known(code: Column, config: Config) -> Column:
    some = F.coalesce(code, F.lit("")) != ""
    return some & code.isin(*config.exemption_codes) if config.exemption_codes else some


def problem(config: Config) -> Column:
    """The first rule that a row (with the source's ``size``, null if it is missing) breaks; null if none."""
    rules = [
        (~F.coalesce(F.col("source_type").isin(*SOURCE_TYPES), F.lit(False)), "source_type"),
        (~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "status"),
        (~F.coalesce(F.col("origin").isin(*ORIGINS), F.lit(False)), "origin"),
        (F.col("start").isNull() | F.col("end").isNull(), "offsets"),
        (F.col("start") < 0, "start"),
        (F.col("end") <= F.col("start"), "end"),
        (F.coalesce("exemption_code", F.lit("")) == "", "code_missing"),
        (~F.coalesce(known(F.col("exemption_code"), config), F.lit(False)), "code_unknown"),
        (F.col("status").isin("accepted", "rejected") & (F.coalesce("reviewer_id", F.lit("")) == ""), "reviewer"),
        (F.col("size").isNull(), "source_missing"),
        (F.col("end") > F.col("size"), "beyond_text"),
    ]
    out = F.when(rules[0][0], rules[0][1])
    for test, name in rules[1:]:
        out = out.when(test, name)
    return out


def validated(rows: DataFrame, sources: DataFrame, config: Config) -> DataFrame:
    """``rows`` with ``reason``: null for a valid redaction."""
    sizes = sources.select("source_type", "source_id", F.length("text").alias("size"))  # no text is shuffled
    return rows.join(sizes, ["source_type", "source_id"], "left").withColumn("reason", problem(config)).drop("size")


def proposals(detections: DataFrame, sources: DataFrame, existing: DataFrame | None, config: Config, min_score: float | None = None, scope: DataFrame | None = None) -> DataFrame:
    """Each detection with its code and ``outcome``: proposed, no_exemption, existing or invalid.

    Of detections with the same span and code, the first in natural order is proposed. ``scope`` (source_type, source_id) limits the run.
    """
    rows = detections if min_score is None else detections.where(F.col("score") >= min_score)
    rows = rows if scope is None else rows.join(scope, ["source_type", "source_id"], "left_semi")
    rows = rows.withColumn("exemption_code", exemption(F.col("entity_type"), config))
    rows = rows.withColumns({"status": F.lit("proposed"), "origin": F.lit("auto"), "reviewer_id": F.lit(None).cast("string")})
    rows = validated(rows, sources, config)
    first = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("reason").asc_nulls_first(), "entity_type", "recognizer"))
    rows = rows.withColumn("nth", first)
    rows = rows.withColumn("there", F.lit(False)) if existing is None else rows.join(existing.select(*KEY, F.lit(True).alias("there")).distinct(), KEY, "left")
    code = ~F.coalesce(known(F.col("exemption_code"), config), F.lit(False))
    outcome = F.when(code, "no_exemption").when(F.col("reason").isNotNull(), "invalid").when(F.coalesce("there", F.lit(False)) | (F.col("nth") > 1), "existing").otherwise("proposed")
    return rows.withColumn("outcome", outcome).drop("nth", "there", "reason")


def reviewed(redactions: DataFrame, decisions: DataFrame) -> DataFrame:
    """``decisions`` (KEY, new_status, reviewer) applied; an acceptance or rejection without reviewer changes nothing."""
    d = decisions.where(F.col("new_status").isin(*STATUSES) & (~F.col("new_status").isin("accepted", "rejected") | (F.coalesce("reviewer", F.lit("")) != "")))
    rows = redactions.join(d, KEY, "left")
    return rows.withColumn("status", F.coalesce("new_status", "status")).withColumn("reviewer_id", F.coalesce("reviewer", "reviewer_id")).drop("new_status", "reviewer")


def deleted(redactions: DataFrame, keys: DataFrame) -> DataFrame:
    return redactions.join(keys.select(*KEY).distinct(), KEY, "left_anti")


def refused(decisions: DataFrame) -> DataFrame:
    """Those of ``decisions`` that ``reviewed`` leaves out, with the reason: an unknown status, or a verdict without reviewer."""
    unknown = ~F.coalesce(F.col("new_status").isin(*STATUSES), F.lit(False))
    unsigned = F.col("new_status").isin("accepted", "rejected") & (F.coalesce("reviewer", F.lit("")) == "")
    return decisions.withColumn("reason", F.when(unknown, "status").when(unsigned, "reviewer")).where("reason IS NOT NULL")


def inserted(target: DataFrame, rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """``target`` and those rows whose key it does not hold; of equal keys the first in ``order``. Keys compare null-safely."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    rows = rows.withColumn("_nth", first).where("_nth = 1").drop("_nth")
    on = [rows[k].eqNullSafe(target[k]) for k in key]
    fresh = rows.join(target, on, "left_anti")
    return target.unionByName(fresh, allowMissingColumns=True)


def upserted(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows replace those of the same key; null fields of an update keep the old value."""
    others = [c for c in target.columns if c not in key]
    t, r = target.alias("t"), rows.alias("r")
    on = [F.col(f"t.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key]
    return t.join(r, on, "full").select(*(F.coalesce(f"r.{k}", f"t.{k}").alias(k) for k in key), *(F.coalesce(f"r.{c}", f"t.{c}").alias(c) if c in rows.columns else F.col(f"t.{c}") for c in others))


def excluded(emails: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    """Marks e-mails as withheld; those that are already keep their first mark."""
    marks = ids.select(F.col("id"), F.lit(at).alias("_at")).distinct()
    return emails.join(marks, "id", "left").withColumn("excluded_at", F.coalesce("excluded_at", "_at")).drop("_at")


def included(emails: DataFrame, ids: DataFrame) -> DataFrame:
    marks = ids.select("id", F.lit(True).alias("_in")).distinct()
    return emails.join(marks, "id", "left").withColumn("excluded_at", F.when(F.col("_in").isNull(), F.col("excluded_at"))).drop("_in")


def tagged(emails: DataFrame, label: str, case_id: int) -> DataFrame:
    """Rows of a mailbox that have no case yet get one."""
    hit = F.col("case_id").isNull() & (F.col("mbox_source") == label)
    return emails.withColumn("case_id", F.when(hit, F.lit(case_id)).otherwise(F.col("case_id")))


def without_orphans(rows: DataFrame, parents: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Cascade: rows whose parent is gone go too."""
    return rows.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_semi")


def without_parent(rows: DataFrame, parents: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Set null: a reference to a parent that is gone becomes null."""
    there = parents.select(F.col(parent_key).alias(key), F.lit(True).alias("_there")).distinct()
    found = rows.join(there, key, "left")
    return found.select(*(F.when(F.col("_there"), F.col(key)).alias(key) if c == key else F.col(c) for c in rows.columns))


def dismissed(flags: DataFrame, ids: DataFrame, actor: str, at: str) -> DataFrame:
    """Open flags among ``ids`` become dismissed."""
    return _moved(flags, ids, "dismissed", actor, at)


def promoted(flags: DataFrame, ids: DataFrame, actor: str, at: str, config: Config, code: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(flags, redactions): open flags become proposed redactions of manual origin, under the given, suggested or mapped code."""
    after = _moved(flags, ids, "promoted", actor, at)
    new = flags.where("review_status = 'open'").join(ids.select("id").distinct(), "id", "left_semi")
    new = new.withColumn("exemption_code", F.coalesce(F.lit(code), "suggested_exemption", exemption(F.col("entity_type"), config)))
    return after, new.where(known(F.col("exemption_code"), config)).select(*KEY, F.lit("proposed").alias("status"), F.lit("manual").alias("origin"), F.lit(actor).alias("reviewer_id"))


def _moved(flags: DataFrame, ids: DataFrame, to: str, actor: str, at: str) -> DataFrame:
    rows = flags.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    hit = F.col("_hit") & (F.col("review_status") == "open")
    for name, value in (("review_actor", actor), ("reviewed_at", at), ("review_status", to)):
        rows = rows.withColumn(name, F.when(hit, F.lit(value)).otherwise(F.col(name)))
    return rows.drop("_hit")
