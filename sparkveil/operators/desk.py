"""The review desk: every change of a store's tables that a person makes, checked as a set, written, and entered in the audit log.

What a change refuses comes back with its reason; nothing of it is written. One event is logged for each change, with its counts.
"""

from __future__ import annotations

import getpass
import os
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkveil.config import AiConfig, Config
from sparkveil.operators import ai, redact, resolve
from sparkveil.operators.jobs import text_sources, utc_now
from sparkveil.operators.redact import KEY
from sparkveil.sources.store import Store

#: Types of events (fixed values).
EVENT_TYPES = (
    "ingest.run", "extract.run", "detection.run", "resolve.run", "resolve.merge", "resolve.rename", "resolve.note", "redaction.propose",
    "redaction.create", "redaction.update", "redaction.delete", "email.excluded", "email.included", "export.run",
)
_MANUAL = 0  # the job of what no import has brought
FLAGS = "id long, source_type string, source_id long, entity_type string, start int, end int, matched_text string, confidence double, rationale string, suggested_exemption string, provider string, model string, qa_run_id string, flagged_at string, review_status string, review_actor string, reviewed_at string"
EXPORTS = "export_id string, exported_at string, path string, emails_exported long, attachments_exported long, pages_written long, redactions_burned long, bates_first string, bates_last string, actor string"


def actor_of(named: str | None = None, variable: str = "SPARKVEIL_ACTOR", prefix: str = "cli") -> str:
    """Who acts: the name given, or the environment's, or the user of this process."""
    if named:
        return named
    if os.environ.get(variable):
        return os.environ[variable]
    try:
        return f"{prefix}:{getpass.getuser()}"
    except (OSError, KeyError, ImportError):
        return prefix


@dataclass(frozen=True)
class ProviderKind:
    """What a provider of flags needs to be told; ``make`` gets model, base_url and api_key and gives what answers a prompt."""

    make: Callable[..., ai.Provider]
    needs_key: bool = True
    needs_url: bool = False
    default_model: str | None = None


class ProviderError(ValueError):
    pass


def choose_provider(settings: AiConfig, kinds: Mapping[str, ProviderKind], provider: str | None = None, model: str | None = None, environ: Mapping[str, str] = os.environ) -> tuple[str, str | None, ai.Provider]:
    """(name, model, provider). What a case asks for goes before the configuration; a missing key is an error, not a quiet way out."""
    name = (provider or settings.provider or "null").lower()
    if name == "null" or (not settings.enabled and provider is None):
        return "null", None, ai.null_provider
    if name not in kinds:
        raise ProviderError(f"unknown provider {name}")
    kind = kinds[name]
    model, key = model or settings.model or kind.default_model, environ.get(settings.api_key_env)
    for missing, what in ((not model, "model"), (kind.needs_url and not settings.base_url, "base_url"), (kind.needs_key and not key, f"key in {settings.api_key_env}")):
        if missing:
            raise ProviderError(f"{name} needs a {what}")
    return name, model, kind.make(model=model, base_url=settings.base_url, api_key=key)


class Desk:
    """Changes of ``store`` by ``actor``."""

    def __init__(self, store: Store, config: Config, actor: str | None = None, clock: Callable[[], str] = utc_now):
        self.store, self.spark, self.config, self.actor, self.clock = store, store.spark, config, actor_of(actor), clock

    def _log(self, event: str, **payload) -> None:
        self.store.log(event, self.actor, payload, self.clock())

    def _sources(self) -> DataFrame:
        return text_sources(self.store.read("emails"), self.store.read("attachments_text"))

    def _redactions(self) -> DataFrame:
        found = self.store.read("redactions")
        if found is None:
            found = self.spark.createDataFrame([], "source_type string, source_id long, start int, end int, exemption_code string, status string, origin string, reviewer_id string, job_id long")
        return found if "notes" in found.columns else found.withColumn("notes", F.lit(None).cast("string"))

    # --- redactions

    def create(self, rows: DataFrame) -> DataFrame:
        """``rows`` (KEY, reviewer_id; status, origin and notes are optional) become redactions. Returns those refused, with ``reason``: a broken rule, or duplicate."""
        filled = {"status": "proposed", "origin": "manual", "reviewer_id": None, "notes": None}
        rows = rows.select(*KEY, *(F.col(c) if c in rows.columns else F.lit(v).cast("string").alias(c) for c, v in filled.items()))
        checked = redact.validated(rows, self._sources(), self.config)
        there = self._redactions().select(*KEY, F.lit(True).alias("_there")).distinct()
        nth = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("reason").asc_nulls_first(), "status"))
        checked = checked.join(there, KEY, "left").withColumn("_nth", nth)
        judged = checked.withColumn("reason", F.coalesce("reason", F.when(F.col("_there") | (F.col("_nth") > 1), "duplicate"))).drop("_there", "_nth")
        kept = f"created_{uuid.uuid4().hex}"
        self.store.replace(kept, judged)  # judged once, before the table changes
        judged = self.store.read(kept)
        new = judged.where("reason IS NULL").drop("reason").withColumn("job_id", F.lit(_MANUAL).cast("long"))
        n = new.count()
        if n:
            self.store.replace("redactions", self._redactions().unionByName(new, allowMissingColumns=True), by=("job_id",))
        self._log("redaction.create", created=n, refused=judged.count() - n)
        return judged.where("reason IS NOT NULL")

    def update(self, changes: DataFrame) -> DataFrame:
        """``changes`` (KEY; new_status, new_code, reviewer, notes, each optional and null for no change) applied. Returns those refused, with ``reason``:
        missing, status, code_unknown, reviewer (a verdict needs one, given now or before) or duplicate (the new code is there already)."""
        names = ("new_status", "new_code", "reviewer", "new_notes")
        changes = changes.withColumnRenamed("notes", "new_notes") if "notes" in changes.columns else changes
        changes = changes.select(*KEY, *(F.col(c) if c in changes.columns else F.lit(None).cast("string").alias(c) for c in names))
        rows = self._redactions()
        both = changes.join(rows, KEY, "left")
        status, code, who = F.coalesce("new_status", "status"), F.coalesce("new_code", "exemption_code"), F.coalesce("reviewer", "reviewer_id")
        taken = rows.select(*(F.col(k).alias(f"_{k}") for k in KEY))
        clash = (F.col("new_code") != F.col("exemption_code")) & F.col("_source_id").isNotNull()
        on = [both[k] == taken[f"_{k}"] for k in KEY[:-1]] + [both["new_code"] == taken["_exemption_code"]]
        judged = both.join(taken, on, "left").withColumn("reason", (
            F.when(F.col("status").isNull(), "missing").when(~status.isin(*redact.STATUSES), "status").when(~F.coalesce(redact.known(code, self.config), F.lit(False)), "code_unknown")
            .when(status.isin("accepted", "rejected") & (F.coalesce(who, F.lit("")) == ""), "reviewer").when(clash, "duplicate")
        )).select(*changes.columns, "reason")
        kept = f"changes_{uuid.uuid4().hex}"
        self.store.replace(kept, judged)
        judged = self.store.read(kept)
        good = judged.where("reason IS NULL").drop("reason")
        n = good.count()
        if n:
            merged = rows.join(good, KEY, "left").select(*(
                F.coalesce("new_status", c).alias(c) if c == "status" else F.coalesce("new_code", c).alias(c) if c == "exemption_code"
                else F.coalesce("reviewer", c).alias(c) if c == "reviewer_id" else F.coalesce("new_notes", c).alias(c) if c == "notes" else F.col(c) for c in rows.columns
            ))
            self.store.replace("redactions", merged, by=("job_id",))
        self._log("redaction.update", updated=n, refused=judged.count() - n)
        return judged.where("reason IS NOT NULL")

    def delete(self, keys: DataFrame) -> int:
        """How many redactions went."""
        rows = self._redactions()
        n = rows.join(keys.select(*KEY).distinct(), KEY, "left_semi").count()
        if n:
            self.store.replace("redactions", redact.deleted(rows, keys), by=("job_id",))
        self._log("redaction.delete", deleted=n)
        return n

    def propose(self, scope: DataFrame | None = None, min_score: float | None = None) -> dict:
        """Redactions for the detections of ``scope`` (source_type, source_id), or of all: what an import does for its own."""
        rows = redact.proposals(self.store.read("detections").drop("job_id"), self._sources(), self._redactions(), self.config, min_score, scope)
        kept = f"proposals_{uuid.uuid4().hex}"
        self.store.replace(kept, rows)
        rows = self.store.read(kept)
        tally = {r["outcome"]: r["n"] for r in rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).orderBy("outcome").collect()}
        if tally.get("proposed"):
            new = rows.where("outcome = 'proposed'").select(*KEY, "status", "origin", "reviewer_id", F.lit(_MANUAL).cast("long").alias("job_id"))
            self.store.replace("redactions", self._redactions().unionByName(new, allowMissingColumns=True), by=("job_id",))
        self._log("redaction.propose", **tally)
        return tally

    def exemptions(self) -> DataFrame:
        """code, entities: what may be cited, and the entities that are mapped to it."""
        codes = {c: [] for c in self.config.exemption_codes}
        for entity, code in sorted(self.config.entity_exemptions.items()):
            if self.config.knows(code):
                codes.setdefault(code, []).append(entity)
        return self.spark.createDataFrame(list(codes.items()), "code string, entities array<string>")

    # --- e-mails

    def exclude(self, ids: DataFrame) -> None:
        emails = redact.excluded(self.store.read("emails"), ids, self.clock())
        self.store.replace("emails", emails, by=("job_id",))
        self._log("email.excluded", emails=ids.distinct().count())

    def include(self, ids: DataFrame) -> None:
        """Those that were not withheld stay as they are, and are not logged."""
        held = self.store.read("emails").where("excluded_at IS NOT NULL").join(ids.select("id").distinct(), "id", "left_semi").count()
        if held:
            self.store.replace("emails", redact.included(self.store.read("emails"), ids), by=("job_id",))
            self._log("email.included", emails=held)

    # --- persons (a person is known by an address)

    def rename(self, person: str, display: str, note: str | None = None) -> None:
        if not display.strip():
            raise ValueError("a name is needed")
        people = self.store.read("persons")
        if not people.where(F.col("email") == person).take(1):
            raise LookupError(person)
        people = people if note is None or "notes" in people.columns else people.withColumn("notes", F.lit(None).cast("string"))
        self.store.replace("persons", resolve.renamed(people, "email", person, display, note))
        self._log("resolve.rename", person=person, display_name=display)
        if note is not None:
            self._log("resolve.note", person=person)

    # --- flags

    def flags(self) -> DataFrame:
        found = self.store.read("ai_flags")
        return self.spark.createDataFrame([], FLAGS) if found is None else found

    def scan(self, provider: ai.Provider, name: str, model: str | None = None, limit: int = 8000) -> dict:
        """All texts put before a provider; its new flags are kept. Counts: texts scanned, skipped (blank) and failed, flags written and there already, by entity."""
        run, sources = uuid.uuid4().hex, self._sources()
        self.store.replace(f"answers_{run}", ai.answered(sources, provider, limit))  # asked once
        answers = self.store.read(f"answers_{run}")
        found, old = ai.anchored(ai.parsed(answers)), self.flags()
        new = ai.unseen(found, old, name)
        base = (old.agg(F.max("id").alias("m")).first()["m"] or 0) + 1
        rows = new.select(
            (F.monotonically_increasing_id() + base).alias("id"), "source_type", "source_id", "entity_type", "start", "end", "matched_text", "confidence", "rationale", "suggested_exemption", "provider",
            F.lit(model).cast("string").alias("model"), F.lit(run).alias("qa_run_id"), F.lit(self.clock()).alias("flagged_at"), "review_status", F.lit(None).cast("string").alias("review_actor"), F.lit(None).cast("string").alias("reviewed_at"),
        )
        n_found = found.count()
        self.store.append("ai_flags", rows)
        written = {r["entity_type"]: r["n"] for r in self.flags().where(F.col("qa_run_id") == run).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n")).orderBy("entity_type").collect()}
        emails = self.store.read("emails")
        blank = emails.agg(*(F.count_if(F.coalesce(F.trim(c), F.lit("")) == "").alias(c) for c in ("subject", "body_text"))).first()
        asked = answers.agg(F.count("answer").alias("scanned"), F.count_if(F.col("answer").isNull()).alias("failed")).first()
        return {"qa_run_id": run, "sources_scanned": asked["scanned"], "sources_skipped": sum(blank), "sources_failed": asked["failed"], "flags_written": sum(written.values()), "flags_skipped_existing": n_found - sum(written.values()), "by_entity": written}

    def dismiss(self, ids: DataFrame) -> None:
        self.store.replace("ai_flags", redact.dismissed(self.flags(), ids, self.actor, self.clock()))

    def promote(self, ids: DataFrame, code: str | None = None) -> DataFrame:
        """Open flags become proposed redactions of manual origin. Returns those refused."""
        after, new = redact.promoted(self.flags(), ids, self.actor, self.clock(), self.config, code)
        refused = self.create(new)
        self.store.replace("ai_flags", after)
        return refused

    # --- imports and exports

    def imports(self) -> DataFrame:
        """Jobs with their cases, the newest first."""
        names = self.store.read("cases").select(F.col("id").alias("case_id"), F.col("name").alias("case_name"))
        return self.store.read("jobs").join(names, "case_id", "left").orderBy(F.desc("id"))

    def exported(self, path: str, manifest: DataFrame) -> str:
        """A production that was written to ``path`` is entered among the exports, by its ``produce.manifest``. Returns its name, made of the time."""
        at = self.clock()
        name = "export-" + "".join(c for c in at if c.isdigit())[:14] + "-" + uuid.uuid4().hex[:6]
        row = manifest.select(F.lit(name).alias("export_id"), F.lit(at).alias("exported_at"), F.lit(path).alias("path"), "emails_exported", "attachments_exported", "pages_written", "redactions_burned", "bates_first", "bates_last", F.lit(self.actor).alias("actor"))
        self.store.append("exports", row)
        self._log("export.run", export_id=name, path=path)
        return name

    def exports(self) -> DataFrame:
        """The newest first."""
        found = self.store.read("exports")
        return (self.spark.createDataFrame([], EXPORTS) if found is None else found).orderBy(F.desc("exported_at"), F.desc("export_id"))
