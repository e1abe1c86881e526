"""Every change at the review desk, what it refuses, and the log of it."""

import pytest

from sparkveil.config import AiConfig, Config, ConfigError, parse
from sparkveil.operators import desk, jobs
from sparkveil.operators.redact import KEY
from sparkveil.sources.store import Store

MAIL = b"""From x
From: Ann <ann@example.org>
Subject: about 572-68-1439

call (571) 555-0123 or bob@x.org, thanks
"""
CONFIG = Config(email_domains=("example.org",), exemption_codes=("PII", "FIN"), entity_exemptions={"US_SSN": "PII", "EMAIL_ADDRESS": "PII"}, default_exemption="FIN")
ROW = "source_type string, source_id long, start int, end int, exemption_code string"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("desk")
    made = Store(spark, f"file://{folder}/store")
    made.replace("cases", spark.createDataFrame([(1, "one", "processing", None, None, "2024", None)], jobs.CASE))
    (folder / "m").write_bytes(MAIL)
    assert jobs.Import(made, CONFIG, jobs.queued(made, 1, f"file://{folder}/m", "box")).run()
    return made


def keys(frame):
    return sorted((r.source_type, r.start, r.end, r.exemption_code, r.status) for r in frame.collect())


def reasons(frame):
    return sorted(r.reason for r in frame.collect())


def test_redactions_are_created_changed_and_deleted(spark, store):
    at = desk.Desk(store, CONFIG, "ann", lambda: "2025-01-01")
    before = keys(store.read("redactions"))
    assert before == [("email_body_text", 5, 19, "FIN", "proposed"), ("email_body_text", 23, 32, "PII", "proposed"), ("email_subject", 6, 17, "PII", "proposed")]
    new = [("email_body_text", 1, 0, 4, "PII"), ("email_body_text", 1, 0, 4, "PII"), ("email_body_text", 1, 5, 19, "FIN"), ("email_body_text", 1, 0, 999, "PII"), ("email_body_text", 1, 0, 4, "NOPE"), ("fax", 1, 0, 4, "PII")]
    assert reasons(at.create(spark.createDataFrame(new, ROW))) == ["beyond_text", "code_unknown", "duplicate", "duplicate", "source_type"]
    assert keys(store.read("redactions")) == sorted([*before, ("email_body_text", 0, 4, "PII", "proposed")])
    changes = [
        ("email_body_text", 1, 0, 4, "PII", "accepted", None, "ann"), ("email_body_text", 1, 5, 19, "FIN", "accepted", None, None), ("email_body_text", 1, 23, 32, "PII", None, "FIN", None),
        ("email_subject", 1, 6, 17, "PII", "gone", None, "x"), ("email_subject", 1, 7, 17, "PII", "accepted", None, "x"),
    ]
    refused = at.update(spark.createDataFrame(changes, ROW + ", new_status string, new_code string, reviewer string"))
    assert reasons(refused) == ["missing", "reviewer", "status"]
    now = keys(store.read("redactions"))
    assert ("email_body_text", 0, 4, "PII", "accepted") in now and ("email_body_text", 23, 32, "FIN", "proposed") in now
    at.create(spark.createDataFrame([("email_body_text", 1, 23, 32, "PII")], ROW))
    clash = at.update(spark.createDataFrame([("email_body_text", 1, 23, 32, "PII", "FIN")], ROW + ", new_code string"))
    assert reasons(clash) == ["duplicate"]
    assert at.update(spark.createDataFrame([("email_body_text", 1, 0, 4, "PII", "rejected")], ROW + ", new_status string")).count() == 0  # by the reviewer before
    assert at.delete(spark.createDataFrame([("email_body_text", 1, 23, 32, "PII"), ("email_body_text", 9, 9, 9, "PII")], ROW)) == 1
    assert at.propose() == {"existing": 2, "proposed": 1} and at.propose()["existing"] == 3
    assert [tuple(r) for r in at.exemptions().orderBy("code").collect()] == [("FIN", []), ("PII", ["EMAIL_ADDRESS", "US_SSN"])]


def test_mails_persons_and_exports(spark, store):
    at = desk.Desk(store, CONFIG, "ann", lambda: "2025-02-03T04:05:06+00:00")
    ids = spark.createDataFrame([(1,)], "id long")
    at.exclude(ids)
    assert store.read("emails").first().excluded_at == "2025-02-03T04:05:06+00:00"
    at.include(ids)
    at.include(ids)
    assert store.read("emails").first().excluded_at is None
    at.rename("ann@example.org", "Ann Lee", "a note")
    row = store.read("persons").where("email = 'ann@example.org'").first()
    assert (row.display_name, row.notes) == ("Ann Lee", "a note") and "Ann Lee" in row.names
    for bad, error in ((("ann@example.org", " "), ValueError), (("no@one", "x"), LookupError)):
        with pytest.raises(error):
            at.rename(*bad)
    done = spark.createDataFrame([(1, 0, 3, 2, "PROD-1", "PROD-3")], "emails_exported long, attachments_exported long, pages_written long, redactions_burned long, bates_first string, bates_last string")
    assert at.exports().count() == 0
    names = [at.exported("file:///p", done), desk.Desk(store, CONFIG, "bob", lambda: "2025-03-01").exported("file:///q", done)]
    assert [r.export_id for r in at.exports().collect()] == names[::-1] and names[0].startswith("export-20250203040506-")
    assert [(r.id, r.case_name) for r in at.imports().collect()] == [(1, "one")]


def test_flags(spark, store):
    def provider(prompt):
        if "about" in prompt:
            raise OSError("no answer")
        return 'Here: {"flags": [{"matched_text": " thanks ", "entity_type": "mood", "confidence": "2"}, {"matched_text": "not there", "entity_type": "x"}]}'

    at = desk.Desk(store, CONFIG, "ann", lambda: "2025-01-01")
    stats = at.scan(provider, "local", "m1")
    assert {k: v for k, v in stats.items() if k != "qa_run_id"} == {"sources_scanned": 1, "sources_skipped": 0, "sources_failed": 1, "flags_written": 1, "flags_skipped_existing": 0, "by_entity": {"MOOD": 1}}
    assert at.scan(provider, "local")["flags_skipped_existing"] == 1 and at.flags().count() == 1
    flag = at.flags().first()
    assert (flag.matched_text, flag.confidence, flag.review_status, flag.model) == ("thanks", 1.0, "open", "m1")
    assert at.promote(at.flags().select("id")).count() == 0 and at.flags().first().review_status == "promoted"
    made = store.read("redactions").where("origin = 'manual'").select(*KEY, "status").collect()
    assert (flag.source_type, flag.source_id, flag.start, flag.end, "FIN", "proposed") in [tuple(r) for r in made]
    at.dismiss(at.flags().select("id"))
    assert at.flags().first().review_status == "promoted"  # only open ones


def test_everything_is_in_the_log(store):
    logged = {r.event_type for r in store.read("audit_log").collect()}
    assert {"redaction.create", "redaction.update", "redaction.delete", "redaction.propose", "email.excluded", "email.included", "resolve.rename", "resolve.note", "export.run"} <= logged
    assert store.read("audit_log").where("event_type = 'email.included'").count() == 1


def test_providers_and_actors(monkeypatch):
    kinds = {"remote": desk.ProviderKind(lambda **k: lambda prompt: str(k), needs_url=True, default_model="d"), "near": desk.ProviderKind(lambda **k: lambda prompt: "{}", needs_key=False)}
    choose = lambda env=None, **k: desk.choose_provider(AiConfig(**{x: k.pop(x) for x in list(k) if x in AiConfig.__dataclass_fields__ and x not in ("provider", "model")} | k.pop("own", {})), kinds, environ=env or {}, **k)
    assert choose()[0] == "null" and choose(own={"provider": "remote"})[0] == "null"  # not enabled
    assert choose(enabled=True, own={"provider": "near", "model": "m"})[:2] == ("near", "m")
    name, model, made = choose({"SPARKVEIL_AI_KEY": "k"}, base_url="u", provider="REMOTE")
    assert (name, model, made("")) == ("remote", "d", "{'model': 'd', 'base_url': 'u', 'api_key': 'k'}")
    for k, e in (({"provider": "remote", "base_url": "u"}, "key"), ({"provider": "remote"}, "base_url"), ({"provider": "near"}, "model"), ({"provider": "what"}, "unknown")):
        with pytest.raises(desk.ProviderError, match=e):
            choose(**k)
    monkeypatch.setenv("SPARKVEIL_ACTOR", "env")
    assert desk.actor_of("x") == "x" and desk.actor_of() == "env"
    monkeypatch.delenv("SPARKVEIL_ACTOR")
    assert desk.actor_of().startswith("cli")
    c = parse({"ai": {"enabled": True, "provider": "Near"}, "departments": {"hr": "people"}})
    assert c.ai.provider == "near" and c.departments == {"hr": "people"}
    for bad in ({"ai": {"max_input_chars": 0}}, {"departments": ["x"]}):
        with pytest.raises(ConfigError):
            parse(bad)
