import pytest

from sparkveil.config import Config
from sparkveil.operators import cases, jobs, query, resolve
from sparkveil.sources.store import Store

RAW = b"""From a
From: Ann Lee <ann@example.org>
To: bob@x.org
Subject: about 572-68-1439
Date: Mon, 1 Jan 2024 10:00:00 +0000

call (571) 555-0123

From b
From: bob@x.org
Subject: two

nothing
"""
CONFIG = Config(email_domains=("example.org",), entity_exemptions={"US_SSN": "PII"})


def started(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.replace("cases", spark.createDataFrame([(1, "one", "processing", None, None, "2024", None)], jobs.CASE))
    return store


def events(store):
    return [(r.stage, r.kind) for r in cases.job_events(store.read("events"), 1).collect()]


def test_import_and_again(spark, tmp_path):
    store = started(spark, tmp_path)
    (tmp_path / "m.mbox").write_bytes(RAW)
    job = jobs.queued(store, 1, f"file://{tmp_path}/m.mbox", "box")
    assert jobs.Import(store, CONFIG, job).run()
    five = [x for s in ("ingest", "extract", "detect", "resolve", "propose") for x in ((s, "started"), (s, "finished"))]
    assert events(store) == [*five, ("done", "finished")]
    assert [r.status for r in store.read("cases").collect()] == ["ready"] and query.one(store.read("jobs"), "id", 1).first().status == "succeeded"
    tables = ("emails", "persons", "detections", "redactions")
    counts = [store.read(t).count() for t in tables]
    assert counts[:3] == [2, 2, 2] and counts[3] == 1
    assert jobs.Import(store, CONFIG, jobs.queued(store, 1, f"file://{tmp_path}/m.mbox", "box", propose=False)).run()
    assert [store.read(t).count() for t in tables] == counts  # nothing twice
    assert [r.event_type for r in store.read("audit_log").collect()] == ["import.run", "import.run"]


def test_a_folder_of_mailboxes_and_writes_in_proportion(spark, tmp_path):
    store = started(spark, tmp_path)
    (tmp_path / "box").mkdir()
    for n in "ab":
        (tmp_path / "box" / n).write_bytes(RAW.replace(b"nothing", n.encode()))
    assert jobs.Import(store, CONFIG, jobs.queued(store, 1, f"file://{tmp_path}/box", "box")).run()
    rows = store.read("emails").orderBy("id").collect()
    assert [(r.id, r.mbox_source, r.mbox_index) for r in rows] == [(1, "box/a", 0), (2, "box/a", 1), (3, "box/b", 0), (4, "box/b", 1)]
    found = {r.source_id for r in store.read("detections").collect()}
    assert found == {1, 3}
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet") if "persons" not in str(p)}
    (tmp_path / "a").write_bytes(RAW.replace(b"572-68-1439", b"572-68-1440"))  # a later mailbox of the same name and size
    assert jobs.Import(store, CONFIG, jobs.queued(store, 1, f"file://{tmp_path}/a", "box/a")).run()
    assert sorted(r.id for r in store.read("emails").collect()) == [1, 2, 3, 4, 5, 6]
    assert {p: p.stat().st_mtime_ns for p in before if p.exists() and not {"jobs", "cases"} & set(p.parts)} == {p: t for p, t in before.items() if not {"jobs", "cases"} & set(p.parts)}
    old = sorted(tuple(r) for r in store.read("detections").select("source_id", "matched_text", "job_id").collect())
    assert jobs.rescan(store, CONFIG)["detections_written"] == len(old)
    assert sorted(tuple(r) for r in store.read("detections").select("source_id", "matched_text", "job_id").collect()) == old


def test_failure_and_retry(spark, tmp_path):
    store = started(spark, tmp_path)
    job = jobs.queued(store, 1, f"file://{tmp_path}/later.mbox", "box")
    assert not jobs.Import(store, CONFIG, job).run()
    row = query.one(store.read("jobs"), "id", job).first()
    assert (row.status, row.failed_stage) == ("failed", "ingest") and events(store) == [("ingest", "started"), ("ingest", "failed")]
    assert store.read("cases").first().status == "failed"
    (tmp_path / "later.mbox").write_bytes(RAW)
    assert jobs.retry(store, CONFIG, job) and events(store)[2] == ("job", "started")
    with pytest.raises(cases.CaseError):
        jobs.retry(store, CONFIG, job)
    with pytest.raises(LookupError):
        jobs.retry(store, CONFIG, 99)


def test_states(spark):
    with pytest.raises(cases.CaseError):
        cases.with_status(spark.createDataFrame([], jobs.CASE), 1, "gone", "2024")
    people = spark.createDataFrame([(x,) for x in "abc"], "person string")
    merges = lambda *m: resolve.checked_merges(spark.createDataFrame(list(m), "loser string, winner string"), people)
    assert sorted(tuple(r) for r in merges(("a", "b"), ("b", "c")).collect()) == [("a", "c"), ("b", "c")]
    for bad in ([("a", "a")], [("a", "z")], [("a", "b"), ("b", "a")], [("a", "b"), ("a", "c")]):
        with pytest.raises(resolve.MergeError):
            merges(*bad)


def test_a_version_number_is_taken_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    store.replace("t", spark.range(2))
    (tmp_path / "t/number-000000000002").touch()  # another writer was here first
    with pytest.raises(Exception, match="exist"):
        store.replace("t", spark.range(3))
    assert store.read("t").count() == 2
