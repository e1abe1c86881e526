import pytest
from pyspark.sql import functions as F

from sparkveil.config import Bates, Config
from sparkveil.operators import ai, produce, query, redact, resolve, search
from sparkveil.operators.snippets import snippet
from sparkveil.sources.store import AppendOnly, Store

BODY = [("email_body_text", 1, "hello 572-68-1439 world"), ("email_subject", 1, "ID")]
SRC = "source_type string, source_id long, text string"
DET = "source_type string, source_id long, entity_type string, start int, end int, score double, recognizer string"


def test_propose_and_propose_again(spark):
    config = Config(entity_exemptions={"US_SSN": "PII", "STUDENT_ID": "FERPA"})
    det = spark.createDataFrame([("email_body_text", 1, "US_SSN", 6, 17, 0.9, "a"), ("email_subject", 1, "STUDENT_ID", 0, 2, 0.5, "b"), ("email_subject", 1, "OTHER", 0, 2, 0.5, "c"), ("email_subject", 1, "US_SSN", 0, 99, 0.5, "d")], DET)
    src = spark.createDataFrame(BODY, SRC)
    rows = redact.proposals(det, src, None, config)
    assert sorted((r.exemption_code or "", r.outcome) for r in rows.collect()) == [("", "no_exemption"), ("FERPA", "proposed"), ("PII", "invalid"), ("PII", "proposed")]
    again = redact.proposals(det, src, rows.where("outcome = 'proposed'"), config)
    assert sorted(r.outcome for r in again.collect()) == ["existing", "existing", "invalid", "no_exemption"]


def test_review_needs_a_reviewer(spark):
    rows = spark.createDataFrame([("t", 1, 0, 2, "PII", "proposed", None)], "source_type string, source_id long, start int, end int, exemption_code string, status string, reviewer_id string")
    say = lambda who: spark.createDataFrame([("t", 1, 0, 2, "PII", "accepted", who)], "source_type string, source_id long, start int, end int, exemption_code string, new_status string, reviewer string")
    assert redact.reviewed(rows, say(None)).first().status == "proposed"
    assert redact.reviewed(rows, say("ann")).first().status == "accepted"


def test_insert_or_ignore_is_null_safe(spark):
    t = spark.createDataFrame([("a", None, 1)], "k string, s string, v int")
    out = redact.inserted(t, spark.createDataFrame([("a", None, 2), ("b", None, 3), ("b", None, 4)], t.schema), ["k", "s"], ["v"])
    assert sorted((r.k, r.v) for r in out.collect()) == [("a", 1), ("b", 3)]


def test_persons(spark):
    schema = "id long, from_addr string, to_addrs array<string>, cc_addrs array<string>, bcc_addrs array<string>, body_text string, date_sent string, ingested_at string"
    mail = [(1, "Al  B. <AL@x.org>", ["b@y.org"], ["C <c@z.org>"], [], "hi\nThanks,\nal@x.org d@q.org", None, "2024")]
    seen = resolve.sightings(spark.createDataFrame(mail, schema))
    people = {r.email: r for r in resolve.persons(seen, ("x.org",)).collect()}
    assert set(people) == {"al@x.org", "b@y.org", "c@z.org", "d@q.org"}
    assert people["al@x.org"].display_name == "Al B" and people["al@x.org"].is_internal and people["b@y.org"].display_name == "b@y.org"


def test_signature_rules(spark):
    bodies = [("a@b.org\nBest,\nx@y.org",), ("-- Alice\n" + "\n".join(f"l{i}@a.org" for i in range(8)),), (None,), ("",)]
    got = [list(r[0]) for r in spark.createDataFrame(bodies, "b string").select(resolve.signature_emails(F.col("b"))).collect()]
    assert got[0] == ["x@y.org"] and got[1] == [f"l{i}@a.org" for i in range(2, 8)] and got[2:] == [[], []]


def test_as_of(spark):
    facts = spark.createDataFrame([(1, "2022-01-01", "in", 1), (1, "2024-01-01", "out", 2), (1, "2024-01-01", "out2", 3)], "p long, t string, v string, id long")
    probes = spark.createDataFrame([(1, "2022-06-01"), (1, "2024-01-01"), (1, "2020-01-01")], "p long, t string")
    assert {r.t: r.v for r in resolve.as_of(probes, facts, ["p"], "t", "v", "id").collect()} == {"2022-06-01": "in", "2024-01-01": "out2", "2020-01-01": None}
    assert {r.v for r in resolve.classified(facts, "2024-02-01", ["p"], "t").collect()} == {"out", "out2"}


def test_pages_and_labels(spark):
    docs = spark.createDataFrame([(1, None, 10, 3), (2, "2024", 50, 3), (3, "2023", 49, 3), (4, "2024", 0, 3)], "id long, date_sent string, lines long, headers int")
    rows = {r.id: (r.pages, r.first_page, r.last_page) for r in produce.laid_out(docs, Bates("ECPS", 42, 4)).collect()}
    assert rows == {3: (1, "ECPS-0042", "ECPS-0042"), 2: (2, "ECPS-0043", "ECPS-0044"), 4: (1, "ECPS-0045", "ECPS-0045"), 1: (1, "ECPS-0046", "ECPS-0046")}


def test_search_and_snippet(spark):
    docs = spark.createDataFrame([("email", 1, "Été report", "the annual report of x-ray work"), ("email", 2, None, "ete work"), ("email", 3, "a", "ray x"), ("email", 4, "b", "c")], "scope string, id long, title string, text string")
    find = lambda q: [r.id for r in search.search(docs, ["title", "text"], q).orderBy("score", "id").collect()]
    assert find("été report") == [1] and find("x-ray") == [1] and set(find("ete")) == {1, 2}
    with pytest.raises(ValueError):
        find('  "" ')
    shown = lambda i, q: docs.where(F.col("id") == i).select(snippet(q)(F.col("title"), F.col("text"))).first()[0]
    assert shown(1, "x") == "the annual report of <mark>x</mark>-ray work"  # a hit is a token, as in the search that finds it
    assert shown(2, "work") == "ete <mark>work</mark>"


def test_flags(spark):
    src = spark.createDataFrame([("t", 1, "call Bob or Bob now"), ("t", 2, " ")], SRC)
    said = ai.answered(src, lambda p: 'ok ```{"flags":[{"matched_text":" Bob ","entity_type":"person","confidence":"9"},{"matched_text":"Eve"},{"matched_text":"Bob","entity_type":"PERSON"}]}```')
    rows = ai.anchored(ai.parsed(said)).collect()
    assert [(r.start, r.end, r.entity_type) for r in rows] == [(5, 8, "PERSON")] and rows[0].confidence in (1.0, 0.5)


def test_store_is_append_only_for_the_log(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    store.log("detect.run", "ann", {"n": 1}, "2024")
    store.log("detect.run", "bob", {}, "2025")
    assert store.read("audit_log").count() == 2
    with pytest.raises(AppendOnly):
        store.replace("audit_log", spark.range(1))
    store.replace("t", spark.range(3))
    store.replace("t", store.read("t").where("id > 0"))
    assert store.read("t").count() == 2


def test_paging_bounds(spark):
    with pytest.raises(ValueError):
        query.page(spark.range(1), ["id"], 501)
