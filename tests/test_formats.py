import json

import pytest

from sparkveil import config
from sparkveil.functions.html import sanitized, text_of
from sparkveil.sources import mail
from sparkveil.streaming.events import lockouts, tail

RAW = b"""From a@b Mon Jan  1 00:00:00 2024
From: Ann Lee <ann@example.org>
To: bob@x.org, Cy <cy@y.org>
Subject: =?utf-8?q?caf=C3=A9?=
Date: Mon, 1 Jan 2024 10:00:00 +0200
Message-ID: <1@x>
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary=q

--q
Content-Type: text/plain; charset=nope

hello
--q
Content-Type: text/html

<p>Hi <b>you</b></p><script>x()</script>
--q
Content-Type: application/pdf; name="a b.pdf"
Content-Disposition: attachment; filename="a b.pdf"
Content-Transfer-Encoding: base64

JVBERg==
--q
Content-Type: message/rfc822

Subject: inner
From: z@z.org

text
--q--

From c@d Mon Jan  1 00:00:00 2024
Subject: two

>From here
"""


def test_html():
    assert text_of("<p>Hello <b>world</b></p><script>x</script>") == "Hello world"
    assert sanitized('<p onclick="x()">a<script>b</script><a href="javascript:x" title="t">c</a><iframe>d</iframe><font>e</font><!-- f -->') == '<p>a<a title="t">c</a>e</p>'
    assert "url-removed(" in sanitized("<p>url (x)</p>") and sanitized(None) is None and sanitized("") == ""


def test_messages():
    one, two = mail.split_mbox(RAW)
    m = mail.parsed_message(one)
    assert (m["subject"], m["from_addr"], m["to_addrs"], m["date_sent"]) == ("café", "Ann Lee <ann@example.org>", ["bob@x.org", "Cy <cy@y.org>"], "2024-01-01T08:00:00+00:00")
    assert [(a["filename"], a["is_nested_eml"]) for a in m["attachments"]] == [("a_b.pdf", False), ("inner.eml", True)]
    assert m["body_text"].strip() == "hello" and "script" not in m["body_html_sanitized"]
    assert mail.parsed_message(two)["body_text"].startswith(">From here")
    assert mail.utc_iso("no date") is None


def test_mbox_in_spark(spark, tmp_path):
    (tmp_path / "m.mbox").write_bytes(RAW)
    rows = mail.parsed(mail.read_mbox(spark, f"file://{tmp_path}/m.mbox", "box"))
    assert [(r.mbox_index, r.subject, r.error) for r in rows.orderBy("mbox_index").collect()] == [(0, "café", None), (1, "two", None)]
    files = mail.explode_attachments(rows).selectExpr("cast(pos as long) AS id", "content_type", "content")
    got = {r.id: r.extraction_status for r in mail.extract(files).collect()}
    assert got[1] == "ok" and got[0] in ("failed", "ok", "empty")
    spark.dataSource.register(mail.MboxSource)
    assert spark.read.format("mbox").option("path", str(tmp_path / "m.mbox")).load().count() == 2


def random_mailbox(seed, n):
    import random

    r = random.Random(seed)
    return b"".join(b"From x%d\n" % i + b"".join(r.choice([b"a line\n", b"\n", b">From q\n", b"From\n", b"xFrom y\n", b"x" * r.randrange(50) + b"\n"]) for _ in range(r.randrange(6))) for i in range(n))


@pytest.mark.parametrize("step", [1, 7, 64, 1 << 20])
def test_ranges_of_a_mailbox_hold_every_message_once(step):
    import io

    data = random_mailbox(step, 60)
    want = list(mail.split_mbox(data))
    for size in (5, 33, 1000, len(data)):
        got = [x for a in range(0, len(data), size) for x in mail.messages_between(io.BytesIO(data), a, min(a + size, len(data)), step)]
        assert [raw for _, raw in got] == want and all(data[p:].startswith(b"From ") for p, _ in got)
    assert list(mail.messages_between(io.BytesIO(b"no message\nFrom b\n\nx\n"), 0, None)) == [(11, b"\nx\n")]


def test_mailboxes_as_a_source_and_as_a_stream(spark, tmp_path):
    """A folder of mailboxes: many ranges, names by file, and the same rows from a stream that saw them grow."""
    folder = tmp_path / "box"
    folder.mkdir()
    data = {n: random_mailbox(i, 25) for i, n in enumerate(("a", "b"))}
    spark.dataSource.register(mail.MboxSource)
    for n, x in data.items():
        (folder / n).write_bytes(x)
    rows = spark.read.format("mbox").option("path", f"file://{folder}").option("label", "L").option("partitionbytes", "100").load()
    batch = {(r.mbox_source, r.mbox_offset): bytes(r.raw) for r in rows.collect()}
    assert rows.rdd.getNumPartitions() > 10 and len(batch) == 50 and {s for s, _ in batch} == {"L/a", "L/b"}
    grown = tmp_path / "grown"
    grown.mkdir()

    def follow(settled):
        flow = spark.readStream.format("mbox").option("path", str(grown)).option("label", "L").option("folder", "true").option("settled", settled).load()
        flow.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start().processAllAvailable()
        for q in spark.streams.active:
            q.stop()

    for share, settled in ((0.3, "false"), (0.31, "false"), (0.8, "false"), (1.0, "true")):
        for n, x in data.items():
            (grown / n).write_bytes(x[: int(len(x) * share)])
        follow(settled)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 50 and {(r.mbox_source, r.mbox_offset): bytes(r.raw) for r in got.collect()} == batch


def test_mailbox_boundaries_are_those_of_the_standard_library(spark, tmp_path):
    import mailbox

    data = b"From a\nSubject: 1\n\nbody\nFrom b\nSubject: 2\n\n>From x\n\nFrom c\n\nFrom d\nSubject: 4\n\nlast\n\n"
    (tmp_path / "m").write_bytes(data)
    box = mailbox.mbox(str(tmp_path / "m"))
    want = [box.get_bytes(k) for k in box.keys()]  # noqa: SIM118
    assert list(mail.split_mbox(data)) == want and len(want) == 4
    for limit in ("128m", "8b"):  # many blocks give the same numbers
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
        rows = mail.read_mbox(spark, f"file://{tmp_path}/m").orderBy("mbox_index").collect()
        assert [(r.mbox_index, bytes(r.raw)) for r in rows] == list(enumerate(want))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "n").write_bytes(b"no message\nFrom b\n\nx\n")
    assert [(r.mbox_index, bytes(r.raw)) for r in mail.read_mbox(spark, f"file://{tmp_path}/n").collect()] == [(0, b"\nx\n")]


def test_text_ladder():
    assert mail.decoded_text("é".encode("utf-16")) == "é" and mail.decoded_text(b"\xe9") == "é" and mail.needs_ocr(2, 39) and not mail.needs_ocr(2, 40)
    assert mail.extracted_text("TEXT/plain; charset=x", b" a ")["extracted_text"] == "a" and mail.extracted_text("video/mp4", b"")["extraction_status"] == "unsupported"


def test_config(tmp_path):
    raw = {"name": "d", "pii_detection": {"builtins": ["US_SSN", "NOPE"], "min_score": 0.4, "custom_recognizers": [{"name": "sid", "entity_type": "STUDENT_ID", "patterns": [{"regex": r"\b\d{8}\b"}]}]}, "exemptions": {"codes": ["PII"], "default": "PII"}, "bates": {"width": 4}}
    (tmp_path / "c.json").write_text(json.dumps(raw))
    c = config.load(str(tmp_path / "c.json"))
    assert [p.entity for p in c.patterns] == ["US_SSN", "STUDENT_ID"] and c.patterns[1].score == 0.5 and c.exemption_for("X") == "PII"
    with pytest.raises(config.ConfigError):
        config.parse({"pii_detection": {"min_score": 2}})
    assert config.load(None) == config.Config()


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("SELECT id, id % 3 AS user_id, timestamp_seconds(1704067200 + id * 100) AS ts FROM range(60)")
    rows.write.parquet(str(tmp_path / "e"))
    flow = tail(spark, str(tmp_path / "e"), "id long, user_id long, ts timestamp")
    run = lockouts(flow, 3, 15).writeStream.format("memory").queryName("locks").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    from sparkveil.operators.resolve import recent_failures

    want = recent_failures(rows, 15).where("n_recent >= 3").count()
    assert spark.table("locks").count() == want > 0


def test_a_late_failure_is_judged_by_its_time_and_state_goes(spark, tmp_path):
    for i, times in enumerate([[0, 60], [30, 7200], [7201, 20000]]):
        spark.createDataFrame([(1, t) for t in times], "user_id long, s long").selectExpr("user_id", "timestamp_seconds(1704067200 + s) AS ts").coalesce(1).write.mode("append").parquet(str(tmp_path / f"e/{i}"))
    flow = spark.readStream.schema("user_id long, ts timestamp").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "e"))
    run = lockouts(flow, 2, 15).writeStream.format("memory").queryName("late").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    got = sorted((r.micros // 10**6 - 1704067200, r.n) for r in spark.table("late").collect())
    assert got == [(30, 2), (60, 2), (7201, 2)]


def test_slices_go_and_rows_beyond_the_watermark_are_dropped(spark, tmp_path):
    """Five files, a batch each: late within the lateness counts, late beyond it does not, and the last batch finds only its own slice."""
    batches = [[0, 100, 200], [1000], [150, 5000], [10, 5001, 4200], [90000]]
    for i, times in enumerate(batches):
        spark.createDataFrame([(7, t) for t in times], "user_id long, s long").selectExpr("user_id", "timestamp_seconds(1704067200 + s) AS ts").coalesce(1).write.mode("append").parquet(str(tmp_path / f"e/{i}"))
    flow = spark.readStream.schema("user_id long, ts timestamp").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    writer = lockouts(flow, 1, 15).writeStream.format("memory").queryName("slices").outputMode("append")
    run = writer.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = sorted((r.micros // 10**6 - 1704067200, r.n) for r in spark.table("slices").collect())
    assert got == [(0, 1), (100, 2), (150, 3), (200, 3), (1000, 3), (4200, 1), (5000, 1), (5001, 3), (90000, 1)]


def test_follow_goes_on_until_the_last_event(spark, tmp_path):
    import threading

    from sparkveil.streaming.events import EVENT, follow

    folder, seen = str(tmp_path / "events"), []
    put = lambda *rows: spark.createDataFrame([(i, 1, s, k, "", "{}", None) for i, s, k in rows], EVENT).coalesce(1).write.mode("append").parquet(folder)
    put((2, "ingest", "finished"), (1, "ingest", "started"))
    later = threading.Timer(4, lambda: put((3, "done", "finished")))
    later.start()
    assert follow(tail(spark, folder), lambda b, _: seen.extend(r.id for r in b.collect()), str(tmp_path / "c"), deadline_s=60)
    assert seen == [1, 2, 3]
    assert not follow(tail(spark, folder).where("id < 3"), lambda b, _: None, str(tmp_path / "d"), deadline_s=3)


def test_lockout_asks_for_its_slices_once():
    from types import SimpleNamespace as Made

    import pandas as pd

    from sparkveil.streaming.events import _Failures

    kept, asked = {(0,): ([5],)}, []
    state = Made(keys=lambda: asked.append("keys") or iter(list(kept)), getValue=lambda k: asked.append(k) or kept[k], updateValue=lambda k, v: kept.__setitem__(k, v), containsKey=lambda k: asked.append("one") or k in kept)
    work = _Failures(2, 160)
    work.init(Made(getMapState=lambda *a: state, registerTimer=lambda at: None))
    out = list(work.handleInputRows((7,), iter([pd.DataFrame({"micros": [165, 12, 400]})]), Made(getCurrentWatermarkInMs=lambda: 0)))[0]
    assert out.values.tolist() == [[7, 12, 2], [7, 165, 3]] and asked == ["keys", (0,)]
    assert kept == {(0,): ([5],), (1,): ([12],), (16,): ([165],), (40,): ([400],)}
