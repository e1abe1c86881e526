from pyspark.sql import functions as F

from sparkveil.config import BUILTIN, Config, Pattern
from sparkveil.operators import spans

TEXT = "Contact parent jane@example.com about SSN 572-68-1439. Home phone (571) 555-0123."


def sources(spark, *texts):
    return spark.createDataFrame([("email_body_text", i, t) for i, t in enumerate(texts)], "source_type string, source_id long, text string")


def hits(spark, patterns, *texts, **more):
    return sorted((r.source_id, r.entity_type, r.start, r.end, r.matched_text, r.recognizer) for r in spans.scan(sources(spark, *texts), patterns, **more).collect())


def test_builtins(spark):
    found = {h[1]: h[4] for h in hits(spark, [BUILTIN[k] for k in ("EMAIL_ADDRESS", "US_SSN", "PHONE_NUMBER")], TEXT)}
    assert found == {"EMAIL_ADDRESS": "jane@example.com", "US_SSN": "572-68-1439", "PHONE_NUMBER": "(571) 555-0123"}


def test_invalid_numbers(spark):
    assert not hits(spark, [BUILTIN["US_SSN"]], "000-12-3456 666-12-3456 900-12-3456 123-00-4567 x123-45-6789")
    assert [h[4] for h in hits(spark, [BUILTIN["CREDIT_CARD"]], "4111 1111 1111 1111 and 4111 1111 1111 1112")] == ["4111 1111 1111 1111"]


def test_edges_are_part_of_the_match(spark):
    """A match without an edge does not take the text of one that has it; expressions of users stay as they are."""
    assert [h[4] for h in hits(spark, [BUILTIN["CREDIT_CARD"]], "A1234 4111 1111 1111 1111")] == ["4111 1111 1111 1111"]
    assert [h[4] for h in hits(spark, [Pattern("A", "a", "\\b\\d{3}\\\\d")], "x123\\d 456\\d")] == ["456\\d"]


def test_stronger_hit_wins_and_types_overlap(spark):
    weak, strong = Pattern("CODE", "weak", "[0-9]{3,4}", 0.4), Pattern("CODE", "strong", "[0-9]{4}", 0.9)
    assert [h[5] for h in hits(spark, [weak, strong], "code 1234 here")] == ["strong"]
    assert len(hits(spark, [Pattern("A", "a", "[0-9]{8}"), Pattern("B", "b", "[0-9]{8}")], "8-digit 12345678 code")) == 2


def test_threshold(spark):
    p = [Pattern("A", "a", "[0-9]+", 0.2)]
    assert len(hits(spark, p, "1 2", min_score=0.5)) == 0 and len(hits(spark, p, "1 2", min_score=0.1)) == 2


def test_offsets_beyond_the_basic_plane_and_empty(spark):
    assert hits(spark, [Pattern("A", "a", "x+")], "🙂🙂xx é x", "", "none", None)[0][2:4] == (2, 4)


def test_wrap(spark):
    rows = spans.wrapped(sources(spark, "", "abcdef\n\nxy\tz"), 4).collect()
    got = sorted((r.source_id, r.line_no, r.start, r.line) for r in rows)
    assert got == [(0, 0, 0, ""), (1, 0, 0, "abcd"), (1, 1, 4, "ef"), (1, 2, 7, ""), (1, 3, 8, "xy z")]


def test_clip_mask_and_segments_with_nested_spans(spark):
    src = sources(spark, "abcdefghijklmnopqrst")
    marks = spark.createDataFrame([("email_body_text", 0, 0, 18), ("email_body_text", 0, 5, 8), ("email_body_text", 0, 19, 30)], "source_type string, source_id long, start int, end int")
    assert spans.masked(src, marks, "#").first().masked == "#" * 18 + "s" + "#"
    clips = spans.clipped(spans.wrapped(src, 10), marks.where("start = 5 OR start = 19"))
    assert sorted((r.line_no, r.from_col, r.to_col) for r in clips.collect()) == [(0, 5, 8), (1, 9, 10)]
    runs = sorted((r.start, r.end, r.marked) for r in spans.segmented(src, marks).collect())
    assert runs == [(0, 18, True), (18, 19, False), (19, 20, True)]


def test_replacement_drops_stale_rows_of_scanned_sources(spark):
    config = Config(patterns=(BUILTIN["EMAIL_ADDRESS"],))
    old = spans.detect(sources(spark, "a@b.org", "c@d.org"), config)
    now = sources(spark, "nothing")
    assert [r.source_id for r in spans.replaced(old, spans.detect(now, config), now).collect()] == [1]


def test_greedy_matching_and_rates(spark):
    p = spark.createDataFrame([(1, "A", 0, 5), (1, "A", 4, 8), (2, "A", 0, 1)], "doc_id long, entity_type string, start int, end int")
    g = spark.createDataFrame([(1, "A", 3, 6), (3, "B", 0, 1)], "doc_id long, entity_type string, start int, end int")
    rows = {r.entity_type: r for r in spans.with_rates(spans.matched_greedily(p, g)).collect()}
    assert (rows["A"].tp, rows["A"].fp, rows["A"].fn) == (1, 2, 0)
    assert (rows["B"].precision, rows["B"].recall, rows["B"].f1) == (1.0, 0.0, 0.0)


def test_one_scan_of_the_text(spark, tmp_path):
    sources(spark, TEXT).write.parquet(str(tmp_path / "t"))
    plan = spans.scan(spark.read.parquet(str(tmp_path / "t")), list(BUILTIN.values()))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and F is not None
