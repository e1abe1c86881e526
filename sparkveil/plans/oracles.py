"""The registered queries once more, in DuckDB's SQL, from the standard tables alone."""

from __future__ import annotations

from sparkveil.config import BUILTIN, SAMPLE, Pattern
from sparkveil.operators.resolve import EMAIL, SIGN_OFFS
from sparkveil.sources import generator
from sparkveil.sources.fixtures import ATTACHMENTS, EMAILS, HTML_MAILS

ORACLES: dict[str, str] = {}

_TEXT = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g'))"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _hits(p: Pattern, order: int, sources: str = "bodies") -> str:
    """SQL for the matches of one pattern: the texts between matches, and the matches, give offsets."""
    re = _quoted(p.regex)
    tests = ["true"]
    if p.check == "luhn":
        digits = "regexp_replace(hit, '[^0-9]', '', 'g')"
        at = f"CAST(substr({digits}, length({digits}) - j, 1) AS INTEGER)"
        tests.append(f"list_sum(list_transform(range(0, length({digits})), lambda j: CASE WHEN j % 2 = 0 THEN {at} WHEN {at} > 4 THEN 2 * {at} - 9 ELSE 2 * {at} END)) % 10 = 0")
    if p.check == "ssn":
        tests.append("substr(hit, 1, 3) NOT IN ('000', '666') AND substr(hit, 1, 1) <> '9' AND substr(hit, 5, 2) <> '00' AND substr(hit, 8, 4) <> '0000'")
    return f"""SELECT source_type, source_id, '{p.entity}' AS entity_type, s AS start_offset, e AS end_offset, CAST({p.score} AS DOUBLE) AS score, '{p.recognizer}' AS recognizer, hit AS matched_text, {order} AS ord
FROM (SELECT *, s + length(hit) AS e FROM (
  SELECT source_type, source_id, text, m[i] AS hit,
    CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS s
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT *, regexp_extract_all(text, {re}) AS m, string_split_regex(text, {re}) AS g FROM {sources}))))
WHERE {' AND '.join(tests)}"""


BODIES = "SELECT 'email_body_text' AS source_type, doc_id AS source_id, text FROM documents"
SOURCES = f"""SELECT * FROM bodies UNION ALL SELECT 'email_subject', id, subject FROM emails WHERE subject <> ''
UNION ALL SELECT 'attachment_text', id, t FROM (SELECT id, {_TEXT} AS t FROM attachments WHERE extraction_status = 'ok') WHERE t <> ''"""


def _detections(sources: str = "bodies") -> str:
    """Overlaps: the two patterns of one entity are the strong card pattern and the weak run of digits, which yields."""
    hits = "\nUNION ALL\n".join(f"({_hits(p, i, sources)})" for i, p in enumerate(SAMPLE.patterns))
    return f"""SELECT h.* FROM ({hits}) h WHERE recognizer <> 'digits' OR NOT EXISTS (
  SELECT 1 FROM ({_hits(next(p for p in SAMPLE.patterns if p.recognizer == 'card'), 0, sources)}) x
  WHERE x.source_type = h.source_type AND x.source_id = h.source_id AND x.start_offset < h.end_offset AND h.start_offset < x.end_offset)"""


CODE = "CASE entity_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SAMPLE.entity_exemptions.items()) + " END"
KNOWN = "exemption_code IN (" + ", ".join(f"'{x}'" for x in SAMPLE.exemption_codes) + ")"
PROPOSED = f"""SELECT *, row_number() OVER (PARTITION BY source_type, source_id, start_offset, end_offset, exemption_code ORDER BY entity_type, recognizer) AS nth
FROM (SELECT *, {CODE} AS exemption_code FROM detections) WHERE {KNOWN}"""
REDACTIONS = "SELECT *, CASE source_id % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'proposed' END AS status FROM proposed WHERE nth = 1"
LINES = r"""SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY start_offset) - 1 AS BIGINT) AS line_no, start_offset, line FROM (
  SELECT source_id, CAST(base + a AS INTEGER) AS start_offset, regexp_replace(substr(p, CAST(a + 1 AS BIGINT), 88), '[\x00-\x09\x0B-\x1F\x7F]', ' ', 'g') AS line
  FROM (SELECT source_id, p, base, unnest(range(0, greatest(1, length(p)), 88)) AS a FROM (
    SELECT source_id, ps[i] AS p, coalesce(list_sum(list_transform(ps[1:i - 1], lambda x: length(x) + 1)), 0) AS base
    FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT source_id, string_split(text, chr(10)) AS ps FROM bodies)))))"""
CLIPS = """SELECT l.source_id, l.line_no, s.start_offset AS span_start, s.end_offset AS span_end,
  greatest(l.start_offset, s.start_offset) - l.start_offset AS from_col, least(l.start_offset + length(l.line), s.end_offset) - l.start_offset AS to_col
FROM lines l JOIN detections s ON s.source_id = l.source_id AND s.start_offset < l.start_offset + length(l.line) AND l.start_offset < s.end_offset WHERE s.source_id % 2 = 0"""
#: With 3 headers 25 units come before the body: 50 lines fit on the first page, 55 on each other one.
LAYOUT = """SELECT id, pages, coalesce(sum(pages) OVER (ORDER BY date_sent NULLS LAST, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
  SELECT id, date_sent, CASE WHEN n <= 49 THEN 1 WHEN n = 50 THEN 2 ELSE 2 + (n - 51) // 55 + CASE WHEN (n - 50) % 55 = 0 THEN 1 ELSE 0 END END AS pages
  FROM (SELECT id, date_sent, greatest(1, coalesce(k, 0)) AS n FROM emails LEFT JOIN (SELECT source_id, count(*) AS k FROM lines GROUP BY 1) ON source_id = id WHERE excluded_at IS NULL))"""
RUNS = """SELECT source_id, start_offset, end_offset, size, coalesce(max(end_offset) OVER (PARTITION BY source_id ORDER BY start_offset, end_offset DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cur
FROM cut"""
NAME = "regexp_replace(trim(from_name), '\\s+', ' ', 'g')"
MARKERS = ", ".join(f"'{x}'" for x in SIGN_OFFS)
SIGNED = f"""SELECT doc_id, list_distinct_in_order AS found FROM (
  SELECT doc_id, list_filter(es, lambda x, i: list_position(es, x) = i) AS list_distinct_in_order FROM (
    SELECT doc_id, list_transform(regexp_extract_all(region, {_quoted(EMAIL)}), lambda x: lower(x)) AS es FROM (
      SELECT doc_id, array_to_string(CASE WHEN mark > 0 THEN ls[mark + 1:len(ls)] ELSE tail[greatest(1, len(tail) - 5):len(tail)] END, chr(10)) AS region FROM (
        SELECT doc_id, ls, coalesce(list_max(list_transform(ls, lambda x, i: CASE WHEN lower(trim(x)) IN ({MARKERS}) THEN i ELSE 0 END)), 0) AS mark,
               list_filter(ls[greatest(1, len(ls) - 19):len(ls)], lambda x: trim(x) <> '') AS tail
        FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS ls FROM documents)))))"""
SEEN = f"""SELECT id AS email_id, 'from' AS role, lower(trim(from_addr)) AS email, {NAME} AS name, coalesce(date_sent, ingested_at) AS observed_at FROM emails
UNION ALL SELECT id, 'to', lower(to_addr), NULL, coalesce(date_sent, ingested_at) FROM emails
UNION ALL SELECT id, 'cc', lower(cc_addr), NULL, coalesce(date_sent, ingested_at) FROM emails WHERE cc_addr IS NOT NULL
UNION ALL SELECT id, 'signature', x, NULL, coalesce(date_sent, ingested_at) FROM (SELECT emails.*, unnest(found) AS x FROM emails JOIN signed ON doc_id = id) WHERE x <> lower(trim(from_addr))"""
GOLD = """SELECT k, text, e, s, s + n AS t FROM (
  SELECT k, 'SSN ' || ssn || ' born ' || born || ' call ' || tel || ' or write ' || mail || ' by 1-800.' AS text, unnest([
    {'e': 'US_SSN', 's': 4, 'n': length(ssn)}, {'e': 'DATE_TIME', 's': 10 + length(ssn), 'n': length(born)},
    {'e': 'PHONE_NUMBER', 's': 16 + length(ssn) + length(born), 'n': length(tel)}, {'e': 'EMAIL_ADDRESS', 's': 26 + length(ssn) + length(born) + length(tel), 'n': length(mail)}], recursive := true)
  FROM (SELECT c_custkey AS k, printf('%03d-%02d-%04d', c_custkey % 600 + 10, c_custkey % 90 + 1, c_custkey % 9000 + 1) AS ssn, printf('%02d/%02d/2024', c_custkey % 12 + 1, c_custkey % 28 + 1) AS born,
        printf('(%03d) 555-%04d', c_custkey % 700 + 200, c_custkey % 10000) AS tel, 'c' || c_custkey || '@example.org' AS mail FROM customer))"""
#: The patterns find every value that was written, except numbers whose area is 666; gold leaves out some phones.
PRF = """SELECT e AS entity_type, CAST(count(*) FILTER (found AND gold) AS BIGINT) AS tp, CAST(count(*) FILTER (found AND NOT gold) AS BIGINT) AS fp, CAST(count(*) FILTER (gold AND NOT found) AS BIGINT) AS fn
FROM (SELECT e, NOT (e = 'US_SSN' AND substr(text, 5, 3) IN ('000', '666')) AS found, NOT (e = 'PHONE_NUMBER' AND k % 10 = 0) AS gold FROM gold) GROUP BY e"""
RATES = "round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 4) AS f1"
WORDS = "regexp_extract_all(strip_accents(lower(TEXT)), '[\\p{L}\\p{N}]+')"
SEARCHED = f"""SELECT 'email' AS scope, id, subject AS title, body_text AS text FROM emails UNION ALL SELECT 'attachment', id, filename, {_TEXT} FROM attachments"""
TOKENS = f"SELECT scope, id, title, text, {WORDS.replace('TEXT', 'title')} AS a, {WORDS.replace('TEXT', 'text')} AS b FROM searched"


def _bm25(terms: list[str]) -> str:
    idf = "greatest(1e-6, ln((n - df{0} + 0.5) / (df{0} + 0.5))) * tf{0} * 2.2 / (tf{0} + 1.2 * (0.25 + 0.75 * size / avg_size))"
    tfs = ", ".join(f"{t} AS tf{i}" for i, t in enumerate(terms))
    dfs = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(idf.format(i) for i in range(len(terms)))
    return f"""SELECT scope, id, round(-({score}), 6) AS score FROM (SELECT scope, id, len(a) + len(b) AS size, {tfs} FROM tokens) JOIN
(SELECT scope, count(*) AS n, avg(size) AS avg_size, {dfs} FROM (SELECT scope, len(a) + len(b) AS size, {tfs} FROM tokens) GROUP BY scope) USING (scope)
WHERE {' AND '.join(f'tf{i} > 0' for i in range(len(terms)))}"""


def _one(w: str) -> str:
    return f"len(list_filter(a, lambda x: x = '{w}')) + len(list_filter(b, lambda x: x = '{w}'))"


def _two(v: str, w: str) -> str:
    return " + ".join(f"len(list_filter(range(1, len({c})), lambda i: {c}[i] = '{v}' AND {c}[i + 1] = '{w}'))" for c in "ab")


CTES = {
    "emails": EMAILS, "attachments": ATTACHMENTS, "bodies": BODIES, "sources": SOURCES, "detections": _detections(), "everywhere": _detections("sources"), "proposed": PROPOSED, "redactions": REDACTIONS,
    "lines": LINES, "clips": CLIPS, "layout": LAYOUT, "signed": SIGNED, "seen": SEEN, "gold": GOLD, "prf": PRF, "searched": SEARCHED, "tokens": TOKENS,
    "facts": "SELECT user_id, ts, event_type, event_id FROM events WHERE event_type <> 'error'",
    "cut": "SELECT d.source_id, start_offset, end_offset, length(text) AS size FROM detections d JOIN bodies b USING (source_id)",
    "runs": RUNS,
    "segs": """SELECT source_id, greatest(start_offset, cur) AS start_offset, end_offset, true AS marked FROM runs WHERE end_offset > cur
UNION ALL SELECT source_id, cur, start_offset, false FROM runs WHERE start_offset > cur
UNION ALL SELECT source_id, last, size, false FROM (SELECT b.source_id, length(text) AS size, coalesce(max(end_offset), 0) AS last FROM bodies b LEFT JOIN detections d USING (source_id) GROUP BY 1, 2) WHERE size > last""",
}
_USES = {
    "sources": ["emails", "attachments", "bodies"], "detections": ["bodies"], "everywhere": ["sources"], "proposed": ["detections"], "redactions": ["proposed"], "lines": ["bodies"], "clips": ["lines", "detections"],
    "layout": ["emails", "lines"], "seen": ["emails", "signed"], "prf": ["gold"], "searched": ["emails", "attachments"], "tokens": ["searched"], "cut": ["detections"], "runs": ["cut"], "segs": ["runs", "detections"],
}


def _add(name: str, uses: str, sql: str) -> None:
    order: list[str] = []

    def visit(x: str) -> None:
        for y in _USES.get(x, []):
            visit(y)
        if x not in order:
            order.append(x)

    for x in uses.split():
        visit(x)
    ORACLES[name] = ("WITH " + ", ".join(f"{x} AS MATERIALIZED ({CTES[x]})" for x in order) + "\n" if order else "") + sql


_add("pii_entity_counts", "detections", "SELECT entity_type, count(*) AS n FROM detections GROUP BY 1")
for _p in SAMPLE.patterns:
    if _p.recognizer != "digits":
        _add(f"pii_spans_{_p.recognizer}", "bodies", f"SELECT source_id, start_offset, end_offset, matched_text FROM ({_hits(_p, 0)})")
_add("pii_overlap_resolved", "detections", "SELECT source_id, start_offset, end_offset, recognizer, score FROM detections WHERE entity_type = 'CREDIT_CARD'")
_add("pii_by_source", "everywhere", "SELECT source_type, entity_type, count(*) AS n, count(DISTINCT source_id) AS n_sources FROM everywhere GROUP BY 1, 2")
_add("sources_scan", "sources", "SELECT source_type, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM sources WHERE text <> '' GROUP BY 1")
_add("detections_min_score", "detections", "SELECT source_id, entity_type, start_offset, end_offset, score FROM detections WHERE score >= 0.8")
_add("segments", "segs", "SELECT source_id, CAST(start_offset AS INTEGER) AS start_offset, CAST(end_offset AS INTEGER) AS end_offset, marked FROM segs")
CTES["accepted"] = "SELECT * FROM detections WHERE source_id % 2 = 0"
_USES["accepted"] = ["detections"]
_add("accepted_only_mask", "bodies accepted", """SELECT b.source_id, sha256(coalesce(string_agg(CASE WHEN hit THEN '█' ELSE ch END, '' ORDER BY i), '')) AS masked_sha256, CAST(count(ch) AS INTEGER) AS n_chars
FROM (SELECT source_id, i, substr(text, i + 1, 1) AS ch, EXISTS (SELECT 1 FROM accepted a WHERE a.source_id = t.source_id AND a.start_offset <= i AND i < a.end_offset) AS hit
      FROM (SELECT source_id, text, unnest(range(0, length(text))) AS i FROM bodies) t) b GROUP BY 1""")
_add("wrap_lines", "lines", "SELECT * FROM lines")
_add("line_clips", "clips", "SELECT * FROM clips")
_add("emails_page", "emails", "SELECT id, subject, date_sent FROM emails WHERE contains(lower(subject), 'th') AND case_id = 1 AND excluded_at IS NULL ORDER BY date_sent DESC NULLS LAST, id DESC LIMIT 50 OFFSET 10")
_add("emails_with_attachments", "emails attachments", "SELECT id, date_sent, case_id FROM emails WHERE EXISTS (SELECT 1 FROM attachments a WHERE a.email_id = emails.id)")
_add("emails_without_attachments", "emails attachments", "SELECT id, date_sent, case_id FROM emails WHERE NOT EXISTS (SELECT 1 FROM attachments a WHERE a.email_id = emails.id)")
_add("emails_with_pii", "emails detections", "SELECT id, date_sent, case_id FROM emails WHERE id IN (SELECT source_id FROM detections)")
_add("emails_without_pii", "emails detections", "SELECT id, date_sent, case_id FROM emails WHERE id NOT IN (SELECT source_id FROM detections)")
_add("emails_date_range", "emails", "SELECT id, date_sent, case_id FROM emails WHERE date_sent >= '2024-03-01' AND date_sent < '2024-06-01' AND contains(lower(from_addr), 'other.test')")
_add("emails_summary_columns", "emails attachments detections", "SELECT id, EXISTS (SELECT 1 FROM attachments a WHERE a.email_id = emails.id) AS has_attachments, (SELECT count(*) FROM detections d WHERE d.source_id = emails.id) AS pii_count, excluded_at IS NOT NULL AS is_excluded FROM emails")
_add("attachments_by_type_prefix", "attachments", "SELECT id, email_id, content_type, size_bytes FROM attachments WHERE starts_with(lower(content_type), 'image/') AND NOT is_inline")
_add("dedupe_attachments_sha", "attachments", "SELECT sha256(html) AS sha256, min(id) AS id, count(*) AS n FROM attachments GROUP BY 1")
_AUDIT = "SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS event_at, event_type, CAST(user_id AS VARCHAR) AS actor, props FROM events"
_add("audit_query", "", f"SELECT id, event_at, actor, json_extract_string(props, '$.k') AS k FROM ({_AUDIT}) WHERE event_type = 'error' AND event_at > '2024-01-05T00:00:00' AND event_at < '2024-01-20T00:00:00' ORDER BY id DESC LIMIT 200")
_add("events_since", "", f"SELECT id, event_at, event_type FROM ({_AUDIT}) WHERE id > 500 ORDER BY id LIMIT 100")
_add("redactions_filtered", "redactions", "SELECT source_type, source_id, start_offset, end_offset, exemption_code FROM redactions WHERE status = 'accepted' AND exemption_code = 'PII'")
_add("case_stats", "emails attachments redactions", """SELECT case_id, count(*) FILTER (excluded_at IS NULL) AS emails, count(*) FILTER (excluded_at IS NOT NULL) AS emails_excluded,
  (SELECT count(*) FROM attachments a JOIN emails x ON a.email_id = x.id WHERE x.case_id = e.case_id AND x.excluded_at IS NULL) AS attachments,
  (SELECT count(*) FROM detections d JOIN emails x ON d.source_id = x.id WHERE x.case_id = e.case_id) AS pii_detections,
  (SELECT count(*) FROM redactions d JOIN emails x ON d.source_id = x.id WHERE x.case_id = e.case_id) AS redactions,
  (SELECT count(*) FROM redactions d JOIN emails x ON d.source_id = x.id WHERE x.case_id = e.case_id AND d.status = 'accepted') AS redactions_accepted
FROM emails e GROUP BY case_id""")
_add("corpus_stats", "emails attachments redactions", """SELECT 'emails' AS name, count(*) AS n FROM emails UNION ALL SELECT 'attachments', count(*) FROM attachments UNION ALL SELECT 'attachments_with_text', count(*) FROM attachments WHERE extraction_status = 'ok'
UNION ALL SELECT 'pii_detections', count(*) FROM detections UNION ALL SELECT 'senders', count(DISTINCT lower(trim(from_addr))) FROM emails
UNION ALL SELECT 'redactions', count(*) FROM redactions UNION ALL SELECT 'redactions_accepted', count(*) FROM redactions WHERE status = 'accepted'""")
_add("orders_semi", "", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49)")
_add("orders_anti", "", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_add("orders_scalar_count", "", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS most FROM customer")
_add("label_tallies", "", "SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS n_good, count(*) FILTER (toxic = 1) AS n_toxic FROM labels JOIN documents USING (doc_id) GROUP BY 1")
_INTERNAL = " OR ".join(f"split_part(X, '@', 2) = '{d}' OR ends_with(split_part(X, '@', 2), '.{d}')" for d in SAMPLE.email_domains)
_add("persons_list", "seen", f"SELECT email, min(observed_at) AS first_seen, count(*) AS n_sightings, {_INTERNAL.replace('X', 'email')} AS is_internal FROM seen GROUP BY email")
_add("person_roles", "seen", "SELECT email, role, count(DISTINCT email_id) AS n FROM seen GROUP BY 1, 2")
_add("person_display_name", "seen", """SELECT email, coalesce(min_by(name, (-length(name), name)) FILTER (name IS NOT NULL), email) AS display_name, coalesce(string_agg(name, '|' ORDER BY first) FILTER (name IS NOT NULL), '') AS names
FROM (SELECT email, name, min(email_id) AS first FROM seen GROUP BY 1, 2) GROUP BY email""")
_add("person_merge", "", """SELECT w AS person, list_sort(list_transform(list_distinct(list_concat(list(c_name), list(c_mktsegment))), lambda x: (-length(x), x)))[1][2] AS display_name, array_to_string(list_sort(list_distinct(list_concat(list(c_name), list(c_mktsegment)))), '|') AS names
FROM (SELECT *, CASE WHEN c_custkey % 3 = 1 AND c_custkey > 1 THEN c_custkey - 1 ELSE c_custkey END AS w FROM customer) GROUP BY w""")
_add("internal_flag", "emails", f"SELECT id, {_INTERNAL.replace('X', 'lower(trim(from_addr))')} AS is_internal FROM emails")
_add("signature_emails", "signed", "SELECT doc_id, array_to_string(found, '|') AS emails FROM signed WHERE len(found) > 0")
_add("affiliation_asof", "facts", """SELECT p.event_id AS probe, p.user_id, f.event_type FROM (SELECT * FROM events WHERE event_type = 'error') p
ASOF LEFT JOIN facts f ON p.user_id = f.user_id AND p.ts >= f.ts""")
CTES["evidence"] = "SELECT DISTINCT email AS person, split_part(email, '@', -1) AS affiliation_value, observed_at, email_id AS id FROM seen WHERE contains(email, '@')"
CTES["people"] = f"SELECT email AS person, coalesce(min_by(name, (-length(name), name)) FILTER (name IS NOT NULL), email) AS display_name, min(observed_at) AS first_seen, {_INTERNAL.replace('X', 'email')} AS is_internal FROM seen GROUP BY email"
CTES["roles"] = "SELECT DISTINCT email AS person, role, email_id FROM seen"
CTES["merges"] = "SELECT 'user' || i || '@example.org' AS loser, 'user' || (CASE WHEN i < 40 THEN i + 20 ELSE i + 10 END) || '@example.org' AS winner FROM range(30, 50) t(i)"
_USES |= {"evidence": ["seen"], "people": ["seen"], "roles": ["seen"]}
_THEN = _INTERNAL.replace("X", "'x@' || d")
_add("internal_asof", "people evidence", f"""SELECT person, CAST(CASE WHEN d IS NOT NULL THEN {_THEN} END AS VARCHAR) AS internal_then FROM people LEFT JOIN
(SELECT person, max_by(affiliation_value, (observed_at, id)) AS d FROM evidence WHERE observed_at <= '2024-06-01' GROUP BY 1) USING (person)""")
_add("affiliations_list", "evidence", "SELECT person, 'email_domain' AS affiliation_type, affiliation_value, observed_at, id FROM evidence")
_add("persons_page", "people roles", """SELECT person, display_name, is_internal, person AS primary_email, n AS occurrences, count(*) OVER () AS total FROM people JOIN (SELECT person, count(*) AS n FROM roles GROUP BY 1) USING (person)
WHERE is_internal AND ends_with(person, '@sub.example.org') AND contains(lower(display_name), 'user') ORDER BY n DESC, display_name, person LIMIT 20 OFFSET 5""")
_add("person_details", "people roles", """SELECT person, person || ' ' || first_seen AS emails, r AS roles FROM people JOIN
(SELECT person, string_agg(role || '=' || n, ',' ORDER BY role) AS r FROM (SELECT person, role, count(*) AS n FROM roles GROUP BY 1, 2) GROUP BY 1) USING (person)""")
_add("merged_occurrences", "roles merges", "SELECT person, count(*) AS n FROM (SELECT DISTINCT coalesce(winner, person) AS person, role, email_id FROM roles LEFT JOIN merges ON loser = person) GROUP BY 1")
_add("merged_affiliations", "evidence merges", "SELECT person, count(*) AS n FROM (SELECT DISTINCT coalesce(winner, person) AS person, affiliation_value, id FROM evidence LEFT JOIN merges ON loser = person) GROUP BY 1")
_add("merged_addresses", "people merges", "SELECT coalesce(winner, person) AS person, person AS email, winner IS NULL AS is_primary FROM people LEFT JOIN merges ON loser = person")
_add("person_renamed", "seen", """SELECT email AS person, CASE WHEN email = 'user7@example.org' THEN 'The Clerk' ELSE coalesce(min_by(name, (-length(name), name)) FILTER (name IS NOT NULL), email) END AS display_name,
  concat_ws('|', string_agg(name, '|' ORDER BY first) FILTER (name IS NOT NULL), CASE WHEN email = 'user7@example.org' THEN 'The Clerk' END) AS names
FROM (SELECT email, name, min(email_id) AS first FROM seen GROUP BY 1, 2) GROUP BY email""")
_add("affiliation_latest", "facts", "SELECT user_id, event_type, event_id FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM facts WHERE ts <= TIMESTAMP '2024-01-20 00:00:00') WHERE r = 1")
_add("affiliation_history", "evidence", "SELECT person, affiliation_value, id, row_number() OVER (PARTITION BY person ORDER BY observed_at, id) AS nth FROM evidence")
_add("emails_total", "emails", "SELECT id, date_sent, count(*) OVER () AS total FROM emails WHERE mbox_source = 'src0' AND excluded_at IS NULL ORDER BY date_sent DESC NULLS LAST, id DESC LIMIT 25 OFFSET 2")
_add("email_details", "emails attachments detections", """SELECT e.id, CAST(coalesce(a.n, 0) AS INTEGER) AS n_attachments, a.f AS first_file, CAST(coalesce(d.n, 0) AS INTEGER) AS n_detections, coalesce(d.s, -1) AS first_start FROM emails e
LEFT JOIN (SELECT email_id, count(*) AS n, min_by(filename, id) AS f FROM attachments GROUP BY 1) a ON a.email_id = e.id
LEFT JOIN (SELECT source_id, count(*) AS n, min(start_offset) AS s FROM detections GROUP BY 1) d ON d.source_id = e.id""")
_add("attachments_with_text", "attachments", f"SELECT id, filename, CASE WHEN extraction_status = 'ok' THEN 'ok' END AS extraction_status, CASE WHEN extraction_status = 'ok' THEN CAST(length({_TEXT}) AS INTEGER) ELSE -1 END AS character_count FROM attachments")
_add("run_counts", "bodies detections", """SELECT count(*) FILTER (trim(text) <> '') AS sources_scanned, count(*) FILTER (trim(text) = '') AS sources_skipped, (SELECT count(*) FROM detections) AS detections_written,
  (SELECT string_agg(entity_type || '=' || n, ',' ORDER BY entity_type) FROM (SELECT entity_type, count(*) AS n FROM detections GROUP BY 1)) AS by_entity FROM bodies""")
_add("redactions_page", "redactions", "SELECT source_id, start_offset, end_offset, exemption_code, count(*) OVER () AS total FROM redactions WHERE status = 'rejected' ORDER BY source_type, source_id, start_offset, exemption_code LIMIT 50 OFFSET 3")
_CASES = "SELECT n_nationkey AS id, n_name AS name, CASE n_nationkey % 3 WHEN 0 THEN 'ready' WHEN 1 THEN 'failed' ELSE 'processing' END AS status, concat('2024-01-', lpad(CAST(n_nationkey % 9 + 10 AS VARCHAR), 2, '0')) AS created_at FROM nation"
_add("cases_list", "", f"SELECT id, name, created_at, count(*) OVER () AS total FROM ({_CASES}) WHERE status = 'ready' ORDER BY created_at DESC, id DESC LIMIT 5 OFFSET 1")
_add("cases_detail", "", """SELECT n_nationkey AS id, coalesce(n, 0) AS emails, CAST(j AS BIGINT) AS job_id, CASE j % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' WHEN 2 THEN 'succeeded' WHEN 3 THEN 'succeeded' END AS job_status
FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n, max(c_custkey) AS j FROM customer GROUP BY 1) ON c_nationkey = n_nationkey""")
_add("case_status_change", "", f"SELECT id, CASE WHEN id = 4 THEN 'failed' ELSE status END AS status, CASE WHEN id = 4 THEN 'no space' END AS error_message, CASE WHEN id = 4 THEN 'extract' END AS failed_stage, CASE WHEN id = 4 THEN '2024-02-02' END AS updated_at FROM ({_CASES})")
_add("job_retry", "", """SELECT c_custkey AS id, CASE WHEN c_custkey = 8 THEN 'queued' WHEN c_custkey % 4 = 0 THEN 'failed' WHEN c_custkey % 4 = 1 THEN 'running' ELSE 'succeeded' END AS status,
  CASE WHEN c_custkey % 4 = 0 AND c_custkey <> 8 THEN 'detect' END AS failed_stage, CASE WHEN c_custkey <> 8 THEN '2025' END AS finished_at FROM customer""")
_add("session_states", "", """SELECT t.event_id + 5 || '' AS token, coalesce(s.event_id, -1) AS session_id, CASE WHEN s.event_id IS NULL THEN 'unknown' WHEN s.event_type = 'error' THEN 'revoked' WHEN s.user_id % 10 = 0 THEN 'disabled'
  WHEN date_trunc('second', s.ts) + INTERVAL 8 HOURS <= TIMESTAMP '2024-01-20 12:00:00' THEN 'expired'
  WHEN s.event_id % 5 = 0 OR TIMESTAMP '2024-01-20 12:00:00' - (date_trunc('second', s.ts) + to_hours(s.event_id % 7)) >= INTERVAL 15 MINUTES THEN 'recheck' ELSE 'active' END AS state
FROM events t LEFT JOIN events s ON s.event_id = t.event_id + 5""")
_add("rows_tagged_to_case", "emails", "SELECT id, coalesce(CASE WHEN id % 3 > 0 THEN case_id WHEN mbox_source = 'src1' THEN 77 END, -1) AS case_id FROM emails")
_add("orphans_removed", "emails attachments", "SELECT id, email_id FROM attachments WHERE email_id IN (SELECT id FROM emails WHERE excluded_at IS NULL)")
_add("parents_set_null", "emails attachments", "SELECT a.id, coalesce(e.id, -1) AS email_id FROM attachments a LEFT JOIN emails e ON e.id = a.email_id AND e.excluded_at IS NULL")
_add("rows_inserted_once", "", "SELECT o_custkey AS k, o_orderstatus AS s, CASE WHEN o_custkey % 2 = 0 THEN count(*) ELSE 1 END AS n, min(o_orderkey) AS v FROM orders GROUP BY 1, 2")
_add("rows_upserted", "", """SELECT coalesce(n.k, o.c_custkey) AS k, coalesce(n.name, o.c_name) AS name, o.c_mktsegment AS segment FROM customer o
FULL JOIN (SELECT c_custkey + 100 AS k, CASE WHEN c_custkey % 2 = 0 THEN c_name || '!' END AS name FROM customer) n ON n.k = o.c_custkey""")
_add("lockout_window", "", """SELECT event_id, user_id, n AS n_recent, n >= 3 AS locked FROM (SELECT event_id, user_id,
  count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS n FROM events WHERE event_type = 'error')""")
_add("propose_redactions", "proposed", "SELECT source_type, source_id, start_offset, end_offset, exemption_code, 'proposed' AS status, 'auto' AS origin FROM proposed WHERE nth = 1")
_add("propose_skip_reasons", "proposed", f"""SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN source_id % 4 = 0 OR nth > 1 THEN 'existing' ELSE 'proposed' END AS outcome FROM proposed
UNION ALL SELECT 'no_exemption' FROM (SELECT {CODE} AS exemption_code FROM detections) WHERE exemption_code IS NULL OR NOT {KNOWN}) GROUP BY 1""")
_add("validate_redactions", "", """SELECT d.doc_id AS case_no, CASE WHEN d.doc_id % 13 = 0 THEN 'source_type' WHEN d.doc_id % 7 - 1 < 0 THEN 'start' WHEN d.doc_id % 5 * 40 <= d.doc_id % 7 - 1 THEN 'end'
  WHEN d.doc_id % 3 = 1 THEN 'code_unknown' WHEN d.doc_id % 2 = 0 AND d.doc_id % 4 <> 0 THEN 'reviewer' WHEN t.doc_id IS NULL THEN 'source_missing' WHEN d.doc_id % 5 * 40 > length(t.text) THEN 'beyond_text' ELSE 'ok' END AS reason
FROM documents d LEFT JOIN documents t ON t.doc_id = CASE WHEN d.doc_id % 11 = 0 THEN d.doc_id + 1000000000 ELSE d.doc_id END""")
_add("redactions_reviewed", "proposed", """SELECT CASE WHEN source_id % 5 <> 0 AND source_id % 2 = 0 THEN CASE WHEN source_id % 3 = 0 THEN 'accepted' ELSE 'rejected' END ELSE 'proposed' END AS status, count(*) AS n
FROM proposed WHERE nth = 1 GROUP BY 1""")
_add("emails_excluded", "emails", "SELECT id, CASE WHEN id % 46 = 0 THEN NULL ELSE coalesce(excluded_at, CASE WHEN id % 10 = 3 THEN '2025-03-01T00:00:00+00:00' END) END AS excluded_at FROM emails")
_add("bates_pages", "layout", "SELECT id, CAST(pages AS BIGINT) AS pages, printf('PROD-%06d', CAST(before + 1 AS BIGINT)) AS first_page, printf('PROD-%06d', CAST(before + pages AS BIGINT)) AS last_page FROM layout")
def _step(inner: str, kind: str, n: str = "0") -> str:
    """Adds to (page p, used units u) what one part of a drawing takes."""
    if kind == "lines":
        first = "greatest(0, (275 - u) // 5)"
        return f"SELECT * REPLACE (CASE WHEN {n} > {first} THEN p + 1 + ({n} - {first} - 1) // 55 ELSE p END AS p, CASE WHEN {n} > {first} THEN (({n} - {first} - 1) % 55 + 1) * 5 ELSE u + 5 * {n} END AS u) FROM ({inner})"
    if kind == "gap":
        return f"SELECT * REPLACE (u + 2 AS u) FROM ({inner})"
    needs, takes = {"heading": (10, 8), "rule": (5, 3)}[kind]
    return f"SELECT * REPLACE (CASE WHEN u + {needs} > 275 THEN p + 1 ELSE p END AS p, CASE WHEN u + {needs} > 275 THEN 0 ELSE u END + {takes} AS u) FROM ({inner})"


def _mark(inner: str, name: str) -> str:
    return f"SELECT *, p AS {name}_p, u AS {name}_u FROM ({inner})"


_LINES = LINES.replace("source_id", "source_type, source_id", 1).replace("PARTITION BY source_id", "PARTITION BY source_type, source_id").replace("SELECT source_id, CAST(base", "SELECT source_type, source_id, CAST(base").replace("SELECT source_id, p, base", "SELECT source_type, source_id, p, base").replace("SELECT source_id, ps[i]", "SELECT source_type, source_id, ps[i]").replace("SELECT source_id, string_split", "SELECT source_type, source_id, string_split").replace("FROM bodies", "FROM sources")
CTES["all_lines"] = _LINES
CTES["line_counts"] = "SELECT source_type, source_id, count(*) AS n FROM all_lines GROUP BY 1, 2"
_N = "(SELECT n FROM line_counts l WHERE l.source_type = '{}' AND l.source_id = {}.id)"
_mail = "SELECT id, date_sent, CAST(3 + CASE WHEN cc_addr IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN date_sent IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS h, greatest(1, coalesce(s.n, 0)) AS sn, greatest(1, coalesce(b.n, 0)) AS bn, CAST(0 AS BIGINT) AS p, CAST(0 AS BIGINT) AS u FROM emails e LEFT JOIN line_counts s ON s.source_type = 'email_subject' AND s.source_id = e.id LEFT JOIN line_counts b ON b.source_type = 'email_body_text' AND b.source_id = e.id WHERE excluded_at IS NULL"
_mail = _step(_step(_step(_step(_mail, "heading"), "lines", "h"), "gap"), "lines", "1")
_mail = _step(_step(_mark(_mail, "s"), "lines", "sn"), "rule")
CTES["mail_pages"] = _step(_step(_mark(_step(_mail, "heading"), "b"), "lines", "bn"), "rule")
_file = "SELECT a.id, a.email_id, CAST(3 AS BIGINT) AS h, greatest(1, coalesce(t.n, 0)) AS tn, CAST(0 AS BIGINT) AS p, CAST(0 AS BIGINT) AS u FROM attachments a JOIN emails e ON e.id = a.email_id AND e.excluded_at IS NULL LEFT JOIN line_counts t ON t.source_type = 'attachment_text' AND t.source_id = a.id WHERE a.extraction_status = 'ok'"
CTES["file_pages"] = _step(_step(_mark(_step(_step(_step(_file, "heading"), "lines", "h"), "gap"), "t"), "lines", "tn"), "rule")
_before = "coalesce(sum(p + 1) OVER (ORDER BY {} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
CTES["places"] = f"""SELECT k.source_type, id AS source_id, 'email ' || id AS source_label, CAST(before + CASE WHEN k.source_type = 'email_subject' THEN s_p ELSE b_p END AS BIGINT) AS page, CASE WHEN k.source_type = 'email_subject' THEN s_u ELSE b_u END AS used, p + 1 AS pages
FROM (SELECT *, {_before.format('date_sent NULLS LAST, id')} AS before FROM mail_pages), (VALUES ('email_subject'), ('email_body_text')) k(source_type)
UNION ALL SELECT 'attachment_text', id, 'attach ' || id, CAST(before + t_p + (SELECT coalesce(sum(p + 1), 0) FROM mail_pages) AS BIGINT), t_u, p + 1 FROM (SELECT *, {_before.format('email_id, id')} AS before FROM file_pages)"""
CTES["full_log"] = """SELECT printf('PROD-%06d', CAST(page + 1 + CASE WHEN n < (275 - used) // 5 THEN 0 ELSE 1 + (n - (275 - used) // 5) // 55 END AS BIGINT)) AS bates_label, r.source_id * 100000 + r.start_offset AS redaction_id, r.source_type, r.source_id, source_label,
  r.start_offset, r.end_offset, r.end_offset - r.start_offset AS length, r.exemption_code, '' AS reviewer_id, '2025-05-05' AS accepted_at
FROM (SELECT * FROM redactions WHERE status = 'accepted') r JOIN (SELECT l.source_id, s.start_offset, s.end_offset, min(l.line_no) AS n FROM all_lines l JOIN redactions s ON s.source_id = l.source_id AND s.source_type = l.source_type AND s.start_offset < l.start_offset + length(l.line) AND l.start_offset < s.end_offset WHERE s.status = 'accepted' GROUP BY 1, 2, 3) f
  ON f.source_id = r.source_id AND f.start_offset = r.start_offset AND f.end_offset = r.end_offset JOIN places p ON p.source_type = r.source_type AND p.source_id = r.source_id"""
_USES |= {"all_lines": ["sources"], "line_counts": ["all_lines"], "mail_pages": ["emails", "line_counts"], "file_pages": ["emails", "attachments", "line_counts"], "places": ["mail_pages", "file_pages"], "full_log": ["places", "redactions", "all_lines"]}
_add("production_places", "places", "SELECT * FROM places")
_add("redaction_log_full", "full_log", "SELECT * FROM full_log")
_add("production_manifest", "full_log", """SELECT (SELECT count(*) FROM mail_pages) AS emails_exported, (SELECT count(*) FROM file_pages) AS attachments_exported, CAST(n AS BIGINT) AS pages_written,
  (SELECT count(DISTINCT redaction_id) FROM full_log) AS redactions_burned, 'PROD-000001' AS bates_first, printf('PROD-%06d', CAST(n AS BIGINT)) AS bates_last
FROM (SELECT (SELECT coalesce(sum(p + 1), 0) FROM mail_pages) + (SELECT coalesce(sum(p + 1), 0) FROM file_pages) + 1 AS n)""")
_add("production_lines", "lines accepted", """SELECT source_id, line_no, coalesce(string_agg(CASE WHEN EXISTS (SELECT 1 FROM accepted a WHERE a.source_id = c.source_id AND a.start_offset <= i AND i < a.end_offset) THEN '█' ELSE ch END, '' ORDER BY i) FILTER (ch <> ''), '') AS line
FROM (SELECT source_id, line_no, start_offset + j AS i, substr(line, CAST(j + 1 AS BIGINT), 1) AS ch FROM (SELECT *, unnest(range(0, greatest(1, length(line)))) AS j FROM lines)) c GROUP BY 1, 2""")
_add("redaction_log", "clips layout", """SELECT source_id, span_start, span_end, printf('PROD-%06d', CAST(before + 1 + CASE WHEN n < 50 THEN 0 ELSE 1 + (n - 50) // 55 END AS BIGINT)) AS page
FROM (SELECT source_id, span_start, span_end, min(line_no) AS n FROM clips GROUP BY 1, 2, 3) JOIN layout ON id = source_id""")
_add("eval_prf", "prf", f"SELECT entity_type, tp, fp, fn, {RATES} FROM (SELECT *, CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END AS r FROM prf)")
_add("eval_micro", "prf", f"SELECT tp, fp, fn, {RATES} FROM (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM prf))")
_add("search_bm25", "tokens", _bm25([_one("and"), _one("the")]))
_add("search_by_index", "tokens", _bm25([_one("and"), _one("the")]))
_add("search_folded", "", _bm25([_one("dvorak")]).replace("FROM tokens", """FROM (SELECT 'email' AS scope, doc_id AS id, regexp_extract_all(strip_accents(lower(CASE doc_id % 3 WHEN 0 THEN 'Dvořák' WHEN 1 THEN 'DVORAK' ELSE 'Łódź' END)), '[\\p{L}\\p{N}]+') AS a,
regexp_extract_all(strip_accents(lower(substr(text, 1, 40 + doc_id % 50))), '[\\p{L}\\p{N}]+') AS b FROM documents)""").replace("SELECT scope, id, round", "SELECT id, round"))
_add("search_scope", "tokens", f"SELECT id, score FROM ({_bm25([_two('of', 'the')])}) WHERE scope = 'email' ORDER BY score, id LIMIT 50")
_add("fts_backfill_missing", "searched", "SELECT scope, count(*) AS n FROM searched WHERE id % 3 = 0 GROUP BY 1")
_add("html_to_text", "", f"SELECT page_id, {_TEXT} AS text FROM pages")
_add("ai_reanchor", "", """SELECT source_id, 'NAME' AS entity_type, CAST(strpos(text, m) - 1 AS INTEGER) AS start_offset, CAST(strpos(text, m) - 1 + length(m) AS INTEGER) AS end_offset, conf AS confidence
FROM (SELECT doc_id AS source_id, text, trim(substr(text, 11, 12), ' ') AS m, CAST(CASE doc_id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 0.25 END AS DOUBLE) AS conf FROM documents) WHERE m <> '' AND strpos(text, m) > 0""")
_FLAGS = "SELECT *, source_id * 100000 + start_offset AS id, source_id % 2 = 0 AS is_open FROM detections"
_add("flags_page", "detections", f"SELECT id, source_id, count(*) OVER () AS total FROM ({_FLAGS}) WHERE is_open AND entity_type = 'EMAIL_ADDRESS' ORDER BY id DESC LIMIT 30 OFFSET 2")
_add("flags_promoted", "detections", f"""SELECT source_id, start_offset, end_offset, exemption_code, 'proposed' AS status, 'manual' AS origin FROM (SELECT *, coalesce(CASE WHEN source_id % 4 = 0 THEN 'FIN' END, {CODE}) AS exemption_code FROM ({_FLAGS}) WHERE is_open AND source_id % 3 = 0) WHERE {KNOWN}""")
_add("flags_dismissed", "detections", f"SELECT 'dismissed' AS review_status, CASE WHEN is_open THEN 'ann' END AS review_actor, count(*) AS n FROM ({_FLAGS}) WHERE NOT is_open OR start_offset % 2 = 0 GROUP BY 1, 2 UNION ALL SELECT 'open', NULL, count(*) FROM ({_FLAGS}) WHERE is_open AND start_offset % 2 <> 0")
_add("prompts_truncated", "", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || ' [truncated]' ELSE text END AS prompt FROM documents")
CTES["formats"] = """SELECT 'rendered' AS source_type, c_custkey AS source_id, printf('SSN %03d-%02d-%04d, itin 9%02d-7%d-%04d. ', c_custkey % 900, c_custkey % 100, c_custkey % 10000, c_custkey % 100, c_custkey % 10, c_custkey) || printf('A1234 4111 1111 1111 1111 or 4111 1111 1111 111%d; ', c_custkey % 10)
|| printf('B%07d C%08d MD%07d acct %010d x%010d ', c_custkey, c_custkey, c_custkey, c_custkey, c_custkey) || printf('DE89%018d http://h%d.org/p?q=%d ', c_custkey, c_custkey, c_custkey) || printf('10.0.%d.%d and %d/%d/2024 May %d, 2024 ', c_custkey % 256, c_custkey % 300, c_custkey % 12 + 1, c_custkey % 28 + 1, c_custkey % 28 + 1)
|| printf('+1 (%03d) 555-%04d, %03d.555.%04d', c_custkey % 1000, c_custkey, c_custkey % 1000, c_custkey) AS text FROM customer"""
_add("pii_builtin_spans", "formats", "SELECT source_id, recognizer, start_offset, end_offset, matched_text FROM (" + " UNION ALL ".join(_hits(p, 0, "formats") for p in BUILTIN.values()) + ")")
_add("ai_json_extract", "", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
_add("event_tail_stream", "", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")

# HTML bodies: paragraphs are lines, so texts and places in the markup follow from the lines
_AT = "CASE WHEN source_id % 2 = 0 THEN '&#64;' ELSE '@' END"


def _escaped(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '@', {_AT})"


_MAIL = _quoted(BUILTIN["EMAIL_ADDRESS"].regex)
CTES["htmllines"] = f"""SELECT source_id, i, line, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS node, length(line) - length(regexp_replace(line, '^\\s+', '')) AS lead,
  18 + coalesce(sum(length({_escaped("line")}) + 7) OVER (PARTITION BY source_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mark,
  regexp_extract_all(line, {_MAIL}) AS m, string_split_regex(line, {_MAIL}) AS g
FROM (SELECT doc_id AS source_id, ls[i] AS line, i FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"""
CTES["htmlnodes"] = """SELECT *, coalesce(sum(length(node) + 1) OVER (PARTITION BY source_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM htmllines WHERE node <> ''"""
CTES["htmltexts"] = """SELECT 'email_body_html' AS source_type, d.doc_id AS source_id, coalesce(t, '') AS text FROM documents d LEFT JOIN (SELECT source_id, string_agg(node, ' ' ORDER BY i) AS t FROM htmlnodes GROUP BY 1) ON source_id = doc_id"""
_USES |= {"htmlnodes": ["htmllines"], "htmltexts": ["htmlnodes"], "htmlfound": ["htmltexts"]}
CTES["htmlfound"] = _detections("htmltexts")
_add("html_body_spans", "htmlnodes", f"""SELECT source_id, CAST(base + s - lead AS INTEGER) AS start_offset, CAST(base + s - lead + length(hit) AS INTEGER) AS end_offset, hit AS matched_text,
  CAST(mark + length({_escaped("substr(line, 1, s)")}) AS INTEGER) AS mark_start, CAST(mark + length({_escaped("substr(line, 1, s + length(hit))")}) AS INTEGER) AS mark_end
FROM (SELECT *, m[k] AS hit, CAST(list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS s
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM htmlnodes))""")
_add("html_bodies_burned", "htmllines", f"""SELECT source_id, sha256('<div class="m"><p>' || string_agg(burned, '</p><p>' ORDER BY i) || '</p><!-- end --></div>') AS burned_sha256
FROM (SELECT source_id, i, array_to_string(list_transform(range(1, len(m) + 1), lambda k: {_escaped("g[k]")} || repeat('█', length(m[k]))), '') || {_escaped("g[len(m) + 1]")} AS burned FROM htmllines) GROUP BY 1""")
_add("html_proposals", "htmlfound", f"""SELECT source_type, source_id, start_offset, end_offset, exemption_code, 'proposed' AS status FROM ({PROPOSED.replace("FROM detections", "FROM htmlfound")}) WHERE nth = 1""")
CTES["htmlsearched"] = "SELECT 'html' AS scope, source_id AS id, text FROM htmltexts"
_USES["htmlsearched"] = ["htmltexts"]
CTES["htmltokens"] = f"SELECT scope, id, CAST([] AS VARCHAR[]) AS a, {WORDS.replace('TEXT', 'text')} AS b FROM htmlsearched"
_USES["htmltokens"] = ["htmlsearched"]
_add("html_search", "htmltokens", "SELECT id, score FROM (" + _bm25([_one("and"), _one("the")]).replace("FROM tokens", "FROM htmltokens") + ")")

CTES["burned"] = "SELECT source_type, source_id, start_offset, end_offset, exemption_code FROM redactions WHERE status = 'accepted'"
CTES["boxed"] = """SELECT DISTINCT l.source_type, l.source_id, l.line_no, greatest(l.start_offset, s.start_offset) - l.start_offset AS a, least(l.start_offset + length(l.line), s.end_offset) - l.start_offset AS b, exemption_code AS c
FROM all_lines l JOIN burned s ON s.source_type = l.source_type AND s.source_id = l.source_id AND s.start_offset < l.start_offset + length(l.line) AND l.start_offset < s.end_offset"""
CTES["hidden"] = """SELECT l.source_type, l.source_id, l.line_no, string_agg(CASE WHEN EXISTS (SELECT 1 FROM boxed x WHERE x.source_type = l.source_type AND x.source_id = l.source_id AND x.line_no = l.line_no AND a <= j AND j < b) THEN ' ' ELSE substr(l.line, CAST(j + 1 AS BIGINT), 1) END, '' ORDER BY j) AS line
FROM (SELECT *, unnest(range(0, length(line))) AS j FROM all_lines SEMI JOIN boxed USING (source_type, source_id, line_no)) l GROUP BY 1, 2, 3"""
_USES |= {"burned": ["redactions"], "boxed": ["all_lines", "burned"], "hidden": ["boxed"]}
_add("production_print", "places hidden", """SELECT CAST(page + CASE WHEN line_no < (275 - used) // 5 THEN 0 ELSE 1 + (line_no - (275 - used) // 5) // 55 END AS BIGINT) AS page, CAST(CASE WHEN line_no < (275 - used) // 5 THEN used + 5 * line_no ELSE (line_no - (275 - used) // 5) % 55 * 5 END AS BIGINT) AS used,
  coalesce(h.line, l.line) AS text, coalesce(boxes, '') AS boxes
FROM all_lines l JOIN places USING (source_type, source_id) LEFT JOIN hidden h USING (source_type, source_id, line_no)
LEFT JOIN (SELECT source_type, source_id, line_no, string_agg(a || ' ' || b || ' ' || c, ',' ORDER BY a, b, c) AS boxes FROM boxed GROUP BY 1, 2, 3) USING (source_type, source_id, line_no)""")

# a kept index: what is alive after the additions and deletions
CTES["keptsearched"] = "SELECT * FROM searched WHERE (id % 5 <> 0 OR id % 10 = 0 OR id % 7 = 1) AND id % 9 <> 2"
CTES["kepttokens"] = TOKENS.replace("FROM searched", "FROM keptsearched")
_USES |= {"keptsearched": ["searched"], "kepttokens": ["keptsearched"]}
_add("search_stored", "kepttokens", _bm25([_one("and"), _one("the")]).replace("FROM tokens", "FROM kepttokens"))

# snippets: hits of two words, windows at them and at their sentences
_RAW = "'[\\p{L}\\p{N}]+'"
CTES["found"] = f"SELECT scope, id, total FROM (SELECT *, count(*) OVER () AS total FROM ({_bm25([_one('and'), _one('the')])})) ORDER BY score, id, scope LIMIT 100"
CTES["shown"] = f"""SELECT scope, id, total, col, w, m, g, list_filter(range(0, len(w)), lambda i: w[i + 1] = 'and') AS h1, list_filter(range(0, len(w)), lambda i: w[i + 1] = 'the') AS h2,
  list_filter(range(0, len(w)), lambda i: i = 0 OR regexp_matches(g[i + 1], '[.:][ \\t\\n\\r]+$')) AS stops
FROM (SELECT scope, id, total, col, {WORDS.replace('TEXT', 'x')} AS w, regexp_extract_all(x, {_RAW}) AS m, string_split_regex(x, {_RAW}) AS g
      FROM (SELECT scope, id, total, 0 AS col, title AS x FROM found JOIN searched USING (scope, id) UNION ALL SELECT scope, id, total, 1, text FROM found JOIN searched USING (scope, id)))"""
_IN = "list_filter({0}, lambda x: x >= {1} AND x < {1} + 12)"
_POINTS = " + ".join(f"CASE WHEN len({_IN.format(h, '{0}')}) > 0 THEN 999 + len({_IN.format(h, '{0}')}) ELSE 0 END" for h in ("h1", "h2"))
CTES["windows"] = f"""SELECT scope, id, col, io, 0 AS kind, {_POINTS.format('io')} AS points,
  CAST(greatest(0, least(io - (12 - (list_max(list_concat({_IN.format('h1', 'io')}, {_IN.format('h2', 'io')})) + 1 - io)) // 2, len(w) - 12)) AS BIGINT) AS first FROM (SELECT *, unnest(list_sort(list_concat(h1, h2))) AS io FROM shown)
UNION ALL SELECT scope, id, col, io, 1, {_POINTS.format('s')} + CASE WHEN s = 0 THEN 120 ELSE 100 END, CAST(s AS BIGINT)
FROM (SELECT *, list_max(list_filter(stops, lambda x: x <= io)) AS s FROM (SELECT *, unnest(list_sort(list_concat(h1, h2))) AS io FROM shown)) WHERE s < io AND len(w) > 12"""
_USES |= {"found": ["tokens", "searched"], "shown": ["found"], "windows": ["shown"]}
_add("search_snippets", "windows", """SELECT s.scope, s.id, s.total, coalesce(title, CASE WHEN s.scope = 'email' THEN '(no subject)' ELSE '(unnamed)' END) AS title,
  CASE WHEN first > 0 THEN '…' ELSE '' END || array_to_string(list_transform(range(first, least(first + 12, len(m))), lambda k: CASE WHEN k = first AND first > 0 THEN '' ELSE g[k + 1] END || CASE WHEN w[k + 1] IN ('and', 'the') THEN '<mark>' || m[k + 1] || '</mark>' ELSE m[k + 1] END), '')
  || CASE WHEN first + 11 >= len(m) - 1 THEN g[len(m) + 1] ELSE '…' END AS snippet
FROM (SELECT *, row_number() OVER (PARTITION BY scope, id ORDER BY points DESC, col, io, kind) AS nth FROM windows) b JOIN shown s USING (scope, id, col) JOIN searched d ON d.scope = s.scope AND d.id = s.id WHERE nth = 1""")

_add("lockout_stream", "", """SELECT user_id, epoch_us(ts) AS micros, CAST(n AS BIGINT) AS n FROM (
  SELECT user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS n FROM events WHERE event_type = 'error') WHERE n >= 3""")

# letters: the generator once more, a value of every field for every row
_DRAW = "CAST(CAST('0x' || substr(md5('7:' || o_orderkey || ':{0}'), 1, 8) AS BIGINT) % ({2} - {1} + 1) + {1} AS INTEGER)".format


def _pick(field: str, values: tuple[str, ...]) -> str:
    return "[" + ", ".join(_quoted(v) for v in values) + f"][{_DRAW(field, 0, len(values) - 1)} + 1]"


_FIRST, _LAST = _pick("first", generator.FIRST), _pick("last", generator.LAST)
_FIELDS = {
    "PERSON": f"{_FIRST} || ' ' || {_LAST}", "EMAIL_ADDRESS": f"lower({_FIRST}) || '.' || lower({_LAST}) || '@' || {_pick('domain', generator.DOMAINS)}",
    "PHONE_NUMBER": f"printf('(%03d) %03d-%04d', {_DRAW('code', 201, 989)}, {_DRAW('exchange', 200, 999)}, {_DRAW('line', 1000, 9999)})",
    "US_SSN": f"printf('%03d-%02d-%04d', {_DRAW('area', 100, 664)}, {_DRAW('group', 10, 99)}, {_DRAW('serial', 1000, 9999)})",
    "DATE_TIME:birth": f"printf('%02d/%02d/%04d', {_DRAW('month', 1, 12)}, {_DRAW('day', 1, 28)}, {_DRAW('year', 2004, 2018)})",
    "DATE_TIME:day": f"{_pick('name of month', generator.MONTHS)} || ' ' || {_DRAW('day of month', 1, 28)} || ', 2024'",
    "STUDENT_ID": f"CAST({_DRAW('student', 10000000, 99999999)} AS VARCHAR)", "LUNCH_ACCT": f"'LA' || {_DRAW('lunch', 100000, 999999)}",
}
_LETTER = []
for _i, _t in enumerate(generator.TEMPLATES):
    _parts = [(p, k % 2) for k, p in enumerate(_t.replace("}", "{").split("{"))]
    _LETTER.append(f"SELECT o_orderkey AS source_id, [" + ", ".join(f"{{'e': '{p.split(':')[0] if field else ''}', 't': {_FIELDS[p] if field else _quoted(p)}}}" for p, field in _parts) + f"] AS parts FROM orders WHERE {_DRAW('template', 0, len(generator.TEMPLATES) - 1)} = {_i}")
CTES["letterparts"] = " UNION ALL ".join(_LETTER)
CTES["letters"] = "SELECT 'letter' AS source_type, source_id, array_to_string(list_transform(parts, lambda p: p.t), '') AS text FROM letterparts"
CTES["lettergold"] = "SELECT source_id, parts[k].e AS e, CAST(coalesce(list_sum(list_transform(parts[1:k - 1], lambda p: length(p.t))), 0) AS BIGINT) AS s, length(parts[k].t) AS n FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS k FROM letterparts) WHERE parts[k].e <> ''"
CTES["letterfound"] = " UNION ALL ".join(f"({_hits(p, i, 'letters')})" for i, p in enumerate(generator.SCORED))
_USES |= {"letters": ["letterparts"], "lettergold": ["letterparts"], "letterfound": ["letters"]}
# spans of one entity do not touch here, so every hit meets one written value at most
_add("eval_generated", "lettergold letterfound", f"""SELECT entity_type, tp, fp, fn, {RATES} FROM (SELECT *, CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END AS r FROM (
  SELECT entity_type, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM (
    SELECT e AS entity_type, CASE WHEN f.source_id IS NULL THEN 0 ELSE 1 END AS tp, 0 AS fp, CASE WHEN f.source_id IS NULL THEN 1 ELSE 0 END AS fn
    FROM lettergold g LEFT JOIN letterfound f ON f.source_id = g.source_id AND f.entity_type = g.e AND f.start_offset < g.s + g.n AND g.s < f.end_offset
    UNION ALL SELECT entity_type, 0, 1, 0 FROM letterfound f WHERE NOT EXISTS (SELECT 1 FROM lettergold g WHERE g.source_id = f.source_id AND g.e = f.entity_type AND f.start_offset < g.s + g.n AND g.s < f.end_offset)) GROUP BY 1))""")
