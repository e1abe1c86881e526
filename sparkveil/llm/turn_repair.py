"""Conversations whose turns follow a grammar again: error-correcting Earley parsing, the cheapest edits of every conversation.

The grammar of role initials is ``(s?(ua)+)?``, written left-recursively (``RULES``), so that every item of a chart begins where its
chart begins and a chart column holds a handful of items, however long the conversation is. Error productions let a row be kept, given
another role or deleted, and a missing turn be inserted; an item keeps its smallest (cost, audit), where the audit spells the edits.

A long conversation is parsed in segments of ``SEGMENT`` rows, each from every state that the rows before can leave. A state is the
part of a turn that is complete (nothing, a system turn, an open pair, a closed pair). Inserts are made only before a row or at the
very end, so audits of one segment are equally many rows long and none is the beginning of another: the least audit of a whole
conversation is made of the least audits of its segments. Only costs and ranks (16 numbers a segment) meet in one task; audits and
texts stay in rows, apart from the one string or digest of a conversation that a caller asks for.

Defined cases: rows of a conversation are ordered by turn (nulls first), then role, then text; repeated rows are all kept apart and
are duplicates from the second on; a null role or text is one space, a null conv_id is a conversation of its own; an empty table gives
no rows; other columns are not read. A very long text travels whole and is only compared by its SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored

_SPACES = " \t\n\x0b\x0c\r"
_BLOCK_BITS = 12
SEGMENT = 1 << _BLOCK_BITS
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

#: Nonterminals are capitals; u, a and s are role initials, $ is the end.
RULES = (("Chat", ("$",)), ("Chat", ("Done", "$")), ("Lead", ("s",)), ("Open", ("u",)), ("Open", ("Lead", "u")), ("Open", ("Done", "u")), ("Done", ("Open", "a")))
#: What may be complete between two rows; "" is nothing yet.
STATES = ("", "Lead", "Open", "Done")
_LEAVES = {("$",): 0, ("Lead", "u"): 1, ("Open", "a"): 2, ("Done", "$"): 3}  # the item that waits in that state
_ROLE = {"u": "user", "a": "assistant"}


class _Column(dict):
    """A chart column: (left side, right side, place of the dot) to the smallest (cost, audit)."""

    def offer(self, item: tuple, cost: int, audit: str, waiting: list) -> None:
        if item not in self or (cost, audit) < self[item]:
            self[item] = (cost, audit)
            waiting.append(item)

    def close(self, waiting: list, start: _Column) -> None:
        """Complete and predict until nothing changes. All items begin at ``start``, the only column whose predictions are waited for."""
        while waiting:
            left, right, dot = waiting.pop()
            if dot == len(right):  # complete: every item that waited for it moves on
                cost, audit = self[(left, right, dot)]
                for of, body in RULES:
                    if body[0] == left and (of, body, 0) in start:
                        self.offer((of, body, 1), cost, audit, waiting)

    def terminals(self) -> Iterator[tuple[tuple, str, int, str]]:
        for (left, right, dot), (cost, audit) in list(self.items()):
            if dot < len(right) and not right[dot][0].isupper():
                yield (left, right, dot), right[dot], cost, audit


def _first_column(seed: str) -> _Column:
    column, waiting = _Column(), []
    for left, right in RULES:  # predictions; those that wait for a terminal hold only where nothing is complete yet
        if right[0][0].isupper() or not seed:
            column[(left, right, 0)] = (0, "")
    for left, right in RULES:
        if seed and right[0] == seed:
            column.offer((left, right, 1), 0, "", waiting)
    return column


def _inserted(column: _Column, start: _Column) -> _Column:
    """The column with missing turns put in, as many as pay."""
    out, waiting = _Column(column), list(column)
    done: dict = {}
    while True:
        out.close(waiting, start)
        for item, symbol, cost, audit in out.terminals():
            if symbol in _ROLE and done.get(item) != (cost, audit):
                done[item] = (cost, audit)
                out.offer((item[0], item[1], item[2] + 1), cost + INSERT, audit + "I", waiting)
        if not waiting:
            return out


@lru_cache(maxsize=1 << 14)
def _parse(marks: str, seed: str) -> tuple:
    """For each state at the end of the rows: (cost, audit) or None. ``marks`` has two characters a row: initial, and '.', 't' (truncated) or 'x' (must go)."""
    start = column = _first_column(seed)
    for mark, run in groupby(marks[i : i + 2] for i in range(0, len(marks), 2)):
        rows = sum(1 for _ in run)
        if mark[1] == "x":
            column = _Column({item: (cost + DELETE * rows, audit + "D" * rows) for item, _, cost, audit in column.terminals()})
            continue
        more = TRUNCATED * (mark[1] == "t")
        for _ in range(rows):
            after, waiting = _Column(), []
            for item, _, cost, audit in column.terminals():
                after.offer(item, cost + DELETE, audit + "D", waiting)
            for item, symbol, cost, audit in _inserted(column, start).terminals():
                moved = (item[0], item[1], item[2] + 1)
                if symbol == mark[0]:
                    after.offer(moved, cost + more, audit + "K", waiting)
                elif symbol in _ROLE:
                    after.offer(moved, cost + more + REROLE, audit + "R", waiting)
            after.close(waiting, start)
            column = after
    out: list = [None] * len(STATES)
    for (_, right, _), _, cost, audit in column.terminals():
        if right in _LEAVES and (out[_LEAVES[right]] is None or (cost, audit) < out[_LEAVES[right]]):
            out[_LEAVES[right]] = (cost, audit)
    return tuple(out)


@lru_cache(maxsize=len(STATES))
def _ending(state: int) -> tuple[int, str]:
    """The cheapest inserts that end a conversation in that state."""
    start = _first_column(STATES[state])
    return min((cost, audit) for (left, _, _), symbol, cost, audit in _inserted(start, start).terminals() if left == "Chat" and symbol == "$")


def _matrix(marks: str) -> tuple[list[int], list[int]]:
    """Costs from each state to each, and ranks of their audits among those from the same state; -1 where there is no way."""
    costs, ranks = [], []
    for seed in STATES:
        ways = _parse(marks, seed)
        order = sorted(w[1] for w in ways if w)
        costs += [w[0] if w else -1 for w in ways]
        ranks += [order.index(w[1]) if w else -1 for w in ways]
    return costs, ranks


def _course(segments: list[dict]) -> tuple[int, list[tuple[int, int]]]:
    """The least cost of a conversation, and the states before and after each of its segments: costs backwards, then audits forwards."""
    n = len(STATES)
    left = [[_ending(s)[0] for s in range(n)]]
    for x in reversed(segments):
        ahead = left[-1]
        left.append([min((x["costs"][n * s + t] + ahead[t] for t in range(n) if x["costs"][n * s + t] >= 0), default=1 << 60) for s in range(n)])
    left.reverse()
    now, out = 0, []
    for x, ahead in zip(segments, left[1:], strict=True):
        after = min((x["costs"][n * now + t] + ahead[t], x["ranks"][n * now + t], t) for t in range(n) if x["costs"][n * now + t] >= 0)[2]
        out.append((now, after))
        now = after
    return left[0][0], out


def _edits(marks: str, before: int, after: int, last: bool) -> tuple[str, list[dict]]:
    """The audit of a segment, and for each row its edit, its role afterwards (null: its own) and the roles put in before and after it."""
    audit = _parse(marks, STATES[before])[after][1]
    out, state, ahead, row = [], before, [], 0
    for letter in audit + (_ending(after)[1] if last else ""):
        role = "a" if state == 2 else "u"  # what an insert or a new role is here
        if letter == "D":
            out.append({"edit": "D", "role": None, "ahead": [], "behind": []})
        elif letter == "I":
            ahead = [*ahead, _ROLE[role]]
        else:
            role = marks[2 * row] if letter == "K" else role
            out.append({"edit": letter, "role": _ROLE[role] if letter == "R" else None, "ahead": ahead, "behind": []})
            ahead = []
        state = {"s": 1, "u": 2, "a": 3}[role] if letter != "D" else state
        row += letter != "I"
    if ahead and out:
        out[-1]["behind"] = ahead
    return audit + (_ending(after)[1] if last else ""), out


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults planted by the CRC-32 of ``conv_id:turn``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat_ws(":", text("conv_id"), text("turn"))) % 20).alias("_k"))
    role = F.when(F.col("_k") == 4, "user").otherwise(F.col("role"))
    body = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.where("_k <> 0").select("conv_id", "turn", role.alias("role"), body.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("_k") == 3, 2).otherwise(1))))
    return rows.drop("col")


class Repair:
    """``conversations`` (conv_id, turn, role, text) and their cheapest repairs.

    ``rows``: the rows in order, with ``seq``, which orders them; ``segments``: their parses; ``turns()``, ``audits()`` and ``faults()``: results.
    """

    def __init__(self, conversations: DataFrame):
        rows = conversations.select("conv_id", "turn", "role", "text", F.xxhash64(F.monotonically_increasing_id()).alias("_salt"))
        order = ["conv_id", "turn", "role", "text"]  # equal rows may lie in several ranges, so no number of copies makes one task long
        rows = rows.repartitionByRange(*order, "_salt").sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("seq"), *order)
        self.rows = stored(rows, "turns")
        solid = F.rtrim(F.col("text"), F.lit(_SPACES))
        initial = F.substring("role", 1, 1)
        marked = self.rows.select(
            "seq", "conv_id", "turn", "role", F.sha2("text", 256).alias("h"), (solid == "").alias("blank"), F.right(solid, F.lit(1)).isin(".", "!", "?").alias("ended"),
            F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"), F.length("role").alias("_n"),
        )
        fresh = marked.where("NOT blank").groupBy("conv_id", "role", "h").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("fresh"))
        fault = F.when(F.col("blank"), "blank").when(F.col("fresh").isNull(), "duplicate").when(~F.col("ended"), "truncated")
        self.marks = stored(marked.join(fresh, "seq", "left").select("seq", "conv_id", "turn", "initial", fault.alias("fault")), "marks")
        mark = F.concat("initial", F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", "t").otherwise("."))
        parts = self.marks.groupBy("conv_id", F.shiftright("seq", _BLOCK_BITS).alias("block")).agg(F.array_sort(F.collect_list(F.struct("seq", mark.alias("mark")))).alias("r"))
        self.segments = stored(parts.select("conv_id", F.col("r")[0]["seq"].alias("at"), F.col("r.seq").alias("seqs"), F.array_join("r.mark", "").alias("marks")), "segments")
        kind = conversations.schema["conv_id"].dataType.simpleString()
        self._kind = kind
        found = self.segments.select("conv_id", "at", "marks").mapInArrow(_charts, f"conv_id {kind}, at long, costs array<int>, ranks array<int>, first string, last string, illegal long")
        whole = found.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "costs", "ranks", "first", "last", "illegal"))).alias("s"))
        course = "array<struct<at:long,before:int,after:int,last:boolean>>"
        self.courses = stored(whole.mapInArrow(_courses, f"conv_id {kind}, cost long, illegal long, course {course}"), "courses")
        chosen = self.courses.select(F.inline("course"))
        edited = self.segments.join(chosen, "at").select("conv_id", "at", "seqs", "marks", "before", "after", "last")
        edit = "array<struct<seq:long,edit:string,role:string,ahead:array<string>,behind:array<string>>>"
        self.edits = stored(edited.mapInArrow(_edited, f"conv_id {kind}, at long, audit string, edits {edit}"), "edits")

    def turns(self) -> DataFrame:
        """The repaired conversations: conv_id, seq, place (order within seq), edit, role, text."""
        edits = self.edits.select(F.inline("edits")).withColumnRenamed("role", "new_role")
        put_in = lambda c: F.transform(c, lambda r: F.struct(F.lit("I").alias("edit"), r.alias("role"), F.lit("").alias("text")))
        own = F.struct(F.col("edit"), F.coalesce("new_role", "role").alias("role"), F.col("text"))
        all_ = F.concat(put_in("ahead"), F.when(F.col("edit") != "D", F.array(own)).otherwise(F.array().cast("array<struct<edit:string,role:string,text:string>>")), put_in("behind"))
        rows = self.rows.join(edits, "seq").select("conv_id", "seq", F.posexplode(all_).alias("place", "t"))
        return rows.select("conv_id", "seq", "place", "t.edit", "t.role", "t.text")

    def audits(self) -> DataFrame:
        """conv_id, audit: the initials of a conversation's edits in order."""
        parts = self.edits.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "audit"))).alias("p"))
        return parts.select("conv_id", F.array_join("p.audit", "").alias("audit"))

    def faults(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated: what was wrong."""
        count = lambda f: F.sum(F.when(F.col("fault") == f, 1).otherwise(0)).alias(f)
        turns = self.marks.select("conv_id", "turn").distinct().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
        found = self.marks.groupBy("conv_id").agg(count("blank"), count("duplicate"), count("truncated"))
        return turns.unionByName(found, allowMissingColumns=True).groupBy("conv_id").agg(*(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated")))

    def digests(self) -> DataFrame:
        """conv_id, repaired_sha256 of ``role:text`` lines: one pass over sorted rows, holding a row at a time. A digest is by nature made in one place."""
        lines = self.turns().select("conv_id", "seq", "place", F.concat_ws(":", "role", "text").alias("line"))
        lines = lines.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "place").select("conv_id", "line")
        return lines.mapInArrow(_digests, f"conv_id {self._kind}, repaired_sha256 string")


def _charts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for marks in batch.column("marks").to_pylist():
            costs, ranks = _matrix(marks)
            initials = list(marks[::2])
            out.append({"costs": costs, "ranks": ranks, "first": initials[0], "last": initials[-1], "illegal": _illegal(initials)})
        kinds = [("costs", pa.list_(pa.int32())), ("ranks", pa.list_(pa.int32())), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("at"), *(pa.array([x[k] for x in out], t) for k, t in kinds)], ["conv_id", "at", *(k for k, _ in kinds)])


def _courses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int32()), ("after", pa.int32()), ("last", pa.bool_())]))
    for batch in batches:
        costs, illegal, courses = [], [], []
        for segments in batch.column("s").to_pylist():
            cost, ways = _course(segments)
            costs.append(cost)
            illegal.append(sum(x["illegal"] for x in segments) + _illegal_between(segments))
            courses.append([{"at": x["at"], "before": a, "after": b, "last": i == len(segments) - 1} for i, (x, (a, b)) in enumerate(zip(segments, ways, strict=True))])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(costs, pa.int64()), pa.array(illegal, pa.int64()), pa.array(courses, kind)], ["conv_id", "cost", "illegal", "course"])


def _illegal_between(segments: list[dict]) -> int:
    return sum(_illegal([x["last"], y["first"]]) for x, y in zip(segments, segments[1:], strict=False))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = pa.list_(pa.string())
    kind = pa.list_(pa.struct([("seq", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("ahead", names), ("behind", names)]))
    for batch in batches:
        audits, edits = [], []
        for seqs, marks, before, after, last in zip(*(batch.column(c).to_pylist() for c in ("seqs", "marks", "before", "after", "last")), strict=True):
            audit, rows = _edits(marks, before, after, last)
            audits.append(audit)
            edits.append([{"seq": s} | r for s, r in zip(seqs, rows, strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("at"), pa.array(audits, pa.string()), pa.array(edits, kind)], ["conv_id", "at", "audit", "edits"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, digest, kind = None, None, None
    for batch in batches:
        ids, out, kind = [], [], batch.schema.field("conv_id").type
        for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist(), strict=True):
            if digest is not None and conv == own:
                digest.update(b"\n")
            else:
                if digest is not None:
                    ids.append(own)
                    out.append(digest.hexdigest())
                own, digest = conv, hashlib.sha256()
            digest.update(line.encode())
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(out, pa.string())], ["conv_id", "repaired_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([own], kind), pa.array([digest.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])


def op12_turn_repair(spark, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    repair = Repair(damage(conversations))
    parts = conversations.select("conv_id").distinct()
    for more in (repair.faults(), repair.courses.select("conv_id", "cost", "illegal"), repair.audits(), repair.digests()):
        parts = parts.unionByName(more, allowMissingColumns=True)
    number = lambda c: F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c)
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return parts.groupBy("conv_id").agg(*map(number, counts), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: The contract as a recursion over rows; the CRC-32 is spelled out.
OP12_SQL = r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
c AS (SELECT *, xor(list_reduce(list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(key[i]) AS BIGINT)),
        lambda a, b: list_reduce(CAST(range(8) AS BIGINT[]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(a, b)), 4294967295), 4294967295) % 20 AS f FROM k),
m AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE f <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM m),
r AS (SELECT *, substring(role, 1, 1) AS s, lag(substring(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
        CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
             WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM o),
ins(a, b, cost, letters) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (1, 2, 2, 'I'), (2, 3, 2, 'I'), (3, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 3, 4, 'II'), (2, 2, 4, 'II'), (3, 3, 4, 'II')),
own(a, want, b) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
lines AS (SELECT a, b, cost, letters, CASE letters WHEN '' THEN '' WHEN 'I' THEN CASE a WHEN 2 THEN E'assistant:\n' ELSE E'user:\n' END ELSE CASE a WHEN 2 THEN E'assistant:\nuser:\n' ELSE E'user:\nassistant:\n' END END AS put FROM ins),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, {'c': CAST(0 AS BIGINT), 'a': '', 't': ''} AS best FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, state, min(best) FROM (
    SELECT w.conv_id, r.i, w.state, {'c': w.best.c + 3, 'a': w.best.a || 'D', 't': w.best.t} AS best FROM walk w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
    UNION ALL
    SELECT w.conv_id, r.i, own.b, {'c': w.best.c + l.cost + CASE WHEN own.want = r.s THEN 0 ELSE 2 END + CASE WHEN r.fault = 'truncated' THEN 1 ELSE 0 END,
      'a': w.best.a || l.letters || CASE WHEN own.want = r.s THEN 'K' ELSE 'R' END,
      't': w.best.t || l.put || CASE WHEN own.want = r.s THEN r.role WHEN own.want = 'u' THEN 'user' ELSE 'assistant' END || ':' || r.text || E'\n'} AS best
    FROM walk w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1 JOIN lines l ON l.a = w.state JOIN own ON own.a = l.b
    WHERE r.fault NOT IN ('blank', 'duplicate') AND (own.want = r.s OR own.want <> 's')
  ) GROUP BY conv_id, i, state),
n AS (SELECT conv_id, count(*) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
        count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || s NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
e AS (SELECT w.conv_id, any_value(n.n) AS n, min({'c': w.best.c + CASE w.state WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END, 'a': w.best.a || CASE w.state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
        't': w.best.t || CASE w.state WHEN 1 THEN E'user:\nassistant:\n' WHEN 2 THEN E'assistant:\n' ELSE '' END}) AS best
      FROM walk w LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i = coalesce(n.n, 0) GROUP BY w.conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, e.best.c AS cost, e.best.a AS audit, sha256(CASE WHEN e.best.t = '' THEN '' ELSE e.best.t[:-2] END) AS repaired_sha256
FROM e LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM e.conv_id
"""
