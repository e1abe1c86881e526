"""Line dedup with a segment-partition edit join, in DataFrame operations alone.

Two lines are near if at most ``tau`` edits (1 or 2) part them, and no more than one for each ``per_edit`` characters of the shorter.

Distinct lines are found first. The index cuts a line of l characters into ``tau`` + 1 segments, whose size follows from l without
all but its three highest bits, so that lines of like lengths share it (a line just above such a step is indexed at both sides). ``tau``
edits touch ``tau`` segments at most. For each choice of those, a key is made of all text between them: from the line's start, from
its end, and, between two chosen segments, at its place or one character to either side (if both edits fall into one segment, the
choice of that one and its neighbour finds the pair without a shift). Candidates are verified by a banded bit-parallel
automaton: its row d holds, for the 2 * ``tau`` + 1 diagonals, which prefixes are d edits apart.

A key that at most ``crowded`` lines share has its lines compared, index against probes: by length, letter counts and what the key
leaves out, within the join, and only then by their texts. In a crowded one all lines are compared with one of them, the pivot, and
links make components. If such a key still holds several components, its lines meet in a finer index (``LEVELS``), again by pairs or
pivots. Lines of different components that share a crowded key of the finest index, which is nearly all of their text, are then
compared like those of the others. Keys are counted with
partial aggregation and joined, never gathered, so a segment that very many lines share costs no single task its lines. All joins
merge, whatever size the planner expects: compressed files of a few MB are many times that as a table that the driver would build and send.

Near lines form classes (connected components). Of each class of near or equal lines, the first occurrence (by document, then
text and line number; null ids last) stays, all others go. Lines without a word always stay.

Defined cases: null text has no line and is returned as it is; rows equal in id and text are one document and get one verdict; a text
whose lines all go is empty; very long lines are like any other; equal lines are told by 128 bits of hash; ids are integers; an
empty table gives none; other columns pass, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .storage import release, shuffle_width, stored

#: Segments of the finer indexes.
LEVELS = (6, 14)
_BLANK = " \t\r\x0b\x0c"


def _key() -> list[Column]:
    """Order and identity of a row: null ids last, id, hash of the text."""
    return [F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("k"), F.xxhash64("text").alias("h")]


KEY = ["none", "k", "h"]


def _lines(docs: DataFrame) -> DataFrame:
    """The key, no (from 0) and line, for each line with a word."""
    d = docs.where(F.col("text").isNotNull()).select(*_key(), F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return d.where(F.btrim("line", F.lit(_BLANK)) != "")


def _hashes() -> list[Column]:
    return [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")]


#: Characters after the common start on which most pairs already fail.
_LOOK = 24


def within(pairs: DataFrame, tau: int) -> DataFrame:
    """The rows of pairs (a, b, x, y) whose texts x and y are at most ``tau`` edits apart.

    The common start comes off first, and a pair whose next characters are too far apart goes; then the common end comes off,
    and the automaton reads what is left. Each length is exploded from an array of one, which keeps the optimiser from
    putting its expression in the place of every use.
    """
    x, y, head, tail = F.col("x"), F.col("y"), F.col("head"), F.col("tail")
    n, m = F.length("x"), F.length("y")
    steps = F.array(*(F.lit(1 << i) for i in range(17, -1, -1)))

    def same_start(acc: Column, p: Column) -> Column:
        return F.when((acc + p <= F.least(n, m)) & (F.substring(x, acc + 1, p) == F.substring(y, acc + 1, p)), acc + p).otherwise(acc)

    def same_end(acc: Column, p: Column) -> Column:
        fits = acc + p <= F.least(n, m) - head
        return F.when(fits & (F.substring(x, n - acc - p + 1, p) == F.substring(y, m - acc - p + 1, p)), acc + p).otherwise(acc)

    rows = pairs.where(F.abs(n - m) <= tau).select("*", F.explode(F.array(F.aggregate(steps, F.lit(0), same_start))).alias("head"))
    look = _last_row(F.substring(x, head + 1, F.lit(_LOOK)), F.substring(y, head + 1, F.lit(_LOOK + tau)), tau)
    rows = rows.where((n - head == 0) | (look != 0))
    rows = rows.select("*", F.explode(F.array(F.aggregate(steps, F.lit(0), same_end))).alias("tail"))
    a, b = F.substring(x, head + 1, n - head - tail), F.substring(y, head + 1, m - head - tail)
    short = F.least(n, m) - head - tail == 0
    return rows.where(short | (F.getbit(_last_row(a, b, tau), m - n + tau) == 1)).drop("head", "tail")


def _last_row(a: Column, b: Column, tau: int) -> Column:
    """The automaton's last row after all of ``a``, which is not empty."""
    # the arrays are bound once by a one-element transform, since a lambda's body is evaluated for every element
    ends = F.array(F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y"), F.greatest(F.lit(1), F.length(a)).alias("n")))
    return F.get(F.transform(ends, lambda s: _automaton(s["x"], s["y"], s["n"], tau)), F.lit(0))


def _automaton(x: Column, y: Column, n: Column, tau: int) -> Column:
    band = (1 << (2 * tau + 1)) - 1
    start = F.struct(*(F.lit(sum(1 << t for t in range(tau, tau + d + 1))).cast("long").alias(f"r{d}") for d in range(tau + 1)))
    none = F.lit(0).cast("long")

    def equal(i: Column) -> Column:
        """Bit t: is x's character i also y's on diagonal t."""
        return sum((F.when(F.get(y, i + (t - tau - 1)) == F.get(x, i - 1), F.lit(1 << t).cast("long")).otherwise(none) for t in range(2 * tau + 1)), none)

    def step(acc: Column, same: Column) -> Column:
        rows: list[Column] = []
        for d in range(tau + 1):
            row = acc[f"r{d}"].bitwiseAND(same)
            if d:
                less = acc[f"r{d - 1}"]
                row = row.bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(rows[d - 1], 1)).bitwiseAND(F.lit(band))
            rows.append(row)
        return F.when(acc[f"r{tau}"] == 0, acc).otherwise(F.struct(*(r.cast("long").alias(f"r{d}") for d, r in enumerate(rows))))

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), equal), start, step, lambda acc: acc[f"r{tau}"])


def _step(length: Column) -> Column:
    """``length`` without all but its three highest bits."""
    low = F.greatest(F.length(F.bin(length)) - 3, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", length, low), low)


def _indexed(lines: DataFrame, tau: int, parts: int) -> DataFrame:
    """id, key, probe (0: index, 1: shifted), and d1, d2: what the key leaves out (null: one stretch). A line of fewer than ``parts`` characters is cut into single ones.

    A pair whose edits all lie in one segment also meets under the choice of that one and its neighbour; so under two segments
    that lie apart, only lines that differ in both need to be compared.
    """
    choices = []
    for chosen in combinations(range(parts), tau):
        first, last = chosen[0], chosen[-1]
        for shift in (0, 1, -1) if last - first > 1 else (0,):
            choices.append(F.struct(F.lit(first).alias("first"), F.lit(last).alias("last"), F.lit(shift).alias("shift")))
    line, size, first, last = F.col("line"), F.col("size"), F.col("c")["first"], F.col("c")["last"]
    length = F.length(line).cast("int")
    steps = F.array_distinct(F.array(_step(length), _step(length - tau)))
    sized = lines.select("id", "line", F.explode(steps).alias("step")).select("*", F.least(F.lit(parts), "step").alias("parts"))
    sized = sized.select("*", F.floor(F.col("step") / F.col("parts")).cast("int").alias("size"), F.explode(F.array(*choices)).alias("c")).where(last < F.col("parts"))
    middle = F.substring(line, size * (first + 1) + 1 + F.col("c")["shift"], size * F.greatest(last - first - 1, F.lit(0)))
    key = F.xxhash64(F.substring(line, F.lit(1), size * first), middle, F.right(line, size * (F.col("parts") - 1 - last)), first * parts + last, "step")
    from_, to = size * first, size * (first + 1) + F.col("c")["shift"]
    from_2 = size * last + F.col("c")["shift"]
    to_2 = F.length(line) - size * (F.col("parts") - 1 - last)
    apart = last - first > 1
    dirt = [F.when(apart, F.xxhash64(F.substring(line, a + 1, b - a))).alias(d) for d, a, b in (("d1", from_, to), ("d2", from_2, to_2))]
    return sized.select("id", key.alias("key"), F.abs(F.col("c")["shift"]).alias("probe"), *dirt)


def _shared(keys: DataFrame, name: str) -> DataFrame:
    """The rows of ``keys`` under keys that different lines share, with the number of rows, ``n``."""
    tally = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("probe").alias("probe"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    tally = tally.where("probe = 0 AND lo <> hi").select("key", "n")
    return stored(keys.join(tally.hint("merge"), "key"), name)


def _pairs(rows: DataFrame, facts: DataFrame, tau: int) -> DataFrame:
    """Pairs a < b of a key's lines (index against all) that are of different components, and that neither what the key leaves out nor their letters tell apart."""
    counts = [c for c in facts.columns if c != "id"]
    rows = rows.join(facts.hint("merge"), "id")
    dirt = [c for c in ("d1", "d2") if c in rows.columns]
    a = rows.where("probe = 0").select("key", *(F.col(c).alias(f"a_{c}") for c in ("id", "component", *dirt, *counts)))
    b = rows.select("key", *(F.col(c).alias(f"b_{c}") for c in ("id", "probe", "component", *dirt, *counts)))
    apart = sum((F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in counts if c != "l"), F.lit(0))
    once = (F.col("b_probe") == 1) | (F.col("a_id") < F.col("b_id"))
    on = (a["key"] == b["key"]) & once & (F.col("a_component") != F.col("b_component")) & (F.abs(F.col("a_l") - F.col("b_l")) <= tau) & (apart <= 2 * tau)
    if dirt:
        on &= F.col("a_d1").isNull() | ((F.col("a_d1") != F.col("b_d1")) & (F.col("a_d2") != F.col("b_d2")))
    return a.join(b.hint("merge"), on).select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).distinct()


#: An edit changes at most two of these letters' counts by one each.
_COUNTED = "etaoinsrhldcumfpgwyb"


def _counts(line: Column) -> list[Column]:
    return [(F.length(line) - F.length(F.replace(line, F.lit(x), F.lit("")))).cast("int").alias(f"c{i}") for i, x in enumerate(_COUNTED)]


def _with_pivot(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs a < b of each line of a key and the key's pivot, one of its index rows."""
    pivot = rows.where("probe = 0").groupBy("key").agg(F.min_by(F.struct("id", "component"), F.xxhash64("id", F.lit(turn))).alias("p"))
    met = rows.join(pivot.hint("merge"), "key").where(F.col("component") != F.col("p.component"))
    return met.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")).distinct()


def _verified(pairs: DataFrame, lines: DataFrame, tau: int, per_edit: int) -> DataFrame:
    x = pairs.hint("merge").join(lines.select(F.col("id").alias("a"), F.col("line").alias("x")), "a")
    both = x.hint("merge").join(lines.select(F.col("id").alias("b"), F.col("line").alias("y")), "b").where(F.abs(F.length("x") - F.length("y")) <= tau)
    both = both.repartition(shuffle_width(lines.sparkSession), "a", "b")
    least, found = F.least(F.length("x"), F.length("y")), None
    for edits in range(1, tau + 1):
        fits = least >= per_edit * edits if edits == tau else (least >= per_edit * edits) & (least < per_edit * (edits + 1))
        near = within(both.where(fits), edits).select("a", "b")
        found = near if found is None else found.union(near)
    return stored(found, "near")


def _with_component(rows: DataFrame, classes: DataFrame | None) -> DataFrame:
    rows = rows.drop("component")
    if classes is None:
        return rows.withColumn("component", F.col("id"))
    known = rows.join(classes.withColumnRenamed("node", "id").hint("merge"), "id", "left")
    return known.withColumn("component", F.coalesce("component", "id"))


def _undecided(rows: DataFrame) -> DataFrame:
    """Those under keys that hold several components."""
    several = rows.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    return stored(rows.join(several.hint("merge"), "key", "left_semi"), "undecided")


def near_classes(lines: DataFrame, tau: int, per_edit: int, crowded: int, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """node, component of the lines (id, line) that links reach; component is a class's smallest id."""
    able = lines.where(F.length("line") >= max(8, per_edit)).select("id", "line")
    links: DataFrame | None = None
    classes: DataFrame | None = None

    def link(pairs: DataFrame) -> None:
        nonlocal links, classes
        found = _verified(pairs, texts, tau, per_edit)
        links = found if links is None else links.union(found)
        classes = stored(components(links), "classes")

    texts = able
    for level, parts in enumerate((tau + 1, *levels)):
        keys = _indexed(texts, tau, parts)
        rows = _shared(keys if level else keys.drop("d1", "d2"), "segments")
        release(lines.sparkSession)
        if not level:  # lines that share no segment with another are done; the others' texts are fetched once
            # by merging at any size: the lines are many, and so are those that share a segment
            texts = stored(able.hint("merge").join(rows.select("id").distinct(), "id", "left_semi"), "candidates")
            facts = stored(texts.select("id", F.length("line").cast("int").alias("l"), *_counts(F.col("line"))), "facts")
            release(lines.sparkSession)
        now = _with_component(rows, classes)
        now = now if classes is None else _undecided(now)
        few, many = now.where(F.col("n") <= crowded), now.where(F.col("n") > crowded)
        link(_pairs(few, facts, tau).union(_with_pivot(many, level)).distinct())
        rest = _undecided(_with_component(rows.where(F.col("n") > crowded), classes))
        if not rest.take(1):
            return classes
        if level < len(levels):
            texts = stored(texts.hint("merge").join(rest.select("id").distinct(), "id", "left_semi"), "hot")
    link(_with_pivot(rest, level + 1))
    rest = _undecided(_with_component(rest, classes))
    if rest.take(1):
        link(_pairs(rest, facts, tau))
    return classes


def line_classes(docs: DataFrame, tau: int = 2, per_edit: int = 10, crowded: int = 1024) -> DataFrame:
    """The occurrences of lines that have an equal or near one: the row's key, no, root (the key and no of the one that stays), and whether it goes as ``equal`` or ``near``."""
    distinct = _lines(docs).groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    distinct = stored(distinct.select(F.monotonically_increasing_id().alias("id"), *_hashes(), "n", "line"), "lines")
    release(docs.sparkSession)
    classes = near_classes(distinct, tau, per_edit, crowded)
    known = distinct.select("id", "h1", "h2", "n").hint("merge").join(classes.withColumnRenamed("node", "id"), "id", "left").where("n > 1 OR component IS NOT NULL")
    known = known.select("id", "h1", "h2", F.coalesce("component", "id").alias("component"))
    rows = _lines(docs).select(F.struct(*KEY, "no").alias("own"), *_hashes())
    rows = stored(rows.join(known.hint("merge"), ["h1", "h2"]).select("own", "id", "component"), "occurrences")
    first = rows.groupBy("id", "component").agg(F.min("own").alias("first"))
    root = first.groupBy("component").agg(F.min("first").alias("root"))
    judged = rows.join(stored(first.join(root.hint("merge"), "component").select("id", "first", "root"), "firsts").hint("merge"), "id")
    own, gone = F.col("own"), F.col("own") != F.col("root")
    near = gone & (own == F.col("first"))
    return judged.select("own.*", "root", near.alias("near"), (gone & ~near).alias("equal"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the lines that go taken out of ``text``; ``n_chars``, where there is one, follows."""
    gone = line_classes(docs, **options).where("equal OR near").groupBy(*KEY).agg(F.collect_set("no").alias("gone"))
    gone = gone.withColumnRenamed("none", "_none")
    release(docs.sparkSession)
    names = docs.columns
    whole = F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")  # out of the way of the names below
    rows = docs.select(whole, "text", *_key()).withColumnRenamed("none", "_none").join(gone.hint("merge"), ["_none", "k", "h"], "left")
    rows = rows.select("row", "text", "gone", F.split("text", "\n").alias("lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n"))
    rows = rows.select("row", "gone", text.alias("text"))
    after = {c: F.col("row")[c] for c in names} | {"text": F.col("text")}
    if "n_chars" in names:
        after["n_chars"] = F.when(F.col("gone").isNull(), F.col("row")["n_chars"]).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*(x.alias(c) for c, x in after.items()))


def op6_line_edit_join(spark, sf_dir: str) -> DataFrame:
    """A row per document: its lines, those that go as equal and as near, and the documents that hold the occurrences that stay in their place."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = line_classes(docs).where("equal OR near").groupBy(*KEY)
    found = found.agg(F.count_if("equal").alias("n_equal"), F.count_if("near").alias("n_near"), F.sort_array(F.collect_set(F.when(~F.col("root")["none"], F.col("root")["k"]))).alias("firsts"))
    rows = docs.select("doc_id", *_key(), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    out = rows.join(found.hint("merge"), KEY, "left")
    none = F.array().cast("array<bigint>")
    return out.select("doc_id", "n_lines", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_equal", "n_near")), F.coalesce("firsts", none).alias("firsts"))
