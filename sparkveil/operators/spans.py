"""The span algebra. A span is half-open in code points; all of it is row-local column work, or an equi-join with a range residual.

The central relation is sources(source_type, source_id, text).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkveil.config import Config, Pattern

KEY = ["source_type", "source_id"]
_SPAN = "array<struct<entity_type:string,start:int,end:int,score:double,recognizer:string,ord:int>>"


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x made once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def running(xs: Column) -> Column:
    """For each of an array of ints, the sum of those before it. By blocks of the root of their number, as every append copies what is there."""
    none = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("sum"))
    scan = lambda block: F.aggregate(block, none, lambda acc, x: F.struct(F.concat(acc["out"], F.array(acc["sum"])).alias("out"), (acc["sum"] + x).alias("sum")))

    def blocks(x: Column) -> Column:
        step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x))).cast("int"))
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / step).cast("int")), lambda i: scan(F.slice(x, i * step + 1, step)))

    whole = let(xs, lambda x: F.when(F.size(x) == 0, F.array().cast("array<int>")).otherwise(
        let(blocks(x), lambda b: let(scan(F.transform(b, lambda s: s["sum"]))["out"], lambda bases: F.flatten(F.transform(b, lambda s, i: F.transform(s["out"], lambda o: o + F.get(bases, i))))))
    ))
    return whole


def matches(text: Column, pattern: Pattern, ord_: int) -> Column:
    """All matches of one pattern, as an array of spans. Texts between matches and the matches give the offsets."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern.regex), F.lit(0)), lambda m: F.length(m))
    gaps = F.transform(F.split(text, pattern.regex, -1), lambda g: F.length(g))

    def spans_of(x: Column) -> Column:
        both = F.transform(x["size"], lambda n, i: n + F.get(x["gap"], i))
        start = lambda before, i: before + F.get(x["gap"], i)
        return F.transform(running(both), lambda before, i: F.struct(
            F.lit(pattern.entity).alias("entity_type"), start(before, i).alias("start"), (start(before, i) + F.get(x["size"], i)).alias("end"),
            F.lit(float(pattern.score)).alias("score"), F.lit(pattern.recognizer).alias("recognizer"), F.lit(ord_).alias("ord"),
        ))

    spans = let(F.struct(gaps.alias("gap"), found.alias("size")), spans_of)
    spans = F.filter(spans, lambda s: _sound(text, s, pattern))
    there = text.rlike(pattern.regex)
    return F.when(text.contains(pattern.needs) & there if pattern.needs else there, spans).otherwise(F.from_json(F.lit("[]"), _SPAN))


def _sound(text: Column, s: Column, pattern: Pattern) -> Column:
    ok = F.lit(True)
    hit = F.substring(text, s["start"] + 1, s["end"] - s["start"])
    if pattern.check == "luhn":
        ok = ok & F.call_function("luhn_check", F.regexp_replace(hit, "[^0-9]", ""))
    if pattern.check == "ssn":
        area = F.substring(hit, 1, 3)
        ok = ok & ~area.isin("000", "666") & ~area.startswith("9") & (F.substring(hit, 5, 2) != "00") & (F.substring(hit, 8, 4) != "0000")
    return ok


def scan(sources: DataFrame, patterns: Iterable[Pattern], min_score: float = 0.0, resolve: bool = True) -> DataFrame:
    """One row per hit: key, entity_type, start, end, score, recognizer, matched_text. The text is read once for all patterns."""
    patterns = [p for p in patterns if p.score >= min_score]
    hits = F.flatten(F.array(*(matches(F.col("text"), p, i) for i, p in enumerate(patterns)))) if patterns else F.from_json(F.lit("[]"), _SPAN)
    # exploded from arrays of one: the optimiser would put the expression in the place of every use of it, and scan again for each
    rows = sources.where(F.col("text") != "").select(*KEY, "text", F.explode(F.array(hits)).alias("hits")).where(F.size("hits") > 0)
    if resolve:
        rows = rows.select(*KEY, "text", F.explode(F.array(resolve_overlaps(F.col("hits"), sorted({p.entity for p in patterns})))).alias("hits"))
    rows = rows.select(*KEY, "text", F.inline("hits"))
    return rows.select(*KEY, "entity_type", "start", "end", "score", "recognizer", F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")).alias("matched_text"))


def resolve_overlaps(hits: Column, entities: Iterable[str]) -> Column:
    """Per entity type, of overlapping hits the one with the higher score (the earlier, if equal); types may overlap each other."""

    def fold(entity: str) -> Column:
        own = F.transform(F.filter(hits, lambda s: s["entity_type"] == entity), lambda s: F.struct(s["start"].alias("start"), (-s["score"]).alias("worse"), s["ord"].alias("ord"), s["end"].alias("end"), s["recognizer"].alias("recognizer")))

        def step(acc: Column, s: Column) -> Column:
            last = F.element_at(acc, -1)
            clear = s["start"] >= last["end"]
            better = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(s))
            return F.when(clear, F.concat(acc, F.array(s))).when(s["worse"] < last["worse"], better).otherwise(acc)

        def folded(x: Column) -> Column:
            empty = F.filter(x, lambda s: F.lit(False))
            clash = F.exists(F.transform(x, lambda s, i: (i > 0) & (s["start"] < F.get(x, i - 1)["end"])), lambda hit: hit)
            # the first span is taken before any is looked at: an empty array has no last element
            return F.when(clash, F.aggregate(x, empty, lambda acc, s: F.when(F.size(acc) == 0, F.array(s)).otherwise(step(acc, s)))).otherwise(x)

        return F.transform(
            let(F.array_sort(own), folded),
            lambda s: F.struct(F.lit(entity).alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), (-s["worse"]).alias("score"), s["recognizer"].alias("recognizer"), s["ord"].alias("ord")),
        )

    entities = list(entities)
    return F.flatten(F.array(*(fold(e) for e in entities))) if entities else hits


def detect(sources: DataFrame, config: Config) -> DataFrame:
    return scan(sources, config.patterns, config.min_score)


def run_counts(sources: DataFrame, found: DataFrame) -> DataFrame:
    """One row: sources_scanned, sources_skipped (blank texts), detections_written, by_entity (a map)."""
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    seen = sources.agg(F.count_if(~blank).alias("sources_scanned"), F.count_if(blank).alias("sources_skipped"))
    tally = found.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))
    tally = tally.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("detections_written"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "n")))).alias("by_entity"))
    one = lambda df: df.withColumn("_", F.lit(0))
    return one(seen).join(one(tally), "_").drop("_")


def replaced(old: DataFrame, new: DataFrame, scanned: DataFrame) -> DataFrame:
    """``old`` without the rows of any scanned source, and ``new``."""
    return old.join(scanned.select(*KEY).distinct(), KEY, "left_anti").unionByName(new)


def wrapped(sources: DataFrame, width: int) -> DataFrame:
    """Lines of at most ``width`` code points: key, line_no, start, line. Control characters become blanks, one for one."""
    clean = F.regexp_replace("text", r"[\x00-\x09\x0B-\x1F\x7F]", " ")
    rows = sources.where("text IS NOT NULL").select(*KEY, F.explode(F.array(F.split(clean, "\n", -1))).alias("paras"))
    cut = F.transform("paras", lambda p: F.when(p == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(p, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))))
    rows = rows.select(*KEY, running(F.transform("paras", lambda p: F.length(p) + 1)).alias("base"), F.explode(F.array(cut)).alias("cut"))
    rows = rows.select(*KEY, F.inline(F.arrays_zip("base", "cut", running(F.transform("cut", F.size)).alias("first"))))
    rows = rows.select(*KEY, "base", "first", F.posexplode("cut").alias("at", "line"))
    return rows.select(*KEY, (F.col("first") + F.col("at")).alias("line_no"), (F.col("base") + F.col("at") * width).alias("start"), "line")


def line_count(text: Column, width: int) -> Column:
    """How many lines ``wrapped`` makes of a text."""
    return F.aggregate(F.split(text, "\n", -1), F.lit(0), lambda n, p: n + F.greatest(F.lit(1), F.ceil(F.length(p) / width)).cast("int"))


def clipped(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans cut to lines, in line coordinates: an equi-join on the source with a range residual."""
    end = F.col("l.start") + F.length("l.line")
    on = (F.col("l.source_type") == F.col("s.source_type")) & (F.col("l.source_id") == F.col("s.source_id")) & (F.col("s.start") < end) & (F.col("l.start") < F.col("s.end"))
    return lines.alias("l").join(spans.alias("s"), on).select(
        "l.source_type", "l.source_id", "l.line_no", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"),
        (F.greatest("l.start", "s.start") - F.col("l.start")).alias("from_col"), (F.least(end, "s.end") - F.col("l.start")).alias("to_col"),
    )


def segmented(sources: DataFrame, spans: DataFrame) -> DataFrame:
    """Runs that cover each text: key, start, end, marked. A running maximum of ends keeps nested spans from uncovering text."""
    size = sources.select(*KEY, F.length("text").alias("size"))
    cuts = spans.join(size, KEY).select(*KEY, F.greatest(F.lit(0), F.least("start", "size")).alias("start"), F.greatest(F.lit(0), F.least("end", "size")).alias("end"), "size")
    w = Window.partitionBy(*KEY).orderBy("start", F.desc("end"))
    cuts = cuts.select("*", F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("cursor"))
    marked = cuts.where("end > cursor AND end > start").select(*KEY, F.greatest("start", "cursor").alias("start"), "end", F.lit(True).alias("marked"))
    before = cuts.where("start > cursor").select(*KEY, F.col("cursor").alias("start"), F.col("start").alias("end"), F.lit(False).alias("marked"))
    last = size.join(cuts.groupBy(*KEY).agg(F.max("end").alias("last")), KEY, "left").select(*KEY, F.coalesce("last", F.lit(0)).alias("start"), F.col("size").alias("end"), F.lit(False).alias("marked")).where("end > start")
    return marked.unionByName(before).unionByName(last)


def masked(sources: DataFrame, spans: DataFrame, sign: str = "█") -> DataFrame:
    """Key and text with every covered code point replaced."""
    runs = segmented(sources, spans).join(sources, KEY)
    piece = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    runs = runs.select(*KEY, "start", F.when(F.col("marked"), F.repeat(F.lit(sign), F.col("end") - F.col("start"))).otherwise(piece).alias("piece"))
    done = runs.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "piece"))), lambda x: x["piece"]), "").alias("done"))
    return sources.select(*KEY).join(done, KEY, "left").select(*KEY, F.coalesce("done", F.lit("")).alias("masked"))


def matched_greedily(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """entity_type, tp, fp, fn: each prediction, in order, takes the first overlapping gold span that is still free."""
    spans = lambda df, name: df.groupBy("doc_id", "entity_type").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(name))
    both = spans(predicted, "p").join(spans(gold, "g"), ["doc_id", "entity_type"], "full")
    none = F.from_json(F.lit("[]"), "array<struct<start:int,end:int>>")
    p, g = F.coalesce("p", none), F.coalesce("g", none)

    def take(free: Column, s: Column) -> Column:
        hit = F.filter(free, lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"]))
        return F.when(F.size(hit) == 0, free).otherwise(F.array_except(free, F.slice(hit, 1, 1)))

    left = F.size(F.aggregate(p, g, take))
    counts = both.select("entity_type", F.size(p).alias("np"), F.size(g).alias("ng"), left.alias("left"))
    return counts.groupBy("entity_type").agg(F.sum(F.col("ng") - F.col("left")).alias("tp"), F.sum(F.col("np") - F.col("ng") + F.col("left")).alias("fp"), F.sum("left").alias("fn"))


def with_rates(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to tp, fp, fn; an empty denominator gives 1, and f1 is 0 if both are 0."""
    rate = lambda other: F.when(F.col("tp") + F.col(other) == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col(other)))
    rows = counts.withColumn("precision", rate("fp")).withColumn("recall", rate("fn"))
    total = F.col("precision") + F.col("recall")
    return rows.withColumn("f1", F.when(total == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / total))
