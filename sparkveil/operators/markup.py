"""Spans found in the text of HTML, placed in its markup: where they stand, and the markup with them burned out.

All work on a row is local to it; what is joined by source are spans and runs, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkveil.functions.projection import projection, runs_of
from sparkveil.operators import spans
from sparkveil.operators.spans import KEY

SOURCE_TYPE = "email_body_html"


def with_projection(rows: DataFrame, html: str = "html") -> DataFrame:
    """``rows`` with ``text`` and ``runs`` of their markup."""
    # exploded from an array of one, so that the projection is made once, whatever uses it
    made = rows.select("*", F.explode(F.array(projection(F.col(html)))).alias("_p"))
    return made.withColumns({"text": F.col("_p.text"), "runs": runs_of(F.col("_p"))}).drop("_p")


def html_sources(rows: DataFrame, html: str = "html", key: str = "id") -> DataFrame:
    """source_type, source_id, html, text, runs of HTML bodies."""
    return with_projection(rows.select(F.lit(SOURCE_TYPE).alias("source_type"), F.col(key).alias("source_id"), F.col(html).alias("html")))


def pieces(runs: Column, start: Column, end: Column) -> Column:
    """Where [start, end) of the text stands in the markup: array<struct<start, end, size>>; ``size`` is how many code points of the text a piece is."""

    def cut(r: Column) -> Column:
        exact = (r["text_end"] - r["text_start"]) == (r["mark_end"] - r["mark_start"])
        first, last = F.greatest(start, r["text_start"]), F.least(end, r["text_end"])
        return F.struct(
            F.when(exact, r["mark_start"] + first - r["text_start"]).otherwise(r["mark_start"]).alias("start"),
            F.when(exact, r["mark_end"] - (r["text_end"] - last)).otherwise(r["mark_end"]).alias("end"),
            F.when(exact, last - first).otherwise(r["text_end"] - r["text_start"]).alias("size"),
        )

    return F.transform(F.filter(runs, lambda r: (r["text_start"] < end) & (start < r["text_end"])), cut)


def placed(found: DataFrame, bodies: DataFrame) -> DataFrame:
    """``found`` spans with their ``pieces`` and the first and last place (mark_start, mark_end) in the markup; a span of joining blanks alone has none."""
    rows = found.join(bodies.select(*KEY, "runs"), KEY)
    rows = rows.withColumn("pieces", pieces(F.col("runs"), F.col("start"), F.col("end"))).drop("runs")
    return rows.withColumns({"mark_start": F.array_min("pieces.start"), "mark_end": F.array_max("pieces.end")})


def burned(bodies: DataFrame, accepted: DataFrame, sign: str = "█") -> DataFrame:
    """Key and ``html`` with every covered code point of its text replaced by ``sign``: its text is then what ``spans.masked``
    makes of the text, but for the blanks that join nodes, which are not in the markup.

    ``bodies``: what ``html_sources`` gives. Overlapping spans are united first; a character reference goes as a whole.
    """
    covered = spans.segmented(bodies.select(*KEY, "text"), accepted.join(bodies.select(*KEY), KEY, "left_semi")).where("marked")
    intervals = covered.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("covered"))
    rows = bodies.join(intervals, KEY, "left")
    cuts = F.flatten(F.transform("covered", lambda s: pieces(F.col("runs"), s["start"], s["end"])))
    # a reference that two intervals touch is one cut
    cuts = F.array_sort(F.array_distinct(cuts))
    rows = rows.select(*KEY, "html", F.explode(F.array(F.coalesce(cuts, F.array().cast("array<struct<start:int,end:int,size:int>>")))).alias("cuts"))

    def piece(c: Column, i: Column) -> Column:
        last = F.when(i > 0, F.get("cuts", i - 1)["end"]).otherwise(F.lit(0))
        return F.concat(F.substring(F.col("html"), last + 1, c["start"] - last), F.repeat(F.lit(sign), c["size"]))

    after = F.coalesce(F.try_element_at("cuts", F.lit(-1))["end"], F.lit(0))
    out = F.concat(F.array_join(F.transform("cuts", piece), ""), F.substring(F.col("html"), after + 1, F.length("html")))
    return rows.select(*KEY, out.alias("html"))
