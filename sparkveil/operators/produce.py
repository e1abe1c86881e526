"""Productions: page layout, running page numbers, and the log of what was redacted where.

Units are fifths of a line: a page holds 275, a body line takes 5, a heading 8 (10 must be free), a header line 5, the gap
after the headers 2, the subject's label 5, the rule at the end 3 (5 must be free). A line holds 88 characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkveil.config import Bates
from sparkveil.functions.text import bates
from sparkveil.operators import spans

PAGE, LINE, HEADING, GAP, RULE, RULE_NEEDS, WIDTH = 275, 5, 8, 2, 3, 5, 88


def line_page(used: Column, line_no: Column) -> Column:
    """The page, from 0, of a body line when ``used`` units of the first page are taken before line 0."""
    first = F.greatest(F.lit(0), F.floor((PAGE - used) / LINE))
    return F.when(line_no < first, F.lit(0)).otherwise(1 + F.floor((line_no - first) / (PAGE // LINE))).cast("long")


def units_before(headers: Column) -> Column:
    return F.lit(HEADING) + headers * LINE + GAP


def pages(used: Column, lines: Column) -> Column:
    """How many pages a document takes, the rule at its end included. An empty body takes one line."""
    last = line_page(used, F.greatest(F.lit(1), lines) - 1)
    first = F.greatest(F.lit(0), F.floor((PAGE - used) / LINE))
    on_last = F.when(last == 0, used + F.greatest(F.lit(1), lines) * LINE).otherwise((F.greatest(F.lit(1), lines) - first - (last - 1) * (PAGE // LINE)) * LINE)
    return (last + 1 + F.when(on_last + RULE_NEEDS > PAGE, 1).otherwise(0)).cast("long")


def running_total(rows: DataFrame, levels: list[list[Column]], order: list[Column], value: str, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over all rows before this one.

    ``levels``: keys from coarse to fine; together with ``order`` (within the finest) they sort like the rows. At each level only the totals
    of its buckets are summed up, inside their coarser bucket, so that one task sees all totals of the coarsest level at most.
    """
    names = [[f"_k{i}_{j}" for j in range(len(x))] for i, x in enumerate(levels)]
    rows_ = rows.select("*", *(c.alias(n) for ns, cs in zip(names, levels, strict=True) for n, c in zip(ns, cs, strict=True)))
    flat = [n for ns in names for n in ns]
    earlier = lambda above, own: (Window.partitionBy(*above) if above else Window.partitionBy()).orderBy(*(F.col(n).asc_nulls_last() for n in own)).rowsBetween(Window.unboundedPreceding, -1)

    def offsets(depth: int) -> DataFrame:
        """The keys of the first ``depth`` levels, and the total before each of their buckets."""
        above, own = [n for ns in names[: depth - 1] for n in ns], names[depth - 1]
        sums = rows_.groupBy(*above, *own).agg(F.sum(value).alias("_t"))
        here = sums.select(*above, *own, F.coalesce(F.sum("_t").over(earlier(above, own)), F.lit(0)).cast("long").alias("_before"))
        if not above:
            return here
        up = offsets(depth - 1).select(*(F.col(n).alias(f"{n}_") for n in above), F.col("_before").alias("_up"))
        return here.join(up, [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in above]).select(*above, *own, (F.col("_before") + F.col("_up")).alias("_before"))

    totals = offsets(len(names)).withColumnsRenamed({n: f"{n}_" for n in flat})
    own = Window.partitionBy(*flat).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows_.select("*", F.coalesce(F.sum(value).over(own), F.lit(0)).alias("_in"))
    return placed.join(totals, [placed[n].eqNullSafe(totals[f"{n}_"]) for n in flat]).select(*rows.columns, (F.col("_before") + F.col("_in")).alias(out))


def by_date(dates: Column, ids: Column, least: int, most: int) -> list[list[Column]]:
    """Levels for rows in order of an ISO time, nulls last, then of an id between ``least`` and ``most``: hours, then times and stretches of ids."""
    stretch = F.floor((ids - least) * 1024 / (most - least + 1))
    return [[F.substring(dates, 1, 13)], [dates, stretch]]


def laid_out(docs: DataFrame, config: Bates) -> DataFrame:
    """docs(id, date_sent, lines, headers) to their pages: first and last label, in order of date (none last), then id."""
    rows = docs.withColumn("pages", pages(units_before(F.col("headers")), F.col("lines")))
    ends = docs.agg(F.min("id").alias("a"), F.max("id").alias("b")).first()
    rows = running_total(rows, by_date(F.col("date_sent"), F.col("id"), ends["a"] or 0, ends["b"] or 0), [F.col("id")], "pages", "before")
    first = F.col("before") + config.start
    return rows.select("id", "pages", bates(first, config.prefix, config.width).alias("first_page"), bates(first + F.col("pages") - 1, config.prefix, config.width).alias("last_page"), "before")


def _room(rows: DataFrame, needs: int) -> DataFrame:
    """A new page if less than ``needs`` is free. Where a document's drawing stands: page (from 0) and used units."""
    full = F.col("used") + needs > PAGE
    return rows.withColumns({"page": F.col("page") + F.when(full, 1).otherwise(0), "used": F.when(full, 0).otherwise(F.col("used"))})


def _heading(rows: DataFrame) -> DataFrame:
    return _room(rows, 2 * LINE).withColumn("used", F.col("used") + HEADING)


def _lines(rows: DataFrame, n: Column) -> DataFrame:
    """``n`` lines, one after the other."""
    first = F.greatest(F.lit(0), F.floor((PAGE - F.col("used")) / LINE))
    over, on_page = n - first - 1, PAGE // LINE
    turned = n > first
    return rows.withColumns({
        "page": (F.col("page") + F.when(turned, 1 + F.floor(over / on_page)).otherwise(0)).cast("long"),
        "used": F.when(turned, (over % on_page + 1) * LINE).otherwise(F.col("used") + n * LINE).cast("long"),
    })


def _gap(rows: DataFrame) -> DataFrame:
    return rows.withColumn("used", F.col("used") + GAP)


def _rule(rows: DataFrame) -> DataFrame:
    return _room(rows, RULE_NEEDS).withColumn("used", F.col("used") + RULE)


def _body(rows: DataFrame, lines: str, name: str) -> DataFrame:
    """The lines of a text (an empty one takes one), from where they begin: kept as ``name``_page and ``name``_used."""
    rows = rows.withColumns({f"{name}_page": F.col("page"), f"{name}_used": F.col("used")})
    rows = _rule(_lines(rows, F.greatest(F.lit(1), F.coalesce(lines, F.lit(0)))))
    return rows.withColumns({f"{name}_rule_page": F.col("page"), f"{name}_rule": F.col("used") - RULE})


def email_pages(docs: DataFrame) -> DataFrame:
    """docs(id, headers: how many header lines, subject_lines, body_lines) with where each text begins, and ``pages``.

    A heading and the headers, the subject under its label, a rule, a heading, the body, a rule; then a new page.
    """
    rows = _heading(docs.withColumns({"page": F.lit(0).cast("long"), "used": F.lit(0).cast("long")}))
    rows = _lines(_gap(_lines(rows, F.col("headers"))), F.lit(1))
    rows = _body(rows, "subject_lines", "subject")
    rows = _body(_heading(rows), "body_lines", "body")
    return rows.withColumn("pages", F.col("page") + 1).drop("page", "used")


def attachment_pages(docs: DataFrame) -> DataFrame:
    """docs(id, headers, lines) likewise: a heading and the headers, the text, a rule."""
    rows = _heading(docs.withColumns({"page": F.lit(0).cast("long"), "used": F.lit(0).cast("long")}))
    rows = _body(_gap(_lines(rows, F.col("headers"))), "lines", "text")
    return rows.withColumn("pages", F.col("page") + 1).drop("page", "used")


def lines_of(text: str) -> Column:
    """How many printed lines a text has; an empty one has none of its own, one of blanks alone has those that they fill."""
    empty = F.coalesce(F.col(text), F.lit("")) == ""
    return F.when(empty, 0).otherwise(spans.line_count(F.col(text), WIDTH))


def produced(emails: DataFrame, attachments: DataFrame) -> DataFrame:
    """Where every text of a production begins: source_type, source_id, source_label, page (of the whole production, from 0), used, pages (of its
    document), rule_page and rule (where the rule after it is).

    ``emails``: id, date_sent, cc_addrs, excluded_at, subject and body_text; excluded ones are left out. ``attachments``: id, email_id, extracted_text.
    Lines are counted where the texts are. E-mails come by date (none last) and id, then attachments by e-mail and id.
    """
    kept = emails.where("excluded_at IS NULL")
    headers = (F.lit(3) + (F.size("cc_addrs") > 0).cast("int") + F.col("date_sent").isNotNull().cast("int")).alias("headers")  # From, To, Source; Cc; Date
    mails = email_pages(kept.select("id", "date_sent", headers, lines_of("subject").alias("subject_lines"), lines_of("body_text").alias("body_lines")))
    ends = kept.agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("n")).first()
    mails = running_total(mails, by_date(F.col("date_sent"), F.col("id"), ends["a"] or 0, ends["b"] or 0), [F.col("id")], "pages", "before")
    files = attachments.select("id", "email_id", F.lit(3).alias("headers"), lines_of("extracted_text").alias("lines"))
    files = attachment_pages(files.join(kept.select(F.col("id").alias("email_id")), "email_id", "left_semi"))
    span = files.agg(F.min("email_id").alias("a"), F.max("email_id").alias("b")).first()
    coarse = F.floor((F.col("email_id") - (span["a"] or 0)) * 1024 / ((span["b"] or 0) - (span["a"] or 0) + 1))
    files = running_total(files, [[coarse], [F.col("email_id")]], [F.col("id")], "pages", "before")
    all_mail = mails.agg(F.coalesce(F.sum("pages"), F.lit(0)).alias("n")).first()["n"]
    def texts(rows: DataFrame, label: str, more: int, **kinds: str) -> DataFrame:
        one = lambda kind, name: F.struct(F.lit(kind).alias("source_type"), (F.col("before") + F.col(f"{name}_page") + more).alias("page"), F.col(f"{name}_used").alias("used"), (F.col("before") + F.col(f"{name}_rule_page") + more).alias("rule_page"), F.col(f"{name}_rule").alias("rule"))
        rows = rows.select(F.col("id").alias("source_id"), F.concat(F.lit(label), F.col("id").cast("string")).alias("source_label"), "pages", F.inline(F.array(*(one(k, n) for k, n in kinds.items()))))
        return rows.select("source_type", "source_id", "source_label", "page", "used", "pages", "rule_page", "rule")

    return texts(mails, "email ", 0, email_subject="subject", email_body_text="body").unionByName(texts(files, "attach ", all_mail, attachment_text="text"))


def full_log(clips: DataFrame, accepted: DataFrame, places: DataFrame, config: Bates) -> DataFrame:
    """The redaction log with its eleven columns, in the order of burning: page by page.

    ``clips``: accepted spans cut to lines; ``accepted``: the redactions with id, exemption_code, reviewer_id, accepted_at.
    """
    key = ["source_type", "source_id", "start", "end"]
    seen = clips.where("to_col > from_col").groupBy("source_type", "source_id", F.col("span_start").alias("start"), F.col("span_end").alias("end")).agg(F.min("line_no").alias("line_no"))
    rows = seen.join(accepted, key).join(places, ["source_type", "source_id"])
    page = F.col("page") + config.start + line_page(F.col("used"), F.col("line_no"))
    rows = rows.select(
        bates(page, config.prefix, config.width).alias("bates_label"), F.col("id").alias("redaction_id"), "source_type", "source_id", "source_label", F.col("start").alias("start_offset"), F.col("end").alias("end_offset"),
        (F.col("end") - F.col("start")).alias("length"), "exemption_code", F.coalesce("reviewer_id", F.lit("")).alias("reviewer_id"), "accepted_at",
    )
    return rows


def manifest(places: DataFrame, log: DataFrame, config: Bates) -> DataFrame:
    """One row about a production: documents, pages, redactions, first and last label. After the last document a page is begun, which alone is left if there is none."""
    docs = places.where("source_type <> 'email_subject'").groupBy().agg(
        F.count_if(F.col("source_type") == "email_body_text").alias("emails_exported"), F.count_if(F.col("source_type") == "attachment_text").alias("attachments_exported"),
        at_least_one_page(F.sum("pages") + 1).cast("long").alias("pages_written"),
    )
    burned = log.agg(F.countDistinct("redaction_id").alias("redactions_burned"))
    one = lambda df: df.withColumn("_", F.lit(0))
    rows = one(docs).join(one(burned), "_").drop("_")
    return rows.select("*", bates(F.lit(config.start), config.prefix, config.width).alias("bates_first"), bates(F.col("pages_written") - 1 + config.start, config.prefix, config.width).alias("bates_last"))


def redaction_log(clips: DataFrame, layout: DataFrame, config: Bates, headers: int = 3) -> DataFrame:
    """Each burned span with the label of the page where it is first seen; spans that cover no character of a line are not burned."""
    seen = clips.where("to_col > from_col").groupBy("source_id", "span_start", "span_end").agg(F.min("line_no").alias("line_no"))
    rows = seen.join(layout, seen["source_id"] == layout["id"])
    number = F.col("before") + config.start + line_page(units_before(F.lit(headers)), F.col("line_no"))
    return rows.select("source_id", "span_start", "span_end", bates(number, config.prefix, config.width).alias("page"))


def overlaid(lines: DataFrame, accepted: DataFrame, sign: str = "█") -> DataFrame:
    """``lines`` with covered characters replaced by ``sign``, and the ``boxes`` that cover them (with the code, if ``accepted`` has any).

    Lines break where the uncovered text breaks, whatever is covered.
    """
    code = F.col("exemption_code") if "exemption_code" in accepted.columns else F.lit(None).cast("string")
    marked = accepted.select("source_type", "source_id", "start", "end", code.alias("code")).distinct()
    cuts = spans.clipped(lines, marked).join(marked.withColumnsRenamed({"start": "span_start", "end": "span_end"}), ["source_type", "source_id", "span_start", "span_end"]).where("to_col > from_col")
    boxes = cuts.groupBy("source_type", "source_id", "line_no").agg(F.array_sort(F.collect_set(F.struct("from_col", "to_col", "code"))).alias("boxes"))
    hide = lambda line, b: F.concat(F.substring(line, 1, b["from_col"]), F.repeat(F.lit(sign), b["to_col"] - b["from_col"]), F.substring(line, b["to_col"] + 1, F.length(line)))
    rows = lines.join(boxes, ["source_type", "source_id", "line_no"], "left")
    return rows.withColumn("line", F.when(F.col("boxes").isNull(), F.col("line")).otherwise(F.aggregate("boxes", F.col("line"), hide)))


def production_lines(sources: DataFrame, accepted: DataFrame, width: int = WIDTH) -> DataFrame:
    """The text of every line as it is printed: covered characters blacked out, controls blank."""
    return overlaid(spans.wrapped(sources, width), accepted).drop("boxes")


def on_pages(rows: DataFrame) -> DataFrame:
    """Lines (line_no) of texts that begin at (page, used) with the page and units of their own."""
    first = F.greatest(F.lit(0), F.floor((PAGE - F.col("used")) / LINE))
    turned = F.col("line_no") >= first
    return rows.withColumns({
        "page": F.col("page") + line_page(F.col("used"), F.col("line_no")),
        "used": F.when(turned, (F.col("line_no") - first) % (PAGE // LINE) * LINE).otherwise(F.col("used") + F.col("line_no") * LINE).cast("long"),
    })


def printed_text(sources: DataFrame, accepted: DataFrame, places: DataFrame) -> DataFrame:
    """page, used, kind, text, boxes of every line of every text; what a box covers is blank."""
    lines = overlaid(spans.wrapped(sources, WIDTH), accepted, " ")
    rows = on_pages(lines.join(places.select("source_type", "source_id", "page", "used"), ["source_type", "source_id"]))
    return rows.select("page", "used", F.lit("line").alias("kind"), F.col("line").alias("text"), "boxes")


def printed_frame(emails: DataFrame, attachments: DataFrame, places: DataFrame) -> DataFrame:
    """Headings, header lines, labels and rules round the texts, as printed_text gives them.

    ``emails``: also from_addr, to_addrs, mbox_source, mbox_index; ``attachments``: also filename, content_type.
    """
    item = lambda used, kind, text: F.struct(used.cast("long").alias("used"), F.lit(kind).alias("kind"), text.alias("text"))
    none = F.lit(None).cast("array<struct<from_col:int,to_col:int,code:string>>").alias("boxes")
    number = F.col("id").cast("string")
    said = lambda name, value: F.when(value.isNotNull(), F.concat(F.rpad(F.lit(name + ":"), 9, " "), F.substring(value, 1, WIDTH - 9)))

    def headers(*lines: Column) -> Column:
        return F.transform(F.filter(F.array(*lines), lambda x: x.isNotNull()), lambda x, i: F.struct((HEADING + i * LINE).cast("long").alias("used"), F.lit("line").alias("kind"), x.alias("text")))

    listed = lambda c: F.array_join(c, ", ")
    top = lambda kind: places.where(F.col("source_type") == kind).select(F.col("source_id").alias("id"), "page", F.col("used").alias("at"))
    mails = emails.join(top("email_subject"), "id")
    mails = mails.select("page", F.inline(F.concat(
        F.array(item(F.lit(0), "heading", F.concat(F.lit("E-mail "), number))),
        headers(said("From", F.coalesce("from_addr", F.lit(""))), said("To", listed("to_addrs")), F.when(F.size("cc_addrs") > 0, said("Cc", listed("cc_addrs"))), said("Date", F.col("date_sent")), said("Source", F.concat_ws(" #", "mbox_source", F.col("mbox_index").cast("string")))),
        F.array(item(F.col("at") - LINE, "line", F.lit("Subject:"))),
    )))
    bodies = places.where("source_type = 'email_body_text'").select("page", F.inline(F.array(item(F.col("used") - HEADING, "heading", F.lit("Body")))))
    files = attachments.join(top("attachment_text"), "id").select("page", F.inline(F.concat(
        F.array(item(F.lit(0), "heading", F.concat(F.lit("Attachment "), number))),
        headers(said("File", F.coalesce("filename", F.lit(""))), said("Type", F.coalesce("content_type", F.lit(""))), said("E-mail", F.col("email_id").cast("string"))),
    )))
    rules = places.select(F.col("rule_page").alias("page"), F.inline(F.array(item(F.col("rule"), "rule", F.lit("")))))
    return mails.unionByName(bodies).unionByName(files).unionByName(rules).select("*", none)


def page_labels(places: DataFrame, config: Bates) -> DataFrame:
    """page, label of every page, the one that is begun after the last document included."""
    documents = places.where("source_type <> 'email_subject'")
    total = documents.agg(F.sum("pages").alias("n")).first()["n"] or 0
    return places.sparkSession.range(total + 1).select(F.col("id").alias("page"), bates(F.col("id") + config.start, config.prefix, config.width).alias("label"))


def write_log(log: DataFrame, path: str) -> None:
    """One CSV file with a header, in the order of burning; the log is as long as the redactions of a production."""
    log.orderBy(*log.columns[:1], "source_id", "start_offset", "end_offset").coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def at_least_one_page(n: Column) -> Column:
    return F.greatest(F.lit(1), F.coalesce(n, F.lit(0)))
