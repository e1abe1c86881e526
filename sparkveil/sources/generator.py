"""A labelled corpus made in parallel: every value is a hash of seed, row and field, so any row can be made anywhere, again and alone.

``rows`` give the identifiers; texts are rendered from templates of literal pieces and fields, and the places of the fields are recorded
while they are written. The same documents come as messages of a mailbox.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkveil.config import BUILTIN, Pattern

#: Made-up names and places.
FIRST = ("Ada", "Boris", "Carla", "Dmitri", "Esther", "Farid", "Greta", "Hugo", "Imani", "Jonas", "Keiko", "Lars")
LAST = ("Abara", "Bianchi", "Castillo", "Dahl", "Eriksen", "Fontaine", "Grant", "Hoffmann", "Ito", "Jansen", "Kowalski", "Lund")
DOMAINS = ("example.org", "mail.example.com", "families.example.net")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
#: Pieces of text and, in braces, fields.
TEMPLATES = (
    "{PERSON} wrote from {EMAIL_ADDRESS}: the file of student {STUDENT_ID} lists {DATE_TIME:birth} as the date of birth, and {PHONE_NUMBER} is still the number at home.",
    "To the records office. Social security number {US_SSN} belongs to {PERSON} (student {STUDENT_ID}); answer to {EMAIL_ADDRESS} or {PHONE_NUMBER}.",
    "On {DATE_TIME:day} we meet about the plan. {PERSON} comes, reachable at {PHONE_NUMBER}; minutes go to {EMAIL_ADDRESS}.",
    "Trip to the museum: {PERSON} agrees. Meals are charged to {LUNCH_ACCT}. In need call {PHONE_NUMBER}.",
    "Report of {DATE_TIME:day}, student {STUDENT_ID}: {PERSON} was told by phone ({PHONE_NUMBER}) and by mail to {EMAIL_ADDRESS}. Nothing else happened.",
)
#: Recognisers that an office would add, and the built-in ones that the corpus is scored with.
CUSTOM = (Pattern("STUDENT_ID", "student_id", r"\b[0-9]{8}\b", 0.55), Pattern("LUNCH_ACCT", "lunch_account", r"\bLA[0-9]{6}\b", 0.85))
SCORED = (*(BUILTIN[e] for e in ("US_SSN", "EMAIL_ADDRESS", "PHONE_NUMBER", "DATE_TIME")), *CUSTOM)
ENTITIES = ("US_SSN", "EMAIL_ADDRESS", "PHONE_NUMBER", "DATE_TIME", "STUDENT_ID", "LUNCH_ACCT", "PERSON")


def number(seed: int, row: Column, field: str, low: int, high: int) -> Column:
    """A whole number in [low, high], from 32 bits of a hash."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), row.cast("string"), F.lit(field)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % (high - low + 1) + low).cast("int")


def one_of(seed: int, row: Column, field: str, values: Iterable[str]) -> Column:
    values = list(values)
    return F.get(F.array(*map(F.lit, values)), number(seed, row, field, 0, len(values) - 1))


def fields(seed: int, row: Column) -> dict[str, Column]:
    pick = lambda name, values: one_of(seed, row, name, values)
    draw = lambda name, low, high: number(seed, row, name, low, high)
    first, last = pick("first", FIRST), pick("last", LAST)
    area = draw("area", 100, 664)  # no area begins with 9 or is 000 or 666
    return {
        "PERSON": F.concat_ws(" ", first, last),
        "EMAIL_ADDRESS": F.concat(F.lower(first), F.lit("."), F.lower(last), F.lit("@"), pick("domain", DOMAINS)),
        "PHONE_NUMBER": F.format_string("(%03d) %03d-%04d", draw("code", 201, 989), draw("exchange", 200, 999), draw("line", 1000, 9999)),
        "US_SSN": F.format_string("%03d-%02d-%04d", area, draw("group", 10, 99), draw("serial", 1000, 9999)),
        "DATE_TIME:birth": F.format_string("%02d/%02d/%04d", draw("month", 1, 12), draw("day", 1, 28), draw("year", 2004, 2018)),
        "DATE_TIME:day": F.format_string("%s %d, 2024", pick("name of month", MONTHS), draw("day of month", 1, 28)),
        "STUDENT_ID": draw("student", 10_000_000, 99_999_999).cast("string"),
        "LUNCH_ACCT": F.concat(F.lit("LA"), draw("lunch", 100_000, 999_999).cast("string")),
    }


def _rendered(template: str, values: dict[str, Column]) -> Column:
    """struct<text, marks: array<struct<entity_type, start, end>>> of one template."""
    parts, lengths, marks = [], F.lit(0), []
    for i, piece in enumerate(template.replace("}", "{").split("{")):  # every other piece is a field
        value = values[piece] if i % 2 else F.lit(piece)
        if i % 2:
            marks.append(F.struct(F.lit(piece.split(":")[0]).alias("entity_type"), lengths.alias("start"), (lengths + F.length(value)).alias("end")))
        parts.append(value)
        lengths = lengths + F.length(value)
    return F.struct(F.concat(*parts).alias("text"), F.array(*marks).alias("marks"))


def labelled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """doc_id, text and marks (entity_type, start, end) for every value of ``key`` in ``rows``."""
    row = F.col(key)
    drawn = F.struct(number(seed, row, "template", 0, len(TEMPLATES) - 1).alias("template"), *(c.alias(n) for n, c in fields(seed, row).items()))
    # exploded from an array of one: every value is drawn once, whatever uses it
    rows = rows.select(row.alias("doc_id"), F.explode(F.array(drawn)).alias("v"))
    values = {n: F.col("v")[n] for n in fields(seed, row)}
    made = F.get(F.array(*(_rendered(t, values) for t in TEMPLATES)), F.col("v")["template"])
    return rows.select("doc_id", F.explode(F.array(made)).alias("d")).select("doc_id", "d.text", "d.marks")


def gold(documents: DataFrame) -> DataFrame:
    """doc_id, entity_type, start, end: what was written into the texts."""
    return documents.select("doc_id", F.inline("marks"))


def messages(documents: DataFrame, seed: int) -> DataFrame:
    """doc_id and message: each document as a message of a mailbox, its "From " line first, an empty line last."""
    row = F.col("doc_id")
    who = fields(seed, row)
    date = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + number(seed, row, "sent", 0, 31_000_000)), "EEE, d MMM yyyy HH:mm:ss")
    head = F.concat(
        F.lit("From corpus\nMessage-ID: <"), row.cast("string"), F.lit("@corpus.example.org>\nFrom: "), who["PERSON"], F.lit(" <"), who["EMAIL_ADDRESS"], F.lit(">\nTo: office@example.org\nSubject: Letter "), row.cast("string"),
        F.lit("\nDate: "), date, F.lit(" +0000\nContent-Type: text/plain; charset=utf-8\n\n"),
    )
    return documents.select("doc_id", F.concat(head, F.regexp_replace("text", "(?m)^From ", ">From "), F.lit("\n")).alias("message"))


def write_mailboxes(mail: DataFrame, path: str) -> None:
    """One mailbox a partition."""
    mail.select(F.col("message").alias("value")).write.text(path)
