"""Mailboxes and messages: an mbox data source, and messages and attachments parsed in Arrow batches."""

from __future__ import annotations

import email
import email.policy
import hashlib
import json
import re
from collections.abc import Iterator
from datetime import timezone
from email.message import Message
from email.utils import getaddresses, parsedate_to_datetime

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from sparkveil.functions.html import sanitized, text_of
from sparkveil.sources import office, pdf

MESSAGE = (
    "mbox_source string, mbox_index int, message_id string, subject string, from_addr string, to_addrs array<string>, cc_addrs array<string>, bcc_addrs array<string>, "
    "date_sent string, date_raw string, body_text string, body_html_sanitized string, headers map<string,array<string>>, raw_sha256 string, "
    "attachments array<struct<filename:string,content_type:string,content_disposition:string,size_bytes:long,sha256:string,is_inline:boolean,is_nested_eml:boolean,content:binary>>"
)
#: Extension for a nameless attachment of a type (fixed values); one of an image is its subtype.
EXTENSIONS = {"application/pdf": ".pdf", "text/plain": ".txt", "text/html": ".html", "message/rfc822": ".eml"}


def extension_of(kind: str) -> str:
    main, _, sub = kind.partition("/")
    return EXTENSIONS.get(kind) or ("." + safe_filename(sub) if main == "image" and sub else ".bin")


def split_mbox(data: bytes) -> Iterator[bytes]:
    """Messages of an mbox: each begins after a line that starts with "From "; an empty line before the next one, or the end, is not its own.

    Quoted ">From " lines stay as they are.
    """
    marks = [m.start() for m in re.finditer(rb"(?m)^From ", data)]
    for a, b in zip(marks, [*marks[1:], len(data)], strict=True):
        end = data.find(b"\n", a, b)
        body = data[end + 1 : b] if end >= 0 else b""
        yield body[:-1] if body.endswith(b"\n\n") or body == b"\n" else body


class MboxSource(DataSource):
    """spark.read.format("mbox").load(path) or spark.readStream...: mbox_source, mbox_offset (where the message begins in the file), raw.

    Option ``label`` replaces the path as the source's name. Source and offset name a message for good, in batches as in streams.
    """

    @classmethod
    def name(cls) -> str:
        return "mbox"

    def schema(self) -> str:
        return "mbox_source string, mbox_offset long, raw binary"

    def reader(self, schema) -> DataSourceReader:
        return _MboxReader(self.options)


    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _MboxTail(self.options)


def _files(path: str) -> tuple[fs.FileSystem, list[tuple[str, int]]]:
    """Mailboxes at or below a path, with their sizes, in order of name. Any file system that pyarrow knows."""
    files, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = files.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return files, [(at, info.size)]
    below = files.get_file_info(fs.FileSelector(at, recursive=True))
    return files, sorted((x.path, x.size) for x in below if x.type == fs.FileType.File and not x.base_name.startswith((".", "_")))


def _named(path: str, label: str | None, alone: bool) -> str:
    """A mailbox's name: its path, or the label, which in a folder is followed by the file's name."""
    return path if label is None else label if alone else f"{label}/{path.rsplit('/', 1)[-1]}"


def messages_between(stream, start: int, end: int | None, step: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of the messages of a mailbox that begin at a "From " line in [start, end), read in pieces of ``step``.

    A message may go on beyond ``end``. Lines are looked for from the byte before ``start``, so every line belongs to one range.
    """
    at = max(0, start - 1)
    stream.seek(at)
    held, base, begun, done = b"" if at else b"\n", at - (not at), None, False
    while not done:
        piece = stream.read(step)
        held += piece
        done = not piece
        search = 0
        while True:
            found = held.find(b"\nFrom ", search)
            if found < 0:
                break
            place = base + found + 1
            if begun is not None:
                yield begun, _body(held[: found + 1][begun - base :], last=False)
                begun = None
            if end is not None and place >= end:
                return
            if place >= start:
                begun = place
            search = found + 1
        cut = (begun - base) if begun is not None else max(0, len(held) - 6)
        held, base = held[cut:], base + cut
        if begun is None and end is not None and base >= end:
            return
    if begun is not None:
        yield begun, _body(held[begun - base :], last=True)


def _body(message: bytes, last: bool) -> bytes:
    """A message without its "From " line; an empty line before the next one, or at the end, is not its own."""
    line, _, body = message.partition(b"\n")
    return body[:-1] if body.endswith(b"\n\n") or body == b"\n" else body


class _MboxReader(DataSourceReader):
    """Ranges of ``partitionbytes`` bytes (64 MB unless told otherwise)."""

    def __init__(self, options: dict):
        self.path, self.label, self.step = options["path"], options.get("label"), int(options.get("partitionbytes", 64 << 20))

    def partitions(self):
        _, found = _files(self.path)
        return [_Range(p, _named(p, self.label, len(found) == 1), a, min(a + self.step, size)) for p, size in found for a in range(0, size, self.step)]

    def read(self, partition):
        files, _ = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), None)
        with files.open_input_file(partition.path) as stream:
            for place, raw in messages_between(stream, partition.start, partition.end):
                yield partition.source, place, raw


class _Range(InputPartition):
    def __init__(self, path: str, source: str, start: int, end: int):
        self.path, self.source, self.start, self.end = path, source, start, end


class _MboxTail(SimpleDataSourceStreamReader):
    """A mailbox, or a folder of them, that grows. The offset is how far each file is read; a message is handed on once the next one
    begins, or, with the option ``settled``, as it stands. A batch is at most ``batchbytes`` of each file, ended by a whole message."""

    def __init__(self, options: dict):
        self.path, self.label, self.settled = options["path"], options.get("label"), options.get("settled", "false") == "true"
        self.folder = options.get("folder", "false") == "true"
        self.most = int(options.get("batchbytes", 64 << 20))

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def _rows(self, start: dict, stop: dict | None) -> tuple[list[tuple], dict]:
        files, found = _files(self.path)
        rows, reached = [], dict(start)
        for path, size in found:
            first = start.get(path, 0)
            end = size if stop is None else stop.get(path, 0)
            if first >= end:
                continue
            with files.open_input_file(path) as stream:
                own = list(messages_between(stream, first, min(end, first + self.most) if stop is None else end))
                if stop is None and own:
                    # what begins after the last one, or the file's end, closes it
                    stream.seek(own[-1][0])
                    rest = next((p for p, _ in messages_between(stream, own[-1][0] + 1, None)), None)
                    if rest is None and not self.settled:
                        own, rest = own[:-1], own[-1][0]
                    reached[path] = size if rest is None else rest
            rows += [(_named(path, self.label, not self.folder), place, raw) for place, raw in own]
        return rows, reached

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, reached = self._rows(start, None)
        return iter(rows), reached

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter(self._rows(start, end)[0])


def read_mbox(spark: SparkSession, path: str, label: str | None = None) -> DataFrame:
    """Mailboxes below ``path`` in any store that Spark reads: mbox_source (a path, or the label, and of several the file's name), mbox_index (from 0), raw.

    A mailbox is split like any text file, at its "From " lines, so a large one is read by many tasks. A message's number is
    the number of messages in the file's earlier blocks (a few rows) plus its place in its own.
    """
    parts = spark.read.option("lineSep", "\nFrom ").text(path)
    parts = parts.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value").cast("binary").alias("part"))
    per_block = parts.groupBy("file", "block").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file").orderBy("block")
    per_block = per_block.select("file", "block", "first", F.coalesce(F.sum("n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("file")).alias("all"))
    rows = parts.join(per_block, ["file", "block"]).select("file", "part", (F.col("before") + F.col("row") - F.col("first")).alias("nth"), "all")
    one = label is None or per_block.select("file").distinct().limit(2).count() < 2
    begins = rows.where("nth = 0").select("file", (F.substring("part", 1, 5) == F.lit(b"From ")).alias("whole"))  # else what comes first is no message
    rows = rows.join(begins, "file").where("whole OR nth > 0")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for name, part, nth, n, whole in zip(f["file"], f["part"], f["nth"], f["all"], f["whole"], strict=True):
                part = bytes(part)
                body = part.partition(b"\n")[2]
                if nth == n - 1:
                    body = body[:-1] if body.endswith(b"\n\n") or body == b"\n" else body
                elif body and not body.endswith(b"\n"):
                    body += b"\n"
                out.append((_named(name, label, one), int(nth) - (not whole), body))
            yield pd.DataFrame(out, columns=["mbox_source", "mbox_index", "raw"])

    return rows.select("file", "part", "nth", "all", "whole").mapInPandas(run, "mbox_source string, mbox_index int, raw binary")


def _decoded(part: Message) -> str:
    data, charset = part.get_payload(decode=True) or b"", part.get_content_charset() or "utf-8"
    try:
        return data.decode(charset, "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def _header(message: Message, name: str) -> str | None:
    value = message.get(name)
    return str(email.header.make_header(email.header.decode_header(value))) if value is not None else None


def _addresses(message: Message, name: str) -> list[str]:
    found = getaddresses([str(v) for v in message.get_all(name, [])])
    return [f"{n} <{a}>" if n else a for n, a in found if a]


def utc_iso(raw: str | None) -> str | None:
    """ISO 8601 in UTC; a time without zone counts as UTC, what is no date is null."""
    try:
        when = parsedate_to_datetime(raw) if raw else None
    except (TypeError, ValueError):
        return None
    if when is None:
        return None
    return (when.replace(tzinfo=timezone.utc) if when.tzinfo is None else when).astimezone(timezone.utc).isoformat()


def safe_filename(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]", "_", name).strip("._")[:180]


def _leaves(part: Message, root: bool = True) -> Iterator[tuple[Message, bool]]:
    """Attachments, and whether one is a whole nested message, which is not looked into."""
    if part.get_content_type() == "message/rfc822":
        yield part, True
    elif part.is_multipart():
        for p in part.get_payload():
            yield from _leaves(p, False)
    elif part.get_content_disposition() == "attachment" or (not root and part.get_content_maintype() in ("image", "application", "audio", "video")):
        yield part, False


def _attachments(message: Message) -> list[dict]:
    out = []
    for i, (part, nested) in enumerate(_leaves(message)):
        inner = part.get_payload(0) if nested and part.is_multipart() else None
        data = inner.as_bytes() if inner is not None else part.get_payload(decode=True)
        if not data:
            continue
        kind = part.get_content_type()
        name = (f"{_header(inner, 'Subject') or 'message'}.eml" if inner is not None else part.get_filename()) or f"attachment_{i}{extension_of(kind)}"
        out.append({
            "filename": safe_filename(name) or f"attachment_{i}", "content_type": kind, "content_disposition": part.get_content_disposition(), "size_bytes": len(data),
            "sha256": hashlib.sha256(data).hexdigest(), "is_inline": part.get_content_disposition() == "inline", "is_nested_eml": nested, "content": data,
        })
    return out


def parsed_message(raw: bytes) -> dict:
    message = email.message_from_bytes(raw, policy=email.policy.compat32)
    bodies: dict[str, str] = {}
    for part in message.walk():
        if part.get_content_type() in ("text/plain", "text/html") and part.get_content_disposition() != "attachment":
            bodies.setdefault(part.get_content_type(), _decoded(part))
    headers: dict[str, list[str]] = {}
    for k, v in message.items():
        headers.setdefault(k, []).append(str(v))
    senders = _addresses(message, "From")
    return {
        "message_id": (message.get("Message-ID") or "").strip() or None, "subject": _header(message, "Subject"), "from_addr": senders[0] if senders else None,
        "to_addrs": _addresses(message, "To"), "cc_addrs": _addresses(message, "Cc"), "bcc_addrs": _addresses(message, "Bcc"),
        "date_sent": utc_iso(message.get("Date")), "date_raw": message.get("Date"), "body_text": bodies.get("text/plain"), "body_html_sanitized": sanitized(bodies.get("text/html")),
        "headers": headers, "raw_sha256": hashlib.sha256(raw).hexdigest(), "attachments": _attachments(message),
    }


def parsed(mailbox: DataFrame) -> DataFrame:
    """Messages of mailbox(mbox_source, mbox_index, raw); one that cannot be read has null fields and ``error``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in re.sub(r"<[^ ]*>", "", MESSAGE).split(", ")]
        for f in frames:
            rows = []
            for source, i, raw in zip(f["mbox_source"], f["mbox_index"], f["raw"], strict=True):
                try:
                    row = parsed_message(raw) | {"error": None}
                except Exception as e:  # counted by the caller
                    row = {"error": str(e)}
                rows.append({"mbox_source": source, "mbox_index": i} | row)
            yield pd.DataFrame(rows, columns=[*names, "error"])

    return mailbox.mapInPandas(run, f"{MESSAGE}, error string")


def decoded_text(data: bytes) -> str:
    """UTF-16 with a mark only; then UTF-8, then Windows-1252, then Latin-1."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace").strip()
    for charset in ("utf-8", "cp1252", "latin-1"):
        try:
            return data.decode(charset).strip()
        except UnicodeDecodeError:
            pass
    return ""


def eml_text(data: bytes) -> str:
    m = parsed_message(data)
    head = [("From", m["from_addr"]), ("To", ", ".join(m["to_addrs"])), ("Cc", ", ".join(m["cc_addrs"])), ("Subject", m["subject"]), ("Date", m["date_raw"])]
    return "\n".join([f"{k}: {v}" for k, v in head if v] + ["", (m["body_text"] or text_of(m["body_html_sanitized"])).strip()]).strip()


EXTRACTED = "extracted_text string, extraction_method string, extraction_status string, error_message string, page_count int, needs_ocr boolean, character_count int"


def extracted_text(kind: str | None, data: bytes | None) -> dict:
    """The columns of ``EXTRACTED`` by MIME type. Images and the older office formats need tools that are absent, and are unsupported.

    ``needs_ocr``: the text layer of a PDF holds too little to be all of it, or could not be read.
    """
    kind = (kind or "").split(";")[0].strip().lower()
    method = {"text/plain": "text", "text/html": "html", "message/rfc822": "eml", "application/pdf": "pdf"}.get(kind, "office" if kind in office.READERS else None)
    row = {"extracted_text": None, "extraction_method": method or "skipped", "extraction_status": "unsupported", "error_message": None, "page_count": None, "needs_ocr": False, "character_count": 0}
    if method is None:
        return row
    try:
        if data is None:
            raise ValueError("the content is missing")
        if method == "pdf":
            text, row["page_count"] = pdf.text_layer(data)
            row["needs_ocr"] = needs_ocr(row["page_count"], len(text))
        else:
            text = {"text": decoded_text, "html": lambda d: text_of(d.decode("utf-8", "replace")).strip(), "eml": eml_text, "office": lambda d: office.read(kind, d)}[method](data)
    except Exception as e:
        return row | {"extraction_status": "failed", "error_message": str(e)[:400], "needs_ocr": method == "pdf"}
    return row | {"extracted_text": text, "extraction_status": "ok" if text else "empty", "character_count": len(text)}


def needs_ocr(pages: int, characters: int) -> bool:
    """Does a PDF's text layer hold too little to be all of it."""
    return characters < max(1, pages) * 20


def extract(attachments: DataFrame, done: DataFrame | None = None, force: bool = False) -> DataFrame:
    """id and the columns of ``EXTRACTED`` of attachments(id, content_type, content) not in ``done``, or, by ``force``, of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [extracted_text(k, d) for k, d in zip(batch.column("content_type").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            columns = [pa.array([r[n] for r in rows], {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[t]) for n, t in (x.split() for x in EXTRACTED.split(", "))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", *(x.split()[0] for x in EXTRACTED.split(", "))])

    rows = attachments if done is None or force else attachments.join(done.select("id"), "id", "left_anti")
    return rows.select("id", "content_type", "content").mapInArrow(run, f"id long, {EXTRACTED}")


def explode_attachments(messages: DataFrame) -> DataFrame:
    return messages.select("mbox_source", "mbox_index", F.posexplode("attachments").alias("pos", "a")).select("mbox_source", "mbox_index", "pos", "a.*")


def as_ndjson(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def describe(stats: dict) -> str:
    return json.dumps(stats, sort_keys=True)
