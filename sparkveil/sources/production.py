"""Productions as PDF files: a data source that is written to, one file per volume of pages.

    rows.write.format("production_pdf").option("path", folder).mode("append").save()

``rows`` are ``printable`` pages: volume, page, label, banner and the page's ``items``. Each volume is written by one task, page after
page, so nothing of a production passes through the driver; the commit only gives the volumes their names, the first and last label of
their pages, and writes ``manifest.json``. Files of failed or repeated tasks never get a name. Any file system that pyarrow knows will do.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Points: the page, its margins, a unit of layout (a fifth of a line), letters of Courier.
WIDE, HIGH, LEFT, TOP, UNIT, SIZE, LETTER = 612, 792, 36, 756, 2.6, 10, 6.0
ITEM = "struct<used:int,kind:string,text:string,boxes:array<struct<from_col:int,to_col:int,code:string>>>"
PAGE_ROW = f"volume long, page long, label string, banner string, items array<{ITEM}>"


def printable(printed: DataFrame, labels: DataFrame, banner: str, volume_pages: int = 5000) -> DataFrame:
    """``PAGE_ROW`` of printed(page, used, kind, text, boxes) and labels(page, label), a page of which may be blank. A page holds at most 60 items or so."""
    item = F.struct(F.col("used").cast("int").alias("used"), "kind", "text", "boxes")
    own = printed.groupBy("page").agg(F.array_sort(F.collect_list(item), lambda a, b: a["used"] - b["used"]).alias("items"))
    rows = labels.join(own, "page", "left").select(F.floor(F.col("page") / volume_pages).alias("volume"), "page", "label", F.lit(banner).alias("banner"), "items")
    return rows.repartition("volume").sortWithinPartitions("volume", "page")


def _literal(text: str) -> bytes:
    """A string of a content stream: Windows-1252, what it lacks is a question mark."""
    return b"(" + text.encode("cp1252", "replace").replace(b"\\", rb"\\").replace(b"(", rb"\(").replace(b")", rb"\)") + b")"


def _text(x: float, y: float, size: float, text: str, grey: float = 0, font: str = "F1") -> bytes:
    return b"BT /%s %.4g Tf %.3g g %.6g %.6g Td %s Tj ET\n" % (font.encode(), size, grey, x, y, _literal(text))


def page_stream(label: str, banner: str, items: list[dict]) -> bytes:
    """What is drawn on a page. Characters under a box are not in ``text``: its places there are blanks."""
    out = [_text(LEFT, 18, 8, banner, 0.25), _text(WIDE - LEFT - 4.8 * len(label), 18, 8, label, 0.25)]
    for item in items:
        top = TOP - item["used"] * UNIT
        if item["kind"] == "rule":
            out.append(b"0.7 G %g %.6g m %g %.6g l S\n" % (LEFT, top - 3, WIDE - LEFT, top - 3))
            continue
        base = top - SIZE
        if item["text"] and item["text"].strip():
            out.append(_text(LEFT, base, SIZE, item["text"], font="F2" if item["kind"] == "heading" else "F1"))
        for box in item["boxes"] or ():
            x, width = LEFT + box["from_col"] * LETTER, (box["to_col"] - box["from_col"]) * LETTER
            out.append(b"0 g %.6g %.6g %.6g %g re f\n" % (x, base - 2.1, width, SIZE * 1.18))
            if box["code"] and 3.6 * len(box["code"]) + 4 <= width:
                out.append(_text(x + (width - 3.6 * len(box["code"])) / 2, base, 6, box["code"], 1))
    return b"".join(out)


class PdfFile:
    """Pages written one after the other to ``out``; only the places of objects are kept."""

    def __init__(self, out):
        self.out, self.at, self.places = out, 0, {}
        self.kids: list[int] = []
        self._write(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n")
        for number, font in ((3, b"Courier"), (4, b"Courier-Bold")):
            self._object(number, b"<</Type/Font/Subtype/Type1/BaseFont/%s/Encoding/WinAnsiEncoding>>" % font)
        self._object(5, b"<</Font<</F1 3 0 R/F2 4 0 R>>>>")
        self.next = 6

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _object(self, number: int, body: bytes) -> None:
        self.places[number] = self.at
        self._write(b"%d 0 obj\n%s\nendobj\n" % (number, body))

    def page(self, content: bytes) -> None:
        data = zlib.compress(content)
        self._object(self.next, b"<</Length %d/Filter/FlateDecode>>\nstream\n%s\nendstream" % (len(data), data))
        self._object(self.next + 1, b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 %d %d]/Resources 5 0 R/Contents %d 0 R>>" % (WIDE, HIGH, self.next))
        self.kids.append(self.next + 1)
        self.next += 2

    def close(self) -> None:
        self._object(1, b"<</Type/Catalog/Pages 2 0 R>>")
        self._object(2, b"<</Type/Pages/Count %d/Kids[%s]>>" % (len(self.kids), b" ".join(b"%d 0 R" % k for k in self.kids)))
        start = self.at
        self._write(b"xref\n0 %d\n0000000000 65535 f \n" % self.next + b"".join(b"%010d 00000 n \n" % self.places[i] for i in range(1, self.next)))
        self._write(b"trailer\n<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (self.next, start))


@dataclass
class Volumes(WriterCommitMessage):
    """What a task has written: (file, number of the volume, first label, last label, pages)."""

    written: list[tuple[str, int, str, str, int]]


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class ProductionPdf(DataSource):
    @classmethod
    def name(cls) -> str:
        return "production_pdf"

    def schema(self) -> str:
        return PAGE_ROW

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _PdfWriter(self.options["path"].rstrip("/"), overwrite)


class _PdfWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex
        files, at = _file_system(path)
        if not overwrite and files.get_file_info(f"{at}/manifest.json").type == fs.FileType.File:
            raise FileExistsError(f"there is a production in {path}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Volumes:
        files, at = _file_system(self.path)
        files.create_dir(f"{at}/_{self.run}", recursive=True)
        done: list[tuple[str, int, str, str, int]] = []
        volume = out = file = first = last = None

        def end() -> None:
            if out is not None:
                file.close()
                out.close()
                done.append((name, volume, first, last, len(file.kids)))

        for batch in iterator:
            for row in batch.to_pylist():
                if row["volume"] != volume:
                    end()
                    name = f"{at}/_{self.run}/{uuid.uuid4().hex}.pdf"
                    out = files.open_output_stream(name)
                    volume, file, first = row["volume"], PdfFile(out), row["label"]
                file.page(page_stream(row["label"], row["banner"], row["items"] or []))
                last = row["label"]
        end()
        return Volumes(done)

    def commit(self, messages: list[Volumes | None]) -> None:
        files, at = _file_system(self.path)
        rows = sorted((x for m in messages if m for x in m.written), key=lambda x: x[1])
        names = []
        for file, volume, first, last, pages in rows:
            name = f"{first}_{last}.pdf"
            files.move(file, f"{at}/{name}")
            names.append({"file": name, "volume": volume, "first_label": first, "last_label": last, "pages": pages})
        files.create_dir(at, recursive=True)
        if files.get_file_info(f"{at}/_{self.run}").type == fs.FileType.Directory:
            files.delete_dir(f"{at}/_{self.run}")
        with files.open_output_stream(f"{at}/manifest.json") as out:
            out.write(json.dumps({"pages": sum(x["pages"] for x in names), "volumes": names}, indent=1).encode())

    def abort(self, messages: list[Volumes | None]) -> None:
        files, at = _file_system(self.path)
        if files.get_file_info(f"{at}/_{self.run}").type == fs.FileType.Directory:
            files.delete_dir(f"{at}/_{self.run}")
