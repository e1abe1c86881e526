"""Text of office files, from their parts: OOXML (documents, workbooks, presentations) and OpenDocument. Row-local; nothing is converted.

Order is the reader's: paragraphs and tables of a document as they stand, then its footnotes and endnotes; the sheets of a workbook
as its parts list says, a line per row; the slides of a presentation likewise, each with its notes. Cells of a row are joined by tabs.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

#: Content types and what reads them.
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
XLSX = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
PPTX = "application/vnd.openxmlformats-officedocument.presentationml.presentation"
ODT, ODS, ODP = (f"application/vnd.oasis.opendocument.{x}" for x in ("text", "spreadsheet", "presentation"))


class OfficeError(ValueError):
    pass


def _tag(node: ElementTree.Element) -> str:
    """An element's name without its namespace (namespaces differ between strict and transitional files)."""
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def _attribute(node: ElementTree.Element, name: str, default: str | None = None) -> str | None:
    return next((v for k, v in node.attrib.items() if k.rpartition("}")[2] == name), default)


class Package:
    """A zip file of parts, and the relationships between them."""

    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise OfficeError(str(e)) from e
        self.names = set(self.zip.namelist())
        if any(x.flag_bits & 1 for x in self.zip.infolist()):
            raise OfficeError("the file is encrypted")

    def part(self, name: str) -> ElementTree.Element | None:
        if name not in self.names:
            return None
        try:
            return ElementTree.fromstring(self.zip.read(name))
        except ElementTree.ParseError as e:
            raise OfficeError(f"{name}: {e}") from e

    def targets(self, name: str) -> dict[str, tuple[str, str]]:
        """Relationships of a part: id to (last word of the type, name of the target)."""
        folder, base = posixpath.split(name)
        rels = self.part(posixpath.join(folder, "_rels", base + ".rels"))
        out = {}
        for r in rels if rels is not None else ():
            if r.get("TargetMode") != "External":
                target = r.get("Target", "")
                target = target[1:] if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
                out[r.get("Id", "")] = (r.get("Type", "").rpartition("/")[2], target)
        return out

    def main(self) -> str:
        found = [target for kind, target in self.targets("").values() if kind == "officeDocument"]
        if not found or found[0] not in self.names:
            raise OfficeError("the main part is missing")
        return found[0]


def _run_text(paragraph: ElementTree.Element) -> str:
    """Runs of a paragraph in order. Deleted text and field codes are no text; a second way of drawing the same (Fallback) is left out."""
    out: list[str] = []

    def walk(node: ElementTree.Element) -> None:
        for x in node:
            tag = _tag(x)
            if tag == "t":
                out.append(x.text or "")
            elif tag == "tab":
                out.append("\t")
            elif tag in ("br", "cr"):
                out.append("\n")
            elif tag == "noBreakHyphen":
                out.append("‑")
            elif tag not in ("del", "moveFrom", "delText", "instrText", "Fallback", "pPr", "rPr", "p"):
                walk(x)
            elif tag == "p":  # a paragraph in a text box
                out.append("\n")
                walk(x)

    walk(paragraph)
    return "".join(out)


def _blocks(node: ElementTree.Element) -> Iterator[str]:
    """Paragraphs and table rows."""
    for x in node:
        tag = _tag(x)
        if tag == "p":
            yield _run_text(x)
        elif tag == "tr":
            yield "\t".join("\n".join(_blocks(cell)) for cell in x if _tag(cell) in ("tc", "sdt"))
        elif tag not in ("del", "moveFrom", "sectPr", "tblPr", "tblGrid", "tcPr", "trPr"):
            yield from _blocks(x)


def docx(package: Package) -> str:
    main = package.main()
    lines = list(_blocks(package.part(main)))
    notes = {kind: target for kind, target in package.targets(main).values() if kind in ("footnotes", "endnotes")}
    for kind in ("footnotes", "endnotes"):
        part = package.part(notes.get(kind, ""))
        for note in part if part is not None else ():
            if _attribute(note, "type") in (None, "normal"):
                lines += _blocks(note)
    return "\n".join(lines)


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if c.isalpha():
            n = 26 * n + ord(c.upper()) - 64
    return n


def xlsx(package: Package) -> str:
    main = package.main()
    book, targets = package.part(main), package.targets(main)
    shared_part = package.part(next((t for k, t in targets.values() if k == "sharedStrings"), ""))
    text = lambda node: "".join(t.text or "" for r in node for t in ([r] if _tag(r) == "t" else r if _tag(r) == "r" else ()) if _tag(t) == "t")
    shared = [text(si) for si in shared_part] if shared_part is not None else []
    lines: list[str] = []
    for sheet in (s for group in book if _tag(group) == "sheets" for s in group):
        part = package.part(targets.get(_attribute(sheet, "id") or "", ("", ""))[1])
        lines.append(sheet.get("name", ""))
        for row in (r for group in (part if part is not None else ()) if _tag(group) == "sheetData" for r in group):
            cells: list[str] = []
            for cell in row:
                kind, value = cell.get("t", "n"), next((v.text or "" for v in cell if _tag(v) == "v"), "")
                if kind == "s":
                    value = shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
                elif kind == "inlineStr":
                    value = "".join(text(v) for v in cell if _tag(v) == "is")
                elif kind == "b":
                    value = {"1": "TRUE", "0": "FALSE"}.get(value, value)
                place = _column(cell.get("r", ""))
                if 0 < place <= 16384:  # as many columns as a sheet can have
                    cells += [""] * (place - 1 - len(cells))
                cells.append(value)
            if any(cells):
                lines.append("\t".join(cells))
    return "\n".join(lines)


def pptx(package: Package) -> str:
    main = package.main()
    deck, targets = package.part(main), package.targets(main)
    lines: list[str] = []
    for entry in (s for group in deck if _tag(group) == "sldIdLst" for s in group):
        rel = next((v for k, v in entry.attrib.items() if k.endswith("}id")), "")  # its own id is without a namespace
        name = targets.get(rel, ("", ""))[1]
        notes = [t for k, t in package.targets(name).values() if k == "notesSlide"]
        for part in (package.part(name), *(package.part(t) for t in notes)):
            lines += _blocks(part) if part is not None else ()
    return "\n".join(x for x in lines if x)


def _open_text(node: ElementTree.Element) -> str:
    out = [node.text or ""]
    for x in node:
        tag = _tag(x)
        if tag == "s":
            out.append(" " * int(_attribute(x, "c", "1") or 1))
        elif tag == "tab":
            out.append("\t")
        elif tag == "line-break":
            out.append("\n")
        elif tag == "note":
            out.append(" (" + " ".join(_open_blocks(next((b for b in x if _tag(b) == "note-body"), x))) + ")")
        elif tag not in ("annotation", "tracked-changes"):
            out.append(_open_text(x))
        out.append(x.tail or "")
    return "".join(out)


def _open_blocks(node: ElementTree.Element) -> Iterator[str]:
    for x in node:
        tag = _tag(x)
        if tag in ("p", "h"):
            yield _open_text(x)
        elif tag == "table-row":
            row = ["\n".join(_open_blocks(cell)) for cell in x if _tag(cell) in ("table-cell", "covered-table-cell") for _ in range(_repeated(cell))]
            if any(row):  # empty rows and cells fill a sheet up to its limits
                yield from ["\t".join(row).rstrip("\t")] * _repeated(x, "rows")
        elif tag not in ("tracked-changes", "annotation", "forms"):
            yield from _open_blocks(x)


def _repeated(node: ElementTree.Element, what: str = "columns") -> int:
    return max(1, int(_attribute(node, f"number-{what}-repeated", "1") or 1))


def open_document(package: Package) -> str:
    content = package.part("content.xml")
    if content is None:
        raise OfficeError("content.xml is missing")
    return "\n".join(_open_blocks(next((b for b in content if _tag(b) == "body"), content)))


READERS: dict[str, Callable[[Package], str]] = {DOCX: docx, XLSX: xlsx, PPTX: pptx, ODT: open_document, ODS: open_document, ODP: open_document}


def read(kind: str, data: bytes) -> str:
    """The text of an office file of MIME type ``kind``."""
    return READERS[kind](Package(data)).strip()
