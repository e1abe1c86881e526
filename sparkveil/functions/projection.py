"""The text of HTML together with where each of its characters stands in the markup.

The text is what ``html_to_text`` gives: text nodes without script and style, stripped, empty ones dropped, joined by one space. A run
says that code points [text_start, text_end) of the text come from [mark_start, mark_end) of the markup. Runs of equal length are copied
one for one; others are character references, which belong together. The blanks that join nodes come from nowhere.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from sparkveil.functions.html import pieces

_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
Run = tuple[int, int, int, int]
RUN_FIELDS = ("text_start", "text_end", "mark_start", "mark_end")


class _Nodes(HTMLParser):
    """Text nodes and where they begin in the markup."""

    def __init__(self, markup: str) -> None:
        super().__init__(convert_charrefs=True)
        self.line_starts = [0, *(m.end() for m in re.finditer("\n", markup))]
        self.nodes: list[tuple[str, int]] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data: str) -> None:
        if not self.hidden and data.strip():
            line, column = self.getpos()
            self.nodes.append((data, self.line_starts[line - 1] + column))


def _aligned(data: str, markup: str, at: int) -> list[Run]:
    """Runs of one text node, whose markup begins at ``at``."""
    runs: list[Run] = []
    done, place = 0, at
    while done < len(data) and place < len(markup):
        found = _REFERENCE.match(markup, place) if markup[place] == "&" else None
        meant = html.unescape(found[0]) if found else None
        if found and meant != found[0]:
            if meant:
                runs.append((done, done + len(meant), place, found.end()))
            done, place = done + len(meant), found.end()
            continue
        ahead = markup.find("&", place + 1)
        size = min((ahead if ahead >= 0 else len(markup)) - place, len(data) - done)
        if runs and runs[-1][1] - runs[-1][0] == runs[-1][3] - runs[-1][2] and (runs[-1][1], runs[-1][3]) == (done, place):
            runs[-1] = (runs[-1][0], done + size, runs[-1][2], place + size)
        else:
            runs.append((done, done + size, place, place + size))
        done, place = done + size, place + size
    sound = done == len(data) and all(b - a != d - c or data[a:b] == markup[c:d] for a, b, c, d in runs)
    return runs if sound else [(0, len(data), at, min(len(markup), at + len(data)))]


def projected(markup: str | None) -> tuple[str, list[Run]]:
    """The text of ``markup`` and its runs, in order."""
    markup = markup or ""
    parser = _Nodes(markup)
    parser.feed(markup)
    parser.close()
    parts, runs, size = [], [], 0
    for data, at in parser.nodes:
        kept = data.strip()
        lead = len(data) - len(data.lstrip())
        size += bool(parts)
        for a, b, c, d in _aligned(data, markup, at):
            first, last = max(a, lead), min(b, lead + len(kept))
            if first < last:
                exact = b - a == d - c
                runs.append((size + first - lead, size + last - lead, c + (first - a) * exact, d - (b - last) * exact))
        parts.append(kept)
        size += len(kept)
    return " ".join(parts), runs


_INTS = ArrayType(IntegerType())
_FLAT = StructType([StructField("text", StringType()), *(StructField(f, _INTS) for f in RUN_FIELDS)])


def _packed(markup: str | None) -> tuple[str, np.ndarray]:
    text, runs = projected(markup)
    return text, np.array(runs, np.int32).reshape(-1, len(RUN_FIELDS))


@F.arrow_udf(_FLAT)
def _projection(markup: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for rows in pieces(markup, _packed):
        ends = pa.array(np.cumsum([0, *(len(runs) for _, runs in rows)]), pa.int32())
        runs = np.concatenate([runs for _, runs in rows])
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(runs[:, i]))) for i in range(len(RUN_FIELDS))]
        yield pa.StructArray.from_arrays([pa.array([t for t, _ in rows], pa.string()), *lists], ["text", *RUN_FIELDS])


def projection(markup: Column) -> Column:
    """A struct of ``text`` and its runs as four arrays; ``runs_of`` zips them."""
    return _projection(markup)


def runs_of(x: Column) -> Column:
    """array<struct<text_start, text_end, mark_start, mark_end>> of a ``projection``."""
    return F.arrays_zip(*(x[f].alias(f) for f in RUN_FIELDS))
