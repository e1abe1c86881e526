"""Snippets: the window of tokens, over all columns, that shows most of a query.

A window's score is 1000 for each phrase that begins in it, 1 for each further time, and 100 if it begins a sentence (120 at the text's
beginning). Candidates are the windows at each hit, moved so that its hits stand in the middle, and those at the sentence's beginning
before it. Whole phrases are marked; overlapping ones are one mark.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sparkveil.operators.search import MARKED, PLAIN, folded_text, phrases

_MARKS = MARKED[len(PLAIN) :]
_TOKEN = re.compile(rf"[^\W_](?:[^\W_]|[{re.escape(_MARKS)}])*")
FIRST, AGAIN, SENTENCE, BEGINNING = 1000, 1, 100, 120


class _Column:
    def __init__(self, text: str | None, wanted: list[list[str]]):
        self.text = text or ""
        self.spans = [m.span() for m in _TOKEN.finditer(self.text)]
        words = [folded_text(self.text[a:b]) for a, b in self.spans]
        hits = [(i, p) for p, phrase in enumerate(wanted) for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]
        self.hits = [(i, p, len(wanted[p])) for i, p in sorted(hits)]
        self.sentences = [i for i, (a, _) in enumerate(self.spans) if i == 0 or self._follows_stop(a)]

    def _follows_stop(self, at: int) -> bool:
        before = self.text[:at].rstrip(" \t\n\r") if at and self.text[at - 1] in " \t\n\r" else ""
        return before.endswith((".", ":"))

    def score(self, at: int, width: int) -> tuple[int, int]:
        """A window's score, and where it begins if its hits stand in the middle."""
        inside = [h for h in self.hits if at <= h[0] < at + width]
        kinds = len({p for _, p, _ in inside})
        points = FIRST * kinds + AGAIN * (len(inside) - kinds)
        if not inside:
            return points, at
        first, end = inside[0][0], inside[-1][0] + inside[-1][2]
        room = width - (end - first)
        begin = first - (room // 2 if room >= 0 else -(-room // 2))  # halves are cut towards zero
        return points, max(0, min(begin, len(self.spans) - width))

    def best(self, width: int) -> tuple[int, int]:
        """(score, first token) of the best window; of equal ones the first that is tried."""
        found = (0, 0)
        for i, _, _ in self.hits:
            points, begin = self.score(i, width)
            if points > found[0]:
                found = (points, begin)
            start = max((s for s in self.sentences if s <= i), default=None)
            if start is not None and start < i and len(self.spans) > width:
                points = self.score(start, width)[0] + (BEGINNING if start == 0 else SENTENCE)
                if points > found[0]:
                    found = (points, start)
        return found

    def shown(self, begin: int, width: int, opening: str, closing: str, dots: str) -> str:
        last = begin + width - 1
        rest = last >= len(self.spans) - 1
        at = self.spans[begin][0] if begin else 0
        end = len(self.text) if rest else self.spans[last][1]
        marks: list[list[int]] = []
        for i, _, n in self.hits:
            if marks and i <= marks[-1][1]:
                marks[-1][1] = max(marks[-1][1], i + n - 1)
            else:
                marks.append([i, i + n - 1])
        out = [] if begin == 0 else [dots]
        for a, b in marks:
            a, b = max(a, begin), min(b, last)
            if a <= b:
                left, right = self.spans[a][0], self.spans[b][1]
                out += [self.text[at:left], opening, self.text[left:right], closing]
                at = right
        return "".join([*out, self.text[at:end], "" if rest else dots])


def snippet_of(texts: list[str | None], wanted: list[list[str]], width: int = 12, opening: str = "<mark>", closing: str = "</mark>", dots: str = "…") -> str:
    """The best window of the columns ``texts``; the first column's beginning if there is no hit."""
    columns = [_Column(t, wanted) for t in texts]
    best = max(range(len(columns)), key=lambda i: (columns[i].best(width)[0], -i))
    return columns[best].shown(columns[best].best(width)[1], width, opening, closing, dots)


def snippet(query: str, width: int = 12) -> Callable[..., Column]:
    """A function of text columns, in order. It works on rows that are found, a page of them as a rule."""
    wanted = phrases(query)

    @F.pandas_udf(StringType())
    def made(*columns: pd.Series) -> pd.Series:
        return pd.Series([snippet_of(list(row), wanted, width) for row in zip(*columns, strict=True)], dtype=object)

    return lambda *columns: made(*columns)
