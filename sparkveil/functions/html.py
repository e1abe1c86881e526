"""HTML by the standard library's parser, in Arrow batches: a sanitiser with an allow-list, and the text of a page."""

from __future__ import annotations

import html as _html
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Elements that go with their content; elements, attributes and schemes that may stay; elements without content.
REMOVED = frozenset("script style link iframe object embed video audio source track meta base img picture svg canvas form input button select textarea".split())
ALLOWED = frozenset("a abbr b blockquote br code div em h1 h2 h3 h4 h5 h6 hr i li ol p pre span strong sub sup table tbody td th thead tr u ul".split())
ATTRIBUTES = {"a": ("href", "title"), "abbr": ("title",)}
SCHEMES = frozenset(("http", "https", "mailto"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def _scheme_allowed(url: str) -> bool:
    found = re.match(r"\s*([A-Za-z][A-Za-z0-9+.-]*)\s*:", re.sub(r"[\x00-\x20]+", "", url))
    return found is None or found[1].lower() in SCHEMES


class _Sanitizer(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.open, self.hidden = [], [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in REMOVED:
            if tag not in VOID:
                self.hidden.append(tag)
            return
        if self.hidden or tag not in ALLOWED:
            return
        kept = [(k, v or "") for k, v in attrs if k in ATTRIBUTES.get(tag, ()) and (k != "href" or _scheme_allowed(v or ""))]
        self.out.append("<" + tag + "".join(f' {k}="{_html.escape(v)}"' for k, v in kept) + ">")
        if tag not in VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass
        elif not self.hidden and tag in self.open:
            while (last := self.open.pop()) != tag:
                self.out.append(f"</{last}>")
            self.out.append(f"</{tag}>")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(_html.escape(data, quote=False))


def sanitized(text: str | None) -> str | None:
    if not text:
        return text
    parser = _Sanitizer()
    parser.feed(text)
    parser.close()
    done = "".join(parser.out + [f"</{t}>" for t in reversed(parser.open)])
    return re.sub(r"url\s*\(", "url-removed(", done, flags=re.IGNORECASE)


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data: str) -> None:
        if not self.hidden and data.strip():
            self.parts.append(data.strip())


def text_of(text: str | None) -> str:
    parser = _Text()
    parser.feed(text or "")
    parser.close()
    return " ".join(parser.parts)


#: Characters of markup whose results a task holds at a time (a longer page alone).
_HELD = 1 << 22


def pieces(batches: Iterator[pa.Array], f: Callable[[str | None], object]) -> Iterator[list]:
    """f of each value, a few pages at a time: a batch's values and results are never Python objects all at once."""
    for batch in batches:
        out, held = [], 0
        for x in batch:
            text = x.as_py()
            out.append(f(text))
            held += len(text or "")
            if held >= _HELD:
                yield out
                out, held = [], 0
        if out:
            yield out


@F.arrow_udf(StringType())  # a type as text would need a session, which workers lack
def sanitize_html(x: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for out in pieces(x, sanitized):
        yield pa.array(out, pa.string())


@F.arrow_udf(StringType())  # a type as text would need a session, which workers lack
def html_to_text(x: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for out in pieces(x, lambda t: None if t is None else text_of(t)):
        yield pa.array(out, pa.string())
