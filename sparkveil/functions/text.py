"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(x: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(F.regexp_replace(x, r"^\s+", ""), r"\s+$", "")


def canonical_email(x: Column) -> Column:
    return F.lower(stripped(x))


def canonical_name(x: Column) -> Column:
    y = F.btrim(F.regexp_replace(stripped(x), r"\s+", " "), F.lit(" .,\"'"))
    return F.when(y != "", y)


def domain(email: Column) -> Column:
    return F.when(email.contains("@"), F.substring_index(email, "@", -1))


def is_internal(email: Column, domains: tuple[str, ...]) -> Column:
    """Does the last domain equal, or lie below, one of ``domains``."""
    d, out = F.lower(domain(email)), F.lit(False)
    for x in domains:
        out = out | (d == x) | d.endswith("." + x)
    return F.coalesce(out, F.lit(False))


def contains_fold(x: Column, needle: str) -> Column:
    return F.lower(x).contains(needle.lower())


def starts_fold(x: Column, prefix: str) -> Column:
    return F.lower(x).startswith(prefix.lower())


def safe_filename(x: Column) -> Column:
    return F.substring(F.btrim(F.regexp_replace(x, r"[^A-Za-z0-9._-]", "_"), F.lit("._")), 1, 180)


def bates(number: Column, prefix: str, width: int) -> Column:
    return F.concat(F.lit(prefix + "-"), F.format_string(f"%0{width}d", number))


def clamped(x: Column, default: float = 0.5) -> Column:
    """A number in [0, 1]; what is none becomes ``default``."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x.try_cast("double"), F.lit(default))))


def plain_text(html: Column) -> Column:
    """Text of HTML by regular expressions: script and style go with their content, tags and comments become blanks."""
    x = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", " ")
    x = F.regexp_replace(x, r"(?is)<style[^>]*>.*?</style>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.btrim(F.regexp_replace(x, r"[ \t\n\r]+", " "))


def json_block(x: Column) -> Column:
    """From the first brace to the last."""
    y = F.regexp_extract(x, r"(?s)\{.*\}", 0)
    return F.when(y != "", y)


def truncated(x: Column, n: int, marker: str = " [truncated]") -> Column:
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit(marker))).otherwise(x)
