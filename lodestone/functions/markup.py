"""Headings and paragraphs of HTML, with their whole texts."""

from __future__ import annotations

import html
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags that end an open paragraph, whether they start or end.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
TAKEN = frozenset("h1 h2 h3 h4 h5 h6 p".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|title|textarea|noscript|iframe)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-z][^\s/>]*)(?:\"[^\"]*\"|'[^']*'|[^>])*+(?:>|\Z)", re.S | re.I)


def elements(page: str | None) -> list[tuple[str, str]]:
    """(tag, text) of each h1 to h6 and p with text, in order: inline markup is gone, references are decoded.

    A paragraph ends at its end tag or at any block's tag, a heading at a heading's end tag or where one of these elements begins.
    """
    page = page or ""
    found, parts, tag, at = [], [], "", 0

    def end() -> None:
        if tag and (text := html.unescape("".join(parts))).strip():
            found.append((tag, text))

    for m in _TOKEN.finditer(page):
        parts.append(page[at : m.start()])
        at = m.end()
        name, closes = (m[3] or "").lower(), bool(m[2])
        if name in TAKEN and not closes or (tag == "p" and name in BLOCK) or (tag and closes and name in TAKEN and name != "p"):
            end()
            tag, parts = ("" if closes or name not in TAKEN else name), []
        elif name in BLOCK or name == "br":
            parts.append(" ")
    parts.append(page[at:])
    end()
    return found


def html_elements(page: Column) -> Column:
    """Array of (tag, text) of a page."""
    return F.udf(elements, "array<struct<tag:string,text:string>>", useArrow=True)(page)
