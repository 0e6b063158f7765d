"""Text of HTML."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quern.functions.text import col

BREAKS = {"p", "br", "div", "tr", "h1", "h2", "h3", "h4", "ul", "ol"}


# The portal's internal and public routes to files.
INTERNAL, PUBLIC = ":8081/api/files/", "/CRMPublicPortalApi/api/files/"


def fix_links(text: Column | str, internal: str = INTERNAL, public: str = PUBLIC) -> Column:
    """Links through the internal port become the public route."""
    return F.regexp_replace(col(text), rf"(?i)(https?://[^\s/:]+){re.escape(internal)}", f"$1{public}")


class _Reader(HTMLParser):
    """Links as text (address), list items as dashes, a line break after each block."""

    def __init__(self, keep_links: bool):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.links: list[tuple[str, int]] = []
        self.keep = keep_links

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.links.append(((dict(attrs).get("href") or "").strip(), len(self.out)))
        elif tag == "li":
            self.out.append("\n- ")
        elif tag == "br":
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag == "a" and self.links:
            href, at = self.links.pop()
            text = re.sub(r"\s+", " ", " ".join(self.out[at:])).strip()
            shown = (f"{text} ({href})" if text else href) if self.keep and href and href not in text else text
            self.out[at:] = [shown]
        elif tag in BREAKS and tag != "br":
            self.out.append("\n")

    def handle_data(self, data):
        self.out.append(data)


def read_html(value: str | None, keep_links: bool = True) -> str:
    if value is None:
        return ""
    reader = _Reader(keep_links)
    reader.feed(value)
    reader.close()
    text = re.sub("[ \t ]+", " ", "".join(reader.out))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(line.strip() for line in text.splitlines())).strip()


@F.pandas_udf(StringType())
def html_to_text(value: pd.Series) -> pd.Series:
    """Parsed text of pages, links kept; apply fix_links to the result."""
    return value.map(read_html)


def plain_html(value: Column | str) -> Column:
    """Built-in functions only: scripts and styles go, blocks break lines, tags vanish; entities stay."""
    t = F.regexp_replace(F.coalesce(col(value), F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?i)<li[^>]*>", "\n- ")
    t = F.regexp_replace(t, r"(?i)<br[^>]*>|</(p|div|tr|h1|h2|h3|h4|ul|ol)>", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"<[^>]*>", ""), "[ \t ]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r" ?\n ?", "\n"), r"\n{3,}", "\n\n")
    return F.trim(F.regexp_replace(t, r"^\n+|\n+$", ""))


def links(value: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(col(value), F.lit("")), F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))


def infobox_value(value: Column | str, label: str) -> Column:
    """The cell beside a label in a page's table, empty if it is missing."""
    cell = F.regexp_extract(col(value), rf"(?is)<t[hd][^>]*>\s*{re.escape(label)}\s*:?\s*</t[hd]>\s*<td[^>]*>(.*?)</td>", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(cell, r"<[^>]*>", " "), r"\s+", " "))
