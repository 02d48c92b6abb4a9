"""Ordered scans of HTML pages, in Arrow workers: the text of a fragment, and the fields of a guest job page."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from jobloom.schemas import struct

# Elements that begin and end lines, and elements whose content is no text.
BLOCKS = frozenset("p div section article ul ol li br tr td th table h1 h2 h3 h4 h5 h6 blockquote pre".split())
DROPPED = frozenset("script style noscript template svg head".split())
# Class names of a guest job page: its fields, its text, and the pairs of its criteria.
ANCHORS = {"topcard__title": "title", "topcard__org-name-link": "company", "topcard__flavor--bullet": "location", "posted-time-ago__text": "posted_at"}
BODY = "show-more-less-html__markup"
LABEL, VALUE = "description__job-criteria-subheader", "description__job-criteria-text"
_TAG = re.compile(r"""<(?P<end>/?)(?P<name>[a-z][a-z0-9]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^>"'])*?)(?P<closed>/?)>""", re.I)
_CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)')""")


def tidy(text: str) -> str:
    """Lines without blanks at their ends, blank lines one at a time and none at the ends."""
    lines = "\n".join(x.strip() for x in text.splitlines())
    return re.sub("\n{3,}", "\n\n", lines).strip()


class _Text(HTMLParser):
    """A fragment's text with block lines and bullets."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.dropped, self.bullet = 0, False

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.dropped += 1
        elif tag in BLOCKS and not self.dropped:
            self.out.append("\n- " if tag == "li" else "\n")
            self.bullet |= tag == "li"

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS and not self.dropped:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.dropped = max(0, self.dropped - 1)
        elif tag in BLOCKS and not self.dropped:
            self.out.append("\n")
            self.bullet &= tag != "li"

    def handle_data(self, data):
        if not self.dropped:
            self.out.append(data.lstrip() if self.bullet else data)
            self.bullet = False


class _Fields(HTMLParser):
    """Texts of the elements that carry wanted classes.

    An element ends where fewer are open than when it began. Every tag that begins
    opens one, void ones as well, so text behind a line break inside a field reaches
    to the end of what holds the field.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.fields, self.pairs = 0, {}, {LABEL: [], VALUE: []}
        self.open: list[tuple[str, int, list[str]]] = []
        self.criterion: tuple[str, int, list[str]] | None = None

    def handle_starttag(self, tag, attrs):
        self.depth += 1
        names = (dict(reversed(attrs)).get("class") or "").split()
        self.open += [(field, self.depth, []) for a, field in ANCHORS.items() if a in names and field not in self.fields]
        kind = next((k for k in (LABEL, VALUE) if k in names), None)
        if kind:
            self.criterion = (kind, self.depth, [])

    def handle_endtag(self, tag):
        self.depth = max(0, self.depth - 1)
        ended = [x for x in self.open if x[1] > self.depth]
        self.open = [x for x in self.open if x[1] <= self.depth]
        for field, _, data in ended:
            if text := _flat(data):
                self.fields.setdefault(field, text)
        if self.criterion and self.criterion[1] > self.depth:
            if text := _flat(self.criterion[2]):
                self.pairs[self.criterion[0]].append(text)
            self.criterion = None

    def handle_data(self, data):
        for x in (*self.open, *([self.criterion] if self.criterion else [])):
            x[2].append(data)


def _flat(data: list[str]) -> str:
    return " ".join("".join(data).split())


def html_text(html: str | None) -> str:
    scan = _Text()
    scan.feed(html or "")
    scan.close()
    return tidy("".join(scan.out))


def body_html(html: str) -> str | None:
    """What is inside the first div of the text's class, other divs inside it counted; null if there is none or it does not end."""
    depth, start = 0, None
    for tag in _TAG.finditer(html):
        if tag["name"].lower() != "div" or tag["closed"]:
            continue
        if start is None:
            names = _CLASS.search(tag["attrs"])
            if not tag["end"] and names and BODY in (names[1] or names[2] or "").split():
                depth, start = 1, tag.end()
            continue
        depth += -1 if tag["end"] else 1
        if not depth:
            return html[start : tag.start()]
    return None


def job_page(html: str | None) -> dict:
    """title, company, location, posted_at, description, criteria (the employment type) and error of a guest job page.

    The first element of a field that has text counts. A page without the advert's
    text is an error and has no fields.
    """
    html = html or ""
    none = dict.fromkeys((*ANCHORS.values(), "description", "criteria"))
    if not html.strip():
        return none | {"error": "empty page"}
    body = body_html(html)
    if body is None:
        return none | {"error": "no advert in the page"}
    description = html_text(body)
    if not description:
        return none | {"error": "empty advert"}
    scan = _Fields()
    scan.feed(html)
    scan.close()
    criteria = dict(zip(scan.pairs[LABEL], scan.pairs[VALUE], strict=False))
    return none | scan.fields | {"description": description, "criteria": criteria.get("Employment type"), "error": None}


@F.pandas_udf(StringType())
def html_text_udf(html: pd.Series) -> pd.Series:
    return html.map(html_text)


_PAGE = "title company location posted_at description criteria error".split()


@F.pandas_udf(struct(", ".join(f"{c} string" for c in _PAGE)))
def job_page_udf(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([job_page(x) for x in html], columns=_PAGE)
