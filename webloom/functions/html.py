"""One pass over the HTML of a page.

Spark has no HTML parser, so this is the one place where a page goes through Python: Arrow
batches in, a struct of the fields that later expressions need out. Everything after the fields
(titles, links, permissions, terms) is built-in column work.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ALL_FIELDS = {
    "title": T.StringType(),
    "og_title": T.StringType(),
    "twitter_title": T.StringType(),
    "heading": T.StringType(),
    "body_text": T.StringType(),
    "hrefs": T.ArrayType(T.StringType()),
    "meta_robots": T.ArrayType(T.StringType()),
}

# HTML elements without content, and elements whose text is not page text.
_VOID = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta "
    "nextid param source spacer track wbr".split()
)
_NOT_TEXT = frozenset(["script", "style", "template", "rt", "rp"])
_VERBATIM = frozenset(["pre", "textarea"])
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")

# Names of marked sections with the end of each kind.
_SECTION_NAME = re.compile(r"<!\[\s*([a-zA-Z]*)")
_SECTION_END = dict.fromkeys(("temp", "cdata", "ignore", "include", "rcdata"), re.compile(r"]\s*]\s*>"))
_SECTION_END |= dict.fromkeys(("if", "else", "endif"), re.compile(r"]\s*>"))
_COMMENT_END = re.compile(r"--\s*>")


class _Page(HTMLParser):
    """Collects the fields while tags open and close.

    An end tag closes the nearest open tag of its name with everything inside; one without an
    open tag is ignored. The first title, heading of each level and body collect their own text.

    No markup can fail, and none is searched for twice: what follows the last ``>`` cannot be a tag,
    and once an end mark is not found, no later construct of its kind looks for it.
    """

    def __init__(self, with_text: bool):
        super().__init__(convert_charrefs=True)
        self.texts: dict[str, list[str]] = {}
        self.meta: dict[str, str] = {}
        self.hrefs: list[str] = []
        self.meta_robots: list[str] = []
        self._wanted = frozenset(("title", "body") + _HEADINGS) if with_text else frozenset()
        self._stack: list[str] = []
        self._open: Counter[str] = Counter()
        self._collecting: dict[str, int] = {}
        self._node: list[str] = []
        self._missing: set[re.Pattern] = set()

    def read(self, html: str) -> None:
        """Parse a whole page."""
        end = html.rfind(">") + 1
        self.feed(html[:end])
        super().close()
        if not self.cdata_elem:
            for text in re.split("(?=<)", html[end:]):
                self.handle_data(unescape(text))
        self._end_text_node()

    def _end_of(self, mark: re.Pattern, start: int) -> re.Match | None:
        found = None if mark in self._missing else mark.search(self.rawdata, start)
        if found is None:
            self._missing.add(mark)
        return found

    def parse_comment(self, i, report=1):
        end = self._end_of(_COMMENT_END, i + 4)
        if end is None:
            return -1
        self.handle_comment(self.rawdata[i + 4 : end.start()])
        return end.end()

    def parse_marked_section(self, i, report=1):
        """A section of an unknown name is a comment up to the next ``>``."""
        name = _SECTION_NAME.match(self.rawdata, i)[1].lower()
        if name not in _SECTION_END:
            return self.parse_bogus_comment(i)
        end = self._end_of(_SECTION_END[name], i + 3)
        if end is None:
            return -1
        self.unknown_decl(self.rawdata[i + 3 : end.start()])
        return end.end()

    def handle_starttag(self, tag, attrs):
        self._end_text_node()
        if tag == "a":
            self.hrefs.extend(list({k: v or "" for k, v in attrs if k == "href"}.values()))
        elif tag == "meta":
            self._read_meta({k: v or "" for k, v in attrs})
        if tag in _VOID:
            return
        self._stack.append(tag)
        self._open[tag] += 1
        if tag in self._wanted and tag not in self.texts:
            self.texts[tag] = []
            self._collecting[tag] = len(self._stack)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._end_text_node()
        if not self._open[tag]:
            return
        while True:
            closed = self._stack.pop()
            self._open[closed] -= 1
            if self._collecting and self._collecting.get(closed, 0) > len(self._stack):
                del self._collecting[closed]
            if closed == tag:
                break

    def handle_data(self, data):
        self._node.append(data)

    def handle_comment(self, data):
        self._end_text_node()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def _end_text_node(self):
        if not self._node:
            return
        text, self._node = "".join(self._node), []
        if not self._collecting or any(self._open[t] for t in _NOT_TEXT):
            return
        verbatim = any(self._open[t] for t in _VERBATIM)
        for field in self._collecting:
            so_far = self.texts[field]
            if verbatim:
                so_far.append(text)
            elif text.strip():
                so_far.append(f" {text.strip()}" if so_far else text.strip())

    def _read_meta(self, attrs):
        if attrs.get("name") == "robots" and "content" in attrs:
            self.meta_robots.append(attrs["content"])
        if attrs.get("property") == "og:title":
            self.meta.setdefault("og_title", attrs.get("content", ""))
        if attrs.get("name") == "twitter:title":
            self.meta.setdefault("twitter_title", attrs.get("content", ""))

    def text(self, tag):
        return "".join(self.texts[tag]).strip() if tag in self.texts else None

    def fields(self) -> dict:
        return {
            "title": self.text("title"),
            "og_title": self.meta.get("og_title"),
            "twitter_title": self.meta.get("twitter_title"),
            "heading": next((self.text(h) for h in _HEADINGS if h in self.texts), None),
            "body_text": self.text("body"),
            "hrefs": self.hrefs,
            "meta_robots": self.meta_robots,
        }


def parse_page(html: str, with_text: bool = True) -> dict:
    page = _Page(with_text)
    page.read(html)
    return page.fields()


def html_fields(html: Column, *fields: str) -> Column:
    """Struct of the named fields of each page, all of them by default.

    ``title``, ``body_text`` and ``heading`` (first existing level) are NULL where the element is
    missing; text nodes are set apart by spaces. ``hrefs`` and ``meta_robots`` are in document order.
    """
    names = list(fields) or list(_ALL_FIELDS)
    schema = T.StructType([T.StructField(n, _ALL_FIELDS[n]) for n in names])
    arrow = {T.StringType(): pa.string(), T.ArrayType(T.StringType()): pa.list_(pa.string())}
    arrow_type = pa.struct([(n, arrow[_ALL_FIELDS[n]]) for n in names])
    with_text = bool({"title", "body_text", "heading"} & set(names))

    @F.arrow_udf(schema)
    def extract(pages: pa.Array) -> pa.Array:
        parsed = (parse_page(html or "", with_text) for html in pages.to_pylist())
        return pa.array([{n: page[n] for n in names} for page in parsed], arrow_type)

    return extract(html)
