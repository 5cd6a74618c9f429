"""Small HTML helpers for one page: text lines and elements by selector (stdlib parser only)."""

import re
from bisect import bisect_left
from collections import defaultdict
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from itertools import islice

# Elements without an end tag, and elements whose text is not page text.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_SILENT = {"script", "style", "template", "rt", "rp"}
_SIMPLE = re.compile(r"^([\w-]+|\*)?((?:[.#][\w-]+)*)$")
# Text and the tag behind it, if that is an end tag or has only attributes in double quotes.
_ATTRIBUTES = r"""(?:[ \t\n\r\f]++[^\s/>='"]++="[^"]*+")*+"""
_PLAIN = re.compile(rf"([^<]*+)<(?:([a-zA-Z][^\t\n\r\f />\x00]*+)({_ATTRIBUTES})[ \t\n\r\f]*+(/?)|/([a-zA-Z][-.a-zA-Z0-9:_]*+))>")
_ATTRIBUTE = re.compile(r"""([^\s/>='"]++)="([^"]*+)\"""")
_NONE = frozenset()


class Element:
    """A tag with its place in the page and the ranges of text nodes and elements inside it."""

    __slots__ = ("tag", "attrs", "parent", "first", "end", "at", "last", "classes")

    def __init__(self, tag, attrs, parent, first, at):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.first = self.end = first
        self.at, self.last = at, at + 1
        self.classes = frozenset(attrs["class"].split()) if "class" in attrs else _NONE


class Page(HTMLParser):
    """Elements and text nodes of one page, both in document order."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.texts = []  # (text, the silent element it belongs to or None)
        self.root = Element("", {}, None, 0, -1)
        self.elements, self._open, self._pending = [], [self.root], []
        self._places = defaultdict(list)  # places of the elements of a tag, a class or an id, ascending
        self.feed(html or "")
        self.close()
        self._end_text()
        self._close_down_to(0)

    def _end_text(self):
        """A tag or comment ends the current text node."""
        text = "".join(self._pending).strip()
        self._pending = []
        if text:
            inner = self._open[-1]
            self.texts.append((text, inner if inner.tag in _SILENT else None))

    def _close_down_to(self, depth):
        for element in self._open[depth:]:
            element.end, element.last = len(self.texts), len(self.elements)
        del self._open[depth:]

    def _add(self, tag, attrs):
        if self._pending:
            self._end_text()
        at = len(self.elements)
        element = Element(tag, {k: v or "" for k, v in attrs} if attrs else {}, self._open[-1], len(self.texts), at)
        self.elements.append(element)
        self._places["tag", tag].append(at)
        if attrs:
            for mark in (("id", element.attrs.get("id", "")), *(("class", c) for c in element.classes)):
                self._places[mark].append(at)
        return element

    def parse_starttag(self, i):
        """Reads on as long as plain tags follow; any other tag goes the general way, with the same result."""
        data = self.rawdata
        token = _PLAIN.match(data, i)
        if token is None:
            return super().parse_starttag(i)
        while token is not None:
            text, start, attrs, empty, end = token.groups()
            i = token.end()
            if text:
                self.handle_data(unescape(text))
            if end:
                self.handle_endtag(end.lower())
            else:
                tag = start.lower()
                pairs = [(k.lower(), unescape(v)) for k, v in _ATTRIBUTE.findall(attrs)] if attrs else []
                if empty:
                    self.handle_startendtag(tag, pairs)
                else:
                    self.handle_starttag(tag, pairs)
                    if tag in self.CDATA_CONTENT_ELEMENTS:
                        self.set_cdata_mode(tag)
                        break
            token = _PLAIN.match(data, i)
        return i

    def updatepos(self, i, j):
        """Lines are not counted."""
        return j

    def handle_data(self, data):
        self._pending.append(data)

    def handle_starttag(self, tag, attrs):
        element = self._add(tag, attrs)
        if tag not in _VOID:
            self._open.append(element)

    def handle_startendtag(self, tag, attrs):
        self._add(tag, attrs)

    def handle_endtag(self, tag):
        if self._pending:
            self._end_text()
        for depth in range(len(self._open) - 1, 0, -1):
            if self._open[depth].tag == tag:
                return self._close_down_to(depth)

    def handle_comment(self, data):
        self._end_text()

    def handle_decl(self, decl):
        self._end_text()

    def texts_of(self, element):
        return [t for t, silent in self.texts[element.first : element.end] if silent is None or silent is element]

    def lines(self):
        """Trimmed non-blank text lines of the page."""
        parts = (line.strip() for text in self.texts_of(self.root) for line in text.split("\n"))
        return [p for p in parts if p]

    def select(self, selector, inside=None):
        """Elements matching ``tag``, ``.class``, ``#id`` or a blank-separated descent of those, in order.

        Only the elements below ``inside`` that share a mark with the last step are looked at.
        """
        steps = _steps(selector)
        low, high = (0, len(self.elements)) if inside is None else (inside.at + 1, inside.last)
        tag, classes, ids = steps[-1]
        marks = [("id", i) for i in ids] + [("class", c) for c in classes] + ([("tag", tag)] if tag else [])
        places = range(low, high)
        if marks:
            of_mark = min((self._places.get(m, []) for m in marks), key=len)
            places = islice(of_mark, bisect_left(of_mark, low), bisect_left(of_mark, high))
        return (self.elements[i] for i in places if _matches(self.elements[i], steps))


def _simple(selector):
    found = _SIMPLE.match(selector)
    if not found or not selector:
        raise ValueError(f"selector {selector!r}: only tag, .class, #id and descent are known")
    tag, rest = found.group(1), found.group(2)
    marks = re.findall(r"([.#])([\w-]+)", rest)
    return (
        tag.lower() if tag and tag != "*" else None,
        {v for k, v in marks if k == "."},
        {v for k, v in marks if k == "#"},
    )


@lru_cache(maxsize=256)
def _steps(selector):
    return [_simple(s) for s in selector.split()]


def _fits(element, step):
    tag, classes, ids = step
    return (tag is None or element.tag == tag) and classes <= element.classes and ids <= {element.attrs.get("id", "")}


def _matches(element, steps):
    if not _fits(element, steps[-1]):
        return False
    wanted, node = len(steps) - 2, element.parent
    while wanted >= 0 and node is not None:
        wanted -= _fits(node, steps[wanted])
        node = node.parent
    return wanted < 0


def value_of(page, element, attr="text"):
    """Text or attribute of an element; '' for a missing element or attribute."""
    if element is None:
        return ""
    return "".join(page.texts_of(element)) if attr == "text" else element.attrs.get(attr, "")


def text_lines(html):
    return Page(html).lines()


def extract(html, rules):
    """Rows of rule values: per container when the first rule names one, else aligned by position."""
    page = Page(html)
    container = rules[0].get("container", "")
    if container:
        rows = []
        for box in page.select(container):
            row = []
            for rule in rules:
                selector = rule.get("selector", "")
                found = next(page.select(selector, box), None) if selector else box
                row.append(value_of(page, found, rule.get("attr", "text")))
            rows.append(row)
    else:
        columns = [
            [value_of(page, e, r.get("attr", "text")) for e in page.select(r.get("selector", "body"))] for r in rules
        ]
        longest = max(map(len, columns), default=0)
        rows = [[c[i] if i < len(c) else "" for c in columns] for i in range(longest)]
    return [r for r in rows if any(r)]
