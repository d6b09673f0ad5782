"""The items of HTML pages, by a streaming tokenizer with a stack of open elements, as a table function."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that hold nothing and are never closed.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text isn't the page's.
SILENT = frozenset(("script", "style", "template"))
#: Characters that the tokenizer takes at once.
CHUNK = 1 << 16


class _Paragraph:
    __slots__ = ("number", "parts", "size", "link")

    def __init__(self, number: int):
        self.number, self.parts, self.size, self.link = number, [], -1, None


class PageParser(HTMLParser):
    """Collects the paragraphs of a page's body: (number, text, link) of those with `least` to `most` characters.

    The body is the first `<section name="articleBody">`, or else the first `<article>`. A paragraph's text is that of all
    strings in it, paragraphs inside of it included, each without blanks at its ends and joined by one; scripts, styles and
    comments don't count. An end tag closes the last open element of its name and what is open inside; one that closes
    nothing is left out, and what is never closed ends with the page. A paragraph that has grown past `most` gathers no more
    text, so a page of unclosed paragraphs takes no more than `most` characters for each. link: the first group of `article`
    in the first link inside that matches it and not `skip`.
    """

    def __init__(self, article: re.Pattern, skip: re.Pattern, least: int, most: int):
        super().__init__(convert_charrefs=True)
        self.article, self.skip, self.least, self.most = article, skip, least, most
        self.stack: list[tuple[str, object]] = []  # names, with the paragraph or body that begins there
        self.open: list[_Paragraph] = []
        self.text: list[str] = []
        self.silent = self.count = 0
        self.bodies = {"section": None, "article": None}  # None: not met, True: open, False: over
        self.found: dict[str, list[tuple[int, str, str | None]]] = {"section": [], "article": []}

    def handle_starttag(self, tag, attrs):
        self._string()
        if tag in VOID:
            return
        mark = None
        if tag in self.bodies and self.bodies[tag] is None and (tag == "article" or ("name", "articleBody") in attrs):
            self.bodies[tag] = mark = True
        elif tag == "p" and True in self.bodies.values():
            self.count += 1
            mark = _Paragraph(self.count)
            self.open.append(mark)
        elif tag == "a" and any(p.link is None for p in self.open):
            m = self.article.match((dict(attrs).get("href") or "").strip())
            if m and not self.skip.search(m.group(1)):
                for p in self.open:
                    p.link = p.link or m.group(1)
        self.silent += tag in SILENT
        self.stack.append((tag, mark))

    def handle_endtag(self, tag):
        self._string()
        if tag in VOID or not any(name == tag for name, _ in reversed(self.stack)):
            return
        while self._pop() != tag:
            pass

    def handle_data(self, data):
        if not self.silent and self.open:
            self.text.append(data)

    def handle_comment(self, data):
        self._string()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def _string(self) -> None:
        """Ends a string: it belongs to all open paragraphs that have room."""
        if not self.text:
            return
        string = "".join(self.text).strip()
        self.text.clear()
        for p in self.open if string else ():
            if p.size <= self.most:
                p.parts.append(string[: self.most + 1])
                p.size += 1 + len(string)

    def _pop(self) -> str:
        name, mark = self.stack.pop()
        self.silent -= name in SILENT
        if mark is True:
            self.bodies[name] = False
        elif mark is not None:
            self.open.remove(mark)
            if self.least <= mark.size <= self.most:
                item = mark.number, " ".join(mark.parts), mark.link
                for body, state in self.bodies.items():
                    if state:
                        self.found[body].append(item)
        return name

    def items(self, html: str) -> Iterator[tuple[int, str, str | None]]:
        for at in range(0, len(html), CHUNK):
            self.feed(html[at : at + CHUNK])
        self.close()
        self._string()
        while self.stack:
            self._pop()
        yield from sorted(self.found["section"] if self.bodies["section"] is not None else self.found["article"], key=lambda x: x[0])


@F.udtf(returnType="no int, text string, link string")
class PageItems:
    """The table function: a page's items by `PageParser` whose text begins like `lead`, numbered from 0; none of a null page."""

    def eval(self, html: str, lead: str, article: str, skip: str, least: int, most: int):
        if html is None:
            return
        parser = PageParser(re.compile(article), re.compile(skip), least, most)
        begins = re.compile(lead).match
        for no, (_, text, link) in enumerate(x for x in parser.items(html) if begins(x[1])):
            yield no, text, link


def page_items(
    pages: DataFrame, html: str, lead: str = "", article: str = r"https?://[^/]+(/\d{4}/\d{2}/\d{2}/[^?#\s]+\.html)",
    skip: str = r"(?i)/pageoneplus/", least: int = 40, most: int = 2000,
) -> DataFrame:
    """`pages` (all columns but `html`) with a row for each item of the page: no, text, link. A page is parsed once, by the task
    that reads it; the join is lateral, so nothing is exchanged. Patterns are Python's; a page without items has no row."""
    made = PageItems(F.col(html).outer(), *map(F.lit, (lead, article, skip, least, most)))
    return pages.lateralJoin(made).select(*(c for c in pages.columns if c != html), "no", "text", "link")
