"""HTML extraction: words, title words, description, links, base, images and an English flag from one page.

One pass over the text, from tag to tag. Only twelve tag names do anything; every other tag is dropped. Closing tags act
like opening ones. Sections of scripts, styles and drawings are dropped up to their end.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from . import tokens
from .batches import keep_small, tidy

_NAME = re.compile(r"[^ \n/>\r\f\t]*")
_GAP = re.compile(r"[ \t\r\n]+")
_SPACE = " \t\n\v\f\r"
_TO_CLOSE = re.compile(r'[^>"]*(?:"[^"]*"[^>"]*)*')
_QUOTE = re.compile("[\"']")
_QUOTE_OR_CLOSE = re.compile("[\"'>]")
_TITLE_END = re.compile("(?ai)</title>")
_TITLE_TAGS = re.compile("<[^>]*>?|>")
_SECTIONS = {"script", "style", "svg", "radialgradient"}
SCHEMA = ("words array<string>, title_words array<string>, description array<string>, links array<string>, base string, img_count int, is_english boolean")


def _split(text: str) -> list[str]:
    """Words between the six white-space characters of C."""
    return [w for w in re.split(r"[ \t\n\v\f\r]+", text) if w]


@dataclass
class Page:
    words: list[str] = field(default_factory=list)
    title_words: list[str] = field(default_factory=list)
    description: list[str] = field(default_factory=list)
    links: list[str] = field(default_factory=list)
    base: str = ""
    img_count: int = 0
    is_english: bool = False


class _Parser:
    def __init__(self, text: str):
        self.s, self.n, self.page, self.word = text, len(text), Page(), ""

    def after(self, mark: str, i: int) -> int:
        """Behind the next ``mark``, or past the end."""
        j = self.s.find(mark, i)
        return self.n + 1 if j < 0 else j + len(mark)

    def flush(self) -> None:
        if self.word:
            self.page.words.append(self.word)
            self.word = ""

    def text(self, piece: str) -> None:
        parts = _GAP.split(piece)
        self.word += parts[0]
        for p in parts[1:]:
            self.flush()
            self.word = p

    def section(self, name: str, i: int) -> int:
        """Past '</' and the section's name; other sections than svg and style look for a script's end, over their own name's length."""
        end = name if name in ("svg", "style") else "script"
        if len(name) > len(end):
            return self.n
        j = self.s.find("</" + end[:len(name)], i)
        return self.n if j < 0 or j + 2 >= self.n else j + len(name) + 3

    def run(self) -> Page:
        s, n, i = self.s, self.n, 0
        while i < n:
            j = s.find("<", i)
            if j < 0:
                self.text(s[i:])
                break
            self.text(s[i:j])
            i = j + 1
            if i < n and s[i] == "/":
                i += 1
            if i >= n:
                return self.page  # an unfinished tag drops the pending word
            name = _NAME.match(s, i).group()
            i += len(name)
            if not name:
                self.word += "<"
                if s[i] == " ":
                    self.flush()
                else:
                    self.word += s[i]
                i += 1
                continue
            self.flush()
            low = name.lower()
            if low in _SECTIONS:
                i = self.section(name, i)
            elif low in _ACTIONS and len(name) <= 36:
                i = _ACTIONS[low](self, i)
            else:
                i = _TO_CLOSE.match(s, i).end()
                i = n if i < n and s[i] == '"' else i + 1
        self.flush()
        return self.page

    def comment(self, i: int) -> int:
        return self.after("-->", i)

    def title(self, i: int) -> int:
        i = min(self.after(">", i), self.n)
        end = _TITLE_END.search(self.s, i)
        stop = end.start() if end else max(i, self.n - 7)
        self.page.title_words += _split(_TITLE_TAGS.sub("", self.s[i:stop]))
        return end.end() if end else stop

    def image(self, i: int) -> int:
        self.page.img_count += 1
        return self.after(">", i)

    def anchor(self, i: int) -> int:
        """The link, then its words up to the anchor's end; an anchor within starts over, an image ends it, both drop the pending word."""
        s, n, words = self.s, self.n, self.page.words
        while True:
            close = s.find(">", i)
            href = s.find("href", i, close) if close >= 0 else s.find("href", i)
            if close >= 0 and (href < 0 or close < href):
                return close + 1
            quote = _QUOTE_OR_CLOSE.search(s, href) if href >= 0 else None
            if not quote:
                return n
            if quote.group() == ">":
                return quote.end()
            stop = s.find(quote.group(), quote.end())
            stop = n if stop < 0 else stop
            self.page.links.append(s[quote.end():stop])
            i = self.after(">", stop)
            word, inside, again = "", False, False
            while i < n:
                c = s[i]
                if c == "<":
                    if s.startswith(("</a>", "</a\n", "</a\r", "</a\f"), i):
                        if word:
                            words.append(word)
                        return i + (4 if s[i + 3] == ">" else 6)
                    if s.startswith("<a", i):
                        i, again = i + 2, True
                        break
                    if s.startswith("<img", i):
                        return self.image(i)
                    if s.startswith("<base", i):
                        return self.base(i + 5)
                    i += 1
                    if i < n and s[i] == "/":
                        i += 1
                        if i == n:
                            return i
                    name = _NAME.match(s, i).group()
                    if name.lower() in _SECTIONS:
                        i = self.section(name, i)
                    if word:
                        words.append(word)
                        word = ""
                    inside = True
                elif c == ">":
                    inside = False
                elif not inside:
                    if c in " \t\r\n":
                        if word:
                            words.append(word)
                            word = ""
                    else:
                        word += c
                i += 1
            if not again:
                return i

    def _attribute(self, name: str, i: int) -> tuple[str | None, int]:
        """Value of the attribute in the tag, quotes respected, and where the scan ended: past the '>' or on the value's end."""
        s, n, quote = self.s, self.n, ""
        while i < n:
            if s[i] == ">" and not quote:
                return None, i + 1
            if s[i] in "\"'":
                quote = "" if s[i] == quote else s[i]
            if s.startswith(name, i):
                eq = s.find("=", i + len(name))
                start = _QUOTE.search(s, eq) if eq >= 0 else None
                if not start:
                    return None, n
                stop = s.find(start.group(), start.end())
                stop = n if stop < 0 else stop
                return s[start.end():stop], stop
            i += 1
        return None, i

    def base(self, i: int) -> int:
        value, at = self._attribute("href", i)
        if value is None:
            return at
        self.page.base = self.page.base or value
        return self.after(">", at)

    def embed(self, i: int) -> int:
        value, at = self._attribute("src", i)
        if value is None:
            return at
        self.page.links.append(value)
        close = self.s.find(">", at)
        return self.n if close < 0 else close  # the '>' itself is read as text

    def html(self, i: int) -> int:
        s, n, pos, lang = self.s, self.n, i, ""
        while (at := s.find("lang", pos)) >= 0 and ">" not in s[pos:at]:
            at += 4
            while at < n and s[at] in " =":
                at += 1
            if at < n and s[at] in "\"'":
                stop = s.find(s[at], at + 1)
                lang = s[at + 1:n if stop < 0 else stop]
                break
            if at < n and s[at] == ">":
                at -= 1
            pos = at + 1
        if len(lang) >= 2:
            self.page.is_english = lang.startswith("en")
        return self.after(">", i)

    def meta(self, i: int) -> int:
        s, n, at = self.s, self.n, i
        got: dict[str, str] = {}
        while at < n and s[at] != ">":
            while at < n and s[at] in _SPACE:
                at += 1
            key = next((k for k in ("name", "content") if s.startswith(k, at)), None)
            if key:
                eq = s.find("=", at + len(key))
                at = n if eq < 0 else eq + 1
                if at < n and s[at] in "\"'":
                    stop = s.find(s[at], at + 1)
                    stop = n if stop < 0 else stop
                    got[key] = s[at + 1:stop]
                    at = stop + 1
            else:
                while at < n and s[at] not in " >":
                    at += 1
        if "content" in got and got.get("name", "").lower() == "description":
            self.page.description += _split(got["content"])
        return min(self.after(">", i), n)


_ACTIONS = {"!--": _Parser.comment, "title": _Parser.title, "a": _Parser.anchor, "base": _Parser.base, "embed": _Parser.embed, "img": _Parser.image, "html": _Parser.html, "meta": _Parser.meta}


def parse_html(text: str | None) -> Page:
    return _Parser(text or "").run()


def _texts(name: str) -> Callable[[list[Page]], pa.Array]:
    return lambda found: pa.array([getattr(p, name) for p in found], pa.list_(pa.string()))


def _terms(name: str) -> Callable[[list[Page]], pa.Array]:
    return lambda found: tokens.terms_of_words(_texts(name)(found))


def _count(name: str) -> Callable[[list[Page]], pa.Array]:
    return lambda found: pa.array([len(getattr(p, name)) for p in found], pa.int32())


_COLUMNS: dict[str, tuple[str, Callable[[list[Page]], pa.Array]]] = {
    **{name: ("array<string>", _texts(name)) for name in ("words", "title_words", "description", "links")},
    "base": ("string", lambda found: pa.array([p.base for p in found], pa.string())),
    "img_count": ("int", lambda found: pa.array([p.img_count for p in found], pa.int32())),
    "is_english": ("boolean", lambda found: pa.array([p.is_english for p in found], pa.bool_())),
    "n_words": ("int", _count("words")), "n_links": ("int", _count("links")),
    "title_terms": ("array<string>", _terms("title_words")), "body_terms": ("array<string>", _terms("words"))}


def parser(keep: list[str], columns: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of HTML and the columns ``keep`` to those and ``columns``; the parsed form of few pages is held at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in tokens.groups(tokens.sizes(batch.column(0)), tokens.GROUP_BYTES):
                part = batch.slice(start, stop - start)
                found = [parse_html(t) for t in part.column(0).to_pylist()]
                yield pa.record_batch({name: part.column(k + 1) for k, name in enumerate(keep)} | {name: _COLUMNS[name][1](found) for name in columns})

    return run


def parse_pages(pages: DataFrame, html_col: str = "html", columns: tuple[str, ...] = tuple(c.split()[0] for c in SCHEMA.split(", "))) -> DataFrame:
    """``pages`` without the HTML, with the columns of SCHEMA, or those asked for: counts and index terms too."""
    keep = [c for c in pages.columns if c != html_col]
    base = pages.select(html_col, *keep)
    keep_small(pages.sparkSession)
    shape = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema[1:]] + [f"{name} {_COLUMNS[name][0]}" for name in columns]
    return base.mapInArrow(tidy(parser(keep, columns)), ", ".join(shape))
