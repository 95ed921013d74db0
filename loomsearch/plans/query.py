"""The query language: words, AND, OR, NOT, phrases and groups, from text to a small tree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

STOP_WORDS = frozenset((Path(__file__).parent / "stopwords.txt").read_text().split())
STRIPPED = str.maketrans("", "", "!,.?;:-+/~`><@#$%^&*")
KEYWORDS = {"AND", "OR", "NOT"}
OR_SIGNS, AND_SIGNS, QUOTES = {"OR", "|", "||"}, {"AND", "&", "&&"}, {'"', "'"}
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_TOKEN = re.compile(r"\|\||\||[()\"']|[^\s|()\"']+")
_INNER_QUOTE = re.compile(r"(?<=[A-Za-z0-9])'(?=[A-Za-z0-9])")


class QuerySyntaxError(ValueError):
    """The query has no tree; a search for it finds nothing."""


@dataclass(frozen=True)
class Word:
    term: str


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]


@dataclass(frozen=True)
class All:
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Any:
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Without:
    """Documents of ``wanted`` that none of ``unwanted`` matches."""
    wanted: Node
    unwanted: tuple[Node, ...]


Node = Word | Phrase | All | Any | Without


def tokenize(query: str, compat: bool = False) -> list[str]:
    """Tokens, lower-cased but for keywords, without stop words outside quotes.

    An apostrophe within a word goes, as in the index; with ``compat`` it is a quote wherever it stands.
    """
    text = query.translate(STRIPPED)
    tokens = _TOKEN.findall(text if compat else _INNER_QUOTE.sub("", text))
    if len(tokens) < 2:
        return [t.translate(_LOWER) for t in tokens]
    out, quoted = [], False
    for t in tokens:
        if t in QUOTES:
            quoted = not quoted
            out.append(t)
        elif t in KEYWORDS:
            out.append(t)
        elif quoted or t.translate(_LOWER) not in STOP_WORDS:
            out.append(t.translate(_LOWER))
    if all(t in KEYWORDS for t in out):
        return [tokens[0].translate(_LOWER)]
    return out


class _Parser:
    def __init__(self, tokens: list[str], compat: bool):
        self.tokens, self.at, self.compat = tokens, 0, compat

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, signs: set[str]) -> bool:
        if self.peek() and self.peek() in signs:
            self.at += 1
            return True
        return False

    def union(self) -> Node:
        parts = [self.both()]
        while self.take(OR_SIGNS):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Any(tuple(parts))

    def both(self) -> Node:
        parts = [self.simple()]
        while self.take(AND_SIGNS):
            parts.append(self.simple())
        return parts[0] if len(parts) == 1 else All(tuple(parts))

    def simple(self) -> Node:
        """Operands side by side are all wanted; those after NOT, up to the next operator, are all unwanted."""
        wanted: list[Node] = []
        unwanted: list[Node] = []
        into = wanted
        while (t := self.peek()) and t not in OR_SIGNS | AND_SIGNS and t != ")":
            if t == "NOT":
                self.at += 1
                into = unwanted
            elif t == "(" or t in QUOTES and not self.compat or t == '"':
                if self.compat:
                    break
                into.append(self.group() if t == "(" else self.phrase())
            else:
                self.at += 1
                into.append(Word(t))
        if not wanted:
            raise QuerySyntaxError("a word to search for is missing")
        node = wanted[0] if len(wanted) == 1 else All(tuple(wanted))
        return Without(node, tuple(unwanted)) if unwanted else node

    def phrase(self) -> Node:
        quote = self.tokens[self.at]
        self.at += 1
        terms = []
        while self.peek() != quote:
            if not self.peek():
                raise QuerySyntaxError("a quote isn't closed")
            terms.append(self.tokens[self.at])
            self.at += 1
        self.at += 1
        if not terms:
            raise QuerySyntaxError("a phrase is empty")
        return Word(terms[0]) if len(terms) == 1 else Phrase(tuple(terms))

    def group(self) -> Node:
        self.at += 1
        node = self.union()
        if not self.take({")"}):
            raise QuerySyntaxError("a parenthesis isn't closed")
        return node


def parse(query: str, compat: bool = False) -> Node:
    """The tree of a query. With ``compat`` neither phrases nor groups exist: such signs end the query or make it fail."""
    return _Parser(tokenize(query, compat), compat).union()


def terms_of(node: Node, negative: bool = True) -> Iterator[str]:
    match node:
        case Word(term):
            yield term
        case Phrase(terms):
            yield from terms
        case All(parts) | Any(parts):
            for p in parts:
                yield from terms_of(p, negative)
        case Without(wanted, unwanted):
            yield from terms_of(wanted, negative)
            if negative:
                for p in unwanted:
                    yield from terms_of(p, negative)


def ranking_leaves(node: Node, negative: bool = False) -> list[list[str]]:
    """The terms that ranking uses, by leaf in query order: adjacent words are one leaf, a phrase is one."""
    match node:
        case Word(term):
            return [[term]]
        case Phrase(terms):
            return [list(terms)]
        case All(parts):
            out: list[list[str]] = []
            run: list[str] = []
            for p in parts:
                if isinstance(p, Word):
                    run.append(p.term)
                else:
                    out += [run] if run else []
                    run = []
                    out += ranking_leaves(p, negative)
            return out + ([run] if run else [])
        case Any(parts):
            return [leaf for p in parts for leaf in ranking_leaves(p, negative)]
        case Without(wanted, unwanted):
            return ranking_leaves(wanted, negative) + ([leaf for p in unwanted for leaf in ranking_leaves(p, negative)] if negative else [])
