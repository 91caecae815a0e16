"""The search language: words, "phrases", and/or/not, grouping, and fuzzy words.

A query becomes a tree of nodes. Words beside each other are joined by AND, + means AND, | means OR, and a
leading - or NOT excludes. word~, ~word or fuzzy=True widen a word to variants within one edit.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

MOST_VARIANTS = 20
SHORTEST_PREFIX, SHORTEST_EDIT, LONGEST_EDIT = 3, 4, 16


class QueryError(ValueError):
    """The query can't be read, or excludes without naming anything to find."""


@dataclass(frozen=True)
class Term:
    """A word or phrase to find; prefix also matches longer words."""

    text: str
    phrase: bool = False
    prefix: bool = False

    def __str__(self) -> str:
        plain = not self.phrase and re.fullmatch(r"[\w]+", self.text) is not None
        shown = self.text if plain else '"' + self.text.replace('"', '""') + '"'
        return shown + "*" * self.prefix


@dataclass(frozen=True)
class Fuzzy:
    text: str


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    """keep AND NOT drop; drop alone (keep None) is only possible inside an AND."""

    keep: object
    drop: object


_TOKEN = re.compile(r'\s*(?:(?P<quoted>"(?:[^"]|"")*")|(?P<mark>[()+|])|(?P<word>~?-?[\w./:\-#]+~?)|(?P<bad>\S))', re.UNICODE)


def _tokens(query: str) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    at = 0
    query = query.strip()
    operand = lambda: bool(out) and out[-1][0] in {"word", "fuzzy", "phrase", ")"}
    while at < len(query):
        m = _TOKEN.match(query, at)
        at = m.end()
        if m["bad"]:
            raise QueryError(f"unexpected {m['bad']!r}")
        if m["quoted"]:
            out.append(("phrase", m["quoted"][1:-1].replace('""', '"')))
        elif m["mark"]:
            out.append(({"+": "and", "|": "or"}.get(m["mark"], m["mark"]), m["mark"]))
        else:
            word = m["word"]
            if word.startswith("-") and len(word) > 1:
                out.append(("not", "-"))
                word = word[1:]
            fuzzy = word.startswith("~") or word.endswith("~")
            word = word.strip("~")
            if not word:
                raise QueryError("~ needs a word")
            if not fuzzy and word.lower() in {"and", "or", "not"} and operand():
                out.append((word.lower(), word))
            else:
                out.append(("fuzzy" if fuzzy else "word", word))
    return out


class _Reader:
    def __init__(self, tokens: list[tuple[str, str]], fuzzy: bool) -> None:
        self.tokens, self.fuzzy, self.at = tokens, fuzzy, 0

    def next_kind(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else ""

    def either(self):
        parts = [self.both()]
        while self.next_kind() == "or":
            self.at += 1
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def both(self):
        parts, kind = [self.single()], self.next_kind()
        while kind and kind not in {"or", ")"}:
            self.at += kind == "and"
            parts.append(self.single())
            kind = self.next_kind()
        keep = [p for p in parts if not (isinstance(p, Not) and p.keep is None)]
        drop = [p.drop for p in parts if isinstance(p, Not) and p.keep is None]
        if not keep:
            return parts[0] if len(parts) == 1 else Not(None, Or(tuple(drop)))
        node = keep[0] if len(keep) == 1 else And(tuple(keep))
        for d in drop:
            node = Not(node, d)
        return node

    def single(self):
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        self.at += 1
        if kind == "not":
            return Not(None, self.single())
        if kind == "(":
            node = self.either()
            if self.next_kind() != ")":
                raise QueryError("( without )")
            self.at += 1
            return node
        if kind == "phrase":
            return Term(text, phrase=True)
        if kind == "fuzzy" or kind == "word" and self.fuzzy:
            return Fuzzy(text)
        if kind == "word":
            return Term(text)
        raise QueryError(f"unexpected {text!r}" if kind else "the query ends too soon")


def _sound(node, root: bool = True) -> None:
    if isinstance(node, Not):
        if node.keep is None:
            raise QueryError("nothing to find, only to exclude" if root else "an exclusion can't be an alternative")
        _sound(node.keep)
        _sound(node.drop, False)
    elif isinstance(node, Or):
        for p in node.parts:
            _sound(p, False)
    elif isinstance(node, And):
        for p in node.parts:
            _sound(p)


def variants(word: str) -> list[Term]:
    """The word, longer words that begin with it, and words one deletion or substitution away; at most MOST_VARIANTS."""
    word = word.strip()
    found: dict[tuple[str, bool], Term] = {}

    def take(text: str, prefix: bool = False) -> None:
        if len(found) < MOST_VARIANTS and (len(text) >= 2 or prefix):
            found.setdefault((text, prefix), Term(text, prefix=prefix))

    take(word)
    if len(word) >= SHORTEST_PREFIX:
        take(word, prefix=True)
    if SHORTEST_EDIT <= len(word) <= LONGEST_EDIT:
        for i in range(len(word)):
            take(word[:i] + word[i + 1 :])
        for i, letter in enumerate(word):
            if letter.isalpha():
                first = ord("A" if letter.isupper() else "a")
                for code in range(first, first + 26):
                    if chr(code) != letter:
                        take(word[:i] + chr(code) + word[i + 1 :])
    return list(found.values())


def parse(query: str, fuzzy: bool = False):
    """The query's tree, with fuzzy words widened to an Or of their variants. QueryError if it can't be read."""
    tokens = _tokens(query)
    if not tokens:
        raise QueryError("empty query")
    reader = _Reader(tokens, fuzzy)
    node = reader.either()
    if reader.at < len(tokens):
        raise QueryError(f"unexpected {tokens[reader.at][1]!r}")
    _sound(node)
    return _widen(node)


def _widen(node):
    if isinstance(node, Fuzzy):
        options = variants(node.text)
        return options[0] if len(options) == 1 else Or(tuple(options))
    if isinstance(node, Not):
        return Not(_widen(node.keep), _widen(node.drop))
    if isinstance(node, (And, Or)):
        return type(node)(tuple(_widen(p) for p in node.parts))
    return node


def render(node, inside: str = "") -> str:
    """The tree as text, fully bracketed where needed."""
    if isinstance(node, Term):
        return str(node)
    if isinstance(node, And):
        text = " AND ".join(render(p, "and") for p in node.parts)
        return f"({text})" if inside else text
    if isinstance(node, Or):
        return "(" + " OR ".join(render(p, "or") for p in node.parts) + ")"
    text = f"{render(node.keep, 'not')} NOT {render(node.drop, 'not')}"
    return f"({text})" if inside else text


def terms(node) -> list[Term]:
    """All terms in order, repeated ones too."""
    if isinstance(node, Term):
        return [node]
    children = (node.keep, node.drop) if isinstance(node, Not) else node.parts
    return [t for c in children for t in terms(c)]
