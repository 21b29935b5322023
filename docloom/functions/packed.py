"""Parsing of packed fields: several values in one string, under a delimiter-and-quote dialect.

A dialect is a set of delimiters and the switches below; ``parse`` is a pure function of text and dialect, so any number of
dialects can be scored on the same field.
"""

from __future__ import annotations

import ast
import json
import re
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

# Separator characters (comma, enumeration comma, semicolon, bar in any script's form, tab, line break).
COMMAS = ",，、،﹐﹑､\u07f8\u055d"
SEMICOLONS = ";；؛﹔"
BARS = "|｜¦│"
BREAKS = "\t\n\r\x0b\x0c\x85\u2028\u2029"
SEPARATORS = COMMAS + SEMICOLONS + BARS + BREAKS
SLASHES = "/／"
# Quote pairs.
QUOTES = {
    '"': '"', "'": "'", "＂": "＂", "＇": "＇", "`": "`", "“": "”", "‘": "’", "„": "“”", "‚": "‘’",
    "「": "」", "『": "』", "«": "»", "‹": "›", "〝": "〞", "｢": "｣",
}
# Bracket pairs inside which a separator doesn't count, both widths of a kind together.
BRACKETS = [("(（﹙", ")）﹚"), ("[［", "]］"), ("【〖", "】〗")]

# The kinds of separator, each a delimiter that a dialect has or lacks.
DELIMITERS = {
    "comma": ",，،﹐﹑\u07f8\u055d", "enumeration": "、､", "semicolon": SEMICOLONS, "bar": BARS, "tab": "\t", "break": BREAKS.replace("\t", ""), "slash": SLASHES,
}
_KIND_OF = {c: k for k, cs in DELIMITERS.items() for c in cs}


class Dialect(NamedTuple):
    """How a field is read: its delimiters, whether quotes protect, and whether the thousands commas of numbers do."""

    delimiters: frozenset[str] = frozenset(DELIMITERS)
    quotes: bool = True
    numbers: bool = True


#: plain: the finest dialect, of all delimiters. nonum: a comma between digits separates. noquote: quotes are ordinary
#: characters. whole: no delimiter. Beside these there is list: the whole field is a serialised list.
NAMED = {"plain": Dialect(), "nonum": Dialect(numbers=False), "noquote": Dialect(quotes=False), "whole": Dialect(frozenset())}

_BLANK = r"[^\S\t\n\r\x0b\x0c\x85\u2028\u2029]"
_MARK = re.compile(
    rf"{_BLANK}*(?:[•●▪■◆◦‣·○□◇➢✓*\-–—]{_BLANK}+|[•●▪■◆◦‣○□◇➢]|[①-⑳⑴-⒇⒈-⒛]{_BLANK}*"
    rf"|[(（]\d{{1,3}}[)）]{_BLANK}*|\d{{1,3}}(?:[)）、]|[.．](?!\d)){_BLANK}*)"
)
_NUMBER = r"(?<![0-9A-Za-z０-９])[0-9０-９]{1,3}(?:[,，][0-9０-９]{3})+(?![0-9０-９])"
_HAS_NUMBER, _HAS_BRACKET = re.compile(r"[0-9０-９][,，][0-9０-９]"), re.compile("[" + re.escape("".join(o for o, _ in BRACKETS)) + "]")
_HAS_QUOTE, _CLOSING = re.compile("[" + re.escape("".join(QUOTES)) + "]"), frozenset("".join(QUOTES.values()))


@lru_cache(maxsize=None)
def _sep(delimiters: frozenset[str]) -> str:
    """A separator with the blanks around it; a slash needs a blank, or the end, on both sides."""
    chars = "".join(DELIMITERS[d] for d in DELIMITERS if d in delimiters and d != "slash")
    parts = [rf"{_BLANK}*[{re.escape(chars)}]{_BLANK}*"] if chars else []
    if "slash" in delimiters:
        parts.append(rf"{_BLANK}*(?<={_BLANK})[{SLASHES}](?={_BLANK}|\Z){_BLANK}*")
    return f"(?:{'|'.join(parts)})" if parts else r"(?!)"


@lru_cache(maxsize=None)
def _sep_re(delimiters: frozenset[str]) -> re.Pattern:
    return re.compile(_sep(delimiters))


@lru_cache(maxsize=None)
def _stop(delimiters: frozenset[str], numbers: bool) -> re.Pattern:
    """What ends a value or protects a part of it: a number (n), an opening bracket (o) or a separator."""
    opens = re.escape("".join(o for o, _ in BRACKETS))
    return re.compile(("(?P<n>" + _NUMBER + ")|" if numbers else "") + f"(?P<o>[{opens}])|{_sep(delimiters)}")


def _brackets(text: str) -> dict[int, int]:
    """The place of each opening bracket that is closed, to that of its end; each kind of bracket is matched by itself, however deep."""
    ends: dict[int, int] = {}
    if _HAS_BRACKET.search(text):
        for opens, closes in BRACKETS:
            open_ = []
            for m in _bracket_re(opens + closes).finditer(text):
                if m[0] in opens:
                    open_.append(m.start())
                elif open_:
                    ends[open_.pop()] = m.start()
    return ends


@lru_cache(maxsize=None)
def _bracket_re(chars: str) -> re.Pattern:
    return re.compile(f"[{re.escape(chars)}]")


def _value_end(text: str, at: int, stop: re.Pattern, ends: dict[int, int]) -> int:
    """Where the unquoted value that starts at ``at`` ends."""
    while m := stop.search(text, at):
        if m.lastgroup == "o":
            at = ends.get(m.start(), m.start()) + 1
        elif m.lastgroup == "n":
            at = m.end()
        else:
            return m.start()
    return len(text)


@lru_cache(maxsize=None)
def _quoted(opening: str, delimiters: frozenset[str]) -> re.Pattern:
    o, c, end = re.escape(opening), re.escape(QUOTES[opening]), rf"(?={_sep(delimiters)}|{_BLANK}*\Z)"
    if opening in '"＂':
        return re.compile(rf"{o}((?:[^{o}]|{o}{o}|{o}(?!{o}|{end}))*){o}{end}")
    return re.compile(rf"{o}([\s\S]*?)[{c}]{end}")


_BLANKS_RE = re.compile(rf"{_BLANK}*")


def parse_list(text: str) -> list[str] | None:
    """The values of a whole serialised list (JSON or Python literal), or None if the text isn't one."""
    t = text.strip().strip("\u200b\u200c\u200d\u200e\u2060\ufeff\u00ad").strip()
    if not (t.startswith("[") and t.endswith("]")):
        return None
    got = None
    try:
        got = json.loads(t, strict=False)
    except ValueError:
        try:
            got = ast.literal_eval(t)
        except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
            return None
    if not isinstance(got, list):
        return None
    return ["" if x is None else x.strip() if isinstance(x, str) else json.dumps(x, ensure_ascii=False, default=str) for x in got]


def parse(text: str, dialect: str | Dialect = "plain", marks: bool = False) -> list[str] | None:
    """The values of ``text`` in order, empty places included, or None where the dialect doesn't apply.

    ``marks``: also take off a bullet or running number in front of a value, outside quotes.
    """
    got = parse_quoted(text, dialect, marks)
    return None if got is None else [item for item, _ in got]


_CLOSED = re.compile(f"[{re.escape(''.join(QUOTES.values()))}](?={_sep(NAMED['plain'].delimiters)})")


def _kind(separator: str) -> str:
    return next(_KIND_OF[c] for c in separator if c in _KIND_OF)


class Value(NamedTuple):
    """A value of a field: its text, whether it stood in quotes, its place in the field, and the kind of separator behind it."""

    item: str
    quoted: bool
    start: int
    end: int
    behind: str | None


def parse_values(text: str, dialect: Dialect, marks: bool) -> list[Value]:
    stop, sep, ends = _stop(dialect.delimiters, dialect.numbers), _sep_re(dialect.delimiters), _brackets(text)
    out, at, n = [], 0, len(text)
    while True:
        start = begin = _BLANKS_RE.match(text, at).end()
        if marks and (m := _MARK.match(text, start)):
            start = _BLANKS_RE.match(text, m.end()).end()
        item, quoted = None, True
        if dialect.quotes and start < n and text[start] in QUOTES and (m := _quoted(text[start], dialect.delimiters).match(text, start)):
            item = m[1].replace(text[start] * 2, text[start]) if text[start] in '"＂' else m[1]
            at = m.end()
        if item is None:
            at = _value_end(text, start, stop, ends)
            item, quoted = text[start:at], False
        m = sep.match(text, at) if at < n else None
        out.append(Value(item.strip(), quoted, begin, at, _kind(m[0]) if m else None))
        if m is None:
            return out
        at = m.end()


def parse_quoted(text: str, dialect: str | Dialect, marks: bool) -> list[tuple[str, bool]] | None:
    """``parse`` with whether each value stood in quotes."""
    if dialect == "list":
        got = parse_list(text)
        return None if got is None else [(x, True) for x in got]
    return [(v.item, v.quoted) for v in parse_values(text, NAMED.get(dialect, dialect), marks)]


def simple(text: str) -> bool:
    """True for a text without quote marks, commas between digits and the form of a serialised list."""
    return not (_HAS_QUOTE.search(text) or _HAS_NUMBER.search(text) or text.lstrip().startswith("["))


def neighbours(dialect: Dialect, text: str) -> list[Dialect]:
    """The dialects that differ from this one in a switch that plays a part in the text."""
    kinds = sorted({_KIND_OF[c] for c in text if c in _KIND_OF} & dialect.delimiters)
    out = [dialect._replace(delimiters=dialect.delimiters - {k}) for k in kinds]
    if dialect.quotes and _HAS_QUOTE.search(text):
        out.append(dialect._replace(quotes=False))
    if dialect.numbers and _HAS_NUMBER.search(text):
        out.append(dialect._replace(numbers=False))
    return out


def candidates(text: str, marks: bool = False) -> list[tuple[str | Dialect, list[tuple[str, bool]]]]:
    """The distinct parses of ``text``, each under its first dialect: a serialised list, then the finest dialect, then those of
    fewer of the delimiters that the finest one found, of literal quotes and of bare numbers."""
    seen, out = set(), []
    got = parse_list(text)
    if got is not None:
        seen.add(tuple(got))
        out.append(("list", [(x, True) for x in got]))
    finest = parse_values(text, NAMED["plain"], marks)
    kinds = sorted({_KIND_OF[c] for c in text if c in _KIND_OF}) if _HAS_QUOTE.search(text) else sorted({v.behind for v in finest if v.behind})
    for numbers in (True, False) if _HAS_NUMBER.search(text) else (True,):
        for quotes in (True, False) if _HAS_QUOTE.search(text) else (True,):
            for n in range(len(kinds), -1, -1):
                for delimiters in combinations(kinds, n):
                    d = Dialect(frozenset(delimiters), quotes, numbers)
                    items = [(v.item, v.quoted) for v in parse_values(text, d, marks)]
                    if (key := tuple(x for x, _ in items)) not in seen:
                        seen.add(key)
                        out.append((d, items))
    return out


def surprises(item: str, quoted: bool) -> int:
    """What a value holds that the rules would have read otherwise: separators without the protection of quotes, brackets or a
    number, and a quote mark at its start or end that doesn't enclose it; inside quotes, a closing mark in front of a separator."""
    if quoted:
        return sum(1 for _ in _CLOSED.finditer(item)) if not _CLOSING.isdisjoint(item) else 0
    stop, ends, at, found = _stop(NAMED["plain"].delimiters, True), _brackets(item), 0, 0
    while (at := _value_end(item, at, stop, ends)) < len(item):
        at, found = _sep_re(NAMED["plain"].delimiters).match(item, at).end(), found + 1
    return found + (item[:1] in QUOTES) + (len(item) > 1 and item[-1] in _CLOSING)
