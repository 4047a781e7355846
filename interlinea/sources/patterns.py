"""Which patterns of users may keep a matcher busy for ever: a test of the pattern itself, before any text is held against it.

A pattern becomes an automaton of its characters' places. It is exponential if a place can be left and reached again over one and the same text in
two ways: an edge that exists twice lies on a circle, or, in the product of the automaton with itself, a pair of equal places and a
pair of different ones lie on a circle. Powers of a text's length are no reason to refuse.

Patterns are read by Python's own reader, after the spellings that only Java has are put into its own. What is read too widely (classes by property,
references to groups, repeats up to more than eight times as endless, groups without a way back as others) may refuse a pattern that ends, never accept
one that doesn't; so does a pattern that can't be read or has too many places.
"""

from __future__ import annotations

import re
import sys
import warnings
from functools import lru_cache, reduce
from itertools import combinations
from string import ascii_lowercase

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    from re import _parser as reader
except ImportError:  # before Python 3.11
    import sre_parse as reader

#: Places of a pattern that are looked at, and copies of a part that is repeated a limited number of times.
PLACES, COPIES, EXACT = 400, 8, 32
ANY = ((0, sys.maxunicode),)
_CLASSES = {"DIGIT": "0123456789", "SPACE": " \t\n\r\f\v", "WORD": "0123456789_abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"}
_SPELLINGS = [(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}"), (r"\[(\^?)\\[pP](?:\{\w+\}|\w)\]|\\[pP](?:\{\w+\}|\w)", lambda m: r"[\s\S]"), (r"\\z", lambda m: r"\Z"), (r"\\h", lambda m: r"[ \t\xa0]"), (r"\(\?<(?=[A-Za-z])", lambda m: "(?P<"), (r"\\k<(\w+)>", lambda m: f"(?P={m[1]})")]


def _apart(m: re.Match) -> str:
    """An escape, a class or a bar. Behind a bar an empty condition keeps the reader from making one of two alternatives that are alike."""
    if m[0].startswith("[") and re.search(r"(?<!\\)\[|&&", m[0][1:]):
        raise re.error("classes inside classes")
    return "|(?=)" if m[0] == "|" else m[0]


def _python(pattern: str) -> str:
    if not any(x in pattern for x in ("\\", "[", "(?<")):  # nothing that only Java has
        return pattern.replace("|", "|(?=)")
    quoted = re.sub(r"\\Q(.*?)(?:\\E|$)", lambda m: re.escape(m[1]), pattern, flags=re.S)
    for java, to in _SPELLINGS:
        quoted = re.sub(java, to, quoted)
    return re.sub(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\|", _apart, quoted, flags=re.S)


def _inverse(ranges: tuple) -> tuple:
    out, at = [], 0
    for a, b in sorted(ranges):
        if a > at:
            out.append((at, a - 1))
        at = max(at, b + 1)
    return (*out, *(((at, sys.maxunicode),) if at <= sys.maxunicode else ()))


def _characters(op: str, arg, fold: bool) -> tuple:
    """The ranges of characters that one node takes."""
    if op == "LITERAL" and not fold:
        return ((arg, arg),)
    if op == "LITERAL":
        return tuple((ord(c), ord(c)) for c in {chr(arg), *([chr(arg).lower(), chr(arg).upper()] if fold else [])} if len(c) == 1)
    if op == "NOT_LITERAL":
        return _inverse(_characters("LITERAL", arg, fold))
    if op == "RANGE":
        return ((arg[0], arg[1]), *(((ord("A"), ord("Z")), (ord("a"), ord("z"))) if fold else ()))
    if op == "CATEGORY":
        name = str(arg).removeprefix("CATEGORY_")
        ranges = tuple((ord(c), ord(c)) for c in _CLASSES[name.removeprefix("NOT_")])
        return _inverse(ranges) if name.startswith("NOT_") else ranges
    if op == "IN":
        ranges = tuple(r for o, a in arg if str(o) != "NEGATE" for r in _characters(str(o), a, fold))
        return _inverse(ranges) if str(arg[0][0]) == "NEGATE" else ranges
    return ANY


class TooLong(ValueError):
    pass


def _both(a: dict, b: dict) -> dict:
    """The ways to places of two parts together."""
    if not a or not b:
        return a or b
    out = dict(a)
    for p, n in b.items():
        out[p] = out.get(p, 0) + n
    return out


class Places:
    """The automaton of a pattern: the characters of each place, and how many ways lead from a place to another.

    A part of a pattern is (can be empty, first places, last places), the places with the number of ways to them."""

    def __init__(self, pattern: str):
        self.characters, self.edges, self.inner = [], {}, []
        tree = reader.parse(pattern)
        self.fold = bool(tree.state.flags & re.IGNORECASE)
        self.sequence(tree)
        while self.inner:  # what is looked for ahead or behind is matched by itself
            self.sequence(self.inner.pop())

    def place(self, ranges: tuple) -> tuple:
        if len(self.characters) >= PLACES:
            raise TooLong
        self.characters.append(ranges)
        at = {len(self.characters) - 1: 1}
        return False, at, at

    def joined(self, a: tuple, b: tuple) -> tuple:
        self.link(a[2], b[1])
        return a[0] and b[0], _both(a[1], b[1]) if a[0] else a[1], _both(b[2], a[2]) if b[0] else b[2]

    def link(self, last: dict, first: dict) -> None:
        for p, m in last.items():
            for q, n in first.items():
                self.edges[p, q] = min(2, self.edges.get((p, q), 0) + m * n)

    def sequence(self, nodes) -> tuple:
        out = (True, {}, {})
        for op, arg in nodes:
            out = self.joined(out, self.node(str(op), arg))
        return out

    def either(self, parts: list) -> tuple:
        return any(p[0] for p in parts), reduce(_both, [p[1] for p in parts], {}), reduce(_both, [p[2] for p in parts], {})

    def node(self, op: str, arg) -> tuple:
        if op in ("AT", "FAILURE"):
            return True, {}, {}
        if op in ("ASSERT", "ASSERT_NOT"):
            self.inner.append(arg[1])
            return True, {}, {}
        if op == "SUBPATTERN":
            self.fold = self.fold or bool(arg[1] & re.IGNORECASE)
            return self.sequence(arg[3])
        if op == "ATOMIC_GROUP":
            return self.sequence(arg)
        if op == "BRANCH":
            return self.either([self.sequence(x) for x in arg[1]])
        if op == "GROUPREF_EXISTS":
            return self.either([self.sequence(x or []) for x in arg[1:]])
        if op == "GROUPREF":
            some = self.place(ANY)
            self.link(some[2], some[1])
            return True, *some[1:]
        if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            return self.repeat(*arg)
        return self.place(_characters(op, arg, self.fold))

    def repeat(self, least: int, most, nodes) -> tuple:
        single = len(nodes) == 1 and str(nodes[0][0]) in ("LITERAL", "NOT_LITERAL", "IN", "ANY")
        endless = most is reader.MAXREPEAT or most > (EXACT if single and least == most else COPIES)
        out = (True, {}, {})
        if endless:
            for _ in range(min(least, COPIES) - 1):
                out = self.joined(out, self.sequence(nodes))
            part = self.sequence(nodes)
            self.link(part[2], part[1])
            return self.joined(out, part if least else (True, *part[1:]))
        optional = (True, {}, {})
        for _ in range(most - least):
            inner = self.joined(self.sequence(nodes), optional)
            optional = (True, *inner[1:])
        for _ in range(least):
            out = self.joined(out, self.sequence(nodes))
        return self.joined(out, optional)


def _circles(nodes: list, following) -> dict:
    """The strongly connected part of each node that can be reached."""
    number, low, part, stack, n = {}, {}, {}, [], 0
    for root in nodes:
        if root in number:
            continue
        number[root] = low[root] = n
        n += 1
        stack.append(root)
        work = [(root, iter(following(root)))]
        while work:
            v, after = work[-1]
            for w in after:
                if w not in number:
                    number[w] = low[w] = n
                    n += 1
                    stack.append(w)
                    work.append((w, iter(following(w))))
                    break
                if w not in part:
                    low[v] = min(low[v], number[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == number[v]:
                    while True:
                        w = stack.pop()
                        part[w] = number[v]
                        if w == v:
                            break
    return part


def may_not_end(pattern: str | None) -> bool:
    """Whether matching a pattern may take time that is exponential in a text's length; none, or an empty one, takes none."""
    return bool(pattern) and _may_not_end(_renamed(pattern))


#: Patterns of small letters, groups, bars, repeats and ends.
_LETTERS = re.compile(r"(?:[a-z|)*+$^]|\((?:\?:)?|(?<!\()\?)*")


def _renamed(pattern: str) -> str:
    """A pattern of letters with these renamed in the order in which they come: the test asks which are equal, not what they are."""
    if not _LETTERS.fullmatch(pattern):
        return pattern
    return pattern.translate(dict(zip(dict.fromkeys(ord(c) for c in pattern if "a" <= c <= "z"), ascii_lowercase)))


@lru_cache(1 << 16)
def _may_not_end(pattern: str) -> bool:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            a = Places(_python(pattern))
    except (re.error, TooLong, KeyError, OverflowError, RecursionError):
        return True
    if any(n > 1 and p == q for (p, q), n in a.edges.items()):
        return True
    after = [[] for _ in a.characters]
    for p, q in a.edges:
        after[p].append(q)
    meets = lru_cache(None)(lambda p, q: any(x <= d and c <= y for x, y in a.characters[p] for c, d in a.characters[q]))
    if max(a.edges.values(), default=1) < 2 and not any(meets(p, q) for qs in after if len(qs) > 1 for p, q in combinations(qs, 2)):
        return False  # one way only, whatever comes
    part = _circles(list(range(len(after))), after.__getitem__)
    on_circle = lambda p, q: part[p] == part[q]
    if any(n > 1 and on_circle(p, q) for (p, q), n in a.edges.items()):
        return True
    # Only what lies on circles matters: elsewhere there are as many ways as the pattern has, however long a text is.
    after = [[q for q in qs if on_circle(p, q)] for p, qs in enumerate(after)]
    pairs = _circles([(p, p) for p in range(len(after))], lambda v: [(x, y) for x in after[v[0]] for y in after[v[1]] if meets(x, y)])
    equal = {c for (p, q), c in pairs.items() if p == q}
    return any(p != q and c in equal for (p, q), c in pairs.items())


def endless(pattern: Column) -> Column:
    """may_not_end() of a column; a batch's patterns are looked at once each."""

    @F.pandas_udf("boolean")
    def run(p: pd.Series) -> pd.Series:
        return p.map(may_not_end).astype(bool)

    return run(pattern)
