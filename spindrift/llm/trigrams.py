"""Boolean trigram queries from regular expressions, and a trigram index to ask.

A query is a positive Boolean formula over trigrams that every match of an
expression must satisfy, derived from the parsed expression: for every part the
strings it can be, as long as they are few, else what all its matches begin
with, end with and hold.  The index lists, for each trigram that some query
names, the documents that hold it; formulas intersect and unite these lists.
Trigrams are of bytes (UTF-8, A-Z in lower case).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser

import numpy as np

#: Formulas: ALL (no condition), NONE (cannot match), ("tri", bytes), ("and", parts), ("or", parts).
ALL, NONE = ("all",), ("none",)
#: At most so many strings are followed for a part, and so many members of a character class.
FEW, MEMBERS = 64, 16


def both(*parts: tuple) -> tuple:
    flat = {p for x in parts for p in (x[1] if x[0] == "and" else (x,)) if p != ALL}
    if NONE in flat:
        return NONE
    return ALL if not flat else next(iter(flat)) if len(flat) == 1 else ("and", frozenset(flat))


def either(*parts: tuple) -> tuple:
    flat = {p for x in parts for p in (x[1] if x[0] == "or" else (x,)) if p != NONE}
    if ALL in flat:
        return ALL
    return NONE if not flat else next(iter(flat)) if len(flat) == 1 else ("or", frozenset(flat))


def grams_of(s: bytes) -> tuple:
    return both(*(("tri", s[i : i + 3]) for i in range(len(s) - 2)))


def any_of(strings) -> tuple:
    return either(*map(grams_of, strings))


@dataclass(frozen=True)
class Part:
    """What is known of all matches: the strings themselves, or their beginnings, ends and a formula."""

    whole: frozenset[bytes] | None
    starts: frozenset[bytes]
    ends: frozenset[bytes]
    holds: tuple = ALL


_EMPTY = frozenset([b""])
ANYTHING = Part(None, _EMPTY, _EMPTY)


def exactly(strings) -> Part:
    s = frozenset(strings)
    return Part(s, s, s) if len(s) <= FEW else settle(Part(None, s, s, any_of(s)))


def settle(p: Part) -> Part:
    """Keeps beginnings and ends short: two bytes are what a trigram across a seam needs."""
    starts, ends, holds = p.starts, p.ends, p.holds
    if any(len(x) > 2 for x in starts):
        holds, starts = both(holds, any_of(starts)), frozenset(x[:2] for x in starts)
    if any(len(x) > 2 for x in ends):
        holds, ends = both(holds, any_of(ends)), frozenset(x[-2:] for x in ends)
    return Part(None, starts if len(starts) <= FEW else _EMPTY, ends if len(ends) <= FEW else _EMPTY, holds)


def follow(a: Part, b: Part) -> Part:
    """a, then b."""
    if a.whole is not None and b.whole is not None and len(a.whole) * len(b.whole) <= FEW:
        return exactly(x + y for x, y in product(a.whole, b.whole))
    ends, starts = a.whole if a.whole is not None else a.ends, b.whole if b.whole is not None else b.starts
    across = any_of(x + y for x, y in product(ends, starts)) if len(ends) * len(starts) <= FEW * FEW else both(any_of(ends), any_of(starts))
    begin = frozenset(x + y for x, y in product(a.whole, starts)) if a.whole is not None and len(a.whole) * len(starts) <= FEW else a.whole if a.whole is not None else a.starts
    end = frozenset(x + y for x, y in product(ends, b.whole)) if b.whole is not None and len(ends) * len(b.whole) <= FEW else b.whole if b.whole is not None else b.ends
    return settle(Part(None, begin, end, both(a.holds, b.holds, across)))


def choose(parts: list[Part]) -> Part:
    if all(p.whole is not None for p in parts):
        return exactly(x for p in parts for x in p.whole)
    starts = frozenset(x for p in parts for x in (p.whole if p.whole is not None else p.starts))
    ends = frozenset(x for p in parts for x in (p.whole if p.whole is not None else p.ends))
    return settle(Part(None, starts, ends, either(*(any_of(p.whole) if p.whole is not None else p.holds for p in parts))))


def _letters(code: int, ignore: bool) -> set[bytes] | None:
    """Folded bytes of the characters that a literal can stand for; None: not told."""
    c = chr(code)
    if ignore:
        # Beyond ASCII, and for k, s and i, case folding leaves A-Z: not followed.
        if code > 127 or c in "kKsSiI":
            return None
    if 0xD800 <= code <= 0xDFFF:
        return None
    return {c.lower().encode() if code < 128 else c.encode()}


def _class(items, ignore: bool) -> set[bytes] | None:
    out: set[bytes] = set()
    for op, av in items:
        if op is C.LITERAL:
            codes = [av]
        elif op is C.RANGE and av[1] - av[0] < 64:
            codes = range(av[0], av[1] + 1)
        else:
            return None
        for code in codes:
            one = _letters(code, ignore)
            if one is None:
                return None
            out |= one
            if len(out) > MEMBERS:
                return None
    return out


def _walk(tokens, flags: int) -> Part:
    ignore = bool(flags & re.IGNORECASE)
    out = exactly([b""])
    for op, av in tokens:
        if op is C.LITERAL:
            s = _letters(av, ignore)
            part = ANYTHING if s is None else exactly(s)
        elif op is C.IN:
            s = _class(av, ignore)
            part = ANYTHING if s is None else exactly(s)
        elif op is C.BRANCH:
            part = choose([_walk(x, flags) for x in av[1]])
        elif op is C.SUBPATTERN:
            part = _walk(av[3], (flags | av[1]) & ~av[2])
        elif op is C.ATOMIC_GROUP:
            part = _walk(av, flags)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            least, most, inner = av
            one = _walk(inner, flags)
            if most == 0:
                part = exactly([b""])
            elif least == 0 and most == 1:
                part = choose([one, exactly([b""])])
            elif least == 0:
                part = ANYTHING
            else:
                part = one
                for _ in range(min(least, 8) - 1):
                    part = follow(part, one)
                if most != least or least > 8:
                    whole = part.whole
                    # More may follow: beginnings and ends hold, the strings as a whole do not.
                    part = part if whole is None else settle(Part(None, whole, whole))
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            continue
        elif op is C.FAILURE:
            return Part(None, _EMPTY, _EMPTY, NONE)
        else:  # any character, negated classes, back references, conditions
            part = ANYTHING
        out = follow(out, part)
    return out


def query_of(pattern: re.Pattern | str) -> tuple:
    """The formula that every text with a match of a string pattern satisfies; ALL where none is mandatory."""
    text = pattern if isinstance(pattern, str) else pattern.pattern
    parsed = _parser.parse(text, 0 if isinstance(pattern, str) else pattern.flags)
    p = _walk(parsed, parsed.state.flags)
    return any_of(p.whole) if p.whole is not None else both(p.holds, any_of(p.starts), any_of(p.ends))


def trigrams_in(formula: tuple) -> set[bytes]:
    if formula[0] == "tri":
        return {formula[1]}
    return set().union(*(trigrams_in(p) for p in formula[1])) if formula[0] in ("and", "or") else set()


class TrigramIndex:
    """Sorted lists of documents by trigram, over the trigrams that the formulas name."""

    def __init__(self, formulas: list[tuple]):
        self.names = sorted(set().union(*(trigrams_in(f) for f in formulas)) if formulas else set())
        codes = np.array([int.from_bytes(t, "big") for t in self.names], dtype=np.int64)
        self.number = np.full(1 << 24, -1, dtype=np.int16 if len(codes) < 32000 else np.int32)
        self.number[codes] = np.arange(len(codes))
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32
        self.postings: dict[bytes, np.ndarray] = {}
        self.all = np.zeros(0, np.int64)

    def fill(self, data: np.ndarray, offsets: np.ndarray) -> TrigramIndex:
        """Replaces the postings by those of texts laid end to end; offsets: len + 1."""
        n = len(offsets) - 1
        self.all = np.arange(n)
        found = []
        step = 4_000_000
        for a in range(0, max(0, len(data) - 2), step):
            b = self.fold[data[a : a + step + 2]].astype(np.int32)
            t = self.number[(b[:-2] << 16) | (b[1:-1] << 8) | b[2:]]
            at = np.flatnonzero(t >= 0)
            doc = np.searchsorted(offsets, at + a, side="right") - 1
            inside = at + a + 3 <= offsets[doc + 1]
            found.append(np.unique(t[at][inside].astype(np.int64) * max(n, 1) + doc[inside]))
        keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        cuts = np.searchsorted(keys, np.arange(len(self.names) + 1) * max(n, 1))
        self.postings = {name: keys[x:z] - i * max(n, 1) for i, (name, x, z) in enumerate(zip(self.names, cuts[:-1], cuts[1:]))}
        return self

    def ask(self, formula: tuple) -> np.ndarray:
        """Documents that may match, ascending."""
        kind = formula[0]
        if kind == "all":
            return self.all
        if kind == "none":
            return self.all[:0]
        if kind == "tri":
            return self.postings[formula[1]]
        lists = sorted((self.ask(p) for p in formula[1]), key=len)
        out = lists[0]
        for x in lists[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if kind == "and" else np.union1d(out, x)
        return out
