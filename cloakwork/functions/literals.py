"""Many literals in one pass over a text, with Aho-Corasick automata in Arrow workers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import ahocorasick

# Letters that a case-insensitive pattern takes for one another although their case folding is not one letter.
SAME_LETTER = {"\u0130": "i", "\u0131": "i", "\u1fd3": "\u0390", "\u1fe3": "\u03b0", "\ufb05": "\ufb06"}
# End of fixed values.


@lru_cache(maxsize=1 << 16)
def _fold_letter(c: str) -> str:
    if c in SAME_LETTER:
        return SAME_LETTER[c]
    return next((f for f in (c.casefold(), c.lower()) if len(f) == 1), c)


@lru_cache(maxsize=1 << 16)
def _lowers(c: str) -> bool:
    """Whether lower() folds this letter, wherever it stands (a sigma's lower case depends on its place)."""
    return c != "\u03a3" and c.lower() == _fold_letter(c)


def fold(text: str) -> str:
    """``text`` with letters of one case class made equal, one for one; coarser than lower() and than patterns without case."""
    if text.isascii() or all(map(_lowers, set(text))):
        return text.lower()
    return "".join(map(_fold_letter, text))


class Literals:
    """Finds of many literals, overlapping ones included; ``entries`` are (literal, anything)."""

    def __init__(self, entries: Iterable[tuple[str, object]]):
        self.found = ahocorasick.Automaton()
        held: dict[str, list] = {}
        for literal, item in entries:
            if literal:
                held.setdefault(literal, []).append(item)
        for literal, items in held.items():
            self.found.add_word(literal, (len(literal), items))
        if held:
            self.found.make_automaton()
        self.any = bool(held)

    def finds(self, text: str) -> Iterator[tuple[int, int, list]]:
        """(start, length, items) by end."""
        if self.any:
            for end, (n, items) in self.found.iter(text):
                yield end + 1 - n, n, items


class RuleMatcher:
    """Rules (k, from, to, category, id, case-insensitive) in order ``k``; the longest at each place, left to right."""

    def __init__(self, rules: Iterable[tuple]):
        rules = list(rules)
        self.exact = Literals((r[1], r) for r in rules if not r[5])
        self.loose = Literals((fold(r[1]), r) for r in rules if r[5])

    def finds(self, text: str) -> Iterator[tuple[int, int, int, str, str, str]]:
        """(start, length, k, to, category, id) of every place where a rule holds, of several the first at a start and length."""
        best: dict[tuple[int, int], tuple] = {}
        for start, n, rules in self.exact.finds(text):
            best[start, n] = min(rules, key=lambda r: r[0])
        if self.loose.any:
            for start, n, rules in self.loose.finds(fold(text)):
                low = text[start : start + n].lower()
                held = [r for r in rules if r[1].lower() == low]
                if (start, n) in best:
                    held.append(best[start, n])
                if held:
                    best[start, n] = min(held, key=lambda r: r[0])
        for (start, n), r in best.items():
            yield start, n, r[0], r[2], r[3], r[4]


def leftmost_longest(finds: Iterable[tuple]) -> Iterator[tuple]:
    """Of finds (start, length, rank, ...) those that a scan from left to right takes, the longest at each start, then the least rank."""
    at = 0
    for find in sorted(finds, key=lambda f: (f[0], -f[1], f[2])):
        if find[0] >= at:
            at = find[0] + find[1]
            yield find


def overlaps_itself(word: str) -> bool:
    """Whether two finds of a word can overlap: it ends as it begins."""
    k = word.find(word[0], 1)
    while k > 0 and not word.startswith(word[k:]):
        k = word.find(word[0], k + 1)
    return k > 0


@lru_cache(maxsize=1 << 14)
def whole_word(literal: str) -> re.Pattern:
    """The literal between word borders, in any case."""
    return re.compile(rf"(?i)\b{re.escape(literal)}\b")


@lru_cache(maxsize=1 << 14)
def same_in_any_case(literal: str) -> re.Pattern:
    return re.compile(rf"(?i)^{re.escape(literal)}$")


def worker_cache(make: Callable[[], object], key: object, _held: dict = {}) -> object:  # noqa: B006
    """What ``make`` gives, kept for the last key that this Python worker was asked for."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]
