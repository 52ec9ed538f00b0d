"""Conditions on a text column, written once and turned into a Spark column or into DuckDB SQL.

Expressions are written with two abbreviations: a blank stands for white space of any length, and
``~`` for a word boundary. ``(?U)`` makes Java's classes those of Unicode.
"""

from __future__ import annotations

import re
import re._constants as K
import re._parser as parser
from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def expand(short: str) -> str:
    return short.replace(" ", r"\s+").replace("~", r"\b").replace("␣", " ")


# ---------------------------------------------------------------- literals that an expression needs
MOST_LITERALS = 64
#: Of squeezed texts fewer, as words that hold blanks are rare each, but many to look for.
MOST_SQUEEZED = 12
#: More words than these are looked for by one expression.
MANY_WORDS = 64


#: White space of any length, parsed.
_RUN = (1, K.MAXREPEAT), [(K.IN, [(K.CATEGORY, K.CATEGORY_SPACE)])]


def _exact(tree, squeezed: bool = False) -> set[str] | None:
    """All texts that a parsed expression matches, if they are few literals; in ``squeezed`` texts white space is one blank."""
    out = {""}
    for op, value in tree:
        if op is K.LITERAL:
            more: set[str] | None = {chr(value).lower()}
        elif op is K.SUBPATTERN:
            more = _exact(value[3], squeezed)
        elif op is K.BRANCH:
            parts = [_exact(b, squeezed) for b in value[1]]
            more = set().union(*parts) if all(p is not None for p in parts) else None
        elif op is K.MAX_REPEAT and value[:2] == (0, 1):
            more = _exact(value[2], squeezed)
            more = more | {""} if more is not None else None
        elif squeezed and op is K.MAX_REPEAT and (value[:2], list(value[2])) == _RUN:
            more = {" "}
        elif op is K.AT:
            more = {""}
        else:
            return None
        if more is None or len(out) * len(more) > (MOST_SQUEEZED if squeezed else MOST_LITERALS):
            return None
        out = {_join(a, b) for a in out for b in more}
    return out


def _join(a: str, b: str) -> str:
    return a + (b.removeprefix(" ") if a.endswith(" ") else b)


def _least(words: set[str]) -> set[str]:
    """Without words that hold another one."""
    return {w for w in words if not any(o != w and o in w for o in words)}


def _needed(tree, squeezed: bool = False) -> list[set[str]]:
    """Sets of words; each match holds at least one word of every set."""
    out, run = [], {""}

    def offer(words: set[str]) -> None:
        if words and "" not in words and len(words := _least(words)) <= MOST_LITERALS:
            out.append(words)

    for op, value in tree:
        exact = _exact([(op, value)], squeezed)
        if exact is not None and len(run) * len(exact) <= (MOST_SQUEEZED if squeezed else MOST_LITERALS):
            run = {_join(a, b) for a in run for b in exact}
            continue
        offer(run)
        run = exact if exact is not None else {""}
        if exact is not None:
            continue
        if op is K.SUBPATTERN:
            out += _needed(value[3], squeezed)
        elif op is K.BRANCH:
            parts = [_needed(branch, squeezed) for branch in value[1]]
            if all(parts):
                offer(set().union(*(max(p, key=_worth) for p in parts)))
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and value[0] >= 1:
            out += _needed(value[2], squeezed)
    offer(run)
    return out


def _worth(words: set[str]) -> tuple:
    shortest = min(len(w) for w in words)
    return shortest >= 3, -len(words), shortest


@cache
def needed(pattern: str, squeezed: bool = False) -> tuple[tuple[str, ...], ...]:
    """Sets of words in lower case: every match of the expression (in ``squeezed`` texts: where it stands there) holds at least one word of each set."""
    found = sorted({tuple(sorted(w)) for w in _needed(parser.parse(pattern), squeezed)}, key=lambda w: _worth(set(w)), reverse=True)
    return tuple([w for w in found if min(map(len, w)) >= 3][:3] or found[:1])


def folded(c: Column) -> Column:
    """What ``Rx.within`` looks for words in: two texts alike but for case, as expressions see it, fold alike."""
    return F.lower(F.upper(c))


def plain(c: Column) -> Column:
    """What ``Rx.plainly`` looks at: the text in lower case, its characters beyond ASCII as one of ASCII each.

    ``L`` stands for letters, 0 for digits, a blank or (where lines end) a return for white space, delete for others:
    expressions of ASCII that ignore case can't tell them from what they stand for, and need no classes of Unicode.
    """
    text = F.lower(F.translate(c, "ſKıİ", "skii"))  # the only others that are letters of ASCII but for case
    for kind, stands in ((r"\d", "0"), (r"\w", "L"), (r"[\x{85}\x{2028}\x{2029}]", "\r"), (r"\s", " "), (r"[^\x00-\x7f]", "\x7f")):
        text = F.regexp_replace(text, rf"(?U)[[^\x00-\x7f]&&{kind}]", stands)
    return F.when(c.rlike(r"[^\x00-\x7f]"), text).otherwise(F.lower(c))


def squeezed(p: Column) -> Column:
    """A ``plain`` text with one blank for white space of any length; what it needs of words is looked for in it."""
    return F.when(p.rlike("[\t-\r]|  "), F.regexp_replace(p, r"\s+", " ")).otherwise(p)


def literals(words: tuple[str, ...]) -> Column:
    """A constant array of words; one literal, whatever their number."""
    return F.split(F.lit("\x1f".join(words)), "\x1f")


@cache
def any_of(words: tuple[str, ...]) -> str:
    """An expression for texts that hold any of the words; places are told by their first letters, not word by word."""
    return _branches(sorted(_least(set(words))))


def _branches(words: list[str]) -> str:
    firsts = sorted({w[0] for w in words})
    if len(words) == 1:
        return re.escape(words[0])
    if len(firsts) == 1:
        rest = [w[1:] for w in words]
        return re.escape(firsts[0]) + (f"(?:{_branches(rest)})" if all(rest) else "")
    among = "(?=[" + "".join(map(re.escape, firsts)) + "])"
    half = firsts[len(firsts) // 2]
    parts = [[w for w in words if w[0] < half], [w for w in words if w[0] >= half]] if len(firsts) > 4 else [[w for w in words if w[0] == f] for f in firsts]
    return among + "(?:" + "|".join(map(_branches, parts)) + ")"


def has_any(c: Column, words: tuple[str, ...]) -> Column:
    if len(words) > MANY_WORDS:
        return c.rlike(any_of(words))  # one pass for all words
    if len(words) > 3:
        return let(c, lambda x: F.exists(literals(words), lambda w: F.contains(x, w)))  # else ``c`` would be computed for each word
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in words))


def holds(c: Column, sets: tuple[tuple[str, ...], ...]) -> Column:
    """Whether a text holds a word of each set; true without sets."""
    return reduce(lambda a, b: a & b, (has_any(c, words) for words in sets), F.lit(True))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def once(c: Column) -> Column:
    """``c``, computed once for the row: filters and later columns read its value and don't repeat it.

    A generator of one row, which the optimizer neither pushes predicates through nor inlines.
    """
    return F.explode(F.array(c))


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value of ``c``, which is computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(c), body), 1)


def _lowered(pattern: str) -> str:
    """An expression in lower case, but for its classes."""
    return "".join(x if x.startswith("\\") else x.lower() for x in re.findall(r"\\.|.", pattern, re.S))


class Condition:
    def column(self, c: Column) -> Column:
        raise NotImplementedError

    def sql(self, name: str) -> str:
        raise NotImplementedError

    def __or__(self, other: Condition) -> Condition:
        return _Joined("or", self, other)

    def __and__(self, other: Condition) -> Condition:
        return _Joined("and", self, other)


class _Joined(Condition):
    def __init__(self, how: str, *parts: Condition):
        self.how, self.parts = how, parts

    def column(self, c: Column) -> Column:
        return reduce(lambda a, b: (a | b) if self.how == "or" else (a & b), (p.column(c) for p in self.parts))

    def sql(self, name: str) -> str:
        return "(" + f" {self.how} ".join(p.sql(name) for p in self.parts) + ")"


class Has(Condition):
    """Some of the words occurs."""

    def __init__(self, *words: str):
        self.words = words

    def column(self, c: Column) -> Column:
        return has_any(c, self.words)

    def sql(self, name: str) -> str:
        return "(" + " or ".join(f"contains({name}, {quoted(w)})" for w in self.words) + ")"


class All(Condition):
    """Every word occurs."""

    def __init__(self, *words: str):
        self.words = words

    def column(self, c: Column) -> Column:
        return reduce(lambda a, b: a & b, (F.contains(c, F.lit(w)) for w in self.words))

    def sql(self, name: str) -> str:
        return "(" + " and ".join(f"contains({name}, {quoted(w)})" for w in self.words) + ")"


class Rx(Condition):
    """An expression matches somewhere."""

    def __init__(self, short: str, flags: str = ""):
        self.pattern, self.flags = expand(short), flags

    def java(self) -> str:
        return f"(?U{self.flags}{'d' if 'm' in self.flags else ''})" + self.pattern

    def column(self, c: Column) -> Column:
        return self.within(c, c)

    def within(self, c: Column, fold: Column) -> Column:
        """As ``column``, but the expression is only tried where ``fold`` (``folded(c)``, or ``c`` itself where case counts) holds a word that it needs."""
        words = needed(self.pattern)
        if fold is c and "i" in self.flags or not words:
            return c.rlike(self.java())
        return holds(fold, words) & c.rlike(self.java())

    def plainly(self, p: Column, q: Column) -> Column:
        """As ``column``, for an expression of ASCII that ignores case, by what ``plain`` (p) and ``squeezed`` (q) make of the text."""
        flags, pattern = self.flags.replace("i", ""), _lowered(self.pattern)
        assert "i" in self.flags and pattern.isascii(), self.pattern
        head = f"(?{flags}d)" if "m" in flags else f"(?{flags})" if flags else ""
        ok = p.rlike(head + pattern)
        if "m" in flags and parser.parse(pattern)[0] == (K.AT, K.AT_BEGINNING):
            # tried once where the text begins (where nothing forbids a match, none of the other places is looked at), and at its other lines if there are any
            ok = ~p.rlike(head + rf"\A(?!{pattern[1:]})") | (F.contains(p, F.lit("\n")) & ok)
        return holds(q, needed(self.pattern, True)) & ok

    def sql(self, name: str) -> str:
        return f"regexp_matches({name}, {quoted((f'(?{self.flags})' if self.flags else '') + self.pattern)})"


def case(rules: list[tuple[Condition, str]], default: str | None, c: Column) -> Column:
    out = F.when(rules[0][0].column(c), rules[0][1])
    for condition, value in rules[1:]:
        out = out.when(condition.column(c), value)
    return out.otherwise(F.lit(default))


def case_sql(rules: list[tuple[Condition, str]], default: str | None, name: str) -> str:
    return "case " + " ".join(f"when {c.sql(name)} then {quoted(v)}" for c, v in rules) + f" else {quoted(default) if default is not None else 'null'} end"
