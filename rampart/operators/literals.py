"""Literals that every match of a regex must hold, taken from its parse tree."""

from __future__ import annotations

import re
from functools import lru_cache
from re import _constants as op
from re import _parser as parser

#: Sets of alternatives grow by products up to here; beyond it a part counts as open.
MOST = 32
_COMMON = " .,\n\t"
_REPEATS = (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT)


def _exact(kind, arg) -> set[str] | None:
    """All texts that a part of the tree can stand for, if they are few."""
    if kind is op.LITERAL:
        return {chr(arg)}
    if kind is op.AT:
        return {""}
    if kind is op.IN and all(k is op.LITERAL for k, _ in arg):
        return {chr(a) for _, a in arg}
    if kind is op.SUBPATTERN:
        return _exact_run(arg[-1]) if not arg[1] and not arg[2] else None
    if kind is op.BRANCH:
        each = [_exact_run(a) for a in arg[1]]
        return None if any(e is None for e in each) else _few(set().union(*each))
    if kind in _REPEATS and tuple(arg[:2]) == (0, 1):
        once = _exact_run(arg[2])
        return None if once is None else _few(once | {""})
    return None


def _few(texts: set[str]) -> set[str] | None:
    return texts if len(texts) <= MOST else None


def _exact_run(items) -> set[str] | None:
    out: set[str] | None = {""}
    for kind, arg in items:
        part = _exact(kind, arg)
        out = None if part is None else _few({a + b for a in out for b in part})
        if out is None:
            return None
    return out


def _needed(items) -> set[str] | None:
    """The best set of texts one of which is in every match of a run, or None."""
    found: list[set[str]] = []
    run = {""}
    for kind, arg in items:
        part = _exact(kind, arg)
        longer = None if part is None else _few({a + b for a in run for b in part})
        if longer is not None:
            run = longer
            continue
        found.append(run)
        run = part or {""}
        if part is not None:
            continue
        inner = None
        if kind is op.SUBPATTERN and not arg[1] and not arg[2]:
            inner = _needed(arg[-1])
        elif kind is op.BRANCH:
            each = [_needed(a) for a in arg[1]]
            inner = None if any(e is None for e in each) else set().union(*each)
        elif kind in _REPEATS and arg[0] >= 1:
            inner = _needed(arg[2])
        if inner is not None:
            found.append(inner)
    found.append(run)
    worth = [(min(len(t.strip(_COMMON)) for t in texts), -len(texts), sorted(texts)) for texts in found]
    worth = [w for w in worth if w[0] > 0]
    return set(max(worth)[2]) if worth else None


@lru_cache(maxsize=10_000)
def required(regex: str) -> tuple[str, ...]:
    """Texts one of which is in every text that the regex matches (case counts).

    Empty where there are none, where flags in the regex change how its letters are read, and where it has syntax that
    is not read alike everywhere (classes within classes, escapes of other dialects).
    """
    if regex.isalnum():
        return (regex,)
    if re.search(r"&&|\[[^\]]*\[", regex):
        return ()
    try:
        tree = parser.parse(regex)
    except re.error:
        return ()
    if tree.state.flags & (re.IGNORECASE | re.VERBOSE):
        return ()
    texts = _needed(tree) or set()
    return tuple(sorted(t for t in texts if not any(o != t and o in t for o in texts)))


#: Stands for all characters from here on, among those that a match can start with.
_HIGH = 128
_KINDS = {
    op.CATEGORY_DIGIT: {*range(48, 58), _HIGH}, op.CATEGORY_SPACE: {*range(9, 14), *range(28, 33), _HIGH},
    op.CATEGORY_WORD: {*range(48, 58), *range(65, 91), 95, *range(97, 123), _HIGH},
}


def _member(kind, arg) -> set[int] | None:
    if kind is op.LITERAL:
        return {min(arg, _HIGH)}
    if kind is op.RANGE:
        return {min(c, _HIGH) for c in range(arg[0], min(arg[1], _HIGH) + 1)} | ({_HIGH} if arg[1] >= _HIGH else set())
    return _KINDS.get(arg) if kind is op.CATEGORY else None


def _start(kind, arg) -> tuple[set[int], bool] | None:
    """What a part of the tree can start with, and whether it can be empty."""
    if kind is op.LITERAL:
        return {min(arg, _HIGH)}, False
    if kind is op.IN:
        each = [_member(*m) for m in arg]
        return None if any(e is None for e in each) else (set().union(*each), False)
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return set(), True
    if kind is op.SUBPATTERN:
        return _start_run(arg[-1]) if not arg[1] and not arg[2] else None
    if kind is op.BRANCH:
        runs = [_start_run(a) for a in arg[1]]
        return None if any(r is None for r in runs) else (set().union(*(r[0] for r in runs)), any(r[1] for r in runs))
    if kind in _REPEATS:
        once = _start_run(arg[2])
        return once and (once[0], once[1] or arg[0] == 0)
    return None


def _start_run(items) -> tuple[set[int], bool] | None:
    out: set[int] = set()
    for kind, arg in items:
        part = _start(kind, arg)
        if part is None:
            return None
        out |= part[0]
        if not part[1]:
            return out, False
    return out, True


@lru_cache(maxsize=None)
def guarded(regex: str) -> str:
    """The regex behind a look at the character it has to start with, so that other places cost one look and not a try of
    each alternative. Matches are the same. As it is where that can't be told."""
    if re.search(r"&&|\[[^\]]*\[|\\v", regex):
        return regex
    try:
        tree = parser.parse(regex)
    except re.error:
        return regex
    start = None if tree.state.flags & (re.IGNORECASE | re.VERBOSE) else _start_run(tree)
    if start is None or start[1]:
        return regex
    chars = "".join(f"\\x{c:02x}" for c in sorted(start[0] - {_HIGH})) + ("\\x{80}-\\x{10ffff}" if _HIGH in start[0] else "")
    return f"(?=[{chars}])(?:{regex})"
