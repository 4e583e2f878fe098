"""Boolean trigram queries that every match of a regular expression has to satisfy."""

from __future__ import annotations

import re._constants as C
import re._parser as parser

#: Alternative strings followed at the same time.
MOST = 48
#: Query: every one of these runs must hold; a run holds if all trigrams of one of its alternatives are there.
Query = list[list[frozenset[str]]]


def _strings(item: tuple) -> set[str] | None:
    """All strings that one item of a parsed expression matches, or None if they are unknown or too many."""
    kind, value = item
    if kind is C.LITERAL:
        return {chr(value)}
    if kind is C.IN:
        found = set()
        for k, v in value:
            if k is C.LITERAL:
                found.add(chr(v))
            elif k is C.RANGE and v[1] - v[0] < 8:
                found |= {chr(x) for x in range(v[0], v[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    if kind is C.SUBPATTERN:
        return _all(value[-1])
    if kind is C.BRANCH:
        found = [_all(b) for b in value[1]]
        return set().union(*found) if all(f is not None for f in found) else None
    if kind in (C.MAX_REPEAT, C.POSSESSIVE_REPEAT) and value[1] <= 3:
        inner = _all(value[2])
        if inner is None:
            return None
        out, level = (set() if value[0] else {""}), {""}
        for n in range(1, int(value[1]) + 1):
            level = {a + b for a in level for b in inner}
            if n >= value[0]:
                out |= level
        return out
    return None


def _all(items) -> set[str] | None:
    out = {""}
    for item in items:
        found = _strings(item)
        if found is None or len(out) * len(found) > MOST:
            return None
        out = {a + b for a in out for b in found}
    return out


def _needed(strings: set[str]) -> list[frozenset[str]] | None:
    """Trigrams of every alternative, or None if one of them has none."""
    grams = {frozenset(s[i: i + 3] for i in range(len(s) - 2)) for s in strings}
    if not all(grams):
        return None
    # an alternative that needs more than another adds nothing
    return sorted((g for g in grams if not any(h < g for h in grams)), key=sorted)


def query(pattern: str) -> Query:
    """The query of a regular expression, in lower case; empty if no trigram is mandatory."""
    out: Query = []

    def close(run: set[str]) -> None:
        if (need := _needed({s.lower() for s in run})) is not None and need not in out:
            out.append(need)

    def walk(items) -> None:
        run = {""}
        for item in items:
            found = _strings(item)
            if found is not None and len(run) * len(found) <= MOST:
                run = {a + b for a in run for b in found}
                continue
            close(run)
            run = found if found is not None else {""}
            if found is None:
                if item[0] is C.SUBPATTERN:
                    walk(item[1][-1])
                elif item[0] in (C.MAX_REPEAT, C.POSSESSIVE_REPEAT) and item[1][0] > 0:
                    walk(item[1][2])
        close(run)

    walk(parser.parse(pattern))
    return out
