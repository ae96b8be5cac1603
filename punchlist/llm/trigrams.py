"""Boolean trigram queries from regular expressions.

A query is a set of alternatives, each a set of trigrams that a match must all contain: a text can match only if it holds
every trigram of some alternative. Trigrams are taken in lower case, as the index folds A-Z. ``{frozenset()}`` says nothing,
so its rule has to scan every text.
"""

from __future__ import annotations

from itertools import product
from re import _constants as K
from re import _parser as parser

MAX_STRINGS, MAX_ALTERNATIVES = 64, 64
ANYTHING: frozenset = frozenset([frozenset()])


def _all(*queries: frozenset) -> frozenset:
    out = ANYTHING
    for q in queries:
        joined = frozenset(a | b for a, b in product(out, q))
        out = joined if len(joined) <= MAX_ALTERNATIVES else out
    return out


def _any(queries) -> frozenset:
    out = frozenset().union(*queries)
    if frozenset() in out or len(out) > MAX_ALTERNATIVES:
        return ANYTHING
    return frozenset(a for a in out if not any(b < a for b in out))


def _of_strings(strings: frozenset) -> frozenset:
    return _any(frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]) for s in strings)


def _class(items) -> frozenset | None:
    chars: set[str] = set()
    for op, arg in items:
        if op is K.LITERAL:
            chars.add(chr(arg).lower())
        elif op is K.RANGE and arg[1] - arg[0] < 4:
            chars |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return frozenset(chars) if len(chars) <= 4 else None


def _sequence(nodes) -> tuple[frozenset | None, frozenset]:
    """The strings that the nodes match, if they are few, and the query that any match satisfies."""
    done, run, exact = [], frozenset([""]), True
    for op, arg in nodes:
        strings, query = _node(op, arg)
        if strings is not None and len(run) * len(strings) <= MAX_STRINGS:
            run = frozenset(a + b for a, b in product(run, strings))
            continue
        exact = False
        done += [_of_strings(run), query]
        run = strings if strings is not None else frozenset([""])
    return (run if exact else None), _all(*done, _of_strings(run))


def _node(op, arg) -> tuple[frozenset | None, frozenset]:
    if op is K.LITERAL:
        return frozenset([chr(arg).lower()]), ANYTHING
    if op is K.IN:
        return _class(arg), ANYTHING
    if op is K.SUBPATTERN:
        return _sequence(arg[-1])
    if op is K.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        exact = all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= MAX_STRINGS
        return (frozenset().union(*(s for s, _ in parts)) if exact else None), _any(q for _, q in parts)
    if op in (K.MAX_REPEAT, K.MIN_REPEAT):
        least, most, inner = arg
        strings, query = _sequence(inner)
        if strings is not None and most == 1:
            return (strings | {""} if least == 0 else strings), ANYTHING
        if strings is not None and least == most and len(strings) ** least <= MAX_STRINGS:
            return frozenset("".join(x) for x in product(strings, repeat=least)), ANYTHING
        return None, (query if least else ANYTHING)
    return None, ANYTHING


def trigram_query(pattern: str) -> frozenset:
    return _sequence(parser.parse(pattern))[1]
