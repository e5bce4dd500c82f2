"""Values bound once inside expressions and first-match ladders over them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``.

    The one-element ``transform`` also keeps a very long body out of generated code, whose methods would otherwise
    grow past the size the JIT compiles.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def any_of(parts: tuple[str, ...]) -> str:
    """Pattern that matches when one of the literal parts occurs."""
    return "|".join(re.escape(part) for part in parts)


def first_match(text: Column, ladder: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """Name of the first ladder entry one of whose parts occurs in ``text``; NULL when none does."""

    def body(t: Column) -> Column:
        cases = F.when(t.rlike(any_of(ladder[0][1])), ladder[0][0])
        for name, parts in ladder[1:]:
            cases = cases.when(t.rlike(any_of(parts)), name)
        return cases

    return let(text, body)


def guarded_rlike(text: Column, pattern: str) -> Column:
    """``rlike`` behind a plain substring test when the pattern starts with a fixed word.

    The substring search is many times cheaper per character, and most texts fail it.
    """
    head = re.match(r"\\b([a-z]{4,})(?![a-z?*])", pattern)
    hit = text.rlike(pattern)
    return text.contains(head.group(1)) & hit if head else hit
