"""Linear-time patterns for fragments cut by literals with anything in between.

A chain ``t0 -> t1 -> ... -> tn`` means: the first ``t0``, then the first ``t1``
after it, and so on.  Backtracking engines go exponential on the plain lazy
form; here every step is atomic and the search is anchored, so a page is read
once however it is written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def chain_pattern(tokens: Sequence[str]) -> str:
    """Group 1 is the text before the fragment, group 2 the fragment."""
    first, *rest = tokens
    steps = "".join(f"(?>.*?{token})" for token in rest)
    return rf"(?s)\A((?>.*?(?={first})))({first}{steps})"


def _fragment(column: Column, pattern: str, group: int) -> Column:
    """Group of the only possible match, or null; unlike an extract with a null test it runs once."""
    return F.get(F.regexp_extract_all(column, F.lit(pattern), F.lit(group)), 0)


def first_chain(column: Column, chains: Sequence[Sequence[str]]) -> Column:
    """Fragment of the first chain that matches, or null."""
    return F.coalesce(*[_fragment(column, chain_pattern(c), 2) for c in chains])


def leftmost_chain(column: Column, chains: Sequence[Sequence[str]]) -> Column:
    """Fragment that starts first, whichever chain it belongs to, or null."""
    options = []
    for chain in chains:
        pattern = chain_pattern(chain)
        start = F.length(_fragment(column, pattern, 1))
        options.append(F.struct(start.alias("start"), _fragment(column, pattern, 2).alias("fragment")))
    found = F.filter(F.array(*options), lambda o: o["start"].isNotNull())
    return F.array_min(found).getField("fragment")
