"""Search in names by an index of their three-letter runs.

A regular expression can match only names that hold all three-letter runs its literal parts need, so
these select candidates by a join on the run, and the expression itself is tried on the candidates
alone. An expression that needs no such run, as ``.*`` or ``ab``, falls back to the scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.operators.serving import search_items

GRAM = 3
_QUANTIFIERS = "*+?{"


def grams_of(name: Column) -> Column:
    """Different three-letter runs of the lower-cased name; none for a shorter one."""
    low = F.lower(name)
    places = F.when(F.length(low) >= GRAM, F.sequence(F.lit(1), F.length(low) - (GRAM - 1)))
    return F.array_distinct(F.transform(places, lambda i: F.substring(low, i, GRAM)))


def name_index(items: DataFrame) -> DataFrame:
    """``(gram, gmap_id)``, to be written once and read by search."""
    return items.select(F.explode(grams_of(F.col("name"))).alias("gram"), "gmap_id").distinct()


def required_runs(pattern: str) -> list[set[str]] | None:
    """For each alternative of the expression the runs that a match must hold; None if one needs none.

    Literals, escaped signs and anchors are understood. A group, a class or a quantifier ends a literal,
    an alternative in a group leaves no literal from the group on; whatever is not understood needs nothing.
    """
    if re.search(r"\(\?|\\[QEpPukxc0-9]", pattern):
        return None
    alternatives: list[list[str]] = [[""]]
    depth = at = 0

    def end() -> None:
        if alternatives[-1][-1]:
            alternatives[-1].append("")

    while at < len(pattern):
        c = pattern[at]
        after = pattern[at + 1 : at + 2]
        if c == "\\":
            # a class such as \d, or a sign taken as it is
            literal, at = (after if after and not after.isalnum() else None), at + 2
        elif c == "[":
            close = pattern.find("]", at + 2 if after not in ("^",) else at + 3)
            if close < 0 or "[" in pattern[at + 1 : close] or "&&" in pattern[at + 1 : close] or "\\" in pattern[at + 1 : close]:
                return None
            literal, at = None, close + 1
        elif c in "()":
            depth += 1 if c == "(" else -1
            literal, at = None, at + 1
        elif c == "|":
            at += 1
            if depth == 0:
                alternatives.append([""])
            end()
            continue
        elif c in "^$":
            end()
            at += 1
            continue
        elif c in _QUANTIFIERS:
            # a quantified sign may be missing or repeat
            end()
            at = pattern.find("}", at) + 1 if c == "{" else at + 1
            if at == 0:
                return None
            continue
        else:
            literal, at = (None if c == "." else c), at + 1
        if literal is None or depth > 0:
            end()
        elif pattern[at : at + 1] and pattern[at] in _QUANTIFIERS:
            end()
            if pattern[at] == "+":  # there at least once, but what follows may not be next to it
                alternatives[-1][-1] += literal
                end()
        else:
            alternatives[-1][-1] += literal
    # a lower-case sign may be longer or shorter than its upper one: only ASCII is required
    runs = [
        {low[i : i + GRAM] for run in found for low in [run.lower()] for i in range(len(low) - GRAM + 1) if low[i : i + GRAM].isascii()}
        for found in alternatives
    ]
    return runs if depth == 0 and all(runs) else None


def indexed_search(items: DataFrame, index: DataFrame, pattern: str = "") -> DataFrame:
    """The items ``search_items`` gives, by way of the index where the expression allows it."""
    runs = required_runs(pattern) if pattern else None
    if runs is None:
        return search_items(items, pattern)
    # one condition per alternative over the runs an item has of those in question
    asked = sorted(set().union(*runs))
    held = index.where(F.col("gram").isin(asked)).groupBy("gmap_id").agg(F.collect_set("gram").alias("held"))
    fits = None
    for needed in runs:
        one = F.size(F.array_intersect("held", F.array(*[F.lit(g) for g in sorted(needed)]))) == len(needed)
        fits = one if fits is None else fits | one
    return search_items(items.join(held.where(fits).select("gmap_id"), "gmap_id", "left_semi"), pattern)
