"""Distances between two sparse vectors, as functions of sums over their common items.

For vectors a and b: ``dot`` = sum of a*b, ``a2`` and ``b2`` = sums of squares, all over the items both
have; ``full_a2`` and ``full_b2`` = sums of squares over all items of each. One formula serves Spark
columns and NumPy arrays alike; ``greatest`` is the larger of two in either.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, NamedTuple


class Sums(NamedTuple):
    dot: Any
    a2: Any
    b2: Any
    full_a2: Any = None
    full_b2: Any = None


@dataclass(frozen=True)
class Distance:
    formula: Callable[[Sums, Callable], Any]
    absent: float | None  # distance of a pair without common item; None: the formula says it
    full_norms: bool = False


# Cosine times one minus the relative difference of the norms. With m and n the smaller and the larger
# norm that is dot/(m*n) * (1 - (n-m)/n) = dot/n^2, so the larger sum of squares is all it takes.
MASKED_COSINE = Distance(lambda s, greatest: 1 - s.dot / greatest(s.a2, s.b2), absent=1.0)
FULL_NORM_COSINE = Distance(
    lambda s, greatest: 1 - s.dot / greatest(s.full_a2, s.full_b2), absent=1.0, full_norms=True
)
COSINE = Distance(
    lambda s, greatest: 1 - s.dot / (s.full_a2 * s.full_b2) ** 0.5, absent=1.0, full_norms=True
)
SQUARED_EUCLIDEAN = Distance(
    lambda s, greatest: s.full_a2 + s.full_b2 - 2 * s.dot, absent=None, full_norms=True
)
