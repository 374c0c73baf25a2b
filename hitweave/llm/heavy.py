"""Sums of counts, and the most frequent rows of a table of counts, bounded in number, so that they can be broadcast."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Classes of counts for each doubling.
STEPS = 16


def most_frequent(counts: DataFrame, limit: int, n: str = "n") -> DataFrame:
    """The rows of `counts` whose count lies in the highest classes that have at most `limit` rows together.

    Classes are counts between neighbouring powers of 2 ** (1 / 16); only how many rows
    each class has, some thousand numbers at most, comes to the driver. What is left out
    has to be looked up by a join.
    """
    level = F.floor(F.log2(F.col(n).cast("double")) * STEPS)
    sizes = sorted(((r[0], r[1]) for r in counts.groupBy(level).count().collect()), reverse=True)
    least, total = None, 0
    for k, rows in sizes:
        total += rows
        if total > limit:
            break
        least = k
    return counts.where(level >= least) if least is not None else counts.where(F.lit(False))


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, sorted, and their sums."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(n, first)
