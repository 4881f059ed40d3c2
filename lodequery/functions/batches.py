"""Batches that Spark hands to Python, cut so that a task's work on them stays small."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd

SLICE_CHARS = 1 << 20
SLICE_ROWS = 1024


def slices(batches: Iterator[pd.Series], size: Callable = len) -> Iterator[pd.Series]:
    """All rows in order, in series of at most ``SLICE_ROWS`` rows and about ``SLICE_CHARS`` characters.

    A batch has up to 10,000 texts of any length; what is made of them would be several times as large at once.
    """
    for batch in batches:
        start = total = 0
        for i, x in enumerate(batch):
            n = 0 if x is None else size(x)
            if i > start and (total + n > SLICE_CHARS or i - start >= SLICE_ROWS):
                yield batch.iloc[start:i]
                start, total = i, 0
            total += n
        yield batch.iloc[start:]
