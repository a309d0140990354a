"""Streams.

No operator here keeps state, has a watermark or a window over time. The row-wise
functions (predicates, feature algebra, similarity to a fixed vector, min-max
scaling, model scoring) run unchanged on a streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def apply_rowwise(stream: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Chain row-wise transformations over a stream."""
    if not stream.isStreaming:
        raise ValueError("the table is not a stream")
    for step in steps:
        stream = stream.transform(step)
    return stream
