"""Row filters in Python that keep every column and shuffle nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

ROWS = 256


def keep_rows(docs: DataFrame, text_col: str, judge: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """The rows of ``docs`` that ``judge``, given some texts, says to keep; few texts are Python strings at once."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                yield part.filter(pa.array(judge(part.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
