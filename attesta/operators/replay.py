"""Replays in order: rows of one key as a stream, whatever their number."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BATCH = 10_000


def in_order(rows: DataFrame, keys: list[str], order: list[str], schema: T.StructType, of_key: Callable[[Iterator[tuple]], Iterable[tuple]]) -> DataFrame:
    """What ``of_key`` makes of the rows of each key, which come to it in order, one at a time.

    Rows of a key go to one task, are sorted there by Spark, which spills, and
    stream through; only what ``of_key`` itself keeps is held.
    """
    n, arrow = len(keys), to_arrow_schema(schema)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    def run(batches):
        given = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        out: list[tuple] = []
        for _, group in groupby(given, key=lambda row: row[:n]):
            for x in of_key(group):
                out.append(x)
                if len(out) == BATCH:
                    yield batch(out)
                    out = []
        if out:
            yield batch(out)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
