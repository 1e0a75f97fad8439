"""Rows that a generator makes from a table, appended to it.

A generator is a Python table function: ``eval`` gets a partition's rows in order, one by one, and yields rows of the
table's own columns; ``terminate`` may yield more. It keeps what it needs of the rows seen, so its memory is its own
state and not the partition; Spark partitions and sorts the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T


class First:
    """A partition's first row again."""

    def __init__(self):
        self.done = False

    def eval(self, row: Row) -> Iterator[tuple]:
        if not self.done:
            self.done = True
            yield tuple(row)


def chained(id: str, text: str, joint: str = "\n", offset: int = 0) -> type:
    """A generator that joins the texts of neighbours: each row but the first gives one, of its own id plus ``offset``;
    null texts are passed over."""

    class Chained:
        def __init__(self):
            self.last = None

        def eval(self, row: Row) -> Iterator[tuple]:
            new = row[text]
            if new is None:
                return
            if self.last is not None:
                yield tuple(row[c] + offset if c == id else self.last + joint + new if c == text else row[c] for c in row.__fields__)
            self.last = new

    return Chained


def generated(rows: DataFrame, generator: type, by: list[str], order: list[Column | str]) -> DataFrame:
    """What ``generator`` makes of each partition's rows; the same columns, all nullable."""
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema])
    return F.udtf(generator, returnType=schema)(rows.asTable().partitionBy(*by).orderBy(*order))


def appended(rows: DataFrame, generator: type, by: list[str], order: list[Column | str], keep: Column | None = None) -> DataFrame:
    """The rows and those made that pass ``keep``; adds made. Feed the result back for another round."""
    new = generated(rows, generator, by, order)
    new = new if keep is None else new.where(keep)
    return rows.withColumn("made", F.lit(False)).unionByName(new.withColumn("made", F.lit(True)))
