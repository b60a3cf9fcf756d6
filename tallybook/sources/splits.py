"""Tables written once: split by a verdict into parts, with figures counted while writing."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.functions.text import field


@dataclass(frozen=True)
class Split:
    """A table whose rows lie in one folder per verdict; a part is read without touching the others."""

    spark: SparkSession
    path: str
    verdict: str
    schema: T.StructType
    figures: Mapping[str, int]

    def part(self, value: str) -> DataFrame:
        """The rows of one verdict, without the verdict; no rows where none has it."""
        return self.all().where(field(self.verdict) == value).drop(self.verdict)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


# Files that a task may hold open, one per verdict; rows of further verdicts are sorted first, as all rows would be otherwise.
OPEN_FILES = 8
_OPEN = "spark.sql.maxConcurrentOutputFileWriters"


@contextmanager
def _files_held_open(spark: SparkSession) -> Iterator[None]:
    """While rows are written by verdict, each task holds a file per verdict open instead of sorting (and spilling) its rows by it.

    A number that the session sets itself is left alone.
    """
    own = spark.conf.get(_OPEN, None)
    if own is None:
        spark.conf.set(_OPEN, str(OPEN_FILES))
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(_OPEN)


def written(df: DataFrame, path: str, mode: str = "error", by: str | None = None, **figures: Column) -> tuple[DataFrame, dict[str, int]]:
    """The frame, written and read back, with figures (aggregates) observed by the one job that writes it."""
    seen = Observation()
    watched = df.observe(seen, *[c.alias(n) for n, c in figures.items()]) if figures else df
    writer = watched.write.mode(mode)
    if by:
        with _files_held_open(df.sparkSession):
            writer.partitionBy(by).parquet(path)
    else:
        writer.parquet(path)
    fields = [f for f in df.schema.fields if f.name != by] + [f for f in df.schema.fields if f.name == by]
    found = seen.get if figures else {}
    return df.sparkSession.read.schema(T.StructType(fields)).parquet(path), {n: found.get(n) or 0 for n in figures}


def write_split(df: DataFrame, path: str, verdict: str, mode: str = "error", **figures: Column) -> Split:
    """Write the rows once, split by the text column ``verdict``: both parts of a yes-or-no question cost one pass."""
    table, found = written(df, path, mode, verdict, **figures)
    return Split(df.sparkSession, path, verdict, table.schema, found)


def counted(verdict: str, *values: str) -> dict[str, Column]:
    """Figures for ``write_split``: the rows of each verdict."""
    return {v: F.count_if(field(verdict) == v) for v in values}
