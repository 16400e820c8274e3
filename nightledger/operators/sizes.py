"""Using configuration as a broadcast or a literal list only after its size has been checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 100_000
SMALL_VALUES = 1_000


def few_values(config: DataFrame, column: str, max_rows: int = SMALL_ROWS) -> list | None:
    """The values of a column of a table with at most ``max_rows`` rows, nulls left out; None if it has more rows."""
    found = [row[0] for row in config.select(column).limit(max_rows + 1).collect()]
    return None if len(found) > max_rows else sorted({value for value in found if value is not None})


def broadcast_if_small(config: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """A table marked for broadcast if it has few rows, otherwise the table itself, for Spark to shuffle.

    Counts at most ``max_rows`` + 1 rows. Spark cannot size every configuration table by itself, and a shuffle of the
    events against a table of a few hundred rows must not happen.
    """
    return F.broadcast(config) if config.limit(max_rows + 1).count() <= max_rows else config


def keep_values(rows: DataFrame, column: str, wanted: DataFrame, max_values: int = SMALL_VALUES) -> DataFrame:
    """Rows whose ``column`` is among the wanted values.

    Up to ``max_values`` of them become a literal list, which also prunes partitions when the column is computed from
    partition columns; more are left to a semi join.
    """
    values = wanted.select(column).distinct()
    found = [row[0] for row in values.limit(max_values + 1).collect()]
    if len(found) > max_values:
        return rows.join(values, column, "left_semi")
    return rows.filter(F.col(column).isin(*found))


def narrow_to(rows: DataFrame, column: str, wanted: DataFrame, max_rows: int = SMALL_VALUES) -> DataFrame:
    """Rows that can match ``wanted``, when that has few rows; all rows when it has many.

    For use before a join on the column: a request for a few values then reads and shuffles only theirs.
    """
    found = [row[0] for row in wanted.select(column).limit(max_rows + 1).collect()]
    return rows if len(found) > max_rows else rows.filter(F.col(column).isin(*set(found)))
