"""Operators on rows in order within a group. A group's rows pass through one task, so groups are to be bounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from statuta.functions.regulatory import distinct_strings


def so_far(group: list[str], order: list[str]) -> WindowSpec:
    """The rows of a group up to and with the present one."""
    return Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def islands(rows: DataFrame, group: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """``rows`` with the number of rows so far where ``starts`` is true: 0 before the first."""
    return rows.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(so_far(group, order)))


def first_so_far(rows: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the first value so far that is not null."""
    return rows.withColumn(name, F.first(value, ignorenulls=True).over(so_far(group, order)))


def occurrences(rows: DataFrame, same: list[str], order: list[str], total: str = "n_same", number: str = "occ") -> DataFrame:
    """``rows`` with how many rows are the same, and which of them, from 1, each is."""
    window = Window.partitionBy(*same)
    return rows.withColumn(total, F.count("*").over(window)).withColumn(number, F.row_number().over(window.orderBy(*order)))


def neighbours(rows: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """``rows`` with prev_ and next_ of ``value``; null at the ends."""
    window = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumns({f"prev_{value}": F.lag(value).over(window), f"next_{value}": F.lead(value).over(window)})


def joined(text: Column, order: Column, separator: str = " ") -> Column:
    """Aggregate: the texts in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), separator)


def distinct_in_order(text: Column, order: Column) -> Column:
    """Aggregate: the distinct texts in order of first appearance, without nulls and empty ones."""
    return distinct_strings(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]))
