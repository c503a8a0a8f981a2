"""Running values of a file's lines, also of files that are too long for one task.

With ``block``, a file is cut into blocks of lines. What a block holds as a whole is
aggregated before anything is shuffled, the blocks before each block are one row each, and
only inside of its block is a line looked at in order. The rows are read twice for that, so
without ``block`` files are windows: one exchange, and one task for a file. Results are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536
#: Lines that a file may have to be handled by one task.
LONG_FILE = 1_000_000
#: Rows that a task gets of a table that dealt() deals.
TASK_ROWS = 250_000
HOW = {"max": F.max, "sum": F.sum}


def either(how: str, a: Column, b: Column) -> Column:
    """Two values as one, where either may be null."""
    if how == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    # not greatest(), which takes no structs
    return F.when(a.isNull() | (b > a), b).otherwise(a)


def running(
    rows: DataFrame, values: dict[str, tuple[str, Column]], before: bool = False, file: str = "source_file", order: str = "pos",
    block: int | None = None
) -> DataFrame:
    """``rows`` with the running maximum or sum ("max", "sum") of each of ``values`` up to the row, or with ``before`` up to the row before.

    ``order`` is a whole number, and different for each row of a file; blocks are equal
    spans of it. Nulls don't count; a maximum of nothing is null, a sum of nothing 0.
    With ``block`` a row without a file or order is dropped.
    """
    last = -1 if before else 0
    if block is None:
        whole = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, last)
        own = {k: HOW[how](v).over(whole) for k, (how, v) in values.items()}
        return rows.withColumns({k: F.coalesce(own[k], F.lit(0)) if how == "sum" else own[k] for k, (how, _) in values.items()})
    # not a floor of a quotient, as doubles hold no long
    x = rows.where(F.col(file).isNotNull() & F.col(order).isNotNull())
    x = x.withColumns({"scan_block": F.expr(f"CAST(`{order}` AS BIGINT) DIV {block}")} | {f"scan_{k}": v for k, (_, v) in values.items()})
    wholes = x.groupBy(file, "scan_block").agg(*(HOW[how](f"scan_{k}").alias(f"scan_{k}") for k, (how, _) in values.items()))
    earlier = Window.partitionBy(file).orderBy("scan_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = wholes.select(file, "scan_block", *(HOW[how](f"scan_{k}").over(earlier).alias(f"scan_before_{k}") for k, (how, _) in values.items()))
    inside = Window.partitionBy(file, "scan_block").orderBy(order).rowsBetween(Window.unboundedPreceding, last)
    found = x.join(carried, [file, "scan_block"])
    for k, (how, _) in values.items():
        found = found.withColumn(k, HOW[how](f"scan_{k}").over(inside))
    for k, (how, _) in values.items():
        found = found.withColumn(k, either(how, F.col(f"scan_before_{k}"), F.col(k)))
    return found.drop("scan_block", *(f"{p}_{k}" for k in values for p in ("scan", "scan_before")))


def places(rows: DataFrame, name: str, page: str, *order: str, file: str = "source_file", block: int | None = None) -> DataFrame:
    """``rows`` with their place in their file, from 1, as a long: by page, a whole number, and in a page by ``order``.

    With ``block`` a page's rows are counted, and the counts summed up page by page; only a
    page's own rows are sorted together, and a row without a file or page is dropped.
    """
    if block is None:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(file).orderBy(page, *order)).cast("long"))
    counts = rows.groupBy(file, page).agg(F.count("*").alias("scan_rows"))
    above = running(counts, {"scan_above": ("sum", F.col("scan_rows"))}, True, file, page, block)
    inside = F.row_number().over(Window.partitionBy(file, page).orderBy(*order))
    return rows.join(above.drop("scan_rows"), [file, page]).withColumn(name, F.col("scan_above") + inside).drop("scan_above")


def tasks_for(table: DataFrame) -> int:
    """How many tasks keep each at some TASK_ROWS rows of ``table``, as read from files; the count reads footers alone."""
    return max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // TASK_ROWS))


def dealt(table: DataFrame, *keys: str) -> DataFrame:
    """``table`` dealt by ``keys`` to tasks_for() it.

    An exchange that Spark plans by itself is merged to tasks of 64 MB as written, which may
    be millions of small rows to sort; a given number of tasks stays. Windows and groups by
    these or more columns need no other exchange.
    """
    return table.repartition(tasks_for(table), *keys)


def needed_block(rows: DataFrame, file: str = "source_file") -> int | None:
    """BLOCK where a file has more rows than one task should sort, else None; ``rows`` are a written table."""
    longest = rows.groupBy(file).count().agg(F.max("count")).first()[0]
    return BLOCK if (longest or 0) > LONG_FILE else None
