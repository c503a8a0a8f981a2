"""Pages to ordered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.functions.text import nonblank, utrim, with_breaks

# Where a line's midpoint belongs to the left or right column, and how many lines make a column.
LEFT_LIMIT, RIGHT_LIMIT, COLUMN_LINES = 0.45, 0.55, 5


def text_lines(pages: DataFrame, text: str = "text") -> DataFrame:
    """One row for each line of a page's text: numbered from 1 before blank lines go, with whole-width boxes."""
    exploded = pages.select(
        "source_file", "page_index",
        F.posexplode(F.split(with_breaks(F.coalesce(F.col(text), F.lit(""))), "\n")).alias("at", "raw")
    )
    box = {"left_ratio": 0.0, "top_ratio": 0.0, "right_ratio": 1.0, "bottom_ratio": 1.0}
    return exploded.select(
        "source_file", "page_index", (F.col("at") + 1).alias("line_in_page"), utrim("raw").alias("text"),
        *(F.lit(v).alias(k) for k, v in box.items())
    ).where(nonblank("text"))


def raw_lines(pages: DataFrame) -> DataFrame:
    """One row for each line of a page: its lines with boxes if it has any, blank ones included, else those of its text without the blank ones."""
    plain = text_lines(pages)
    if "lines" not in pages.columns:
        return plain.withColumn("boxed", F.lit(False))
    has_boxes = F.size(F.coalesce("lines", F.array().cast(pages.schema["lines"].dataType))) > 0
    boxed = pages.where(has_boxes).select("source_file", "page_index", F.explode("lines").alias("l"))
    columns = [F.col(f"l.{c}").alias(c) for c in ("line_in_page", "text", "left_ratio", "top_ratio", "right_ratio", "bottom_ratio")]
    found = boxed.select("source_file", "page_index", *columns).withColumn("line_in_page", F.col("line_in_page").cast("int"))
    without = text_lines(pages.where(~has_boxes))
    return found.withColumn("boxed", F.lit(True)).unionByName(without.withColumn("boxed", F.lit(False)))


def hint_lines(pages: DataFrame) -> DataFrame:
    """What a range may be named in: every page's lines as they are, those of a plain text trimmed and numbered without the blank ones."""
    plain = pages if "lines" not in pages.columns else pages.where(F.size(F.coalesce("lines", F.array().cast(pages.schema["lines"].dataType))) == 0)
    whole = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), utrim), lambda t: t != "")
    own = plain.select("source_file", "page_index", F.posexplode(whole).alias("at", "text")).select(
        "source_file", "page_index", (F.col("at") + 1).alias("line_in_page"), "text", F.lit(False).alias("boxed")
    )
    if "lines" not in pages.columns:
        return own
    return own.unionByName(raw_lines(pages).where("boxed").select(own.columns))


def reading_order(lines: DataFrame) -> DataFrame:
    """``read_at``: 1, 2, ... on each page. With a full column on both sides, left before the rest; else from top to bottom."""
    page = Window.partitionBy("source_file", "page_index")
    middle = (F.col("left_ratio") + F.col("right_ratio")) / 2
    two = (F.count_if(middle <= LEFT_LIMIT).over(page) >= COLUMN_LINES) & (F.count_if(middle >= RIGHT_LIMIT).over(page) >= COLUMN_LINES)
    marked = lines.withColumn("two_columns", two).withColumn(
        "side", F.when(F.col("two_columns"), F.when(middle <= LEFT_LIMIT, 0).otherwise(1)).otherwise(0)
    )
    across = F.when(F.col("two_columns"), F.col("left_ratio")).otherwise(0.0)
    return marked.withColumn("read_at", F.row_number().over(page.orderBy("side", "top_ratio", across, "line_in_page"))).drop("side")


def trim_boilerplate(lines: DataFrame, is_heading: Column, order: str = "line_in_page") -> DataFrame:
    """Lines before a page's first heading go; pages without one keep all."""
    page = Window.partitionBy("source_file", "page_index")
    first = F.min(F.when(is_heading, F.col(order))).over(page)
    return lines.withColumn("first_heading", first).where(
        F.col("first_heading").isNull() | (F.col(order) >= F.col("first_heading"))
    ).drop("first_heading")


def page_stats(pages: DataFrame) -> DataFrame:
    """Of each file: pages, words, and whether any page has text."""
    return pages.groupBy("source_file").agg(
        F.count("*").alias("pages"), F.sum("word_count").alias("words"), F.bool_or(nonblank("text")).alias("has_text")
    )


def pages_per_second(processed: Column, began: Column, now: Column) -> Column:
    """Throughput so far: 0 before the first page."""
    elapsed = F.greatest(F.lit(1e-6), seconds_between(began, now))
    return F.when(processed > 0, processed / elapsed).otherwise(0.0)


def seconds_between(began: Column, now: Column) -> Column:
    """Elapsed seconds of two timestamps."""
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(began.cast("timestamp"))) / 1e6


def leading_lines(lines: DataFrame, k: int = 8) -> DataFrame:
    """The first ``k`` lines of each page."""
    page = Window.partitionBy("source_file", "page_index").orderBy("line_in_page")
    return lines.withColumn("rank", F.row_number().over(page)).where(F.col("rank") <= k)
