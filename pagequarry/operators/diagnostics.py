"""What a document's numbers say about its segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.functions.text import word_count
from pagequarry.operators.lines import hint_lines


def diagnose(candidates: DataFrame, file: str = "source_file", low: str = "start_index", high: str = "end_index") -> DataFrame:
    """Of each file: distinct numbers, those missing from and outside of the expected range, repeated ones, and whether anything is off.

    ``candidates`` has the expected range on every row (null if there is none).
    """
    per = candidates.groupBy(file, low, high, "index").agg(F.count("*").alias("n"))
    found = per.groupBy(file, low, high).agg(
        F.sort_array(F.collect_list("index")).alias("distinct_indexes"),
        F.sort_array(F.collect_list(F.when(F.col("n") > 1, F.col("index")))).alias("repeated")
    )
    expected = F.when(F.col(low).isNotNull(), F.sequence(F.col(low), F.col(high))).otherwise(F.array().cast("array<int>"))
    out = found.withColumn("missing", F.array_except(expected, F.col("distinct_indexes").cast("array<int>")))
    out = out.withColumn(
        "unexpected",
        F.when(F.col(low).isNull(), F.array().cast("array<int>")).otherwise(
            F.filter(F.col("distinct_indexes").cast("array<int>"), lambda v: ~v.between(F.col(low), F.col(high)))
        )
    )
    return out.withColumn("mismatch", F.col(low).isNotNull() & ((F.size("missing") > 0) | (F.size("unexpected") > 0) | (F.size("repeated") > 0)))


def repeated_headers(candidates: DataFrame, file: str = "source_file", keep: int = 5) -> DataFrame:
    """Numbers that occur more than once, with the first headers by place."""
    headers = F.transform(F.array_sort(F.collect_list(F.struct("pos", "header"))), lambda r: r["header"])
    return candidates.groupBy(file, "index").agg(F.count("*").alias("n"), F.slice(headers, 1, keep).alias("headers")).where("n > 1")


def page_diagnostics(pages: DataFrame, candidates: DataFrame, keep: int = 8) -> DataFrame:
    """Of each page: words, lines with boxes, the first lines as ``number: text``, and the distinct numbers of the questions that start there."""
    lines = hint_lines(pages).withColumn("rank", F.row_number().over(Window.partitionBy("source_file", "page_index").orderBy("line_in_page")))
    shown = F.concat(F.col("line_in_page").cast("string"), F.lit(": "), F.coalesce("text", F.lit("")))
    leading = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= keep, F.struct("rank", shown.alias("shown"))))), lambda r: r["shown"])
    first = lines.groupBy("source_file", "page_index").agg(F.count_if("boxed").alias("line_count"), leading.alias("leading_lines"))
    numbers = candidates.where("index > 0").groupBy("source_file", F.col("start_page").alias("page_index")).agg(
        F.sort_array(F.collect_set("index")).alias("candidate_indexes")
    )
    x = pages.select(
        "source_file", "page_index", word_count("text").cast("long").alias("word_count")
    ).join(first, ["source_file", "page_index"], "left").join(numbers, ["source_file", "page_index"], "left")
    none = lambda c: F.coalesce(c, F.array().cast(x.schema[c].dataType)).alias(c)
    return x.select(
        "source_file", "page_index", "word_count", F.coalesce("line_count", F.lit(0)).alias("line_count"), none("leading_lines"),
        none("candidate_indexes")
    )


def report(diagnosis: DataFrame, pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """(source_file, text): a file's diagnosis as text, its pages and then its candidates in order, one line each."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    numbers = lambda c: F.when(F.size(c) > 0, F.array_join(F.col(c).cast("array<string>"), ", ")).otherwise("-")
    head = F.concat_ws("\n", line("file", F.col("source_file").cast("string")), line("numbers", numbers("distinct_indexes")), line("missing", numbers("missing")), line("unexpected", numbers("unexpected")),
                       line("repeated", numbers("repeated")), line("mismatch", F.col("mismatch").cast("string")))
    own = F.concat(
        F.lit("page "), F.col("page_index").cast("string"), F.lit(" | "), numbers("candidate_indexes"), F.lit(" | lines "),
        F.col("line_count").cast("string"), F.lit(" | words "), F.col("word_count").cast("string")
    )
    listed = F.array_join(F.concat(F.array(own), F.transform("leading_lines", lambda l: F.concat(F.lit("  "), l))), "\n")
    by_page = pages.groupBy("source_file").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_index", listed.alias("s")))), lambda r: r["s"]), "\n").alias("pages")
    )
    place = F.concat(
        F.col("index").cast("string"), F.lit(" | "), F.col("start_page").cast("string"), F.lit(":"),
        F.col("start_line").cast("string"), F.lit(" -> "), F.col("end_page").cast("string"), F.lit(":"),
        F.col("end_line").cast("string"), F.lit(" | "), F.coalesce("header", F.lit(""))
    )
    by_place = candidates.groupBy("source_file").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("index", "start_page", "start_line", place.alias("s")))), lambda r: r["s"]),
            "\n"
        ).alias("places")
    )
    x = diagnosis.join(by_page, "source_file", "left").join(by_place, "source_file", "left")
    return x.select("source_file", F.concat_ws("\n\n", head, "pages", "places").alias("text"))


def passing(files: DataFrame, diagnosis: DataFrame) -> DataFrame:
    """Files that may be imported: nothing is off."""
    return files.join(diagnosis.where("mismatch").select("source_file"), "source_file", "left_anti")


def count_status(parsed: DataFrame, detected: DataFrame, file: str = "source_file") -> DataFrame:
    """How many answers and candidates a file has, and which of them are more."""
    both = parsed.groupBy(file).agg(F.count("*").alias("parsed")).join(
        detected.groupBy(file).agg(F.count("*").alias("detected")), file, "full_outer"
    ).na.fill(0, ["parsed", "detected"])
    return both.withColumn(
        "status",
        F.when(F.col("parsed") == F.col("detected"), "equal").when(F.col("parsed") > F.col("detected"), "more_answers").otherwise("more_questions")
    )
