"""Queries and changes of the stored categories, questions and wrong questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.functions.text import source_name, utrim

UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def file_summary(questions: DataFrame) -> DataFrame:
    """Questions of each file; names that differ in case are different files here."""
    return questions.groupBy(source_name("source_file").alias("source_file")).agg(F.count("*").alias("questions")).orderBy("source_file")


def file_count(questions: DataFrame, category: str, file: str) -> DataFrame:
    """How many questions a category has of a file, without regard to case."""
    same = (F.lower("category_id") == category.lower()) & (F.lower(source_name("source_file")) == F.lower(source_name(F.lit(file))))
    return questions.agg(F.count_if(same).alias("questions"))


def listed(categories: DataFrame) -> DataFrame:
    """Categories by name, in the order of a language's users rather than of code points."""
    return categories.orderBy(F.collate("name", "UNICODE"), "id")


def review(questions: DataFrame, category: str, file: str) -> DataFrame:
    """A category's questions of one file, without regard to the case of its name, by number."""
    same = F.lower(source_name("source_file")) == F.lower(source_name(F.lit(file)))
    return questions.where((F.col("category_id") == category) & same).orderBy("index", "id")


def categories_with(stored: DataFrame, names: DataFrame) -> DataFrame:
    """``stored`` (id, name) and a new row for each trimmed, non-blank name that none has, without regard to case; the first spelling by order of ``pos`` counts."""
    asked = names.withColumn("name", utrim("name")).where("name <> ''").withColumn("k", F.lower("name"))
    first = asked.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("pos"))).where("n = 1")
    new = first.join(stored.select(F.lower("name").alias("k")).distinct(), "k", "left_anti")
    return stored.select("id", "name").unionByName(new.select(F.md5("k").alias("id"), "name"))


def without_category(questions: DataFrame, category: str) -> DataFrame:
    return questions.where(F.lower("category_id") != category.lower())


def without_file(questions: DataFrame, category: str, file: str) -> DataFrame:
    gone = (F.lower("category_id") == category.lower()) & (F.lower(source_name("source_file")) == F.lower(source_name(F.lit(file))))
    return questions.where(~gone)


def kept_wrong(wrong: DataFrame, questions: DataFrame) -> DataFrame:
    """Wrong ids whose question still exists; ids are equal in any case."""
    there = questions.select(F.lower("id").alias("same_id"))
    return wrong.join(there, F.lower(wrong["question_id"]) == F.col("same_id"), "left_semi")


def wrong_notes(questions: DataFrame, wrong: DataFrame, uuids: bool = False) -> DataFrame:
    """Questions in the wrong set, by file and number; ids are equal in any case, and those that are no UUID are passed over with ``uuids``."""
    ids = wrong.where(F.col("question_id").rlike(UUID)) if uuids else wrong
    marks = ids.select(F.lower("question_id").alias("marked_id"))
    return questions.join(marks, F.lower(questions["id"]) == F.col("marked_id"), "left_semi").orderBy("source_file", "index", "id")


def neighbours(questions: DataFrame, group: list[str], order: list[str], key: str) -> DataFrame:
    """The question before and after, the place, and how many there are."""
    w = Window.partitionBy(*group).orderBy(*order)
    return questions.withColumns(
        {
            "previous": F.lag(key).over(w), "following": F.lead(key).over(w), "place": F.row_number().over(w),
            "of": F.count("*").over(Window.partitionBy(*group))
        }
    )
