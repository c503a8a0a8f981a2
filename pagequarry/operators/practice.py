"""Choosing questions to practise."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.operators.catalogue import wrong_notes
from pagequarry.operators.grading import has_answer


def shuffled(questions: DataFrame, seed: int, key: str = "id") -> DataFrame:
    """A reproducible random order: by digest of key and seed."""
    return questions.withColumn("draw", F.md5(F.concat(F.col(key).cast("string"), F.lit("|"), F.lit(str(seed))))).orderBy("draw", key)


def sample(questions: DataFrame, n: int, seed: int, key: str = "id", answered_only: bool = False) -> DataFrame:
    """``n`` questions without replacement, all if there are fewer, none if n is not positive. The limit is what is asked for."""
    pool = questions.where(has_answer()) if answered_only else questions
    return shuffled(pool, seed, key).limit(max(0, n))


def samples(questions: DataFrame, n: int, seed: int, by: str = "category_id", key: str = "id", answered_only: bool = False) -> DataFrame:
    """``n`` questions of each category without replacement, the same as sample() would take of each; all where there are fewer.

    A task keeps its own ``n`` first draws of a category before any are shuffled.
    """
    pool = questions.where(has_answer()) if answered_only else questions
    drawn = pool.withColumn("draw", F.md5(F.concat(F.col(key).cast("string"), F.lit("|"), F.lit(str(seed)))))
    place = F.row_number().over(Window.partitionBy(by).orderBy("draw", key))
    return drawn.withColumn("place", place).where(F.col("place") <= max(0, n)).drop("place")


def practice_set(questions: DataFrame, category: str, n: int, seed: int, answered_only: bool = False) -> DataFrame:
    """A category's sample; none if it has fewer than ``n`` questions."""
    pool = questions.where(F.lower("category_id") == category.lower())
    pool = pool.where(has_answer()) if answered_only else pool
    enough = pool.groupBy().agg(F.count("*").alias("available")).where(F.col("available") >= n)
    return sample(pool, n, seed).join(F.broadcast(enough)).drop("available")


def random_questions(questions: DataFrame, category: str, n: int, seed: int, wrong: DataFrame | None = None) -> DataFrame:
    """``n`` of a category's questions, of those in the wrong set (question_id) if it is given; all if there are fewer."""
    pool = questions.where(F.col("category_id") == category)
    if wrong is not None:
        ids = wrong.select(F.lower("question_id").alias("k")).distinct()
        pool = pool.join(ids, F.lower(F.col("id")) == F.col("k"), "left_semi")
    return sample(pool, n, seed)


def wrong_practice(questions: DataFrame, wrong: DataFrame, seed: int) -> DataFrame:
    """A session of all questions in the wrong set, whatever their category, shuffled."""
    return shuffled(wrong_notes(questions, wrong), seed)
