"""Attempts to grades, scores and the set of wrong questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.text import nonblank, try_int, utrim


def has_answer(answers="answers") -> Column:
    return F.exists(F.col(answers), nonblank)


def is_correct(kind="type", answers="answers", given="user_answer") -> Column:
    """True or false, or null if the question has no answer and so isn't graded."""
    number = try_int(F.coalesce(F.col(given), F.lit("")))
    multiple = F.coalesce(F.exists(F.col(answers), lambda a: F.coalesce(try_int(a) == number, F.lit(False))), F.lit(False))
    norm = F.upper(utrim(F.coalesce(F.col(given), F.lit(""))))
    subjective = F.exists(F.col(answers), lambda a: F.upper(utrim(a)) == norm)
    return F.when(has_answer(answers), F.when(F.col(kind) == "MC", multiple).otherwise(subjective))


def graded(attempts: DataFrame, questions: DataFrame) -> DataFrame:
    return attempts.join(questions.select(F.col("id").alias("question_id"), "type", "answers"), "question_id").withColumn("is_correct", is_correct())


def wrong_set(events: DataFrame, question: str = "question_id", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """Questions whose last graded event is wrong; a removal by hand is a correct event, null is no event."""
    decided = events.where(F.col("is_correct").isNotNull())
    last = decided.groupBy(question).agg(F.max_by("is_correct", F.struct(*order)).alias("ok"))
    return last.where(~F.col("ok")).select(question)


def session_scores(graded_attempts: DataFrame, session: str = "session_id") -> DataFrame:
    """Correct answers, and all attempts, ungraded ones included."""
    return graded_attempts.groupBy(session).agg(F.count_if("is_correct").alias("correct"), F.count("*").alias("total"))
