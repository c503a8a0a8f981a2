"""Answer-key text to numbered answers, with errors as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.functions.text import inference_type, split_choices, split_tokens, try_int, utrim


def tokens(keys: DataFrame, text: str = "key_text") -> DataFrame:
    """One row for each token of each key (``key_id``), and whether the key maps numbers to answers: any token has a colon."""
    # what is asked of all tokens is asked once a key, below the explosion
    split = keys.select("key_id", split_tokens(text).alias("all")).select(
        "key_id", "all", F.exists("all", lambda t: t.contains(":")).alias("maps"), F.forall("all", lambda t: t == "").alias("blank")
    )
    return split.where("NOT blank").select("key_id", "maps", F.posexplode("all").alias("at", "token"))


def parsed(keys: DataFrame, text: str = "key_text") -> DataFrame:
    """Every token's number, answers and error: 'format', 'number', 'answer' (the row stays) or null.

    A list counts blank tokens, so a line feed at its end is one more unanswered question.
    Both kinds of keys are read in one pass.
    """
    t = tokens(keys, text).where("NOT maps OR token <> ''")
    maps, parts = F.col("maps"), F.split("token", ":", 2)
    number = try_int(parts[0])
    read = t.select(
        "key_id", "at", "token",
        F.when(maps, F.when(F.size(parts) < 2, "format").when(F.coalesce(number, F.lit(0)) <= 0, "number")).alias("error"),
        F.when(maps, number).otherwise(F.col("at") + 1).alias("index"),
        split_choices(F.when(maps, F.get(parts, F.lit(1))).otherwise(F.col("token"))).alias("answers")
    )
    return read.withColumn(
        "error",
        F.when(F.col("error").isNull() & (F.size("answers") == 0) & F.col("token").contains(":"), "answer").otherwise(F.col("error"))
    )


def answer_map(keys: DataFrame, text: str = "key_text") -> DataFrame:
    """(key_id, index, answers, type): of a number's repeats the last counts."""
    good = parsed(keys, text).where("error IS NULL OR error = 'answer'")
    last = Window.partitionBy("key_id", "index").orderBy(F.desc("at"))
    return good.withColumn("rn", F.row_number().over(last)).where("rn = 1").select(
        "key_id", "index", "answers", inference_type("answers").alias("type")
    )


def key_errors(keys: DataFrame, text: str = "key_text") -> DataFrame:
    """(key_id, at, token, error): what parsed() reports, and 'duplicate' for a number that came before; a token may have both."""
    p = parsed(keys, text).select("key_id", "at", "token", "error", "index", F.coalesce("error", F.lit("answer")).eqNullSafe("answer").alias("good"))
    seen = F.row_number().over(Window.partitionBy("key_id", "good", "index").orderBy("at"))
    again = F.when(F.col("good") & (F.col("n") > 1), "duplicate")
    errors = F.filter(F.array(F.col("error"), again), lambda e: e.isNotNull())
    return p.withColumn("n", seen).select("key_id", "at", "token", F.explode(errors).alias("error"))
