"""Candidates and answers to questions, and their upsert into the store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.functions.text import QUESTION, nonblank, source_name, utrim
from pagequarry.sources.store import SEGMENT, stored_segments


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rn = 1").drop("rn")


def joined(candidates: DataFrame, answers: DataFrame, keys: tuple[str, ...] = ("index",)) -> DataFrame:
    """Full outer join by number: the first candidate of a number, and the answers with most entries, the first among equals.

    ``candidates`` has the keys and pos, ``answers`` the keys, pos and answers.
    """
    c = first_by(candidates, list(keys), "pos").withColumn("has_candidate", F.lit(True))
    a = first_by(answers, list(keys), F.desc(F.size("answers")), "pos").drop("pos")
    out = c.join(a, list(keys), "full_outer")
    return out.withColumn("has_candidate", F.coalesce("has_candidate", F.lit(False))).withColumn(
        "answers", F.coalesce("answers", F.array().cast("array<string>"))
    )


#: What a stored question has besides its number, type, prompt and answers; replaced as a whole, and the defaults where a table lacks them.
CARRIED = {
    "choices": ("array<string>", F.array), "image_segments": (f"array<{SEGMENT}>", F.array), "image_path": ("string", lambda: F.lit(None)),
    "image_top_ratio": ("double", lambda: F.lit(0.0)), "image_bottom_ratio": ("double", lambda: F.lit(1.0)),
}
STORED = ["id", "category_id", "source_file", "index", "type", "prompt", "answers", *CARRIED]


def with_carried(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {name: F.coalesce(F.col(name), make().cast(kind)) if name in df.columns else make().cast(kind) for name, (kind, make) in CARRIED.items()}
    )


def prepared(incoming: DataFrame) -> DataFrame:
    """Trimmed answers without blanks, a prompt for every question, a name for every file, the key they are matched by, and all that is stored."""
    rows = with_carried(incoming)
    answers = F.filter(F.transform(F.coalesce("answers", F.array().cast("array<string>")), utrim), lambda a: a != "")
    prompt = F.when(nonblank("prompt"), utrim("prompt")).otherwise(F.concat(F.lit(QUESTION), F.col("index").cast("string")))
    segments = stored_segments(F.col("image_segments"), F.col("image_path"), F.col("image_top_ratio"), F.col("image_bottom_ratio"))
    return rows.withColumns(
        {"answers": answers, "prompt": prompt, "source_file": source_name("source_file"), "image_segments": segments}
    ).withColumn("file_key", F.lower("source_file"))


def question_id(*keys: str):
    """A reproducible id from the natural key."""
    return F.sha2(F.concat_ws("|", *(F.col(k).cast("string") for k in keys)), 256)


def merged(stored: DataFrame, incoming: DataFrame, replace_answers: bool = True) -> DataFrame:
    """Upsert by (category_id, file without case, index); ``incoming`` comes in the order of ``pos``.

    A stored row keeps its id (the first of several, by id) and gets the last incoming prompt,
    choices, image and its segments.
    Its answers become the incoming ones, even none, and its type only changes if there are
    incoming answers or it had none. Of new rows with one key, the later ones merge into the
    first. With ``replace_answers`` off, the type is replaced and the answers stay.
    """
    rows = prepared(incoming)
    key = ["category_id", "file_key", "index"]
    first = Window.partitionBy(*key).orderBy("pos")
    whole = first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # of a type that only answers may change, the last incoming row with answers decides
    typed = F.last(F.when(F.size("answers") > 0, F.col("type")), ignorenulls=True).over(whole)
    last_before_none = rows.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("pos")))).withColumn("typed", typed)
    before = F.lag(F.size("answers")).over(first)
    last_before_none = last_before_none.withColumn("emptied", F.coalesce(before == 0, F.lit(False)))
    final = last_before_none.where("n = 1").drop("n", "pos")
    heads = rows.withColumn("n", F.row_number().over(first)).where("n = 1").select(
        *key, F.col("type").alias("first_type"), F.col("source_file").alias("first_file")
    )
    new = final.join(heads, key).alias("i")
    old = with_carried(stored).withColumn("file_key", F.lower("source_file")).withColumn(
        "n", F.row_number().over(Window.partitionBy("category_id", F.lower("source_file"), "index").orderBy("id"))
    ).alias("s")
    match = [F.col(f"s.{k}") == F.col(f"i.{k}") for k in key]
    both = old.join(new, [*match, F.col("s.n") == 1], "full_outer")
    hit, fresh = F.col("i.index").isNotNull() & F.col("s.index").isNotNull(), F.col("s.index").isNull()
    had_none = (F.size("s.answers") == 0) | F.col("i.emptied")
    kept_type = F.when(
        F.col("i.typed").isNotNull() & (F.size("i.answers") > 0), F.col("i.type")
    ).when(had_none, F.col("i.type")).otherwise(F.coalesce("i.typed", "s.type"))
    return both.select(
        F.when(fresh, question_id("i.category_id", "i.file_key", "i.index")).otherwise(F.col("s.id")).alias("id"),
        F.coalesce(
            "s.category_id", "i.category_id"
        ).alias("category_id"), F.coalesce("s.source_file", "i.first_file").alias("source_file"), F.coalesce("s.index", "i.index").alias("index"),
        F.when(
            fresh, F.when(F.size("i.answers") > 0, F.col("i.type")).otherwise(F.coalesce("i.typed", "i.first_type"))
        ).when(hit, kept_type if replace_answers else F.col("i.type")).otherwise(F.col("s.type")).alias("type"),
        F.when(hit | fresh, F.col("i.prompt")).otherwise(F.col("s.prompt")).alias("prompt"),
        F.when(fresh, F.col("i.answers")).when(hit & F.lit(replace_answers), F.col("i.answers")).otherwise(F.col("s.answers")).alias("answers"),
        *(F.when(hit | fresh, F.col(f"i.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in CARRIED),
    )


def groups(rows: DataFrame) -> DataFrame:
    """(category_id, file_key): the categories' files that rows are of, without regard to case."""
    return rows.select("category_id", F.lower(source_name("source_file")).alias("file_key")).distinct()


def of_groups(stored: DataFrame, some: DataFrame, how: str = "left_semi") -> DataFrame:
    """The stored rows of some categories' files, or with ``left_anti`` all others: what an import must read, and what it leaves alone."""
    return stored.withColumn("file_key", F.lower("source_file")).join(some, ["category_id", "file_key"], how).drop("file_key").select(stored.columns)


def removed_ids(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(question_id): the stored rows that overwriting by ``incoming`` removes."""
    return of_groups(stored, groups(incoming)).select(F.col("id").alias("question_id"))


def overwritten(stored: DataFrame, incoming: DataFrame, version: str | None = None) -> DataFrame:
    """Stored rows of the incoming categories' files go; every incoming row is appended as new, repeats included.

    New rows have ids that no row had before, as ``version``, which names the import (a new
    name if none is given), is part of them. So the marks of removed rows fall on nothing:
    kept_wrong() takes them away.
    """
    rows = prepared(incoming).withColumn("version", F.lit(version or uuid.uuid4().hex))
    kept = of_groups(with_carried(stored), groups(incoming), "left_anti")
    fresh = rows.withColumn("id", question_id("category_id", "file_key", "index", "pos", "version"))
    return kept.select(STORED).unionByName(fresh.select(STORED))
