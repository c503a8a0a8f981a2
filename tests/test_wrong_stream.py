import random

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import grading
from pagequarry.streaming import wrong_set

EVENTS = "question_id string, ts int, seq int, is_correct boolean, removed boolean"


@pytest.fixture
def run(spark, tmp_path):
    """Rows as a new file of the stream's folder, all of which is then read; the marks after it."""

    def go(rows, questions=None, grace_ms=wrong_set.DAY):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        wrong_set.follow(stream, str(tmp_path / "marks"), str(tmp_path / "at"), questions, grace_ms, availableNow=True).awaitTermination()
        return sorted(r[0] for r in wrong_set.stored_marks(spark, str(tmp_path / "marks")).collect())

    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield go
    spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_restarts_equal_the_batch_fold(spark, run):
    """Events in any order over several starts, some late, some without a grade, null times first."""
    rng = random.Random(3)
    events = [(f"q{rng.randrange(12)}", rng.choice([None, *range(20)]), i, rng.choice([True, False, None]), False) for i in range(120)]
    rng.shuffle(events)
    for upto in (40, 80, 120):
        got = run(events[upto - 40 : upto])
        fold = grading.wrong_set(spark.createDataFrame(events[:upto], EVENTS))
        assert got == sorted(r[0] for r in fold.collect())


def test_goes_on_from_the_stored_set(spark, run, tmp_path):
    stored = spark.createDataFrame([("A",), ("b",), ("c",), (None,), ("a",)], wrong_set.MARKS)
    wrong_set.store_marks(stored, str(tmp_path / "marks"))
    assert run([("a", 1, 1, True, False), (None, 1, 2, False, None), ("D", 1, 3, False, None)]) == ["b", "c", "d"]
    # late: before what is kept; then after it
    assert run([("a", 0, 1, False, False), ("d", 0, 1, True, False), ("b", 1, 1, None, False)]) == ["b", "c", "d"]
    assert run([("a", 2, 1, False, False), ("d", 1, 4, True, False)]) == ["a", "b", "c"]
    assert run([]) == ["a", "b", "c"]


def test_removed_questions(spark, run):
    """A question that is gone has no mark, and late events don't bring it back; ids that are no question are not stored."""
    questions = spark.createDataFrame([("A",), ("b",)], "id string")
    assert run([("a", 1, 1, False, False), ("b", 1, 2, False, False), ("x", 1, 3, False, False)], questions) == ["a", "b"]
    assert run([("a", 2, 1, None, True)]) == ["b"]
    assert run([("a", 3, 1, False, False), ("b", 3, 2, False, True)]) == []
    assert run([("b", 9, 1, False, False)]) == []


def test_state_goes_after_the_grace(spark, run, tmp_path):
    run([("a", 1, 1, False, False), ("b", 1, 1, True, False)], grace_ms=0)
    run([("a", 2, 1, None, True)], grace_ms=0)
    run([("c", 2, 1, True, False)], grace_ms=0)
    state = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "at"))
    assert {r[0] for r in state.select(F.col("key.question_id")).collect()} == {"b", "c"}


def test_a_batch_again_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "marks")
    changes = spark.createDataFrame([("a", True), ("b", True), ("c", False)], wrong_set.CHANGES)
    for _ in range(2):
        wrong_set.merge_marks(changes, folder)
        assert sorted(r[0] for r in wrong_set.stored_marks(spark, folder).collect()) == ["a", "b"]
    wrong_set.merge_marks(changes.where("false"), folder)
    wrong_set.merge_marks(spark.createDataFrame([("b", False), ("zz", True)], wrong_set.CHANGES), folder)
    assert sorted(r[0] for r in wrong_set.stored_marks(spark, folder).collect()) == ["a", "zz"]


def test_times_of_any_kind(spark):
    kinds = {"timestamp": 86400000001, "timestamp_ntz": 86400000001}
    for kind, micros in kinds.items():
        df = spark.sql(f"SELECT CAST('1970-01-02 00:00:00.000001' AS {kind}) AS at, CAST(7 AS SMALLINT) AS n")
        got = df.select(*(wrong_set.as_number(F.col(c), df.schema[c].dataType) for c in ("at", "n"))).first()
        assert tuple(got) == (micros, 7)
