"""Tasks of the windows over lines, boxes and keys are as many as their rows ask for, after one exchange."""

import re

import pytest

from pagequarry.operators import answers, ranges, recovery, scans
from pagequarry.plans.queries import QUERIES, table
from pagequarry.session import settle

SF = "/root/testdata/sf0.001"


def dealt_once(spark, name: str, of: str) -> str:
    """The query's plan, once it has been seen to deal its table once, by the table's rows."""
    df = QUERIES[name](spark, SF)
    rows = table(spark, SF, of).count()
    plan = df._jdf.queryExecution().executedPlan().toString()  # before it runs
    assert df.rdd.getNumPartitions() == -(-rows // scans.TASK_ROWS)
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == 1 and plan.count("FileScan") == 1
    return plan


def test_dealt_keeps_rows_together(spark, monkeypatch):
    monkeypatch.setattr(scans, "TASK_ROWS", 100)
    lines = table(spark, SF, "lineitem")
    x = scans.dealt(lines, "l_suppkey")
    parts = x.rdd.glom().map(lambda rows: (len(rows), {r.l_suppkey for r in rows})).collect()
    assert sum(n for n, _ in parts) == lines.count() and len(parts) == -(-lines.count() // 100)
    assert sum(len(keys) for _, keys in parts) == lines.select("l_suppkey").distinct().count()
    assert scans.dealt(lines.limit(0), "l_suppkey").count() == 0


def test_reading_order_is_dealt_once(spark, monkeypatch):
    monkeypatch.setattr(scans, "TASK_ROWS", 400)
    dealt_once(spark, "reading_order", "lineitem")


@pytest.mark.parametrize("name", ["range_infer", "range_infer_wide"])
def test_range_inference_is_dealt_once(spark, monkeypatch, name):
    monkeypatch.setattr(scans, "TASK_ROWS", 400)
    # nor are the numbers found twice, for themselves and for the ranges that they start
    dealt_once(spark, name, "lineitem")


@pytest.mark.parametrize("name", ["range_infer", "range_infer_wide", "passing_files"])
def test_only_lines_with_numbers_are_dealt(spark, name):
    # a task that writes to many others holds all that it sends
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    sent = plan.split("REPARTITION_BY_NUM")[1:]
    assert sent and all("Filter" in x.split("Scan")[0] for x in sent)


@pytest.mark.parametrize("name", ["range_infer", "range_infer_wide", "passing_files"])
def test_long_files_send_first_places_alone(spark, monkeypatch, name):
    want = sorted(map(str, QUERIES[name](spark, SF).collect()))
    monkeypatch.setattr(scans, "LONG_FILE", 100)
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # no lines are sorted by their places, and what is dealt by file are the numbers of files
    assert "Sort [source_file" in plan and not re.search(r"l_linenumber#\d+ ASC", plan)
    assert all("partial_min(struct" in x for x in plan.split("REPARTITION_BY_NUM")[1:])
    assert sorted(map(str, df.collect())) == want and want


def test_starts_that_two_numbers_give_count_once(spark):
    # 6 gives the start 6, and so does 11, 5 places on
    x = spark.createDataFrame([("a", n, 5) for n in (6, 7, 8, 8, 11)], "source_file string, index int, expected_count int")
    assert [tuple(r) for r in ranges.inferred(x).collect()] == [("a", 6, 10, 3)]


def test_keys_are_read_once(spark, monkeypatch):
    monkeypatch.setattr(scans, "TASK_ROWS", 100)
    for name in ("answer_key_errors", "answer_key_parse"):
        dealt_once(spark, name, "orders")


def test_a_token_may_have_two_errors(spark):
    x = spark.createDataFrame([(1, "1:3,1:,x,0:1,,1:2|"), (2, "3,,4"), (3, " , ;"), (4, None)], "key_id long, key_text string")
    want = [(1, 1, "1:", "answer"), (1, 1, "1:", "duplicate"), (1, 2, "x", "format"), (1, 3, "0:1", "number"), (1, 5, "1:2|", "duplicate")]
    assert sorted(tuple(r) for r in answers.key_errors(x).collect()) == want


def test_recovery_is_dealt_by_its_rows(spark, monkeypatch):
    want = sorted(map(str, QUERIES["gap_markers"](spark, SF).collect()))
    plans = {}

    def noted(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return settle(df, label)

    monkeypatch.setattr(recovery, "settle", noted)
    monkeypatch.setattr(scans, "TASK_ROWS", 400)
    assert sorted(map(str, QUERIES["gap_markers"](spark, SF).collect())) == want and want
    assert {k: p.count("REPARTITION_BY_NUM") for k, p in plans.items()} == {"recovery-clues": 1, "recovery-lines": 1, "recovery-found": 3}
    # but for each file's headings, which are aggregated before they are sent
    assert [p.count("ENSURE_REQUIREMENTS") for p in plans.values()] == [0, 0, 1]
