"""Files in blocks are what they are as windows."""

import random

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import scans, segments
from pagequarry.plans import flows


def numbered(spark, seed=3):
    """One file with half of all lines, one of a single line, one without headings; gaps between places, also over 2^53."""
    rng = random.Random(seed)
    rows = []
    for file, n, base in (("long", 300, 0), ("one", 1, 5), ("none", 40, 0), ("far", 120, 2**53), ("mid", 139, 7)):
        pos = base
        for _ in range(n):
            pos += rng.randrange(1, 4)
            rows.append((file, pos, rng.randrange(0, 90) if file != "none" and rng.random() < 0.3 else None))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "source_file string, pos long, index int")


@pytest.mark.parametrize("before", [False, True])
def test_running_values(spark, before):
    rows, df = numbered(spark)
    want, last = {}, {}
    for file, pos, index in sorted(rows, key=lambda r: (r[0], r[1])):
        top, total, at = last.get(file, (None, 0, None))
        new = (index if top is None else top if index is None else max(top, index), total + (index or 0), (pos, index) if index is not None else at)
        want[file, pos] = (top, total, at) if before else new
        last[file] = new
    marker = F.when(F.col("index").isNotNull(), F.struct("pos", "index"))
    values = {"top": ("max", F.col("index")), "total": ("sum", F.col("index")), "at": ("max", marker)}
    for block in (None, 1, 16, scans.BLOCK):
        got = scans.running(df, values, before, block=block).collect()
        assert {(r.source_file, r.pos): (r.top, r.total, r.at and tuple(r.at)) for r in got} == want and len(got) == len(rows)
    assert scans.running(df.limit(0), values, before, block=16).count() == 0


def test_segments_in_blocks(spark):
    _, df = numbered(spark)
    plain = segments.span_numbers(segments.accept_rising(df)).collect()
    cut = segments.span_numbers(segments.accept_rising(df, block=8), block=8).collect()
    key = lambda r: (r.source_file, r.pos, r["index"], r.accepted, r.segment)
    assert sorted(map(str, map(key, plain))) == sorted(map(str, map(key, cut)))
    # the lines of one reach are one segment
    reach = segments.rising(df, block=8).where("reach > 0").withColumnRenamed("reach", "segment").groupBy("source_file", "segment").count()
    want = sorted((r.source_file, r.segment) for r in segments.span_numbers(segments.accept_rising(df)).where("segment > 0").select("source_file", "segment").distinct().collect())
    assert sorted((r.source_file, r.segment) for r in segments.counted(reach).collect()) == want and want


def book(spark):
    """Pages of files with headings of both kinds, with none, with gaps; one file has more than half of all lines."""
    pages = []
    for file, n, head in (("long", 24, "{}. 다음 중 옳은 것은?"), ("loose", 4, "① 다음 중 옳은 것은?"), ("plain", 5, "머리말 {}"), ("gaps", 6, "{}. 다음 글")):
        for page in range(1, n + 1):
            number = page if file != "gaps" else 2 * page
            body = "\n".join(["본문 설명", "무엇이 그런가 하고 묻는 다음 문장?", "plain", ""][: 1 + page % 4])
            shown = f"\n{page + 1} 다음 글의 뜻은?" if file in ("long", "gaps") else ""
            pages.append((file, page, f"{head.format(number)}\n{body}{shown}"))
    return spark.createDataFrame([*pages, ("empty", 1, None)], "source_file string, page_index int, text string")


def test_places_and_tiers_in_blocks(spark):
    lines = flows.page_lines(book(spark))
    plain = sorted(map(str, segments.positioned(lines).drop("low", "high").collect()))
    cut = segments.positioned(lines, 3)
    # columns of a join come first
    assert sorted(map(str, cut.select(segments.positioned(lines).drop("low", "high").columns).collect())) == plain and plain
    for given in (lines, segments.positioned(lines)):
        want = segments.segment_documents(given)
        got = segments.segment_documents(given, block=3).select(want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and {r.tier for r in want.collect()} == {0, 1, 2}


def test_import_of_a_long_file_is_that_of_a_short_one(spark, monkeypatch):
    pages = book(spark)
    bounds = spark.createDataFrame([("gaps", 1, 12), ("long", 1, 24)], "source_file string, low int, high int")
    want = flows.split(pages, bounds)
    plain = sorted(map(str, want.collect()))
    assert scans.needed_block(pages) is None and scans.needed_block(pages.limit(0)) is None
    monkeypatch.setattr(scans, "LONG_FILE", 20)
    monkeypatch.setattr(scans, "BLOCK", 4)
    assert scans.needed_block(flows.page_lines(pages)) == 4
    assert sorted(map(str, flows.split(pages, bounds).select(want.columns).collect())) == plain and len(plain) > 20
