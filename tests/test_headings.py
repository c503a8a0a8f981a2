import os
import random
import re

import pytest
from pyspark.sql import functions as F

from pagequarry.functions import text as T
from pagequarry.operators import segments
from pagequarry.operators.headings import heading_index, marked, with_following
from pagequarry.operators.recovery import clues, fill, recover, with_markers, with_numbers
from pagequarry.plans import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

STRICT = [
    ("1. 다음 중 옳은 것은?", None, 1), ("문항 12. 다음 설명", None, 12), ("Q3: What?", None, 3), ("007. 다음 글", None, 7), ("3) X=1", "본문 설명", None), ("3) x=1", "본문 설명", 3), ("3) x=1", "abc", None),
    ("제1과목", None, None), ("2학기", None, None), ("(1~25번)", None, None), ("1-25", None, None), ("1000. 다음 설명", None, None), ("0. 다음 설명", None, None), ("10 학기 시험 안내", None, None), ("7 3.14", "다음 글", None),
    ("7. 가", "plain", None), ("5", "다음 글을 읽고", 5), ("5", "6. 다음", None), ("5", None, None), ("① 다음 중", None, None), ("가. 다음 중", None, None), (None, None, None),
]
PERMISSIVE = [("① 다음 중", 1), ("⑳ 다음 중", 20), ("가. 다음 중", 1), ("나. 다음 중", 1177), ("A. what?", None)]


def test_strict_headings(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(STRICT)], "i int, text string, next_text string")
    got = {r.i: r.index_ for r in df.select("i", heading_index("text", "next_text").alias("index_")).collect()}
    assert [got[i] for i in range(len(STRICT))] == [x[2] for x in STRICT]


def test_permissive_headings(spark):
    df = spark.createDataFrame([(i, a, None) for i, (a, _) in enumerate(PERMISSIVE)], "i int, text string, next_text string")
    got = {r.i: r.x for r in df.select("i", heading_index("text", "next_text", pattern=T.PERMISSIVE_HEADING).alias("x")).collect()}
    assert [got[i] for i in range(len(PERMISSIVE))] == [x[1] for x in PERMISSIVE]


@pytest.mark.parametrize("pattern", [T.STRICT_HEADING, T.PERMISSIVE_HEADING])
def test_marked_lines_are_heading_index_by_the_next_line(spark, pattern):
    texts = [x for a, b, *_ in STRICT for x in (a, b)] + [a for a, _ in PERMISSIVE] + ["  3.  다음 글  ", "", "출제위원 7. 다음", "4. (가) ?"]
    df = spark.createDataFrame([(1, 1 + i // 9, i, t) for i, t in enumerate(texts)], "source_file int, page_index int, line_in_page int, text string")
    low, high = F.lit(2), F.lit(12)
    plain = with_following(df).withColumns(
        {"want": heading_index("text", "next_text", pattern=pattern), "inside": heading_index("text", "next_text", low, high, pattern)}
    )
    bounded = df.withColumns({"low": low, "high": high})
    got = {r.line_in_page: r["index"] for r in marked(df, patterns={"index": pattern}).collect()}
    inside = {r.line_in_page: r["index"] for r in marked(bounded, "line_in_page", "low", "high", {"index": pattern}).collect()}
    want = plain.collect()
    assert got == {r.line_in_page: r.want for r in want} and inside == {r.line_in_page: r.inside for r in want} and any(got.values())


def test_expected_range_bounds(spark):
    df = spark.createDataFrame([("1. 다음 중 옳은 것은?", None)], "text string, next_text string")
    assert df.select(heading_index("text", "next_text", F.lit(10), F.lit(20))).first()[0] is None


def search(rows, low, high):
    """fill() of each gap of one file: (pos, number, inferred, guessed)."""
    start = [(p, i, False, False) for p, _, i, _, _ in rows if i is not None]
    markers = [(p, i, x) for p, x, i, _, _ in rows if i is not None and low <= i <= high]
    new = []
    for k in range(len(markers) + 1 if markers else 0):
        a, b = markers[k - 1] if k else None, markers[k] if k < len(markers) else None
        inside = [(p, x, shown, score) for p, x, _, shown, score in rows if (not a or p > a[0]) and (not b or p < b[0])]
        new += fill(inside, a and a[2], a[1] if a else low - 1, b[1] if b else high + 1, bool(b))
    return sorted([(p, i, False, False) for p, i, _ in markers] + [(p, n, True, g) for p, n, g in new]) if new else start


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        # (pos, left, accepted, shown, score)
        ([(1, 0.0, 1, 1, None), (5, 0.0, None, 2, None), (9, 0.0, 3, 3, None)], [(1, 1, False, False), (5, 2, True, False), (9, 3, False, False)]),
        ([(1, 0.0, 1, 1, None), (4, 0.0, None, None, 30), (9, 0.0, 3, 3, None)], [(1, 1, False, False), (4, 2, True, True), (9, 3, False, False)]),
        ([(1, 0.0, 1, 1, None), (4, 0.5, None, None, 30), (9, 0.0, 3, 3, None)], [(1, 1, False, False), (9, 3, False, False)]),
        ([(2, 0.0, None, 1, None), (3, 0.0, 50, 50, None)], [(3, 50, False, False)]),
        ([], []),
    ],
)
def test_recovery(rows, want):
    assert search(rows, 1, 5) == want


def plain_search(rows, low, high):
    """The same from the definition: every neighbour is looked for among all markers, and gaps are gone through from the start each time."""
    markers = [(p, i) for p, _, i, _, _ in rows if i is not None and low <= i <= high]
    if not markers:
        return [(p, i) for p, _, i, _, _ in rows if i is not None]
    start = [(p, i) for p, _, i, _, _ in rows if i is not None]
    left, n_start = {p: x for p, x, *_ in rows}, len(markers)
    for n in range(low, high + 1):
        if n not in {i for _, i in markers}:
            after = max(((i, p) for p, i in markers if i < n), default=(0, 0))[1]
            before = min(((i, p) for p, i in markers if i > n), default=(0, 10**9))[1]
            hit = [p for p, _, _, shown, _ in rows if shown == n and after < p < before]
            markers += [(hit[0], n)] if hit else []
    again = True
    while again:
        again = False
        markers.sort()
        for (a, i), (b, j) in zip(markers, markers[1:], strict=False):
            scored = [(p, s + max(0, 50 - int(abs(x - left[a]) * 400))) for p, x, _, _, s in rows if s is not None and a < p < b]
            scored = [(p, s) for p, s in scored if s >= 40]
            best = [p for p, s in scored if s >= max(s for _, s in scored) - 25][: max(0, j - i - 1)]
            new = [(p, i + 1 + k) for k, p in enumerate(best) if low <= i + 1 + k <= high and i + 1 + k not in {m for _, m in markers}]
            if new:
                markers, again = markers + new, True
                break
    return sorted(markers) if len(markers) > n_start else start


def test_recovery_is_that_of_the_definition():
    rng = random.Random(21)
    for _ in range(400):
        rows, last = [], 0
        for pos in sorted(rng.sample(range(1, 90), rng.randrange(0, 40))):
            index = None
            if rng.random() < 0.25:
                last = index = last + rng.randrange(1, 4)
            shown = rng.randrange(1, 22) if rng.random() < 0.3 else None
            rows.append((pos, rng.choice([0.0, 0.02, 0.1, 0.5]), index, shown, rng.choice([None, None, 5, 12, 30, 45, 70])))
        assert [m[:2] for m in search(rows, 2, 18)] == plain_search(rows, 2, 18)


def test_recovery_of_all_files_is_that_of_the_definition(spark):
    """Also of files that lack nothing, and in blocks of few lines."""
    x = queries.gap_lines(spark, SF)
    got = {(r.source_file, r.pos): (r["index"], r.inferred, r.guessed) for r in recover(x, 1, 120).collect()}
    placed = segments.positioned(x)
    rows = {}
    for r in with_markers(clues(with_numbers(placed, 1, 120), 1, 120)).orderBy("pos").collect():
        rows.setdefault(r.source_file, []).append((r.pos, r.left_ratio, r["index"], r.shown, r.score))
    want = {(f, m[0]): m[1:] for f, own in rows.items() for m in search(own, 1, 120)}
    assert got == want and any(v[1] for v in got.values())
    assert {k: v[0] for k, v in got.items()} == {(f, p): n for f, own in rows.items() for p, n in plain_search(own, 1, 120)}
    small = {(r.source_file, r.pos): (r["index"], r.inferred, r.guessed) for r in recover(x, 1, 120, block=7).collect()}
    assert small == want
    few = x.where("source_file = 1 AND text LIKE '%. 다음 중%'").limit(1)
    one = few.select(
        "source_file", "page_index", "line_in_page", F.concat(F.lit("1"), F.regexp_replace("text", "^[0-9]+", "")).alias("text"),
        "left_ratio"
    )
    assert [(r["index"], r.inferred) for r in recover(one, 1, 1).collect()] == [(1, False)]
    assert recover(x.limit(0), 1, 9).count() == 0


def test_headings_beyond_the_bounds_go_where_others_are_found(spark):
    """Markers that were read without bounds: a has a line that shows what lacks, b has none, c one that looks like a heading."""
    rows = [("a", 1, "3. 다음 글"), ("a", 2, "본문"), ("a", 3, "4. 다음 글"), ("a", 4, "본문"), ("a", 5, "9. 다음 글"), ("b", 1, "3. 다음 글"), ("b", 2, "9. 다음 글")]
    rows += [("c", 1, "3. 다음 글"), ("c", 2, "다음 설명을 보고 고르면?"), ("c", 3, "본문"), ("c", 4, "5. 다음 글")]
    x = spark.createDataFrame([(f, 1, p, p, t, None) for f, p, t in rows], "source_file string, page_index int, line_in_page int, pos int, text string, left_ratio double")
    markers = spark.createDataFrame([("a", 1, 3), ("a", 5, 9), ("b", 1, 3), ("b", 2, 9), ("c", 1, 3), ("c", 4, 5)], "source_file string, pos int, index int")
    got = sorted((r.source_file, r.pos, r["index"], r.inferred, r.guessed) for r in recover(x, 3, 5, markers).collect())
    assert got == [
        ("a", 1, 3, False, False), ("a", 3, 4, True, False), ("b", 1, 3, False, False), ("b", 2, 9, False, False),
        ("c", 1, 3, False, False), ("c", 2, 4, True, True), ("c", 4, 5, False, False)
    ]


def test_clues_of_a_numberless_heading(spark):
    rows = [
        ("1. 다음 중 옳은 것은?", 0.10), ("ㄱ. 다음 설명을 보고", 0.07), ("본문 설명", 0.10), ("① 보기 하나", 0.1), ("본문 설명", 0.1), ("ABC-1", 0.1),
        ("왜 그런가?", 0.1), ("2학기", 0.1)
    ]
    x = segments.positioned(
        spark.createDataFrame(
            [("f", 1, i, t, float(l)) for i, (t, l) in enumerate(rows, 1)],
            "source_file string, page_index int, line_in_page int, text string, left_ratio double"
        )
    )
    got = {r.pos: (r["index"], r.shown, r.score) for r in with_markers(clues(with_numbers(x, 1, 9), 1, 9)).collect()}
    # six syllables and more: 18 or 21, a short prefix, the leading word near the start, the indent
    assert got[1][:2] == (1, 1) and got[2] == (None, None, 3 * 7 + 25 + 20 + 10) and 4 not in got and 6 not in got and 8 not in got
    assert got[7] == (None, None, 3 * 4 + 20 + 25)


def test_inline_breaks_are_those_of_python(spark):
    d = queries.QUERIES["inline_breaks"](spark, SF).collect()
    x = queries.heading_texts(spark, SF).groupBy("source_file").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda r: r["text"]), " ").alias("t")
    ).collect()
    pattern = re.compile(r"(?<=\s)((?:[1-9]|[1-9]\d)\s*[.)])(?=\s)")
    want = {r.source_file: len(pattern.findall(r.t)) for r in x}
    assert {
        r.source_file: r.breaks for r in d
    } == want and {r.source_file: r.lines for r in d} == {k: v + 1 for k, v in want.items()} and sum(want.values()) > 0


def test_text_functions(spark):
    df = spark.createDataFrame(
        [(" 　a\t", "x" * 151, "x" * 150, "머리 1. 다음 2) 무엇", "가b나", "+5", "1.5", None)],
        "a string, b string, c string, d string, e string, f string, g string, h string"
    )
    r = df.select(
        T.utrim("a"), T.clip("b"), T.clip("c"), T.with_breaks("d"), T.break_count("d"), T.hangul_count("e"), T.try_int("f"),
        T.try_int("g"), T.source_name("h"), T.word_count("a"), T.nonblank("h")
    ).first()
    names = spark.createDataFrame([("/a/b:c*.pdf", ["x", "y"]), (" .pdf", []), ("C:\\d\\e.PDF", ["z"])], "f string, c array<string>")
    assert [
        tuple(r) for r in names.select(T.safe_stem("f"), T.numbered("c"), T.base_name("f"), T.extension("f")).collect()
    ] == [("b_c_", "1. x\n2. y", "b:c*.pdf", ".pdf"), ("analysis", "", " .pdf", ".pdf"), ("e", "1. z", "e.PDF", ".PDF")]
    assert list(r) == ["a", "x" * 150 + "...", "x" * 150, "머리 \n1. 다음 \n2) 무엇", 2, 2, 5, None, "manual", 1, False]
