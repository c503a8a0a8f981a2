from pagequarry.plans import flows

STORED = "id string, category_id string, source_file string, index int, type string, prompt string, answers array<string>"


def test_import(spark):
    text = "안내문\n1. 다음 중 옳은 것은?\n가\n2. 다음 설명을 고르시오\n나\n3. 다음 글을 읽고 답하시오\n다"
    pages = spark.createDataFrame(
        [("a.pdf", 1, text), ("b.pdf", 1, "1. 다음 중 옳은 것은?\n4. 다음 설명을 고르시오\n끝"), ("c.pdf", 1, "plain\n" * 12)],
        "source_file string, page_index int, text string"
    )
    keys = spark.createDataFrame([("a.pdf", "1:3,2:정답,9:1"), ("b.pdf", "1:1"), ("none.pdf", "1:1")], "key_id string, key_text string")
    stored = spark.createDataFrame([("s", "math", "A.pdf", 1, "MC", "old", ["9"])], STORED)
    expected = spark.createDataFrame([("a.pdf", "3"), ("b.pdf", "1-3"), ("c.pdf", "")], "source_file string, expected string")
    out = flows.import_files(pages, keys, stored, expected, "math")
    assert {(r.source_file, r.origin) for r in out["ranges"].collect()} == {("a.pdf", "inferred"), ("b.pdf", "given"), ("c.pdf", "none")}
    assert {r.source_file: r.mismatch for r in out["diagnosis"].collect()} == {"a.pdf": False, "b.pdf": True, "c.pdf": False}
    got = {(r.source_file, r["index"]): (r.type, tuple(r.answers), r.prompt) for r in out["questions"].collect()}
    assert got["A.pdf", 1] == ("MC", ("3",), "math - 1. 다음 중 옳은 것은? 가") and got["a.pdf", 2] == ("SUBJ", ("정답",), "math - 2. 다음 설명을 고르시오 나")
    assert got["a.pdf", 3] == ("MC", (), "math - 3. 다음 글을 읽고 답하시오 다") and got["a.pdf", 9] == ("MC", ("1",), "math - 문항 9")
    assert ("c.pdf", 1) in got and ("c.pdf", 2) in got and not any(f == "b.pdf" for f, _ in got)
    assert not any(f == "none.pdf" for f, _ in got)
    wrong = spark.createDataFrame([("S",), ("other",)], "question_id string")
    over = flows.import_files(pages, keys, stored, expected, "math", overwrite=True, wrong=wrong)
    assert over["questions"].where("source_file = 'a.pdf'").count() == 4 and over["wrong"].count() == 0
    assert {(r.category_id, r.source_file) for r in over["touched"].collect()} == {("math", "a.pdf"), ("math", "c.pdf")}


def boxed(rows):
    """(text, left, top) to lines in the order given."""
    return [(i, t, x, y, x + 0.4, y + 0.02) for i, (t, x, y) in enumerate(rows, 1)]


PAGES = "source_file string, page_index int, text string, image_path string, pixel_width int, pixel_height int, lines array<struct<line_in_page:int,text:string,left_ratio:double,top_ratio:double,right_ratio:double,bottom_ratio:double>>"


def test_import_with_boxes_and_a_missed_heading(spark):
    """Two columns in line order right before left; a blank line, boilerplate, one heading without its dot, one without its number."""
    left = [
        ("1. 다음 중 옳은 것은?", 0.05, 0.1), ("가나다라", 0.05, 0.15), ("  ", 0.05, 0.2), ("2번은 다음 중 고르시오", 0.05, 0.3),
        ("보기 설명", 0.05, 0.35), ("본문 설명", 0.05, 0.4)
    ]
    right = [
        ("3. 다음 글을 읽고", 0.55, 0.1), ("마바사아", 0.55, 0.15), ("ㄴ. 다음 설명을 보고 고르시오", 0.55, 0.3), ("자차카타", 0.55, 0.35),
        ("5. 다음 중 틀린 것은?", 0.55, 0.5), ("끝이다", 0.55, 0.55)
    ]
    lines = boxed([("시험 안내", 0.05, 0.01), *left, *right])
    second = boxed([("머리말", 0.05, 0.01), ("이어지는 글", 0.55, 0.1), ("6. 다음 중 고른 것은?", 0.55, 0.3), ("여기까지", 0.55, 0.35)])
    pages = spark.createDataFrame(
        [
            ("a.pdf", 1, "", "p1.png", 1000, 2000, lines), ("a.pdf", 2, "", "p2.png", 1000, 2000, second),
            ("b.pdf", 1, "1. 다음 중 옳은 것은?\n가나다", None, 0, 0, None)
        ],
        PAGES
    )
    keys = spark.createDataFrame([("a.pdf", "1,2,3,4,5,1"), ("b.pdf", "1")], "key_id string, key_text string")
    stored = spark.createDataFrame([("s", "m", "A.PDF", 2, "SUBJ", "old", ["9"])], STORED)
    expected = spark.createDataFrame([("a.pdf", "6"), ("b.pdf", "7")], "source_file string, expected string")
    out = flows.import_files(pages, keys, stored, expected, "m", category_name="Math")
    assert {(r.source_file, r.origin) for r in out["ranges"].collect()} == {("a.pdf", "inferred"), ("b.pdf", "none")}
    found = {r["index"]: r for r in out["candidates"].where("source_file = 'a.pdf'").collect()}
    place = {i: (r.start_page, r.start_line, r.end_page, r.end_line, r.header, r.preview) for i, r in found.items()}
    assert place[1] == (1, 2, 1, 3, "1. 다음 중 옳은 것은?", "가나다라")
    assert place[2] == (1, 5, 1, 7, "2번은 다음 중 고르시오", "보기 설명\n본문 설명")
    assert place[3] == (1, 8, 1, 9, "3. 다음 글을 읽고", "마바사아")
    assert place[4] == (1, 10, 1, 11, "[추정] 4. ㄴ. 다음 설명을 보고 고르시오", "자차카타")
    # trimming goes before the reading order, so the second page starts at its first heading
    assert place[5] == (1, 12, 1, 13, "5. 다음 중 틀린 것은?", "끝이다") and place[6][:4] == (2, 3, 2, 4)
    assert {r.start_page_line_count for r in found.values()} == {13, 4}
    # a count that no range fits is a mismatch, and its file is not imported
    assert {r.source_file: r.mismatch for r in out["diagnosis"].collect()} == {"a.pdf": False, "b.pdf": True}
    got = {r["index"]: r for r in out["questions"].collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6} and got[2].id == "s" and got[2].answers == ["2"] and got[2].type == "MC" and got[2].prompt.startswith("Math - 2번은")
    segments = got[2].image_segments
    assert [(s.page_index, s.image_path, s.pixel_width) for s in segments] == [(1, "p1.png", 1000)] and got[2].image_path == "p1.png"
    assert [
        round(x, 3) for x in (segments[0].left_ratio, segments[0].top_ratio, segments[0].right_ratio, segments[0].bottom_ratio)
    ] == [0.035, 0.285, 0.465, 0.435]
    # question 3's crop ends at the next heading of its column
    assert [round(x, 3) for x in (got[3].image_top_ratio, got[3].image_bottom_ratio)] == [0.085, 0.185]
    page = {r.page_index: r for r in out["pages"].where("source_file = 'a.pdf'").collect()}
    assert page[1].candidate_indexes == [1, 2, 3, 4, 5] and page[1].line_count == 13 and page[1].leading_lines[:2] == [
        "1: 시험 안내", "2: 1. 다음 중 옳은 것은?"
    ]


def test_explicit_range_bounds_the_first_pass(spark):
    """A heading outside of the range is body text, and lines before the first one inside go. A number with a dot starts a line of its own, also where it had one, so blank lines come before."""
    text = "40. 다음 중 옳은 것은?\n글 하나\n1. 다음 중 옳은 것은?\n글 둘\n2. 다음 글을 읽고 답하라\n글 셋"
    pages = spark.createDataFrame([("f", 1, text)], "source_file string, page_index int, text string")
    bounds = spark.createDataFrame([("f", 1, 2)], "source_file string, low int, high int")
    assert [
        (r["index"], r.start_line, r.end_line, r.end_page_line_count) for r in flows.split(pages, bounds).orderBy("index").collect()
    ] == [(1, 4, 5, 8), (2, 7, 8, 8)]
    assert [(r["index"], r.start_line) for r in flows.split(pages).orderBy("index").collect()] == [(40, 1)]


def test_recovered_spans(spark):
    rows = [("1. 다음 중 옳은 것은?", 1), ("가나다라", 2), ("2번은 다음 중 고르시오", 3), ("본문 설명", 4), ("3. 다음 글을 읽고", 5), ("끝이다", 6)]
    lines = spark.createDataFrame(
        [(1, 1, n, t, 0.0) for t, n in rows], "source_file long, page_index int, line_in_page int, text string, left_ratio double"
    )
    got = {(r["index"], r.start_line, r.end_line, r.preview) for r in flows.recovered_spans(lines, 1, 3).collect()}
    assert got == {(1, 1, 2, "가나다라"), (2, 3, 4, "본문 설명"), (3, 5, 6, "끝이다")}


def test_practice(spark):
    q = spark.createDataFrame([(str(i), "c", "f", i, "MC", "p", ["1"] if i % 2 else []) for i in range(10)], STORED)
    a = spark.createDataFrame(
        [("s", k, str(i), "1" if i < 5 else "2", k) for k, i in enumerate(range(10))],
        "session_id string, seq int, question_id string, user_answer string, ts int"
    )
    out = flows.practise(q, a, "C", 5, 1)
    assert out["chosen"].count() == 5 and [(r.correct, r.total) for r in out["scores"].collect()] == [(2, 5)]
    assert {r.question_id for r in out["wrong"].collect()} == {"5", "7", "9"}
    assert flows.practise(q, a, "c", 6, 1)["chosen"].count() == 0
