import json
import os
import random

import pytest
from pyspark.sql import functions as F

from pagequarry.functions import text as T
from pagequarry.operators import answers, catalogue, diagnostics, grading, importer, layout, lines, practice, ranges, segments
from pagequarry.sources import files, store
from pagequarry.streaming.wrong_set import wrong_state

KEYS = {
    "1:3|4,2:정답": [(1, ["3", "4"], "MC"), (2, ["정답"], "SUBJ")], "1,2,3": [
        (1, ["1"], "MC"), (2, ["2"], "MC"), (3, ["3"], "MC")
    ], "1,,3": [(1, ["1"], "MC"), (2, [], "MC"), (3, ["3"], "MC")],
    "1,2\n": [
        (1, ["1"], "MC"), (2, ["2"], "MC"), (3, [], "MC")
    ], "1:3,1:4": [(1, ["4"], "MC")], "1:": [(1, [], "MC")], "x:3": [], "0:3": [], "1:3,7": [(1, ["3"], "MC")], "1:a:b": [(1, ["a:b"], "SUBJ")],
    "1:|3| ": [(1, ["3"], "MC")], "2:1\r\n1:2": [(1, ["2"], "MC"), (2, ["1"], "MC")], "1:3;2:abc|4": [
        (1, ["3"], "MC"), (2, ["abc", "4"], "SUBJ")
    ], "  ": [],
}


def test_answer_keys(spark):
    df = spark.createDataFrame(list(enumerate(KEYS)), "key_id int, key_text string")
    got = {i: [] for i in range(len(KEYS))}
    for r in answers.answer_map(df).orderBy("key_id", "index").collect():
        got[r.key_id].append((r["index"], r.answers, r.type))
    assert [got[i] for i in range(len(KEYS))] == list(KEYS.values())


def test_answer_key_errors(spark):
    df = spark.createDataFrame([(0, "1:3,1:4"), (1, "1:"), (2, "x:3"), (3, "1:3,7")], "key_id int, key_text string")
    assert {(r.key_id, r.error) for r in answers.key_errors(df).collect()} == {(0, "duplicate"), (1, "answer"), (2, "number"), (3, "format")}


def test_grading(spark):
    rows = [
        ("MC", ["3", "4"], g, w) for g,
        w in (("4", True), (" 3 ", True), ("03", True), ("+3", True), ("5", False), ("3.0", False), ("", False), ("three", False), (None, False))
    ]
    rows += [
        ("MC", [], "3", None), ("SUBJ", ["Abc"], " aBC ", True), ("SUBJ", ["Abc"], "a bc", False),
        ("SUBJ", ["3", "abc"], "3", True), ("SUBJ", ["3", "abc"], "03", False), ("SUBJ", [" "], "x", None)
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, type string, answers array<string>, user_answer string")
    got = {r.i: r.ok for r in df.select("i", grading.is_correct().alias("ok")).collect()}
    assert [got[i] for i in range(len(rows))] == [r[3] for r in rows]


def test_wrong_set_is_the_replayed_fold(spark):
    rng = random.Random(3)
    events = [(f"q{rng.randrange(8)}", i, i, rng.choice([True, False, None])) for i in range(200)]
    want: set = set()
    for q, _, _, ok in events:
        if ok is not None:
            (want.discard if ok else want.add)(q)
    df = spark.createDataFrame(events, "question_id string, ts int, seq int, is_correct boolean")
    assert {r.question_id for r in grading.wrong_set(df).collect()} == want


def test_wrong_set_as_stream(spark, tmp_path):
    events = [("a", 1, 1, False), ("b", 2, 2, False), ("a", 3, 3, True), ("b", 1, 0, True)]
    spark.createDataFrame(events, "question_id string, ts int, seq int, is_correct boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("question_id string, ts int, seq int, is_correct boolean").parquet(str(tmp_path / "in"))
    q = wrong_state(stream).writeStream.outputMode("complete").format("memory").queryName("wrong").option(
        "checkpointLocation", str(tmp_path / "cp")
    ).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.sql("SELECT * FROM wrong").collect()} == {("a", False), ("b", True)}


def test_running_maximum_is_greedy_acceptance(spark):
    rng = random.Random(5)
    rows, want = [], []
    for f in range(30):
        last = 0
        for p in range(20):
            i = rng.choice([None, rng.randrange(0, 12)])
            ok = i is not None and i > last
            last = i if ok else last
            rows.append((f, p, i))
            want.append((f, p, ok))
    df = spark.createDataFrame(rows, "source_file int, pos int, index int")
    assert {(r.source_file, r.pos, r.accepted) for r in segments.accept_rising(df).collect()} == set(want)


def infer(indexes, n):
    best = None
    seen = sorted({i for i in indexes if i > 0})
    for s in sorted({s for c in seen for s in range(max(1, c - n + 1), c + 1)}):
        hit = [c for c in seen if s <= c <= s + n - 1]
        score = 1000 * len(hit) - 10 * (hit[0] - s) - (hit[-1] - hit[0]) - s
        key = (-score, hit[0], hit[-1] - hit[0], s)
        if best is None or key < best[0]:
            best = (key, s, len(hit))
    return (best[1], best[1] + n - 1) if best and best[2] >= min(2, n) else None


def test_range_inference(spark):
    rng = random.Random(7)
    cases = [([31, 32, 34, 40], 10), ([3], 5), ([1, 2, 3], 3), ([5], 1)] + [
        ([rng.randrange(1, 60) for _ in range(rng.randrange(1, 9))], rng.randrange(1, 12)) for _ in range(60)
    ]
    df = spark.createDataFrame([(f, n, i) for f, (c, n) in enumerate(cases) for i in c], "source_file int, expected_count int, index int")
    got = {r.source_file: (r.start_index, r.end_index) for r in ranges.inferred(df).collect()}
    assert [got.get(f) for f in range(len(cases))] == [infer(*c) for c in cases]


def test_expected_input(spark):
    cases = {
        "": ("none", None), "25": ("count", 25), "31-55": ("range", 25), "31~55": ("range", 25), "31 〜 55": ("range", 25),
        "55-31": ("error", None), "0-5": ("error", None), "0": ("error", None), "abc": ("error", None), "1-2-3": ("error", None)
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").withColumn("e", ranges.expected_input("t"))
    assert {r.t: (r.e["kind"], r.e["count"]) for r in df.collect()} == cases


def upsert(spark, stored, incoming, **kw):
    s = spark.createDataFrame(
        stored, "id string, category_id string, source_file string, index int, type string, prompt string, answers array<string>"
    )
    i = spark.createDataFrame(
        incoming, "pos int, category_id string, source_file string, index int, type string, prompt string, answers array<string>"
    )
    return s, i


def test_upsert(spark):
    s, i = upsert(
        spark, [("s1", "c", "a.pdf", 1, "MC", "p", ["3"]), ("s2", "c", "a.pdf", 2, "MC", "p", [])],
        [
            (1, "c", "A.PDF", 1, "SUBJ", "n", []), (2, "c", "a.pdf", 2, "SUBJ", "", ["abc "]),
            (3, "c", "a.pdf", 9, "MC", "x", ["1"]), (4, "c", "a.pdf", 9, "MC", "y", ["2"])
        ]
    )
    got = {(r.id if len(r.id) < 64 else "new", r["index"], r.type, r.prompt, tuple(r.answers)) for r in importer.merged(s, i).collect()}
    assert got == {("s1", 1, "MC", "n", ()), ("s2", 2, "SUBJ", "문항 2", ("abc",)), ("new", 9, "MC", "y", ("2",))}
    again = importer.merged(importer.merged(s, i), i)
    assert again.count() == 3
    over = importer.overwritten(s, i).collect()
    assert len(over) == 4 and all(len(r.id) == 64 for r in over)


def test_store_round_trip(spark, tmp_path):
    assert store.read_json(spark, str(tmp_path / "none.json"))["questions"].count() == 0
    state = {
        "Categories": [{"Id": "c1", "Name": "Math"}],
        "Questions": [
            {"Id": "AB", "Index": 1, "CategoryId": "c1", "SourceFileName": "f.pdf", "Type": 1, "CorrectAnswers": ["x"], "ImagePath": "p.png"}
        ],
        "WrongQuestionIds": ["AB"]
    }
    (tmp_path / "s.json").write_text(json.dumps(state))
    t = store.read_json(spark, str(tmp_path / "s.json"))
    q = t["questions"].first()
    assert (q.id, q.type, q.prompt, q.correct_answers, len(q.image_segments), q.image_bottom_ratio) == ("ab", "SUBJ", "", ["x"], 1, 1.0)
    store.save(spark, str(tmp_path / "db"), t)
    store.save(spark, str(tmp_path / "db"), {"wrong_questions": t["wrong_questions"]})
    assert [r.question_id for r in store.load(spark, str(tmp_path / "db"), "wrong_questions").collect()] == ["ab"]


def test_store_versions(spark, tmp_path):
    """A table is replaced by one rename; the folder it was in lasts one version, so readers that have begun can end."""
    one = spark.createDataFrame([("a",)], "question_id string")
    folder = str(tmp_path / "db")
    store.save(spark, folder, {"wrong_questions": one, "other": one})
    reader, first = store.load(spark, folder, "wrong_questions"), store.current(spark, folder)["tables"]
    store.save(spark, folder, {"wrong_questions": reader.unionAll(one)})
    assert reader.count() == 1 and store.load(spark, folder, "wrong_questions").count() == 2
    assert store.current(spark, folder)["tables"]["other"] == first["other"]
    store.save(spark, folder, {"wrong_questions": one})
    assert not (tmp_path / "db" / first["wrong_questions"]).exists() and store.load(spark, folder, "other").count() == 1
    with pytest.raises(Exception, match="fails"):
        store.save(spark, folder, {"wrong_questions": one.select(F.raise_error(F.lit("fails")).alias("question_id"))})
    assert [r.question_id for r in store.load(spark, folder, "wrong_questions").collect()] == ["a"]


def test_texts_and_reports(spark, tmp_path):
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "one.txt").write_text("1:3\n2:4")
    assert [(r.key_id.rsplit("/", 1)[-1], r.key_text) for r in store.key_texts(spark, str(tmp_path / "k")).collect()] == [("one.txt", "1:3\n2:4")]
    pages = spark.createDataFrame([("a.pdf", 1, "x y\n\nz"), ("a.pdf", 2, "")], "source_file string, page_index int, text string")
    store.write_by_file(pages, str(tmp_path / "pages"), "json")
    assert store.read_by_file(spark, str(tmp_path / "pages"), PAGES, "json").where("source_file = 'a.pdf'").count() == 2
    c = spark.createDataFrame(
        [("a.pdf", 2, "h2", 1, 2, 1, 3), ("a.pdf", 1, "h1", 1, 1, 1, 1)],
        "source_file string, index int, header string, start_page int, start_line int, end_page int, end_line int"
    )
    d = diagnostics.diagnose(c.withColumns({"start_index": F.lit(1), "end_index": F.lit(3)}))
    by_page = diagnostics.page_diagnostics(pages, c)
    assert {
        r.page_index: (r.word_count, r.leading_lines, r.candidate_indexes) for r in by_page.collect()
    } == {1: (3, ["1: x y", "2: z"], [1, 2]), 2: (0, [], [])}
    folder = str(tmp_path / "reports")
    files = spark.createDataFrame([("a.pdf",), ("b.pdf",)], "source_file string")
    assert {r.text for r in store.read_reports(spark, folder, files).collect()} == {T.NO_DIAGNOSTICS}
    store.write_reports(diagnostics.report(d, by_page, c), folder)
    got = {r.source_file: r.text for r in store.read_reports(spark, folder, files).collect()}
    assert got["b.pdf"] == T.NO_DIAGNOSTICS and got["a.pdf"].splitlines() == [
        "file: a.pdf", "numbers: 1, 2", "missing: 3", "unexpected: -", "repeated: -", "mismatch: true", "",
        "page 1 | 1, 2 | lines 0 | words 3", "  1: x y", "  2: z", "page 2 | - | lines 0 | words 0", "", "1 | 1:1 -> 1:1 | h1", "2 | 1:2 -> 1:3 | h2",
    ]


PAGES = "source_file string, page_index int, text string"


def test_files_that_an_import_does_not_touch_keep_what_was_written(spark, tmp_path, monkeypatch):
    folder, reports = str(tmp_path / "analysis"), str(tmp_path / "reports")
    made = lambda *rows: spark.createDataFrame(list(rows), PAGES)
    read = lambda: sorted(map(tuple, store.read_by_file(spark, folder, PAGES).collect()))
    assert read() == []
    store.write_by_file(made(("007", 1, "x"), ("a.pdf", 1, "old"), ("A.PDF", 1, "other"), ("k=v/é.pdf", 2, None)), folder)
    store.write_by_file(made(("a.pdf", 1, "new"), ("a.pdf", 2, "more"), ("b.pdf", 1, "b")), folder)
    first = [("007", 1, "x"), ("A.PDF", 1, "other"), ("a.pdf", 1, "new"), ("a.pdf", 2, "more"), ("b.pdf", 1, "b"), ("k=v/é.pdf", 2, None)]
    assert read() == first

    def fails(*_):
        raise OSError("full")

    with monkeypatch.context() as m:
        m.setattr(store, "save", fails)
        with pytest.raises(OSError):
            store.write_by_file(made(("b.pdf", 9, "lost")), folder)
    assert read() == first
    # a file of which nothing is left, and versions without a part go
    store.write_by_file(made(("a.pdf", 3, "last")), folder, files=spark.createDataFrame([("a.pdf",), ("b.pdf",)], "source_file string"))
    assert read() == [("007", 1, "x"), ("A.PDF", 1, "other"), ("a.pdf", 3, "last"), ("k=v/é.pdf", 2, None)]
    store.write_by_file(made(("a.pdf", 4, "again")), folder)
    assert len(os.listdir(f"{folder}/parts")) <= 3
    texts = lambda *rows: spark.createDataFrame(list(rows), "source_file string, text string")
    store.write_reports(texts(("a.pdf", "one\ntwo"), ("12.pdf", "twelve")), reports)
    store.write_reports(texts(("b.pdf", "b")), reports)
    files = spark.createDataFrame([("a.pdf",), ("b.pdf",), ("12.pdf",), ("c.pdf",)], "source_file string")
    assert {r.source_file: r.text for r in store.read_reports(spark, reports, files).collect()} == {
        "a.pdf": "one\ntwo", "b.pdf": "b", "12.pdf": "twelve", "c.pdf": T.NO_DIAGNOSTICS
    }


def test_an_overwriting_import_takes_away_the_marks_of_what_it_removes(spark, tmp_path):
    s, i = upsert(
        spark, [("S1", "c", "a.pdf", 1, "MC", "p", ["3"]), ("s2", "c", "b.pdf", 1, "MC", "p", []), ("s3", "d", "a.pdf", 1, "MC", "p", [])],
        [(1, "c", "A.PDF", 1, "MC", "n", []), (2, "c", "A.PDF", 1, "MC", "n", [])]
    )
    wrong = spark.createDataFrame([("s1",), ("S2",), ("s9",)], "question_id string")
    assert [r[0] for r in importer.removed_ids(s, i).collect()] == ["S1"]
    one, two = importer.overwritten(s, i), importer.overwritten(s, i)
    ids = [{r.id for r in x.collect()} for x in (one, two)]
    assert len(ids[0]) == 4 and ids[0] & ids[1] == {"s2", "s3"}
    assert [r[0] for r in catalogue.kept_wrong(wrong, one).collect()] == ["S2"]
    # ids are equal in any case
    assert {r.id for r in catalogue.wrong_notes(s, wrong).collect()} == {"S1", "s2"}
    assert {r[0] for r in catalogue.kept_wrong(wrong, s).collect()} == {"s1", "S2"}
    # only the touched groups are written
    folder = str(tmp_path / "questions")
    every = s.select("id", "category_id", "source_file", "index")
    schema = "id string, category_id string, source_file string, index int"
    store.save_questions(every, folder, every)
    after = importer.overwritten(importer.of_groups(s, importer.groups(i)), i, "2").select("id", "category_id", "source_file", "index")
    store.save_questions(after, folder, importer.groups(i).withColumnRenamed("file_key", "source_file"))
    assert sorted(map(tuple, store.load_questions(spark, folder, schema).collect())) == sorted(
        map(tuple, importer.overwritten(s, i, "2").select("id", "category_id", "source_file", "index").collect())
    )


def plain_range(numbers, n):
    """Every range that holds a number."""
    found = []
    for s in {s for i in numbers for s in range(max(1, i - n + 1), i + 1)}:
        hits = [i for i in numbers if s <= i < s + n]
        lo, hi = min(hits), max(hits)
        found.append((-(1000 * len(hits) - 10 * (lo - s) - (hi - lo) - s), lo, hi - lo, s, len(hits)))
    *_, s, hits = min(found)
    return (s, s + n - 1, hits) if hits >= min(2, n) else None


def test_ranges_are_the_best_of_all_starts(spark):
    rng = random.Random(6)
    want, rows = {}, []
    for f in range(120):
        n = rng.choice([1, 2, 5, 20, 300, 1500, 4000])
        top = rng.choice([8, 60, 900, 6000])
        numbers = sorted({rng.randrange(1, top) for _ in range(rng.randrange(1, 12))})
        want[f"f{f}"] = plain_range(numbers, n)
        rows += [(f"f{f}", n, i) for i in [*numbers, numbers[0], 0, -3]]
    df = spark.createDataFrame(rows, "source_file string, expected_count int, index int")
    got = {r.source_file: (r.start_index, r.end_index, r.hits) for r in ranges.inferred(df).collect()}
    assert got == {f: w for f, w in want.items() if w}


def test_samples_of_all_categories_are_those_of_each(spark):
    q = spark.createDataFrame([(f"q{i}", f"c{i % 4}", ["1"] if i % 3 else []) for i in range(60)], "id string, category_id string, answers array<string>")
    got = {(r.category_id, r.id) for r in practice.samples(q, 4, 9, answered_only=True).collect()}
    assert got == {
        (c, r.id) for c in ("c0", "c1", "c2", "c3") for r in practice.sample(q.where(F.col("category_id") == c), 4, 9, answered_only=True).collect()
    }
    assert practice.samples(q, 0, 9).count() == 0 and practice.samples(q, 99, 9).count() == 60


def test_practice_sets(spark):
    q = spark.createDataFrame(
        [(f"q{i}", "c" if i % 2 else "C", f"f{i % 3}", i, ["1"]) for i in range(12)],
        "id string, category_id string, source_file string, index int, answers array<string>"
    )
    wrong = spark.createDataFrame([("Q1",), ("q3",), ("q4",), ("gone",)], "question_id string")
    pick = lambda *a: sorted(r.id for r in practice.random_questions(q, *a).collect())
    assert pick("c", 99, 1) == [
        "q1", "q11", "q3", "q5", "q7", "q9"
    ] and len(pick("c", 4, 1)) == 4 and pick("c", 0, 1) == [] and pick("c", 9, 1, wrong) == ["q1", "q3"]
    session = [r.id for r in practice.wrong_practice(q, wrong, 2).collect()]
    assert sorted(session) == ["q1", "q3", "q4"]
    assert [r["index"] for r in catalogue.review(q, "c", "F1").collect()] == [1, 7]
    names = spark.createDataFrame([("1", "b"), ("2", "B"), ("3", "a"), ("4", "A")], "id string, name string")
    assert [catalogue.file_count(q, c, f).first().questions for c, f in (("C", "F1"), ("c", "f9"), ("none", "f1"))] == [4, 0, 0]
    assert [r.name for r in catalogue.listed(names).collect()] == ["a", "A", "b", "B"]
    uuid = "0123abcd-0123-0123-0123-0123456789ab"
    some = spark.createDataFrame(
        [(uuid, "c", "f", 1, ["1"]), ("x", "c", "f", 2, ["1"])],
        "id string, category_id string, source_file string, index int, answers array<string>"
    )
    assert [r.id for r in catalogue.wrong_notes(some, spark.createDataFrame([(uuid,), ("x",)], "question_id string"), uuids=True).collect()] == [uuid]
    times = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS a, timestamp'2024-01-01 00:00:04' AS b")
    one = times.select(
        lines.seconds_between(F.col("a"), F.col("b")), lines.pages_per_second(F.lit(6), F.col("a"), F.col("b")),
        lines.pages_per_second(F.lit(0), F.col("a"), F.col("b")), lines.pages_per_second(F.lit(2), F.col("a"), F.col("a"))
    ).first()
    assert list(one) == [4.0, 1.5, 0.0, 2e6]


def test_stored_questions_keep_images_and_choices(spark):
    segment = "struct<page_index:int,image_path:string,left_ratio:double,top_ratio:double,right_ratio:double,bottom_ratio:double,pixel_width:int,pixel_height:int>"
    more = f"choices array<string>, image_segments array<{segment}>, image_path string, image_top_ratio double, image_bottom_ratio double"
    schema = f"id string, category_id string, source_file string, index int, type string, prompt string, answers array<string>, {more}"
    s = spark.createDataFrame(
        [
            ("s", "c", "f", 1, "MC", "p", ["1"], ["x"], [(1, "old", 0.0, 0.0, 1.0, 1.0, 5, 6)], "old", 0.1, 0.2),
            ("t", "c", "g", 1, "MC", "p", ["1"], ["y"], [], "keep", 0.3, 0.4)
        ],
        schema
    )
    i = spark.createDataFrame(
        [(1, "c", "F", 1, "MC", " n ", ["2"], ["z"], [], "new", 0.5, 0.6), (2, "c", "F", 2, "MC", "m", [], None, None, None, None, None)],
        schema.replace("id string", "pos int", 1)
    )
    got = {(r.source_file, r["index"]): r for r in importer.merged(s, i).collect()}
    one = got["f", 1]
    assert (one.prompt, one.choices, one.image_path, one.image_top_ratio) == ("n", ["z"], "new", 0.5)
    assert [tuple(x)[:6] for x in one.image_segments] == [(1, "new", 0.0, 0.5, 1.0, 0.6)]
    assert (got["g", 1].choices, got["g", 1].image_path, got["g", 1].image_bottom_ratio) == (["y"], "keep", 0.4)
    assert (got["F", 2].choices, got["F", 2].image_segments, got["F", 2].image_path, got["F", 2].image_bottom_ratio) == ([], [], None, 1.0)
    assert importer.overwritten(s, i).columns == importer.merged(s, i).columns


def test_pixel_boxes(spark):
    words = spark.createDataFrame([(1, 10, 20, 30, 5), (1, 50, 18, 20, 9), (1, 0, 0, 0, 9), (2, 5, 5, 5, 5)], "line int, x int, y int, w int, h int")
    got = {r.line: (r.x0, r.y0, r.x1, r.y1) for r in layout.word_boxes(words, "line").collect()}
    assert got == {1: (10, 18, 70, 27), 2: (5, 5, 10, 10)}
    box = spark.createDataFrame([(-5, 70, 100), (10, 250, 200), (1, 2, 0)], "x0 int, x1 int, size int")
    assert [tuple(r) for r in box.select(*layout.to_ratio("x0", "x1", "size")).collect()] == [(0.0, 0.7), (0.05, 1.0), (1.0, 1.0)]
    lines_beyond = spark.range(1).select(
        layout.line_top(F.lit(30), F.lit(10)), layout.line_bottom(F.lit(99), F.lit(10), F.lit(0.2)),
        layout.line_bottom(F.lit(1), F.lit(10), F.lit(0.55)), layout.line_top(F.lit(0), F.lit(0))
    ).first()
    assert [round(x, 6) for x in lines_beyond] == [0.9, 1.0, 0.6, 0.0]


def test_segments_of_a_question_once_each(spark):
    """The shared passage first; a page without lines of the column has none; equal crops are one."""
    c = spark.createDataFrame(
        [("f", 3, 1, 2, 3, 4, 4, 2)],
        "source_file string, index int, start_page int, end_page int, start_line int, end_line int, start_page_line_count int, end_page_line_count int"
    )
    own = [
        (1, "[3~4] 다음 글을 보고 답하라", 0.05, 0.1, 0.45, 0.12), (2, "긴 글", 0.05, 0.15, 0.45, 0.17),
        (3, "3. 다음 중", 0.05, 0.3, 0.45, 0.32), (4, "보기", 0.05, 0.35, 0.45, 0.37)
    ]
    pages = spark.createDataFrame(
        [("f", 1, "", "a", 1, 1, own), ("f", 2, "", "b", 1, 1, [(1, "다른 단", 0.9, 0.1, 0.95, 0.2)]), ("f", 3, "", None, 1, 1, own)],
        "source_file string, page_index int, text string, image_path string, pixel_width int, pixel_height int, lines array<struct<line_in_page:int,text:string,left_ratio:double,top_ratio:double,right_ratio:double,bottom_ratio:double>>"
    )
    got = layout.image_segments(c, layout.page_table(pages, c)).orderBy("pos").collect()
    assert [(r.page_index, round(r.top_ratio, 3), round(r.bottom_ratio, 3)) for r in got] == [(1, 0.085, 0.185), (1, 0.285, 0.385)]
    existing = spark.createDataFrame([("/b/x.pdf", 2), ("/a/X.PDF", 1), ("/a/y.pdf", 1)], "path string, rank int")
    assert {
        (r.name, r.path) for r in files.first_existing(spark.createDataFrame([("x.pdf",), ("z.pdf",)], "name string"), existing).collect()
    } == {("x.pdf", "/a/X.PDF")}
    assert spark.range(1).select(files.page_image_name(F.lit(7))).first()[0] == "page-0007.png"


def test_layout_and_files(spark):
    r = spark.range(1).select(
        layout.line_top(F.lit(3), F.lit(10)), layout.line_bottom(F.lit(5), F.lit(10), F.lit(0.2)),
        layout.at_least(F.lit(0.10), F.lit(0.11), 0.02)
    ).first()
    assert [round(x, 6) for x in r] == [0.2, 0.5, 0.12]
    seg = spark.createDataFrame(
        [(0.0, 1.0, 0.25, 0.5, 1000, 2000)],
        "left_ratio double, right_ratio double, top_ratio double, bottom_ratio double, pixel_width int, pixel_height int"
    )
    v = layout.slice_view(seg).first()
    assert (v.content_width, v.content_height, v.visible_width, v.visible_height, v.shift_y) == (320.0, 640.0, 320.0, 160.0, -160.0)
    listed = files.listing(
        spark.createDataFrame(
            [("/a/p-10.PDF", 1), ("/a/p-2.pdf", 1), ("/b/P-2.PDF", 2), ("/a/x.txt", 1), ("/a/cover.pdf", 1)],
            "path string, rank int"
        )
    )
    assert [r.path for r in listed.orderBy("place").collect()] == ["/a/p-2.pdf", "/a/p-10.PDF", "/a/cover.pdf"]
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452") + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    size = spark.createDataFrame([(png,), (b"x",)], "content binary").select(files.png_size().alias("s")).collect()
    assert tuple(size[0].s) == (640, 480) and size[1].s is None


def test_chunks_of_ten(spark):
    df = spark.createDataFrame([("f", 1, i, f"line {i}") for i in range(1, 24)], "source_file string, page_index int, line_in_page int, text string")
    got = segments.segment_documents(df).orderBy("index").collect()
    assert [(r["index"], r.start_line, r.end_line) for r in got] == [(1, 1, 10), (2, 11, 20), (3, 21, 23)]
