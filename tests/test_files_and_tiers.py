import os

from pyspark.sql import functions as F

from pagequarry.functions import text as T
from pagequarry.operators import segments
from pagequarry.sources import files


def png(width, height):
    return bytes.fromhex("89504E470D0A1A0A0000000D49484452") + width.to_bytes(4, "big") + height.to_bytes(4, "big")


def test_folders_are_listed_and_images_measured(spark, tmp_path):
    """Names with blanks and any letters, in any case; a file of 3 GB, of which no more than the header may be read."""
    a, b = tmp_path / "a", tmp_path / "b 100%"
    (a / "deep").mkdir(parents=True)
    b.mkdir()
    names = [a / "page-0001.png", a / "P 2.PNG", b / "쪽 #3.png", a / "deep" / "x.png"]
    for i, name in enumerate(names, 1):
        name.write_bytes(png(100 * i, 10 * i))
        os.truncate(name, 3 << 30 if i == 1 else 5000)
    (a / "short.png").write_bytes(png(1, 1)[:20])
    (a / "notes.txt").write_text("x")
    found = files.scanned(spark, [str(a), str(b)], ".png")
    assert {(r.path.rsplit("/", 1)[1], r["rank"], r.length) for r in found.collect()} == {
        ("page-0001.png", 1, 3 << 30), ("P 2.PNG", 1, 5000), ("쪽 #3.png", 2, 5000), ("short.png", 1, 20)
    }
    assert files.scanned(spark, [str(a)], ".png", recursive=True).count() == 4 and files.scanned(spark, [str(a)], ".pdf").count() == 0
    gone = spark.createDataFrame([(f"file:{a}/gone.png",), (None,), (str(names[3]),)], "path string")
    sizes = {r.path and r.path.rsplit("/", 1)[1]: (r.width, r.height) for r in files.image_sizes(found.select("path").unionAll(gone)).collect()}
    assert sizes == {
        "page-0001.png": (100, 10), "P 2.PNG": (200, 20), "쪽 #3.png": (300, 30), "x.png": (400, 40), "short.png": (None, None),
        "gone.png": (None, None), None: (None, None)
    }
    assert files.listing(found, ".png").count() == 4


def tiers(lines):
    """Each file's first way that finds anything, one way after another."""
    placed = segments.positioned(lines)
    ways = [segments.by_heading(placed, T.STRICT_HEADING), segments.by_heading(placed, T.PERMISSIVE_HEADING), segments.by_chunks(placed)]
    out, done = [], set()
    for tier, way in enumerate(ways):
        got = [r.asDict() | {"tier": tier} for r in way.collect() if r.source_file not in done]
        done |= {r["source_file"] for r in got}
        out += got
    return sorted(str(sorted(r.items())) for r in out)


def test_tiers_in_one_pass(spark):
    rows = []
    for f in range(9):
        for i in range(25):
            strict, loose = f"{i // 3 + 1}. 다음 중 옳은 것은?", f"{T.CIRCLED[i // 3]} 다음 중 옳은 것은?"
            heading = {0: strict, 1: loose, 2: "본문", 3: strict if i % 2 else loose}[f % 4] if i % 3 == 0 else f"가나다 {f} {i}"
            # a number that comes again or is smaller is body text
            rows.append((f"f{f}", i // 10 + 1, i % 10 + 1, heading if (i, f) != (12, 4) else "1. 다음 중 옳은 것은?"))
    rows.append(("empty", 1, 1, None))
    lines = spark.createDataFrame(rows, "source_file string, page_index int, line_in_page int, text string")
    got = segments.segment_documents(lines)
    assert sorted(str(sorted(r.asDict().items())) for r in got.collect()) == tiers(lines)
    assert {r.tier for r in got.collect()} == {0, 1, 2}
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1
    assert segments.segment_documents(lines.where("false")).count() == 0


def test_bounds_choose_the_tier(spark):
    """Strict headings outside of the bounds are none, so the permissive ones inside count."""
    rows = [(1, "40. 다음 중 옳은 것은?"), (2, "글"), (3, "② 다음 중 옳은 것은?"), (4, "끝")]
    x = spark.createDataFrame([("f", 1, n, t, 1, 9) for n, t in rows], "source_file string, page_index int, line_in_page int, text string, low int, high int")
    assert [(r["index"], r.tier) for r in segments.segment_documents(x, "low", "high").collect()] == [(2, 1)]
    assert [(r["index"], r.tier) for r in segments.segment_documents(x).collect()] == [(40, 0)]
