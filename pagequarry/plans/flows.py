"""Whole ways through the operators: import of files, and practice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.functions.text import QUESTION, nonblank, utrim
from pagequarry.operators import answers, catalogue, diagnostics, grading, headings, importer, layout, lines, practice, ranges, recovery, scans, segments
from pagequarry.session import settle


def page_lines(pages: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Lines of every file, to be positioned by ``read_at``, without what stands before a page's first heading and without blank ones.

    ``bounds`` (source_file, low, high) limit the numbers that headings may have; they come
    along. Lines with boxes are first trimmed in line order, then put in reading order.
    ``page_lines`` is the largest line number of the page.
    """
    raw = lines.raw_lines(pages)
    raw = raw.withColumns(
        {"low": F.lit(None).cast("int"), "high": F.lit(None).cast("int")}
    ) if bounds is None else raw.join(bounds, "source_file", "left")
    page = Window.partitionBy("source_file", "page_index")
    read = headings.marked(
        raw, "line_in_page", "low", "high", {"heading": headings.T.STRICT_HEADING}
    ).withColumn("all_lines", F.max("line_in_page").over(page))
    kept = lines.reading_order(lines.trim_boilerplate(read, F.col("heading").isNotNull()))
    shown = kept.withColumn("text", utrim("text")).where(nonblank("text"))
    counted = shown.withColumn(
        "page_lines", F.when(F.col("boxed"), F.greatest(F.lit(1), F.max("line_in_page").over(page))).otherwise(F.col("all_lines"))
    )
    return counted.select(
        "source_file", "page_index", "line_in_page", "read_at", "text", "left_ratio", "top_ratio", "right_ratio", "bottom_ratio",
        "page_lines", "low", "high"
    )


def split(pages: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Candidates of every file: by headings, with those recovered that the bounds ask for, else by chunks.

    Where headings were recovered, all of the file's candidates are rebuilt from them. If a
    file has more lines than one task should sort, files are handled in blocks.
    """
    rows = settle(page_lines(pages, bounds), "split-lines")
    block = scans.needed_block(rows)
    found = segments.positioned(rows, block).drop("read_at")
    read = settle(segments.segment_documents(found, "low", "high", block), "split-read")
    if bounds is None:
        return read
    # a candidate's first line is its heading
    starts = read.where("tier < 2").select("source_file", "index", F.col("start_page").alias("page_index"), F.col("start_line").alias("line_in_page"))
    bounded = found.where("low IS NOT NULL").join(starts.select("source_file").distinct(), "source_file", "left_semi")
    markers = bounded.join(starts, ["source_file", "page_index", "line_in_page"]).select(
        "source_file", "pos", F.col("index").cast("int").alias("index")
    )
    every = settle(recovery.recover(bounded, "low", "high", markers, block), "split-markers")
    changed = every.where("inferred").select("source_file").distinct()
    rebuilt = segments.rebuilt(every, found.join(changed, "source_file", "left_semi"), block)
    tiers = read.select("source_file", "tier").distinct()
    return read.join(changed, "source_file", "left_anti").unionByName(rebuilt.join(tiers, "source_file"))


def expected_ranges(pages: DataFrame, first: DataFrame, expected: DataFrame) -> DataFrame:
    """Each file's (range, origin, asked): ``expected`` has source_file and what the user typed; ``asked`` is whether that says anything."""
    typed = expected.withColumn("e", ranges.expected_input("expected")).select("source_file", "e.*")
    given = typed.where("kind = 'range'").select("source_file", "start_index", "end_index")
    counts = typed.where("kind = 'count'").select("source_file", F.col("count").alias("expected_count"))
    hint = ranges.hinted(lines.hint_lines(pages).join(counts, "source_file"))
    inference = ranges.inferred(first.join(counts, "source_file"))
    found = ranges.resolved(pages, given, hint, inference)
    return found.join(
        typed.select("source_file", (F.col("kind") != "none").alias("asked")), "source_file", "left"
    ).withColumn("asked", F.coalesce("asked", F.lit(False)))


def judged(candidates: DataFrame, resolved: DataFrame) -> DataFrame:
    """The diagnosis of every file, also of those without candidates: where numbers were asked for, a range that isn't known or isn't filled is a mismatch."""
    bounds = resolved.select("source_file", F.col("range.start_index").alias("start_index"), F.col("range.end_index").alias("end_index"))
    found = diagnostics.diagnose(candidates.where("index > 0").join(bounds, "source_file"))
    x = bounds.join(resolved.select("source_file", "asked"), "source_file").join(found.drop("start_index", "end_index"), "source_file", "left")
    whole = F.when(F.col("start_index").isNotNull(), F.sequence("start_index", "end_index")).otherwise(F.array().cast("array<int>"))
    none = lambda c, other: F.coalesce(c, other.cast(found.schema[c].dataType)).alias(c)
    off = F.col("asked") & (F.col("start_index").isNull() | F.coalesce("mismatch", F.lit(True)))
    return x.select(
        "source_file", "start_index", "end_index", none("distinct_indexes", F.array()), none("repeated", F.array()),
        none("missing", whole), none("unexpected", F.array()), off.alias("mismatch")
    )


def import_files(
    pages: DataFrame, keys: DataFrame, stored: DataFrame, expected: DataFrame, category: str, overwrite: bool = False,
    category_name: str | None = None, wrong: DataFrame | None = None, version: str | None = None
) -> dict[str, DataFrame]:
    """Pages and answer keys to questions in the store.

    ``pages``: source_file, page_index, text (and lines with boxes, image_path, pixel_width and
    pixel_height); ``keys``: key_id (the source file) and key_text; ``stored``: the questions
    so far; ``expected``: source_file and what was typed. Files are split, their expected
    ranges resolved, and split again with them, each pass written to the shared folder. Files
    whose numbers don't fit what was asked for are not imported, nor are keys of files without
    pages. Returns the candidates, ranges, diagnosis, page diagnostics, errors of the keys, the
    new store, the categories' files that were touched (category_id, source_file) and their
    questions, which is all that store.save_questions() needs, and with ``wrong`` (question_id)
    the wrong set without the questions that are gone. ``version`` names the import for the ids
    of an overwrite.
    """
    typed = expected.withColumn("e", ranges.expected_input("expected")).where("e.kind = 'range'")
    first = split(pages, typed.select("source_file", F.col("e.start_index").alias("low"), F.col("e.end_index").alias("high")))
    resolved = settle(expected_ranges(pages, first, expected), "import-ranges")
    bounds = resolved.where("range IS NOT NULL").select(
        "source_file", F.col("range.start_index").alias("low"), F.col("range.end_index").alias("high")
    )
    candidates = settle(split(pages, bounds), "import-candidates")
    diagnosis = settle(judged(candidates, resolved), "import-diagnosis")
    good = diagnostics.passing(candidates, diagnosis)
    read = keys.join(pages.select(F.col("source_file").alias("key_id")).distinct(), "key_id", "left_semi")
    key = answers.answer_map(read).select(F.col("key_id").alias("source_file"), "index", "answers", "type", F.col("index").alias("pos"))
    both = importer.joined(
        good.where("index > 0").select("source_file", "index", "preview", "header", F.col("segment").alias("pos")),
        diagnostics.passing(key, diagnosis), ("source_file", "index")
    )
    name = F.lit(category_name or category)
    shown = F.concat_ws(" ", F.col("header"), F.when(nonblank("preview"), F.col("preview")))
    prompt = F.concat(
        name, F.lit(" - "),
        F.when(F.col("header").isNotNull(), shown).otherwise(F.concat(F.lit(QUESTION), F.col("index").cast("string")))
    )
    incoming = both.select(
        F.lit(category).alias("category_id"), "source_file", "index", F.coalesce("type", F.lit("MC")).alias("type"),
        prompt.alias("prompt"), "answers", F.col("index").alias("pos")
    )
    if "image_path" in pages.columns:
        incoming = incoming.join(question_images(pages, good), ["source_file", "index"], "left")
    # groups that the import doesn't touch are not matched with anything
    mine = importer.groups(incoming)
    before = importer.of_groups(stored, mine)
    after = importer.overwritten(before, incoming, version) if overwrite else importer.merged(before, incoming)
    others = importer.with_carried(importer.of_groups(stored, mine, "left_anti")).select(importer.STORED)
    store = others.unionByName(after)
    touched = {"touched": mine.withColumnRenamed("file_key", "source_file"), "touched_questions": after}
    if wrong is not None:
        touched["wrong"] = catalogue.kept_wrong(wrong, store)
    return touched | {
        "candidates": candidates, "ranges": resolved, "diagnosis": diagnosis, "pages": diagnostics.page_diagnostics(pages, candidates), "key_errors": answers.key_errors(keys), "questions": store,
    }


def question_images(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """(source_file, index, image_segments, image_path, image_top_ratio, image_bottom_ratio) of each number's first candidate."""
    first = importer.first_by(candidates.where("index > 0"), ["source_file", "index"], "segment")
    found = layout.image_segments(first, layout.page_table(pages, candidates))
    fields = [
        F.col(c).cast("int").alias(c) if c in ("page_index", "pixel_width", "pixel_height") else F.col(c) for c in (
            "page_index", "image_path", "left_ratio", "top_ratio", "right_ratio", "bottom_ratio", "pixel_width", "pixel_height"
        )
    ]
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("s")))), lambda r: r["s"])
    x = found.groupBy("source_file", "index").agg(listed.alias("image_segments"))
    primary = F.get("image_segments", F.lit(0))
    return x.select(
        "source_file", "index", "image_segments", primary["image_path"].alias("image_path"),
        primary["top_ratio"].alias("image_top_ratio"), primary["bottom_ratio"].alias("image_bottom_ratio")
    )


def recovered_spans(found: DataFrame, low: int, high: int) -> DataFrame:
    """Candidates of files of which some headings between ``low`` and ``high`` were missed, after their recovery."""
    placed = found if "pos" in found.columns else segments.positioned(found)
    return segments.rebuilt(recovery.recover(placed, low, high), placed)


def practise(questions: DataFrame, attempts: DataFrame, category: str, n: int, seed: int) -> dict[str, DataFrame]:
    """A practice set, its graded attempts, the sessions' scores and the wrong set after them."""
    chosen = practice.practice_set(questions, category, n, seed, answered_only=True)
    marked = grading.graded(attempts.join(chosen.select(F.col("id").alias("question_id")), "question_id", "left_semi"), questions)
    return {"chosen": chosen, "graded": marked, "scores": grading.session_scores(marked), "wrong": grading.wrong_set(marked)}
