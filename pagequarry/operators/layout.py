"""Where questions are on their pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.functions import text as T
from pagequarry.functions.text import clamp
from pagequarry.session import settle

# Crop sizes as shares of a page, and view sizes by kind of device.
PADDING, MIN_HEIGHT, MIN_WIDTH = 0.015, 0.02, 0.08
VIEWS = {"phone": (320.0, 260.0), "tablet": (560.0, 440.0), "desktop": (760.0, 620.0)}
WIDE_ANCHOR, CENTRE_DISTANCE, MARGIN, OVERLAP, RIGHT_COLUMN = 0.55, 0.20, 0.08, 0.12, 0.55
SHARED_QUESTIONS = 3


def crop_line(left: Column, right: Column, anchor_left: Column, anchor_right: Column) -> Column:
    """A line that counts for the width of its anchor's crop: the anchor is wide, the centres are near, or the two overlap."""
    wide = F.greatest(F.lit(0.0), anchor_right - anchor_left) >= WIDE_ANCHOR
    centre, anchor = (left + right) / 2, (anchor_left + anchor_right) / 2
    low, high = clamp(anchor_left - MARGIN), clamp(anchor_right + MARGIN)
    return wide | (F.abs(centre - anchor) <= CENTRE_DISTANCE) | (F.least(right, high) - F.greatest(left, low) >= OVERLAP)


def same_column(left: Column, right: Column, anchor_left: Column, anchor_right: Column) -> Column:
    """A line belongs to its anchor's column: a crop line, or any that starts in a right column."""
    starts_right = ((anchor_left + anchor_right) / 2 >= RIGHT_COLUMN) & (left >= clamp(anchor_left - MARGIN))
    return crop_line(left, right, anchor_left, anchor_right) | starts_right


def reach_of(anchor: Column) -> Column:
    """What crop_line() and same_column() ask of an anchor, a struct, told once for all lines that are held against it."""
    left, right = anchor["left_ratio"], anchor["right_ratio"]
    return F.struct(
        (F.greatest(F.lit(0.0), right - left) >= WIDE_ANCHOR).alias("wide"), ((left + right) / 2).alias("centre"),
        clamp(left - MARGIN).alias("low"), clamp(right + MARGIN).alias("high"), ((left + right) / 2 >= RIGHT_COLUMN).alias("rightward")
    )


def in_crop(line: Column, reach: Column) -> Column:
    """crop_line() of a struct and an anchor's reach."""
    left, right = line["left_ratio"], line["right_ratio"]
    near = F.abs((left + right) / 2 - reach["centre"]) <= CENTRE_DISTANCE
    return reach["wide"] | near | (F.least(right, reach["high"]) - F.greatest(left, reach["low"]) >= OVERLAP)


def beside(line: Column, reach: Column) -> Column:
    """same_column() of a struct and an anchor's reach."""
    return in_crop(line, reach) | (reach["rightward"] & (line["left_ratio"] >= reach["low"]))


def at_least(start: Column, end: Column, size: float) -> Column:
    """The end of a span of at least ``size``, within the page."""
    start, end = clamp(start), clamp(end)
    return F.when(end - start >= size, end).otherwise(F.least(F.lit(1.0), start + size))


def line_top(line: Column, lines: Column) -> Column:
    """Where a line starts on a page of so many lines; lines beyond them count as the last."""
    n = F.greatest(F.lit(1), F.coalesce(lines, F.lit(1)))
    return clamp((F.least(n, F.greatest(F.lit(1), line)) - 1) / n)


def line_bottom(line: Column, lines: Column, top: Column) -> Column:
    """Where a line ends, not above ``top`` and at least the least height below it."""
    n = F.greatest(F.lit(1), F.coalesce(lines, F.lit(1)))
    bottom = F.least(n, F.greatest(line, F.greatest(F.lit(1), F.ceil(top * n)))) / n
    return clamp(F.when(bottom - top < MIN_HEIGHT, F.least(F.lit(1.0), top + MIN_HEIGHT)).otherwise(bottom))


def bounding_box(lines: DataFrame, *keys: str) -> DataFrame:
    """The box around each group's lines."""
    return lines.groupBy(*keys).agg(
        F.min("left_ratio").alias("left_ratio"), F.min("top_ratio").alias("top_ratio"), F.max("right_ratio").alias("right_ratio"),
        F.max("bottom_ratio").alias("bottom_ratio")
    )


def word_boxes(words: DataFrame, *keys: str) -> DataFrame:
    """The box around each line's words (x, y, w, h); boxes without a size don't count."""
    return words.where("w > 0 AND h > 0").groupBy(*keys).agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"),
        F.max(F.col("y") + F.col("h")).alias("y1")
    )


def to_ratio(x0: str, x1: str, size: str) -> tuple[Column, Column]:
    """A pixel span as shares of the page."""
    whole = F.greatest(F.lit(1), F.col(size))
    return clamp(F.col(x0) / whole), clamp(F.col(x1) / whole)


# ---- pages with their lines and the questions that start on them -------------------------

LINE = ["line_in_page", "text", "left_ratio", "top_ratio", "right_ratio", "bottom_ratio"]
PLACE = [c for c in LINE if c != "text"]


def with_lines(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """``pages`` with an array ``lines`` of the rows of ``lines`` on each, in order."""
    gathered = lines.groupBy("source_file", "page_index").agg(F.array_sort(F.collect_list(F.struct(*LINE))).alias("lines"))
    return pages.join(gathered, ["source_file", "page_index"], "left")


def page_table(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pages that have an image, their lines in order, and the questions that start on each.

    ``lines`` have their places, whether they show anything, and which numbers their texts
    name (see named()); ``marks`` are those whose range needs no question to begin at, with
    it. ``starts`` are the candidates by line, ``heads`` those of them whose line exists, with
    that line, and ``naming`` those of the heads whose line names questions. A page's
    lines and questions are one row's arrays, so what follows compares them in place. The
    table is written, as it is joined more than once.
    """
    starts = candidates.groupBy("source_file", F.col("start_page").alias("page_index")).agg(
        F.array_sort(F.collect_list(F.struct("start_line", "index"))).alias("starts"))
    if "lines" not in pages.columns:
        pages = pages.withColumn(
            "lines",
            F.lit(None).cast("array<struct<line_in_page:int,text:string,left_ratio:double,top_ratio:double,right_ratio:double,bottom_ratio:double>>")
        )
    ordered = F.array_sort(
        F.transform(F.coalesce("lines", F.array().cast(pages.schema["lines"].dataType)), lambda l: F.struct(*(l[c].alias(c) for c in LINE)))
    )
    x = pages.where(T.nonblank("image_path")).join(starts, ["source_file", "page_index"], "left")
    said = lambda l: F.struct(*(l[c].alias(c) for c in PLACE), T.nonblank(l["text"]).alias("shown"), named(l["text"]).alias("named"))
    x = x.withColumn("lines", F.transform(ordered, said))
    x = x.withColumn("starts", F.coalesce("starts", F.array().cast(x.schema["starts"].dataType)))
    # of lines in order, the first of a number
    numbers = F.transform("lines", lambda l: l["line_in_page"].cast("int"))
    at = lambda all_numbers, s: F.get("lines", F.array_position(all_numbers, s["start_line"].cast("int")).cast("int") - 1)
    head = lambda s, line: F.struct(s["start_line"].alias("start_line"), s["index"].alias("index"), line.alias("line"))
    found = let(numbers, lambda n: F.transform("starts", lambda s: head(s, at(n, s))))
    ranged = F.transform(F.filter("lines", lambda l: l["named"].isNotNull()), lambda l: F.struct(*(l[c].alias(c) for c in PLACE), *own_range(l["named"])))
    marks = F.filter(ranged, lambda m: m["low"].isNotNull())
    x = x.withColumns({"heads": F.filter(found, lambda h: h["line"].isNotNull()), "marks": marks})
    return settle(x.withColumn("naming", F.filter("heads", lambda h: h["line"]["named"].isNotNull() & (h["index"] > 0))), "layout-pages")


def let(x: Column, body) -> Column:
    """``body`` of ``x``, which is computed once however often the body uses it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def present(x: Column) -> Column:
    """A generator of ``x`` that drops the rows where it is null: a filter of a column would compute it once more."""
    return F.explode(F.filter(F.array(x), lambda v: v.isNotNull()))


def on_pages(candidates: DataFrame, table: DataFrame) -> DataFrame:
    """Each candidate on each page of its span that has an image, with its anchor: its first line, if that page has one, and ``reach`` of it."""
    heads = table.select("source_file", F.col("page_index").alias("start_page"), F.explode("heads").alias("h"))
    anchors = heads.select("source_file", "start_page", F.col("h.start_line").alias("start_line"), F.col("h.line").alias("anchor"), reach_of(F.col("h.line")).alias("reach"))
    anchored = candidates.join(anchors.dropDuplicates(["source_file", "start_page", "start_line"]), ["source_file", "start_page", "start_line"], "left")
    return anchored.withColumn("page_index", F.explode(F.sequence("start_page", "end_page"))).join(table, ["source_file", "page_index"])


def next_top() -> Column:
    """The padded top of the first heading by line below the question, or on a later page of its span, that has another number and the anchor's column; null without one."""
    below = F.filter(
        "heads",
        lambda h: (h["index"] != F.col("index")) & (
            (F.col("page_index") != F.col("start_page")) | (h["start_line"] > F.col("start_line"))
        ) & beside(h["line"], F.col("reach"))
    )
    # the least and the greatest of a null and a number are the number
    return let(F.get(below, F.lit(0))["line"]["top_ratio"], lambda top: F.when(top.isNotNull(), clamp(top - PADDING)))


def next_heading_tops(candidates: DataFrame, table: DataFrame) -> DataFrame:
    """(source_file, index, start_page, start_line, page_index, next_top) of each question on each page of its span."""
    return on_pages(candidates, table).where("anchor IS NOT NULL").select(
        "source_file", "index", "start_page", "start_line", "page_index", next_top().alias("next_top")
    )


def edge(lines: Column, name: str, largest: bool) -> Column:
    values = F.transform(lines, lambda l: l[name])
    return F.array_max(values) if largest else F.array_min(values)


def padded_box(lines: Column, crop: Column) -> Column:
    """Struct of ratios around lines, as wide as those of ``crop``, padded."""
    low = lambda own, name: clamp(edge(own, name, False) - PADDING)
    high = lambda own, name: clamp(edge(own, name, True) + PADDING)
    return F.struct(
        low(crop, "left_ratio").alias("left_ratio"), low(lines, "top_ratio").alias("top_ratio"),
        high(crop, "right_ratio").alias("right_ratio"), high(lines, "bottom_ratio").alias("bottom_ratio")
    )


def narrow(lines: Column, reach: Column) -> Column:
    """The crop lines of an anchor's reach, all if there are none."""
    return let(F.filter(lines, lambda l: in_crop(l, reach)), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(lines))


def boxed(lines: Column, crop) -> Column:
    """The padded box of lines, as wide as those that ``crop`` makes of them; null without any."""
    return let(lines, lambda own: F.when(F.size(own) > 0, let(crop(own), lambda some: padded_box(own, some))))


def finished(df: DataFrame, box: Column) -> DataFrame:
    """Segments of at least the least size, with the page's image; rows without a box go."""
    right = lambda b: at_least(b["left_ratio"], b["right_ratio"], MIN_WIDTH)
    bottom = lambda b: at_least(b["top_ratio"], b["bottom_ratio"], MIN_HEIGHT)
    sized = lambda b: F.struct(
        b["left_ratio"].alias("left_ratio"), b["top_ratio"].alias("top_ratio"), right(b).alias("right_ratio"), bottom(b).alias("bottom_ratio")
    )
    names = ["source_file", "index", "start_page", "start_line", "page_index", "image_path"]
    x = df.select(*names, "pixel_width", "pixel_height", present(let(box, lambda b: F.when(b.isNotNull(), sized(b)))).alias("s"))
    return x.select(*names, "s.*", "pixel_width", "pixel_height")


def question_segments(candidates: DataFrame, table: DataFrame) -> DataFrame:
    """One crop for each page of each question's span.

    ``candidates`` has source_file, index, start_page, end_page, start_line, end_line and the
    two pages' line counts; ``table`` is page_table()'s. Where the question's first line is
    known, lines of its column from its padded top to the next heading's make the crop; a
    later page without any has none. Where it isn't, the lines of the span's numbers do. What
    is left is cut by line numbers.
    """
    x = on_pages(candidates, table)
    first, last = F.col("page_index") == F.col("start_page"), F.col("page_index") == F.col("end_page")
    upper = F.when(first, line_top(F.col("start_line"), F.col("start_page_line_count"))).otherwise(0.0)
    lines_at_end = F.when(F.coalesce("end_page_line_count", F.lit(0)) > 0, F.col("end_page_line_count")).otherwise(F.col("start_page_line_count"))
    lower = F.when(last, line_bottom(F.col("end_line"), lines_at_end, upper)).otherwise(1.0)
    by_number = F.struct(F.lit(0.0).alias("left_ratio"), upper.alias("top_ratio"), F.lit(1.0).alias("right_ratio"), lower.alias("bottom_ratio"))
    limit = F.when(first, clamp(F.col("anchor.top_ratio") - PADDING)).otherwise(0.0)
    anchor = F.col("anchor")
    below = lambda l, top: top.isNull() | (l["top_ratio"] < top)
    fits = lambda l, edges: l["shown"] & (l["bottom_ratio"] >= edges["limit"]) & below(l, edges["next_top"]) & beside(l, F.col("reach"))
    edges = F.struct(limit.alias("limit"), next_top().alias("next_top"))
    own = let(edges, lambda e: F.filter("lines", lambda l: fits(l, e)))
    low_line = F.when(first, F.col("start_line")).otherwise(1)
    counted = F.filter("lines", lambda l: (l["line_in_page"] >= low_line) & (~last | (l["line_in_page"] <= F.col("end_line"))))
    box = F.when(anchor.isNotNull(), boxed(own, lambda some: narrow(some, F.col("reach")))).otherwise(boxed(counted, lambda some: some))
    cut = F.when(first | anchor.isNull() | (F.size("lines") == 0), by_number)
    return finished(x, F.coalesce(box, cut))


def distinct_segments(segments: DataFrame, order: str = "pos", of: list[str] | None = None) -> DataFrame:
    """Segments that are equal to four decimals are one, the first, within each file or what ``of`` names."""
    key = F.concat_ws(
        ":", F.col("page_index").cast("string"),
        *(F.format_string("%.4f", F.col(c)) for c in ("left_ratio", "top_ratio", "right_ratio", "bottom_ratio"))
    )
    w = Window.partitionBy(*(of or ["source_file"]), "key").orderBy(order)
    return segments.withColumn("key", key).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "key")


def named(x: Column) -> Column:
    """Which questions a passage's marker names: struct of start and end of a range, the start alone, the end alone; null if it is no marker."""
    # few lines are markers, and only theirs are read closely
    words = [x.contains(word) for word in T.MARKER_WORDS]
    marks = (words[0] | words[1] | words[2]) & x.rlike("[-~〜]")
    number = lambda t, pattern, group: F.regexp_extract(t, pattern, group).try_cast("int")
    # each pattern is matched once a marker
    read = let(T.utrim(x), lambda t: F.struct(
        number(t, T.RANGE_HINT, 1).alias("low"), number(t, T.RANGE_HINT, 2).alias("high"), number(t, T.RANGE_START, 1).alias("start"),
        number(t, T.RANGE_END, 1).alias("end")
    ))
    whole = lambda r: (r["low"] > 0) & (r["high"] >= r["low"])
    names = lambda r: F.struct(
        F.when(whole(r), r["low"]).alias("low"), F.when(whole(r), r["high"]).alias("high"), r["start"].alias("start"), r["end"].alias("end")
    )
    return F.when(marks, let(read, names))


def own_range(name: Column) -> list[Column]:
    """``low`` and ``high`` of the questions that named() means whatever question is asked for: a range of both ends, or three from a start alone; null without a start."""
    whole, start = name["low"].isNotNull(), name["start"] > 0
    three = name["start"] + F.lit(SHARED_QUESTIONS - 1)
    return [
        F.when(whole, name["low"]).when(start, name["start"]).alias("low"), F.when(whole, name["high"]).when(start, three).alias("high")
    ]


def holds(name: Column, index: Column, fallback: Column) -> Column:
    """Whether named() means a question.

    A range of both ends decides alone. A start alone means three questions; where those
    don't hold the question, an end alone reaches back to ``fallback``.
    """
    three = name["start"] + F.lit(SHARED_QUESTIONS - 1)
    from_start = (name["start"] > 0) & index.between(name["start"], three)
    to_end = (fallback > 0) & (name["end"] >= fallback) & index.between(fallback, name["end"])
    return F.when(name["low"].isNotNull(), index.between(name["low"], name["high"])).otherwise(
        F.coalesce(from_start, F.lit(False)) | F.coalesce(to_end, F.lit(False))
    )


def with_context(candidates: DataFrame, table: DataFrame) -> DataFrame:
    """on_pages() of each question's first page, where it has a ``context``: the lines at which the passage that it shares with others and that passage's questions start.

    The nearest line above the question in its column that names a range with its number,
    and below which the first question of that range starts: the passage is what is between
    those two. Without one, the nearest earlier question of the page in the same column whose
    own line names such a range: the passage then reaches down to the question itself.
    """
    x = on_pages(candidates.where("index > 0").withColumn("end_page", F.col("start_page")), table).where("anchor IS NOT NULL")
    reach, index = F.col("reach"), F.col("index")
    first_in = lambda m: F.get(
        F.filter("starts", lambda s: (s["index"] > 0) & s["index"].between(m["low"], m["high"])), F.lit(0)
    )["start_line"]
    # few marks are of the question's number, and only those are looked at closely
    own = lambda m: index.between(m["low"], m["high"]) & (m["line_in_page"] < F.col("start_line")) & (m["line_in_page"] >= 1)
    above = F.filter("marks", lambda m: own(m) & beside(m, reach))
    named_by = lambda m: F.struct(m["line_in_page"].alias("line"), first_in(m).alias("question"))
    earlier = lambda h: (h["start_line"] < F.col("start_line")) & (h["index"] < index)
    prior = F.filter("naming", lambda h: earlier(h) & holds(h["line"]["named"], index, h["index"]) & beside(h["line"], reach))
    mark = F.try_element_at(F.filter(F.transform(above, named_by), lambda m: m["question"] > m["line"]), F.lit(-1))
    both = F.struct(mark.alias("mark"), F.try_element_at(prior, F.lit(-1)).alias("prior"))
    line = lambda b: F.coalesce(b["mark"]["line"], b["prior"]["start_line"])
    question = lambda b: F.when(b["mark"].isNotNull(), b["mark"]["question"]).otherwise(F.col("start_line"))
    found = lambda b: let(line(b), lambda at: F.when(at.isNotNull(), F.struct(at.alias("context_line"), question(b).alias("question_line"))))
    return x.select("*", present(let(both, found)).alias("context"))


def shared_contexts(candidates: DataFrame, table: DataFrame) -> DataFrame:
    """(source_file, index, start_page, start_line, context_line, question_line) of the questions that share a passage; see with_context()."""
    return with_context(candidates, table).select("source_file", "index", "start_page", "start_line", "context.*")


def shared_segments(candidates: DataFrame, table: DataFrame) -> DataFrame:
    """The crop of each question's shared passage: its non-blank lines in the question's column, as wide as those of its first line's crop."""
    x = with_context(candidates, table)
    inside = lambda l, c: (l["line_in_page"] >= c["context_line"]) & (l["line_in_page"] < c["question_line"])
    own = let(F.col("context"), lambda c: F.filter("lines", lambda l: inside(l, c) & l["shown"] & beside(l, F.col("reach"))))
    return finished(x, boxed(own, lambda some: let(reach_of(F.get(some, F.lit(0))), lambda reach: narrow(some, reach))))


def image_segments(candidates: DataFrame, table: DataFrame) -> DataFrame:
    """All crops of each question in order: the shared passage's, then its pages'; those equal to four decimals are one. ``pos`` is the place."""
    shared = shared_segments(candidates, table).withColumn("pos", F.lit(0))
    own = question_segments(candidates, table).withColumn("pos", F.col("page_index"))
    both = distinct_segments(shared.unionByName(own), "pos", ["source_file", "index", "start_page", "start_line"])
    return both


def slice_view(segments: DataFrame, device: str = "phone") -> DataFrame:
    """Sizes and shift that show a segment in a device's view: the page is as wide as the view, and only the segment is visible.

    Pages without pixel sizes are taken to be as large as the view.
    """
    width, height = VIEWS[device]
    left, top = clamp("left_ratio"), clamp("top_ratio")
    right = F.when(clamp("right_ratio") <= left, F.least(F.lit(1.0), left + MIN_WIDTH)).otherwise(clamp("right_ratio"))
    bottom = F.when(clamp("bottom_ratio") <= top, F.least(F.lit(1.0), top + MIN_HEIGHT)).otherwise(clamp("bottom_ratio"))
    sized = (F.col("pixel_width") > 0) & (F.col("pixel_height") > 0)
    tall = F.when(sized, F.lit(width) * F.col("pixel_height") / F.col("pixel_width")).otherwise(F.lit(height))
    return segments.withColumns({
        "content_width": F.lit(width), "content_height": tall,
        "visible_width": F.greatest(
            F.lit(width * MIN_WIDTH), (right - left) * width
        ), "visible_height": F.greatest(tall * MIN_HEIGHT, (bottom - top) * tall),
        "shift_x": 0.0 - left * width, "shift_y": 0.0 - top * tall,
    })
