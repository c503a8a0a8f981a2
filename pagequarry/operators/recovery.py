"""Recovery of headings that a document should have but its headings as read lack.

Everything that a line says by itself is computed as columns: the number it shows whatever
follows, and how much it looks like a heading without a number. Only the search is
sequential, as each found marker moves the bounds of the next. It runs once for each gap
between two headings in which numbers are missing, over the few lines that qualify.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from pagequarry.functions import text as T
from pagequarry.functions.text import hangul_count, utrim
from pagequarry.operators.headings import code_like, continues, disallowed, marked, plausible
from pagequarry.operators.scans import dealt, running, tasks_for
from pagequarry.operators.segments import accept_rising, positioned
from pagequarry.session import settle

# What a line must look like to be taken for a heading without a number, how
# much each sign counts, and how far scores may be apart.
SHOWN_NUMBER = r"(?U)^\s*(?:[Qq]\s*)?(?:(?:제|문항|문제)\s*)?(\d+)"
LIST_MARK = r"(?U)^(?:0\s|O\s|[㉠-㉻]|[①-⑳])"
SHORT_PREFIX = r"(?U)^[^\d\s]{1,4}[.)\]•·\-~〜]*\s+"
LEADING_WORD = "다음"
LEAST_SCORE, SCORE_RANGE = 40, 25
LEAST_SYLLABLES, EACH_SYLLABLE, MOST_OF_SYLLABLES = 4, 3, 30
OF_QUESTION_MARK, OF_SHORT_PREFIX, OF_LEADING_WORD, LEADING_PLACES = 20, 25, 20, 11
OF_INDENT, LEAST_INDENT = 10, 0.02
MOST_OF_LEFT, EACH_LEFT = 50, 400
NEW = [StructField("pos", LongType()), StructField("index", IntegerType()), StructField("guessed", BooleanType())]


def bound(x: int | str) -> Column:
    return F.col(x) if isinstance(x, str) else F.lit(x)


def with_numbers(lines: DataFrame, low: int | str, high: int | str) -> DataFrame:
    """``lines`` with the number of each that reads as a heading, within the bounds, as ``index``, and what marked() keeps."""
    x = lines.withColumns({"m_low": bound(low), "m_high": bound(high)})
    return marked(x, "pos", "m_low", "m_high", keep=True).withColumn("index", F.col("index").cast("int")).drop("m_low", "m_high")


def qualifying(found: DataFrame) -> DataFrame:
    """Lines that are headings, show a number within the bounds, or may be headings without one."""
    return found.where("index IS NOT NULL OR shown BETWEEN low AND high OR score IS NOT NULL")


def with_markers(found: DataFrame, block: int | None = None) -> DataFrame:
    """clues() with those of the numbers as ``index`` that rise within their file."""
    x = accept_rising(found, block=block)
    return qualifying(x.withColumn("index", F.when(F.col("accepted"), F.col("index"))).drop("accepted"))


def clues(lines: DataFrame, low: int | str, high: int | str) -> DataFrame:
    """Each line's heading number, shown number, and score as a numberless heading but for its place.

    ``lines`` are positioned and have ``index``; what with_numbers() found out is not asked again.
    """
    page = Window.partitionBy("source_file", "page_index").orderBy("pos")
    t, text = utrim("text"), F.coalesce("text", F.lit(""))
    known = "m_next" in lines.columns
    x = lines.select(
        "source_file", "page_index", "pos", "left_ratio", text.alias("text"), "index", bound(low).cast("int").alias("low"),
        bound(high).cast("int").alias("high"), *((F.col("m_bad").alias("bad"), F.col("m_next").alias("next_reads")) if known else ())
    )
    # what a line says by itself, below the window
    x = x.withColumns({
        "t": t, "shown": F.regexp_extract("text", SHOWN_NUMBER, 1),
        "suffix": utrim(F.regexp_replace("text", SHOWN_NUMBER, "")), "syllables": hangul_count(t), "asks": t.contains("?"),
    })
    if not known:
        x = x.withColumn("bad", disallowed("text")).withColumn("reads", continues("text", F.col("bad")))
        x = x.withColumn("next_reads", F.coalesce(F.lead("reads").over(page), F.lit(False)))
    x = x.withColumn("indent", F.lag("left_ratio").over(page) - F.col("left_ratio"))
    t, asks = F.col("t"), F.col("asks")
    eligible = ~F.col("bad") & ~t.rlike(r"(?U)^\d") & ~code_like(t) & ~t.rlike(LIST_MARK) & (
        (F.col("syllables") >= LEAST_SYLLABLES) | asks
    ) & (F.col("next_reads") | asks)
    score = (
        F.least(F.lit(MOST_OF_SYLLABLES), EACH_SYLLABLE * F.col("syllables")) + OF_QUESTION_MARK * asks.cast("int")
        + OF_SHORT_PREFIX * t.rlike(SHORT_PREFIX).cast("int") + OF_LEADING_WORD * F.position(F.lit(LEADING_WORD), t).between(1, LEADING_PLACES).cast("int")
        + OF_INDENT * F.coalesce(F.col("indent") > LEAST_INDENT, F.lit(False)).cast("int")
    )
    shows = ~F.col("bad") & (F.col("shown") != "") & ~F.col("shown").rlike("^0") & plausible(F.col("suffix"), None, F.col("next_reads"))
    found = x.select(
        "source_file", "pos", "left_ratio", "index", "low", "high", F.when(
            shows, F.col("shown").try_cast("int")
        ).alias("shown"), F.when(eligible, score).cast("int").alias("score"),
    )
    return qualifying(found)


def fill(lines: list[tuple], left: float | None, low: int, high: int, closed: bool) -> list[tuple[int, int, bool]]:
    """(pos, number, guessed) of the headings between two others, with numbers between ``low`` and ``high``, both left out.

    ``lines``: (pos, left, shown number, score) in order, None for what is lacking; ``left`` is
    where the heading before starts, None if there is none, and ``closed`` whether one comes
    after. Lines that show a number after that of the last one taken are taken first, the
    smallest number and then the first line before others. Between those, the likeliest lines
    are numbered through.
    """
    chain, last, number = [], None, low
    for n, pos in sorted((shown, pos) for pos, _, shown, _ in lines if shown is not None and low < shown < high):
        if n > number and (last is None or pos > last):
            chain.append((pos, n, False))
            last, number = pos, n
    starts = {pos: x for pos, x, *_ in lines}
    scored = [(pos, x, score) for pos, x, _, score in lines if score is not None]
    places = [s[0] for s in scored]
    ends = [(pos, n) for pos, n, _ in chain] + ([(None, high)] if closed else [])
    after, number = None, low
    if left is None:
        # nothing is guessed before the first heading
        if not ends or ends[0][0] is None:
            return chain
        after, number = ends.pop(0)
        left = starts[after]
    found = list(chain)
    for pos, n in ends:
        stop = len(scored) if pos is None else bisect_left(places, pos)
        while n - number > 1:
            inside = scored[0 if after is None else bisect_right(places, after) : stop]
            new = likeliest(inside, left, n - number - 1)
            if not new:
                break
            found += [(p, number + k, True) for k, p in enumerate(new, 1)]
            after, number, left = new[-1], number + len(new), starts[new[-1]]
        if pos is not None:
            after, number, left = pos, n, starts[pos]
    return found


def likeliest(scored: list[tuple], left: float, missing: int) -> list[int]:
    """The first ``missing`` lines in place of those that score nearly as high as the best."""
    whole = [(pos, score + max(0, MOST_OF_LEFT - int(abs(x - left) * EACH_LEFT))) for pos, x, score in scored]
    whole = [s for s in whole if s[1] >= LEAST_SCORE]
    top = max((s for _, s in whole), default=0)
    return [pos for pos, s in whole if s >= top - SCORE_RANGE][:missing]


def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fill() of gaps, one a row."""
    for batch in batches:
        lines = batch.column("lines")
        own = lines.flatten()
        each = list(zip(*(own.field(k).to_pylist() for k in ("pos", "left_ratio", "shown", "score")), strict=True))
        first = lines.offsets[0].as_py()
        ends = [o.as_py() - first for o in lines.offsets]
        at, found = [], []
        gaps = zip(*(batch.column(k).to_pylist() for k in ("left", "above", "below", "closed")), strict=True)
        for i, (left, above, below, closed) in enumerate(gaps):
            new = fill(each[ends[i] : ends[i + 1]], left, above, below, closed)
            at += [i] * len(new)
            found += new
        pos, number, guessed = zip(*found, strict=True) if found else ((), (), ())
        files = batch.column("source_file").take(pa.array(at, pa.int32()))
        arrays = [files, pa.array(pos, pa.int64()), pa.array(number, pa.int32()), pa.array(guessed, pa.bool_())]
        yield pa.RecordBatch.from_arrays(arrays, ["source_file", "pos", "index", "guessed"])


def gaps_of(found: DataFrame) -> DataFrame:
    """(source_file, after, left, above, below, closed) of each place where numbers are missing.

    ``after`` is the place of the heading before, null before the first; ``above`` and ``below``
    are the numbers around, the bounds at a file's ends. A file has no more headings than its
    bounds have numbers, so they are one array.
    """
    marker = F.when(F.col("index").between(F.col("low"), F.col("high")), F.struct("pos", "index", "left_ratio"))
    files = found.groupBy("source_file").agg(F.array_sort(F.collect_list(marker)).alias("m"), F.max("low").alias("low"), F.max("high").alias("high"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("m")), lambda i: F.struct(F.get("m", i - 1).alias("a"), F.get("m", i).alias("b")))
    each = files.where(F.size("m") > 0).select("source_file", "low", "high", F.explode(pairs).alias("g"))
    return each.select(
        "source_file", F.col("g.a.pos").alias("after"), F.col("g.a.left_ratio").alias("left"),
        F.coalesce(F.col("g.a.index"), F.col("low") - 1).alias("above"),
        F.coalesce(F.col("g.b.index"), F.col("high") + 1).alias("below"), F.col("g.b").isNotNull().alias("closed"),
    ).where("below - above > 1")


def recover(
    lines: DataFrame, low: int | str, high: int | str, markers: DataFrame | None = None, block: int | None = None
) -> DataFrame:
    """(source_file, pos, index, inferred, guessed) of each file's headings between ``low`` and ``high``, numbers or columns.

    ``markers`` are the headings as read, strict ones of ``lines`` if not given; their numbers
    rise within a file. Files that lack no number, or have no heading to go by, keep those;
    files in which something is found lose those beyond the bounds. As the numbers rise, what
    is found between two headings does not depend on the rest of the file, so each gap is a
    group of its own, with the lines of it that qualify. A line without a left edge starts at 0.
    ``block`` is that of scans.running(): without it a file is positioned by one task. What is
    written in between is dealt to as many tasks as its rows ask for.
    """
    placed = lines if "pos" in lines.columns else positioned(lines, block)
    if markers is None:
        read = with_numbers(placed, low, high)
    else:
        read = placed.join(markers.select("source_file", "pos", F.col("index").cast("int").alias("index")), ["source_file", "pos"], "left")
    place = {"pos": F.col("pos").cast("long"), "left_ratio": F.coalesce("left_ratio", F.lit(0.0))}
    found = settle(clues(read, low, high).withColumns(place), "recovery-clues")
    if markers is None:
        found = settle(with_markers(found if block else dealt(found, "source_file"), block), "recovery-lines")
    tasks = tasks_for(found)
    marker = F.when(F.col("index").between(F.col("low"), F.col("high")), F.col("pos"))
    by_file = found if block else found.repartition(tasks, "source_file")
    inside = running(by_file, {"after": ("max", marker)}, block=block).where("after IS NULL OR pos > after")
    # as the key of a join, before any place that a line may have
    gaps = gaps_of(found).withColumn("after", F.coalesce("after", F.lit(-1)))
    gap = ["source_file", "after"]
    x = inside.withColumn("after", F.coalesce("after", F.lit(-1))).repartition(tasks, *gap).join(gaps.repartition(tasks, *gap), gap)
    line = F.struct("pos", "left_ratio", "shown", "score")
    each = x.where("score IS NOT NULL OR shown > above AND shown < below").groupBy(
        "source_file", "after", "left", "above", "below", "closed"
    ).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    schema = StructType([placed.schema["source_file"], *NEW])
    new = settle(each.drop("after").mapInArrow(filled, schema), "recovery-found")
    as_read = found.where("index IS NOT NULL")
    beyond = as_read.where("index NOT BETWEEN low AND high").join(new.select("source_file").distinct(), "source_file", "left_anti")
    old = as_read.where("index BETWEEN low AND high").unionByName(beyond)
    return old.select("source_file", "pos", "index", F.lit(False).alias("inferred"), F.lit(False).alias("guessed")).unionByName(
        new.select("source_file", "pos", "index", F.lit(True).alias("inferred"), "guessed")
    )
