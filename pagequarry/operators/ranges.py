"""Which numbers a document's questions are expected to have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.functions import text as T
from pagequarry.functions.text import nonblank, try_int, utrim

SEPARATOR = "[-~〜]"


def expected_input(x: str) -> Column:
    """Struct (kind, count, start_index, end_index): 'none' if blank, 'count', 'range', or 'error'. Only the first separator splits."""
    t = utrim(F.coalesce(F.col(x), F.lit("")))
    at = F.regexp_instr(t, F.lit(SEPARATOR))
    low, high = try_int(F.substring(t, F.lit(1), at - 1)), try_int(F.substring(t, at + 1, F.length(t)))
    n = try_int(t)
    good = (low > 0) & (high >= low)
    split = at > 1
    kind = F.when(~nonblank(t), "none").when(
        split, F.when(F.coalesce(good, F.lit(False)), "range").otherwise("error")
    ).when(F.coalesce(n, F.lit(0)) > 0, "count").otherwise("error")
    return F.struct(
        kind.alias("kind"), F.when(kind == "range", high - low + 1).when(kind == "count", n).alias("count"),
        F.when(kind == "range", low).alias("start_index"), F.when(kind == "range", high).alias("end_index")
    )


def hinted(lines: DataFrame, expected: str = "expected_count", first: int = 12) -> DataFrame:
    """(source_file, start_index, end_index): the first range of the expected size in the first lines of the pages."""
    page = Window.partitionBy("source_file", "page_index").orderBy("line_in_page")
    near = lines.withColumn("n", F.row_number().over(page)).where(F.col("n") <= first)
    pairs = F.arrays_zip(
        F.regexp_extract_all("text", F.lit(T.RANGE_HINT), F.lit(1)).alias("a"),
        F.regexp_extract_all("text", F.lit(T.RANGE_HINT), F.lit(2)).alias("b")
    )
    found = near.select("source_file", "page_index", "line_in_page", expected, F.posexplode(pairs).alias("at", "r")).select(
        "*", F.col("r.a").cast("int").alias("start_index"), F.col("r.b").cast("int").alias("end_index")
    )
    fits = found.where(
        (F.col("start_index") > 0) & (F.col("end_index") >= F.col("start_index")) & (F.col("end_index") - F.col("start_index") + 1 == F.col(expected))
    )
    place = Window.partitionBy("source_file").orderBy("page_index", "line_in_page", "at")
    return fits.withColumn("rn", F.row_number().over(place)).where("rn = 1").select("source_file", "start_index", "end_index")


def inferred(candidates: DataFrame, expected: str = "expected_count", file: str = "source_file") -> DataFrame:
    """(file, start_index, end_index, hits): the range of the expected size that fits most of the distinct numbers.

    Ranges that contain a number compete by 1000 a hit, less 10 for each place that the
    first hit is late, less the hits' spread, less the start; ties go to the earliest first
    hit, the narrowest spread, the smallest start. The winner needs 2 hits (or all, if 1 is
    expected).

    With the same hits a range scores 9 more for each place that it starts later, so the best
    one starts at its first hit or as far on as the next number stays outside: only a number,
    and the place ``expected`` before one, can be the winner's start. That is two for each
    number, however many are expected; each range's hits are told by its ends' places among
    the sorted numbers.
    """
    c = candidates.where((F.col("index") > 0) & (F.col(expected) > 0)).select(file, expected, F.col("index").cast("long").alias("index")).distinct()
    size = F.col(expected).cast("long")
    # the number itself, and both ends of its two ranges; a start that two numbers give counts once, as its rows are grouped
    point = lambda at, kind, number, s: F.struct(
        at.alias("at"), F.lit(kind).alias("kind"), number.cast("long").alias("number"), s.cast("long").alias("s")
    )
    none, each = F.lit(None), [point(F.col("index"), 0, F.col("index"), F.lit(None))]
    for s in (F.col("index"), F.col("index") - size):
        each += [point(s - 1, 1, none, s), point(s + size - 1, 2, none, s)]
    points = c.select(file, expected, F.explode(F.array(*each)).alias("e")).select(file, expected, "e.*").where("kind = 0 OR s > 0")
    of = Window.partitionBy(file, expected)
    upto = of.orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = of.orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = points.withColumns(
        {"below": F.count("number").over(upto), "last": F.max("number").over(upto), "next": F.min("number").over(onward)}
    )
    before, end = F.col("kind") == 1, F.col("kind") == 2
    scored = placed.where("kind > 0").groupBy(file, expected, "s").agg(
        (F.max(F.when(end, F.col("below"))) - F.max(F.when(before, F.col("below")))).alias("hits"),
        F.max(F.when(before, F.col("next"))).alias("lo"), F.max(F.when(end, F.col("last"))).alias("hi")
    ).where("hits > 0")
    scored = scored.withColumn("score", 1000 * F.col("hits") - 10 * (F.col("lo") - F.col("s")) - (F.col("hi") - F.col("lo")) - F.col("s"))
    best = Window.partitionBy(file).orderBy(F.desc("score"), "lo", F.col("hi") - F.col("lo"), "s")
    winner = scored.withColumn("rn", F.row_number().over(best)).where("rn = 1")
    return winner.where(F.col("hits") >= F.least(F.lit(2), F.col(expected))).select(
        file, F.col("s").alias("start_index"), (F.col("s") + F.col(expected) - 1).alias("end_index"), "hits"
    )


def resolved(files: DataFrame, explicit: DataFrame, hint: DataFrame, inference: DataFrame) -> DataFrame:
    """Each file's range: given, else hinted, else inferred, else null. The inputs have source_file, start_index, end_index."""
    out = files.select("source_file").distinct()
    for i, df in enumerate((explicit, hint, inference)):
        out = out.join(df.select("source_file", F.struct("start_index", "end_index").alias(f"r{i}")), "source_file", "left")
    return out.select(
        "source_file", F.coalesce("r0", "r1", "r2").alias("range"),
        F.when(F.col("r0").isNotNull(), "given").when(F.col("r1").isNotNull(), "hint").when(
            F.col("r2").isNotNull(), "inferred"
        ).otherwise("none").alias("origin")
    )
