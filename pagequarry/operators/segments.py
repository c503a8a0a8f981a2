"""Lines to question spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.functions import text as T
from pagequarry.functions.text import clip, utrim
from pagequarry.operators.headings import marked
from pagequarry.operators.scans import places, running
from pagequarry.session import settle

CHUNK_LINES = 10


def rising(lines: DataFrame, index: str = "index", file: str = "source_file", order: str = "pos", block: int | None = None) -> DataFrame:
    """``accepted`` as in accept_rising(), and ``reach``: the last accepted number up to the line, null before the first.

    As the accepted numbers rise, those of one ``reach`` are one segment.
    """
    x = running(lines, {"reach": ("max", F.col(index))}, True, file, order, block)
    x = x.withColumn("accepted", F.col(index).isNotNull() & (F.col(index) > F.coalesce("reach", F.lit(0))))
    return x.withColumn("reach", F.when(F.col("accepted"), F.col(index)).otherwise(F.when(F.col("reach") > 0, F.col("reach"))))


def accept_rising(lines: DataFrame, index: str = "index", file: str = "source_file", order: str = "pos", block: int | None = None) -> DataFrame:
    """``accepted``: the number is larger than every number before it in the file (and than 0). A rejected heading is body text."""
    return rising(lines, index, file, order, block).drop("reach")


def span_numbers(lines: DataFrame, file: str = "source_file", order: str = "pos", block: int | None = None) -> DataFrame:
    """``segment``: how many accepted headings there are up to the line; 0 before the first."""
    return running(lines, {"segment": ("sum", F.col("accepted").cast("int"))}, False, file, order, block)


def counted(spans: DataFrame, whole: Column | None = None) -> DataFrame:
    """Spans by ``reach``, here ``segment``, numbered from 1 in each file, which has no more of them than numbers; where ``whole``, they are so already."""
    done = F.lit(False) if whole is None else whole
    each = Window.partitionBy("source_file", F.when(done, F.col("segment"))).orderBy("segment")
    return spans.withColumn("segment", F.when(done, F.col("segment")).otherwise(F.row_number().over(each).cast("long")))


def page_order(lines: DataFrame) -> str:
    return "read_at" if "read_at" in lines.columns else "line_in_page"


def positioned(lines: DataFrame, block: int | None = None) -> DataFrame:
    """``pos``: the line's place in its file, in reading order where that is known."""
    return places(lines, "pos", "page_index", page_order(lines), block=block)


def page_line_counts(lines: DataFrame) -> DataFrame:
    """(source_file, page_index, page_lines): the largest line number of each page, 1 at least."""
    return lines.groupBy("source_file", "page_index").agg(F.greatest(F.lit(1), F.max("line_in_page")).alias("page_lines"))


def spans(lines: DataFrame, separator: str | Column = "\n", *keys: str) -> DataFrame:
    """One row for each segment of lines with ``segment`` and, on its first line, ``index``: place, heading and preview of the body.

    ``keys`` are columns that a file's lines share; they are kept, and ``separator`` may depend on them.
    """
    between = F.lit(separator) if isinstance(separator, str) else separator
    body = F.transform(F.array_sort(F.collect_list(F.when(~F.col("accepted"), F.struct("pos", "text")))), lambda r: r["text"])
    counts = [] if "page_lines" in lines.columns else [page_line_counts(lines)]
    rows = (lines.join(counts[0], ["source_file", "page_index"]) if counts else lines).where(F.col("segment") > 0)
    return rows.groupBy("source_file", "segment", *keys).agg(
        F.max(F.when(F.col("accepted"), F.col("index"))).alias("index"), F.max(F.when(F.col("accepted"), F.col("text"))).alias("header"),
        F.min_by("page_index", "pos").alias("start_page"), F.max_by("page_index", "pos").alias("end_page"),
        F.min_by("line_in_page", "pos").alias("start_line"), F.max_by("line_in_page", "pos").alias("end_line"),
        F.min_by("page_lines", "pos").alias("start_page_line_count"), F.max_by("page_lines", "pos").alias("end_page_line_count"),
        clip(utrim(F.call_function("array_join", body, between))).alias("preview"),
    )


def by_heading(lines: DataFrame, pattern: str = T.STRICT_HEADING, low: str | None = None, high: str | None = None) -> DataFrame:
    """Spans that start at accepted headings."""
    x = rising(marked(lines, "pos", low, high, {"index": pattern})).withColumn("segment", F.coalesce("reach", F.lit(0)))
    return counted(spans(x))


def by_chunks(lines: DataFrame, size: int = CHUNK_LINES) -> DataFrame:
    """Spans of ``size`` lines, numbered from 1, for files without headings; their previews are all lines with blanks between."""
    chunk = lines.withColumn("segment", (F.floor((F.col("pos") - 1) / size) + 1).cast("int"))
    found = spans(chunk.withColumn("index", F.lit(None).cast("int")).withColumn("accepted", F.lit(False)), " ")
    return found.withColumn("index", F.col("segment")).withColumn("header", chunk_header("segment"))


def chunk_header(number: str | Column) -> Column:
    return F.concat(F.lit(T.INFERRED + T.QUESTION), T.col(number).cast("string"))


def segment_documents(lines: DataFrame, low: str | None = None, high: str | None = None, block: int | None = None) -> DataFrame:
    """Strict headings (``tier`` 0), else permissive ones (1), else chunks (2), by file. Files without lines have no rows.

    A line is read once for both kinds of headings, and the largest number of each kind says
    which tier the file gets. A file's lines are dealt and sorted once; with ``block`` they are
    written with their numbers, and no file is brought to one task.
    """
    patterns = {"strict": T.STRICT_HEADING, "loose": T.PERMISSIVE_HEADING}
    tier = F.when(F.col("most_strict") > 0, 0).when(F.col("most_loose") > 0, 1).otherwise(2)
    index = F.when(F.col("tier") == 0, F.col("strict")).when(F.col("tier") == 1, F.col("loose"))
    most = {"most_strict": F.max("strict"), "most_loose": F.max("loose")}
    x, has_place = lines, "pos" in lines.columns
    if "page_lines" not in lines.columns:
        page = Window.partitionBy("source_file", "page_index")
        x = lines.withColumn("page_lines", F.greatest(F.lit(1), F.max("line_in_page").over(page)))
    if block is None:
        file = Window.partitionBy("source_file")
        x = marked(x if has_place else positioned(x), "pos", low, high, patterns)
        x = x.withColumns({k: m.over(file) for k, m in most.items()}).withColumn("tier", tier).withColumn("index", index)
        x = span_numbers(accept_rising(x))
    else:
        read = settle(marked(x, "pos" if has_place else page_order(x), low, high, patterns), "segment-marked")
        files = read.groupBy("source_file").agg(*(m.alias(k) for k, m in most.items())).select("source_file", tier.alias("tier"))
        x = (read if has_place else positioned(read, block)).join(files, "source_file").withColumn("index", index)
        x = rising(x, block=block).withColumn("segment", F.coalesce("reach", F.lit(0)))
    chunk = F.floor((F.col("pos") - 1) / CHUNK_LINES) + 1
    x = x.withColumn("segment", F.when(F.col("tier") == 2, chunk).otherwise(F.col("segment")))
    between = F.when(F.col("tier") == 2, " ").otherwise("\n")
    chunks = spans(x, between, "tier")
    if block is not None:
        chunks = counted(chunks, F.col("tier") == 2)
    number, none = F.col("segment").cast("int"), F.col("tier") == 2
    return chunks.withColumn("index", F.when(none, number).otherwise(F.col("index"))).withColumn(
        "header", F.when(none, chunk_header(number)).otherwise(F.col("header"))
    )


def rebuilt(markers: DataFrame, lines: DataFrame, block: int | None = None) -> DataFrame:
    """Candidates from markers (source_file, pos, index, guessed): each reaches to just before the next one's line.

    ``lines`` are positioned. The header of a line that shows no number says that it was guessed.
    """
    x = lines.join(
        markers.select("source_file", "pos", "index", "guessed"), ["source_file", "pos"], "left"
    ).withColumn("accepted", F.col("index").isNotNull())
    number = F.concat(F.lit(T.INFERRED), F.col("index").cast("string"), F.lit(". "), F.col("text"))
    shown = x.withColumn("text", F.when(F.col("guessed"), number).otherwise(F.col("text")))
    return spans(span_numbers(shown.drop("guessed"), block=block))


def rebuilt_spans(markers: DataFrame, lines: DataFrame) -> DataFrame:
    """Spans from each marker's position to just before the next one's, the last to the file's end."""
    after = F.lead("pos").over(Window.partitionBy("source_file").orderBy("pos"))
    ends = lines.groupBy("source_file").agg(F.max("pos").alias("last_pos"))
    return markers.withColumn("next_pos", after).join(ends, "source_file").select(
        "source_file", "index", F.col("pos").alias("start_pos"),
        F.coalesce(F.col("next_pos") - 1, F.col("last_pos")).alias("end_pos")
    )


def gaps(markers: DataFrame) -> DataFrame:
    """``missing``: numbers left out between a marker and the next one in place."""
    place = Window.partitionBy("source_file").orderBy("pos")
    return markers.withColumn("missing", F.lead("index").over(place) - F.col("index") - 1)
