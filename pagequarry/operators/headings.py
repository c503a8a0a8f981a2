"""Which lines are question headings, and their numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.functions import text as T
from pagequarry.functions.text import hangul_count, heading_number, nonblank, utrim


def disallowed(x) -> Column:
    """Blank, a subject, term or range line, or an exam notice."""
    x = utrim(F.coalesce(T.col(x), F.lit("")))
    return (x == "") | x.rlike(T.SUBJECT_LINE) | x.rlike(T.TERM_LINE) | x.rlike(T.RANGE_LINE) | F.lower(x).contains(T.NOTICE_WORDS[0]) | F.lower(x).contains(T.NOTICE_WORDS[1])


def code_like(x) -> Column:
    x = utrim(x)
    return (x != "") & (x.rlike(T.CODE_SUFFIX) | x.rlike(T.NUMBER_SUFFIX))


def continues(following, bad: Column | None = None) -> Column:
    """The next line reads on: it has words and is no heading itself; ``bad`` is disallowed() of it where that is known."""
    x = utrim(F.coalesce(T.col(following), F.lit("")))
    return ~(disallowed(x) if bad is None else bad) & ~x.rlike(T.NUMBERED_LINE) & ((hangul_count(x) >= 2) | x.contains("?"))


def plausible(suffix, following, reads: Column | None = None) -> Column:
    """What follows the number looks like a question; ``reads`` is continues() of the following line where that is known."""
    suffix = T.col(suffix)
    on = continues(following) if reads is None else reads
    reads_on = F.when(nonblank(suffix), (hangul_count(suffix) >= 2) | suffix.contains("?") | on).otherwise(on)
    return ~suffix.rlike(T.TERM_SUFFIX) & ~code_like(suffix) & reads_on


def heading_index(x, following, low=None, high=None, pattern: str = T.STRICT_HEADING) -> Column:
    """The heading's number, or null if the line is none. With bounds, only numbers inside them count."""
    x = F.coalesce(T.col(x), F.lit(""))
    index = heading_number(F.regexp_extract(x, pattern, 1))
    suffix = utrim(F.regexp_replace(x, pattern, ""))
    ok = nonblank(x) & ~disallowed(x) & x.rlike(pattern) & index.isNotNull() & plausible(suffix, following)
    if low is not None:
        ok = ok & (T.col(low).isNull() | index.between(T.col(low), T.col(high)))
    return F.when(ok, index)


def with_following(lines: DataFrame, order: str = "line_in_page") -> DataFrame:
    """``next_text``: the next line on the same page."""
    return lines.withColumn("next_text", F.lead("text").over(Window.partitionBy("source_file", "page_index").orderBy(order)))


def marked(
    lines: DataFrame, order: str = "line_in_page", low: str | None = None, high: str | None = None,
    patterns: dict[str, str] | None = None, keep: bool = False
) -> DataFrame:
    """heading_index() of every line by the next one of its page, as ``index`` or under the names of ``patterns``.

    What a line says by itself is a column below the window, so that each pattern is
    matched once a line; what the next line says comes from there too. With ``keep``,
    ``m_bad`` (disallowed() of the line) and ``m_next`` (continues() of the next one) stay.
    """
    patterns = patterns or {"index": T.STRICT_HEADING}
    text = F.coalesce("text", F.lit(""))
    x = lines.withColumn("m_bad", disallowed("text")).withColumn("m_reads", continues("text", F.col("m_bad")))
    for name, pattern in patterns.items():
        suffix = utrim(F.regexp_replace(text, pattern, ""))
        x = x.withColumns({f"m_{name}": heading_number(F.regexp_extract(text, pattern, 1)), f"m_{name}_suffix": suffix})
        own = F.col(f"m_{name}_suffix")
        shape = F.when(own.rlike(T.TERM_SUFFIX) | code_like(own), 0).when(
            nonblank(own) & ((hangul_count(own) >= 2) | own.contains("?")), 2
        ).otherwise(1)
        x = x.withColumn(f"m_{name}_shape", F.when(F.col(f"m_{name}").isNotNull() & ~F.col("m_bad") & text.rlike(pattern), shape).otherwise(0))
    x = x.withColumn("m_next", F.coalesce(F.lead("m_reads").over(Window.partitionBy("source_file", "page_index").orderBy(order)), F.lit(False)))
    for name in patterns:
        number, shape = F.col(f"m_{name}"), F.col(f"m_{name}_shape")
        ok = (shape == 2) | ((shape == 1) & F.col("m_next"))
        if low is not None:
            ok = ok & (F.col(low).isNull() | number.between(F.col(low), F.col(high)))
        x = x.withColumn(name, F.when(ok, number))
    return x.drop("m_reads", *(() if keep else ("m_bad", "m_next")), *(f"m_{n}{tail}" for n in patterns for tail in ("", "_suffix", "_shape")))
