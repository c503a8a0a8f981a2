"""Text functions as Column expressions; Unicode white space and digits wherever the rules are Unicode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and words that decide which lines are headings.
STRICT_HEADING = r"(?U)^\s*(?:[Qq]\s*)?(?:(?:제|문항|문제)\s*)?(\d{1,3})\s*(?:[.)\]\-:：]|\s|$)"
PERMISSIVE_HEADING = r"(?U)^\s*(?:[Qq]\s*)?(?:(?:제|문항|문제)\s*)?(\d{1,3}|[①-⑳]|[가-하]|[A-Za-z])\s*(?:[.)\]\-:：]|\s|$)"
SUBJECT_LINE = r"(?U)^\s*제\s*\d+\s*과목\s*$"
TERM_LINE = r"(?U)^\s*\d+\s*(?:학기|과목|교시)\s*$"
RANGE_LINE = r"(?U)^\s*\(?\d+\s*[-~〜]\s*.*번\)?\s*$"
NOTICE_WORDS = ["출제위원", "출제범위"]
TERM_SUFFIX = r"(?U)^(?:학기|과목|교시)\b"
CODE_SUFFIX = r"(?U)^[A-Z0-9_+\-*/=().,:;]+$"
NUMBER_SUFFIX = r"(?U)^\d+(?:\.\d+)?$"
NUMBERED_LINE = r"(?U)^\d{1,3}\s*(?:[.)\]\-:：]|$)"
INLINE_BREAK = r"(?U)(?<=\s)((?:[1-9]|[1-9]\d)\s*[.)])(?=\s)"
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
RANGE_HINT = r"(?U)(?<!\d)(\d{1,3})\s*[-~〜]\s*(\d{1,3})\s*(?:번|문항|문제)?(?!\d)"
RANGE_START = r"(?U)(?<!\d)(\d{1,3})\s*[-~〜]"
RANGE_END = r"(?U)[-~〜]\s*(\d{1,3})(?:번|문항|문제)?(?!\d)"
MARKER_WORDS = ["다음", "답하라", "보고"]
# What stands for texts that are lacking.
INFERRED = "[추정] "
QUESTION = "문항 "
NO_DIAGNOSTICS = "저장된 분석 진단 파일이 없습니다."
INVALID_NAME = r'[<>:"/\\|?*\x00-\x1F]'


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def utrim(x) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col(x), r"(?U)^\s+|\s+$", "")


def rtrim_all(x) -> Column:
    return F.regexp_replace(col(x), r"(?U)\s+$", "")


def nonblank(x) -> Column:
    """Not null and with something besides white space."""
    return F.coalesce(col(x).rlike(r"(?U)\S"), F.lit(False))


def try_int(x) -> Column:
    """A 32-bit whole number with optional sign and outer blanks; null for all else."""
    return utrim(x).try_cast("int")


def same_text(a, b) -> Column:
    """Equality without regard to case."""
    return F.lower(col(a)) == F.lower(col(b))


def source_name(x) -> Column:
    return F.when(nonblank(x), utrim(x)).otherwise("manual")


def hangul_count(x) -> Column:
    return F.regexp_count(col(x), F.lit("[가-힣]"))


def clip(x, n: int = 150) -> Column:
    """At most n characters, then an ellipsis for what is cut."""
    x = col(x)
    return F.when(F.length(x) > n, F.concat(rtrim_all(F.substring(x, 1, n)), F.lit("..."))).otherwise(x)


def tidy(x) -> Column:
    """Without carriage returns and blank lines; non-breaking spaces are spaces; lines trimmed."""
    lines = F.split(F.replace(F.replace(F.coalesce(col(x), F.lit("")), F.lit("\r"), F.lit("")), F.lit(" "), F.lit(" ")), "\n")
    return F.array_join(F.filter(F.transform(lines, utrim), lambda v: v != ""), "\n")


def word_count(x) -> Column:
    """Words between carriage returns, line feeds and spaces; a tab doesn't separate, blank ones don't count."""
    return F.size(F.filter(F.split(F.coalesce(col(x), F.lit("")), r"[\r\n ]"), lambda w: w.rlike(r"(?U)\S")))


def split_tokens(x) -> Column:
    """Between commas, line feeds and semicolons, trimmed, empties kept."""
    return F.transform(F.split(F.replace(F.coalesce(col(x), F.lit("")), F.lit("\r"), F.lit("")), "[,\\n;]", -1), utrim)


def split_choices(x) -> Column:
    """Between bars, trimmed, blank ones dropped."""
    return F.filter(F.transform(F.split(col(x), "[|]", -1), utrim), lambda v: v != "")


def with_breaks(x) -> Column:
    """A line feed before each number like ``1.`` or ``2)`` inside a line."""
    return F.regexp_replace(F.replace(col(x), F.lit("\r"), F.lit("\n")), INLINE_BREAK, "\n$1")


def break_count(x) -> Column:
    return F.regexp_count(F.replace(col(x), F.lit("\r"), F.lit("\n")), F.lit(INLINE_BREAK))


def heading_number(x) -> Column:
    """1 to 999 from digits, 1 to 20 from circled digits, and from a syllable its code point's distance; null for all else."""
    x = col(x)
    number = x.try_cast("int")
    circled = F.position(x, F.lit(CIRCLED))
    syllable = F.when(x.between("가", "하") & (F.length(x) == 1), F.ascii(x) - F.lit(44031))
    return F.coalesce(F.when(number > 0, number), F.when(x.rlike("^[①-⑳]$"), circled), syllable)


def inference_type(answers) -> Column:
    """Multiple choice without answers or if all are whole numbers, else subjective."""
    a = col(answers)
    return F.when((F.size(a) == 0) | F.forall(a, lambda v: try_int(v).isNotNull()), "MC").otherwise("SUBJ")


def base_name(x) -> Column:
    return F.regexp_extract(col(x), r"([^/\\]*)$", 1)


def extension(x) -> Column:
    return F.regexp_extract(base_name(x), r"(\.[^.]*)$", 1)


def stem(x) -> Column:
    return F.regexp_replace(base_name(x), r"\.[^.]*$", "")


def safe_stem(x) -> Column:
    """A file stem with invalid characters replaced; ``analysis`` if nothing is left."""
    s = F.regexp_replace(stem(x), INVALID_NAME, "_")
    return F.when(nonblank(s), s).otherwise("analysis")


def trailing_number(x) -> Column:
    """The number that ends a file stem, or the largest int: files without one come last."""
    return F.coalesce(F.regexp_extract(stem(x), r"(\d+)$", 1).try_cast("int"), F.lit(2147483647))


def clamp(x) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), col(x)))


def numbered(choices) -> Column:
    """Choices as lines ``1. text``."""
    return F.array_join(F.transform(col(choices), lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c)), "\n")
