"""The operators over the driver's tables, each with the SQL that must give the same rows.

The tables hold no exams, so stand-ins are derived from them: a supplier's line items are a
file's lines, every returned item a heading with the part's number; parts are questions
(brand: category, type: file); events are attempts; customers and orders give layouts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry.functions import text as T
from pagequarry.operators import answers, catalogue, diagnostics, grading, headings, importer, layout, lines, practice, ranges, recovery, scans, segments
from pagequarry.session import settle, shared_folder
from pagequarry.streaming import wrong_set as streamed

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- a file's lines with numbers ----------------------------------------------------------

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate"]
LINES = """lines AS (
  SELECT l_suppkey AS source_file,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) AS pos,
    CASE WHEN l_returnflag = 'R' THEN l_partkey % 200 END AS index, l_linenumber::VARCHAR AS text FROM lineitem),
accepted AS (
  SELECT *, index IS NOT NULL AND index > coalesce(max(index) OVER (PARTITION BY source_file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING
    AND 1 PRECEDING), 0) AS accepted FROM lines),
spans AS (SELECT *, sum(accepted::INT) OVER (PARTITION BY source_file ORDER BY pos) AS segment FROM accepted)"""


def shown_number() -> Column:
    return F.when(F.col("l_returnflag") == "R", F.col("l_partkey") % 200)


def numbered_lines(spark, sf_dir, headings: bool = False) -> DataFrame:
    """Lines by their files; with ``headings`` those alone that show a number, and ``pos`` is their place among these."""
    # named before it is dealt, so that windows by file need no other exchange
    l = scans.dealt(table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "source_file"), "source_file")  # noqa: E741
    pos = F.row_number().over(Window.partitionBy("source_file").orderBy(*ORDER))
    return (l.where(shown_number().isNotNull()) if headings else l).select(
        "source_file", pos.cast("long").alias("pos"), shown_number().alias("index"), F.col("l_linenumber").cast("string").alias("text")
    )


def candidates(spark, sf_dir) -> DataFrame:
    return segments.accept_rising(numbered_lines(spark, sf_dir)).where("accepted")


def accepted_numbers(spark, sf_dir) -> DataFrame:
    """The numbers of candidates(), for what asks for no places: lines without a number accept none, so they are neither dealt nor sorted.

    A number that was there before is not accepted. So where a file is too long for one task,
    it gets no lines, but each number's first place, which is aggregated before it is sent.
    """
    lineitem = table(spark, sf_dir, "lineitem")
    shown = lineitem.withColumnRenamed("l_suppkey", "source_file").withColumn("index", shown_number()).where("index IS NOT NULL")
    if scans.needed_block(shown) is None:
        x = numbered_lines(spark, sf_dir, headings=True)
    else:
        first = shown.groupBy("source_file", "index").agg(F.min(F.struct(*ORDER)).alias("pos"))
        x = first.repartition(scans.tasks_for(lineitem), "source_file")
    return segments.accept_rising(x).where("accepted").select("source_file", "index")


@query("segments", f"""WITH {LINES}
SELECT source_file, segment::BIGINT AS segment, max(CASE WHEN accepted THEN index END) AS index, min(pos) AS start_pos,
  max(pos) AS end_pos, count(*) AS n_lines,
  CASE WHEN length(body) > 150 THEN rtrim(left(body, 150)) || '...' ELSE body END AS preview
FROM (SELECT *, coalesce(string_agg(CASE
  WHEN NOT accepted THEN text END, ' ' ) OVER (PARTITION BY source_file, segment ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING
  AND UNBOUNDED FOLLOWING), '') AS body FROM spans)
WHERE segment > 0 GROUP BY source_file, segment, body""")  # fmt: skip
def q_segments(spark, sf_dir):
    x = segments.rising(numbered_lines(spark, sf_dir), block=scans.BLOCK).where("reach > 0").withColumnRenamed("reach", "segment")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("accepted"), F.struct("pos", "text")))), lambda r: r["text"]), " ")
    found = x.groupBy("source_file", "segment").agg(
        F.max(F.when(F.col("accepted"), F.col("index"))).alias("index"), F.min("pos").alias("start_pos"),
        F.max("pos").alias("end_pos"), F.count("*").alias("n_lines"), T.clip(body).alias("preview")
    )
    return segments.counted(found)


@query("rebuilt_spans", f"""WITH {LINES}
SELECT source_file, index, pos AS start_pos, coalesce(lead(pos) OVER (PARTITION BY source_file ORDER BY pos) - 1, last_pos) AS end_pos,
  lead(index) OVER (PARTITION BY source_file ORDER BY pos) - index - 1 AS missing
FROM (SELECT *, max(pos) OVER (PARTITION BY source_file) AS last_pos FROM accepted) WHERE accepted""")  # fmt: skip
def q_rebuilt_spans(spark, sf_dir):
    found = segments.rebuilt_spans(candidates(spark, sf_dir), numbered_lines(spark, sf_dir))
    gaps = segments.gaps(candidates(spark, sf_dir)).select("source_file", F.col("pos").alias("start_pos"), "missing")
    return found.join(gaps, ["source_file", "start_pos"]).select("source_file", "index", "start_pos", "end_pos", "missing")


@query("range_infer", f"""WITH {LINES},
c AS (SELECT DISTINCT source_file, index FROM accepted WHERE accepted),
s AS (SELECT DISTINCT source_file, unnest(generate_series(greatest(1, index - 4), index)) AS s FROM c),
h AS (SELECT s.source_file, s, count(*) AS hits, min(index) AS lo, max(index) AS hi FROM s JOIN c ON s.source_file = c.source_file
  AND index BETWEEN s AND s + 4 GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY 1000 * hits - 10 * (lo - s) - (hi - lo) - s DESC, lo, hi - lo, s) AS rn FROM h)
SELECT source_file, s AS start_index, s + 4 AS end_index, hits FROM w WHERE rn = 1 AND hits >= 2""")  # fmt: skip
def q_range_infer(spark, sf_dir):
    return ranges.inferred(accepted_numbers(spark, sf_dir).withColumn("expected_count", F.lit(5)))


@query("range_infer_wide", f"""WITH {LINES},
c AS (SELECT DISTINCT source_file, index FROM accepted WHERE accepted),
s AS (SELECT DISTINCT source_file, unnest(generate_series(greatest(1, index - 119), index)) AS s FROM c),
h AS (SELECT s.source_file, s, count(*) AS hits, min(index) AS lo, max(index) AS hi FROM s JOIN c ON s.source_file = c.source_file
  AND index BETWEEN s AND s + 119 GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY 1000 * hits - 10 * (lo - s) - (hi - lo) - s DESC, lo, hi - lo, s) AS rn FROM h)
SELECT source_file, s AS start_index, s + 119 AS end_index, hits FROM w WHERE rn = 1 AND hits >= 2""")  # fmt: skip
def q_range_infer_wide(spark, sf_dir):
    return ranges.inferred(accepted_numbers(spark, sf_dir).withColumn("expected_count", F.lit(120)))


@query("diagnostics", f"""WITH {LINES},
c AS (SELECT source_file, index, count(*) AS n FROM lines WHERE index > 0 GROUP BY ALL)
SELECT source_file, count(*) AS n_distinct, array_to_string(list_sort(list(index) FILTER (n > 1)), ',') AS repeated,
  array_to_string(list_sort(list_filter(generate_series(1, 40), lambda x: NOT list_contains(list(index), x))), ',') AS missing,
  array_to_string(list_sort(list(index) FILTER (index > 40)), ',') AS unexpected,
  bool_or(n > 1) OR bool_or(index > 40) OR count(*) FILTER (index <= 40) < 40 AS mismatch
FROM c GROUP BY source_file""")  # fmt: skip
def q_diagnostics(spark, sf_dir):
    c = numbered_lines(spark, sf_dir).where("index > 0").select(
        "source_file", F.col("index").cast("int").alias("index"), F.lit(1).alias("start_index"), F.lit(40).alias("end_index")
    )
    d = diagnostics.diagnose(c)
    join = lambda k: F.array_join(d[k].cast("array<string>"), ",").alias(k)
    return d.select(
        "source_file", F.size("distinct_indexes").cast("long").alias("n_distinct"), join("repeated"), join("missing"),
        join("unexpected"), "mismatch"
    )


@query("repeated_headers", f"""WITH {LINES}
SELECT source_file, index, count(*) AS n, array_to_string(list(pos::VARCHAR ORDER BY pos)[1:5], ',') AS headers FROM lines
  WHERE index IS NOT NULL GROUP BY ALL HAVING count(*) > 1""")
def q_repeated_headers(spark, sf_dir):
    x = numbered_lines(spark, sf_dir).where("index IS NOT NULL").withColumn("header", F.col("pos").cast("string"))
    return diagnostics.repeated_headers(x).select("source_file", "index", "n", F.array_join("headers", ",").alias("headers"))


@query("passing_files", f"""WITH {LINES},
c AS (SELECT source_file, index, count(*) AS n FROM accepted WHERE accepted GROUP BY ALL),
bad AS (SELECT source_file FROM c WHERE source_file % 2 = 1
  GROUP BY source_file HAVING bool_or(index > 150) OR count(*) FILTER (index BETWEEN 1 AND 150) < 150)
SELECT source_file, count(*) AS candidates FROM c WHERE source_file NOT IN (SELECT source_file FROM bad) GROUP BY ALL""")
def q_passing_files(spark, sf_dir):
    c = accepted_numbers(spark, sf_dir).select("source_file", F.col("index").cast("int").alias("index"))
    d = diagnostics.diagnose(c.withColumns({"start_index": F.when(F.col("source_file") % 2 == 1, 1), "end_index": F.lit(150)}))
    return diagnostics.passing(c.groupBy("source_file").agg(F.count("*").alias("candidates")), d)


HEADING_TEXTS = """texts AS (
  SELECT source_file, pos,
    CASE WHEN index IS NOT NULL THEN index || CASE pos % 4 WHEN 0 THEN '. 다음 중 옳은 것은?' WHEN 1 THEN ') X=1' WHEN 2 THEN '. 가' ELSE '학기' END
    ELSE CASE pos % 3 WHEN 0 THEN '본문 설명' WHEN 1 THEN 'plain' ELSE '12. 다음' END END AS text FROM lines),
following AS (SELECT *, lead(text) OVER (PARTITION BY source_file ORDER BY pos) AS next_text FROM texts)"""


def heading_texts(spark, sf_dir) -> DataFrame:
    x = numbered_lines(spark, sf_dir)
    tail = F.when(F.col("pos") % 4 == 0, ". 다음 중 옳은 것은?").when(F.col("pos") % 4 == 1, ") X=1").when(F.col("pos") % 4 == 2, ". 가").otherwise("학기")
    body = F.when(F.col("pos") % 3 == 0, "본문 설명").when(F.col("pos") % 3 == 1, "plain").otherwise("12. 다음")
    return x.select(
        "source_file", "pos", F.lit(1).alias("page_index"), F.col("pos").alias("line_in_page"),
        F.when(F.col("index").isNotNull(), F.concat(F.col("index").cast("string"), tail)).otherwise(body).alias("text")
    )


FLAGGED = f"""{LINES}, {HEADING_TEXTS},
parts AS (
  SELECT *, TRY_CAST(nullif(regexp_extract(text, '^\\s*(?:[Qq]\\s*)?(?:(?:제|문항|문제)\\s*)?(\\d{{1,3}})\\s*(?:[.)\\]\\-:：]|\\s|$)', 1), '') AS INTEGER) AS number,
    trim(regexp_replace(text, '^\\s*(?:[Qq]\\s*)?(?:(?:제|문항|문제)\\s*)?(\\d{{1,3}})\\s*(?:[.)\\]\\-:：]|\\s|$)', '')) AS suffix,
    coalesce(next_text, '') <> '' AND NOT regexp_matches(coalesce(next_text, ''), '^\\d+\\s*(?:학기|과목|교시)$')
      AND NOT regexp_matches(coalesce(next_text, ''), '^\\d{{1,3}}\\s*(?:[.)\\]\\-:：]|$)')
      AND (len(regexp_extract_all(coalesce(next_text, ''), '[가-힣]')) >= 2 OR contains(coalesce(next_text, ''), '?')) AS reads_on FROM following),
flagged AS (
  SELECT source_file, pos, text, CASE WHEN number > 0 AND NOT regexp_matches(text, '^\\d+\\s*(?:학기|과목|교시)$')
    AND NOT regexp_matches(suffix, '^(?:학기|과목|교시)')
    AND NOT (suffix <> '' AND (regexp_matches(suffix, '^[A-Z0-9_+\\-*/=().,:;]+$') OR regexp_matches(suffix, '^\\d+(?:\\.\\d+)?$')))
    AND CASE WHEN suffix <> '' THEN len(regexp_extract_all(suffix, '[가-힣]')) >= 2 OR contains(suffix, '?') OR reads_on
  ELSE reads_on END THEN number END AS index FROM parts)"""


@query("heading_flags", f"WITH {FLAGGED} SELECT source_file, pos, index FROM flagged WHERE index IS NOT NULL")
def q_heading_flags(spark, sf_dir):
    return headings.marked(heading_texts(spark, sf_dir), "pos").where("index IS NOT NULL").select("source_file", "pos", "index")


@query("boilerplate_trim", f"""WITH {FLAGGED}, p AS (SELECT *, (pos - 1) // 50 + 1 AS page_index FROM flagged),
f AS (SELECT *, min(CASE WHEN index IS NOT NULL THEN pos END) OVER (PARTITION BY source_file, page_index) AS first_heading FROM p)
SELECT source_file, page_index::BIGINT AS page_index, count(*) AS kept, min(pos) AS first_pos FROM f
  WHERE first_heading IS NULL OR pos >= first_heading GROUP BY ALL""")  # fmt: skip
def q_boilerplate_trim(spark, sf_dir):
    x = headings.marked(heading_texts(spark, sf_dir), "pos")
    x = x.withColumn("page_index", F.floor((F.col("pos") - 1) / 50) + 1)
    return lines.trim_boilerplate(x, F.col("index").isNotNull(), "pos").groupBy("source_file", "page_index").agg(
        F.count("*").alias("kept"), F.min("pos").alias("first_pos")
    )


# ---- raw page text -----------------------------------------------------------------------


def document_pages(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("source_file"), F.lit(1).alias("page_index"), F.coalesce("text", F.lit("")).alias("text"))


DOC_LINES = """doc_lines AS (
  SELECT doc_id AS source_file, i AS line_in_page, trim(l[i]) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l
  FROM documents), unnest(generate_series(1, len(l))) AS t(i) WHERE trim(l[i]) <> '')"""


@query("page_stats", """SELECT doc_id AS source_file,
  count(*) AS pages, sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\r\\n ]'), lambda w: regexp_matches(w, '\\S'))))::BIGINT AS words,
  bool_or(regexp_matches(coalesce(text, ''), '\\S')) AS has_text, sum(length(array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: trim(l)), lambda l: l <> ''), chr(10))))::BIGINT AS tidy_chars
FROM documents GROUP BY doc_id""")  # fmt: skip
def q_page_stats(spark, sf_dir):
    pages = document_pages(spark, sf_dir).withColumn("word_count", T.word_count("text"))
    tidy = pages.groupBy("source_file").agg(F.sum(F.length(T.tidy("text"))).alias("tidy_chars"))
    return lines.page_stats(pages).join(tidy, "source_file")


@query("inline_breaks")
def q_inline_breaks(spark, sf_dir):
    x = heading_texts(spark, sf_dir).groupBy("source_file").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda r: r["text"]), " ").alias("text")
    )
    return x.select(
        "source_file", T.break_count("text").cast("long").alias("breaks"),
        F.size(F.split(T.with_breaks("text"), "\n")).cast("long").alias("lines")
    )


@query("chunk_fallback", f"""WITH {DOC_LINES}, p AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY line_in_page) AS pos
  FROM doc_lines),
c AS (SELECT source_file, (pos - 1) // 10 + 1 AS index, min(line_in_page) AS start_line, max(line_in_page) AS end_line,
  string_agg(text, ' ' ORDER BY pos) AS body
  FROM p GROUP BY ALL)
SELECT source_file, index::BIGINT AS index, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line, '[추정] 문항 ' || index AS header,
  CASE WHEN length(body) > 150 THEN rtrim(left(body, 150)) || '...' ELSE body END AS preview FROM c""")  # fmt: skip
def q_chunk_fallback(spark, sf_dir):
    found = segments.by_chunks(segments.positioned(lines.text_lines(document_pages(spark, sf_dir))))
    return found.select("source_file", *(F.col(c).cast("long").alias(c) for c in ("index", "start_line", "end_line")), "header", "preview")


@query("tier_choice", f"""WITH {FLAGGED},
m AS (SELECT 1000000 + source_file AS source_file, pos, index FROM flagged),
a AS (SELECT *, index IS NOT NULL
  AND index > coalesce(max(index) OVER (PARTITION BY source_file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ok
  FROM m),
strict AS (SELECT source_file, 0 AS tier, count(*) AS segments FROM a WHERE ok GROUP BY source_file),
{DOC_LINES},
chunks AS (SELECT source_file, 2 AS tier, (count(*) + 9) // 10 AS segments FROM doc_lines GROUP BY source_file),
circled AS (SELECT 2000000 + o_custkey AS source_file, o_orderkey AS pos, 1 + o_orderkey % 20 AS index FROM orders),
b AS (SELECT *, index > coalesce(max(index) OVER (PARTITION BY source_file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING), 0) AS ok FROM circled),
permissive AS (SELECT source_file, 1 AS tier, count(*) AS segments FROM b WHERE ok GROUP BY source_file)
SELECT source_file, tier, segments::BIGINT AS segments FROM strict UNION ALL SELECT source_file, tier, segments::BIGINT FROM chunks
  UNION ALL SELECT source_file, tier, segments::BIGINT FROM permissive""")  # fmt: skip
def q_tier_choice(spark, sf_dir):
    numbered = heading_texts(spark, sf_dir).withColumn("source_file", F.col("source_file") + 1000000).select(
        "source_file", "page_index", F.col("pos").cast("int").alias("line_in_page"), "text"
    )
    plain = lines.text_lines(document_pages(spark, sf_dir)).select("source_file", "page_index", "line_in_page", "text")
    sign = F.substring(F.lit(T.CIRCLED), (1 + F.col("o_orderkey") % 20).cast("int"), F.lit(1))
    circled = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") + 2000000).alias("source_file"), F.lit(1).alias("page_index"),
        F.col("o_orderkey").cast("int").alias("line_in_page"), F.concat(sign, F.lit(" 다음 중 옳은 것은?")).alias("text")
    )
    found = segments.segment_documents(numbered.unionByName(plain).unionByName(circled))
    return found.groupBy("source_file", "tier").agg(F.count("*").alias("segments"))


@query("page_diagnostics", f"""WITH {DOC_LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY line_in_page) AS rank
  FROM doc_lines),
f AS (SELECT source_file, string_agg(rank || ': ' || text, chr(10) ORDER BY rank) FILTER (rank <= 8) AS leading_lines, (max(rank) + 9) // 10 AS chunks
  FROM r GROUP BY source_file)
SELECT doc_id AS source_file, len(list_filter(regexp_split_to_array(coalesce(documents.text, ''), '[\\r\\n ]'), lambda w: regexp_matches(w, '\\S')))::BIGINT AS word_count,
  coalesce(leading_lines, '') AS leading_lines, coalesce(array_to_string(generate_series(1, chunks), ','), '') AS candidate_indexes
  FROM documents LEFT JOIN f ON source_file = doc_id""")  # fmt: skip
def q_page_diagnostics(spark, sf_dir):
    pages = document_pages(spark, sf_dir)
    chunks = segments.by_chunks(segments.positioned(lines.text_lines(pages)))
    x = diagnostics.page_diagnostics(pages, chunks)
    return x.select(
        "source_file", "word_count", F.array_join("leading_lines", "\n").alias("leading_lines"),
        F.array_join(F.col("candidate_indexes").cast("array<string>"), ",").alias("candidate_indexes")
    )


@query("leading_lines", f"""WITH {DOC_LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY line_in_page) AS rank
  FROM doc_lines)
SELECT source_file, rank, line_in_page::BIGINT AS line_in_page, CASE WHEN length(text) > 40 THEN rtrim(left(text, 40)) || '...'
  ELSE text END AS text FROM r WHERE rank <= 8""")  # fmt: skip
def q_leading_lines(spark, sf_dir):
    x = lines.leading_lines(lines.text_lines(document_pages(spark, sf_dir)))
    return x.select(
        "source_file", F.col("rank").cast("long").alias("rank"), F.col("line_in_page").cast("long").alias("line_in_page"),
        T.clip("text", 40).alias("text")
    )


def gap_lines(spark, sf_dir) -> DataFrame:
    """Lines of files whose headings lack numbers; every seventh line is indented."""
    x = heading_texts(spark, sf_dir)
    return x.select(
        "source_file", "page_index", F.col("line_in_page").cast("int").alias("line_in_page"), "text",
        F.when(F.col("pos") % 7 == 0, 0.05).otherwise(0.0).alias("left_ratio")
    )


@query("gap_markers")
def q_gap_markers(spark, sf_dir):
    return recovery.recover(gap_lines(spark, sf_dir), low=1, high=120)


@query("range_hint", f"""WITH {LINES}, r AS (SELECT source_file, (pos - 1) // 50 + 1 AS page_index, (pos - 1) % 50 + 1 AS line_in_page,
  coalesce(index, 0) AS a, coalesce(index, 0) + pos % 8 AS b FROM lines),
f AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY page_index, line_in_page) AS rn FROM r WHERE line_in_page <= 12
  AND a > 0 AND b < 1000 AND b - a + 1 = 5)
SELECT source_file, a::INTEGER AS start_index, b::INTEGER AS end_index FROM f WHERE rn = 1""")  # fmt: skip
def q_range_hint(spark, sf_dir):
    x = numbered_lines(spark, sf_dir)
    a = F.coalesce("index", F.lit(0))
    t = x.select(
        "source_file", (F.floor((F.col("pos") - 1) / 50) + 1).alias("page_index"),
        ((F.col("pos") - 1) % 50 + 1).alias("line_in_page"),
        F.concat(F.lit("( "), a.cast("string"), F.lit(" ~ "), (a + F.col("pos") % 8).cast("string"), F.lit("번)")).alias("text"),
        F.lit(5).alias("expected_count")
    )
    return ranges.hinted(t)


@query("expected_input", """WITH x AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN (o_custkey % 90)::VARCHAR
  WHEN 2 THEN (o_custkey % 90) || ' - ' || (o_custkey % 90 + 20) WHEN 3 THEN '55~' || (o_custkey % 90) WHEN 4 THEN 'abc'
  ELSE '1-2-3' END AS t, o_custkey % 90 AS n FROM orders)
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'none' WHEN 1 THEN CASE WHEN n > 0 THEN 'count' ELSE 'error' END WHEN 2 THEN
  CASE WHEN n > 0 THEN 'range' ELSE 'error' END WHEN 3 THEN CASE WHEN n >= 55 THEN 'range' ELSE 'error' END ELSE 'error' END AS kind,
  CASE o_orderkey % 6 WHEN 1 THEN CASE WHEN n > 0 THEN n END WHEN 2 THEN CASE WHEN n > 0 THEN 21 END WHEN 3 THEN
    CASE WHEN n >= 55 THEN n - 54 END END::BIGINT AS count,
  CASE o_orderkey % 6 WHEN 2 THEN CASE WHEN n > 0 THEN n END WHEN 3 THEN CASE WHEN n >= 55 THEN 55 END END::BIGINT AS start_index,
  CASE o_orderkey % 6 WHEN 2 THEN CASE WHEN n > 0 THEN n + 20 END WHEN 3 THEN CASE WHEN n >= 55 THEN n END END::BIGINT AS end_index
  FROM x""")  # fmt: skip
def q_expected_input(spark, sf_dir):
    n, k = (F.col("o_custkey") % 90).cast("string"), F.col("o_orderkey") % 6
    t = F.when(k == 0, "").when(k == 1, n).when(
        k == 2, F.concat(n, F.lit(" - "), (F.col("o_custkey") % 90 + 20).cast("string"))
    ).when(k == 3, F.concat(F.lit("55~"), n)).when(k == 4, "abc").otherwise("1-2-3")
    x = table(spark, sf_dir, "orders").select("o_orderkey", t.alias("t")).withColumn("e", ranges.expected_input("t"))
    return x.select("o_orderkey", "e.kind", *(F.col(f"e.{c}").cast("long").alias(c) for c in ("count", "start_index", "end_index")))


@query("range_resolution", f"""WITH {LINES}, f AS (SELECT DISTINCT source_file FROM lines)
SELECT source_file, CASE WHEN source_file % 3 = 0 THEN 'given' WHEN source_file % 3 = 1 THEN 'hint' WHEN source_file % 2 = 0 THEN 'inferred'
  ELSE 'none' END AS origin,
  CASE WHEN source_file % 3 = 0 THEN 1 WHEN source_file % 3 = 1 THEN 2 WHEN source_file % 2 = 0 THEN 3 END::INTEGER AS start_index FROM f""")
def q_range_resolution(spark, sf_dir):
    files = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source_file"))
    some = lambda n, by: files.distinct().where(by).select(
        "source_file", F.lit(n).alias("start_index"), F.lit(n + 9).alias("end_index")
    )
    r = ranges.resolved(files, some(1, "source_file % 3 = 0"), some(2, "source_file % 3 <> 2"), some(3, "source_file % 2 = 0"))
    return r.select("source_file", "origin", F.col("range.start_index").alias("start_index"))


# ---- answer keys, import and grading -----------------------------------------------------

KEYS = """pieces AS (SELECT o_custkey, o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN (o_orderkey % 30) || ':3| 4'
  WHEN 1 THEN (o_orderkey % 30) || ':' WHEN 2 THEN 'x:3' WHEN 3 THEN '7' ELSE (o_orderkey % 30) || ': abc ' END AS t FROM orders),
keys AS (SELECT o_custkey AS key_id, CASE WHEN o_custkey % 2 = 0 THEN string_agg(t, ';' ORDER BY o_orderkey)
  ELSE string_agg(t, ',' ORDER BY o_orderkey) END AS k FROM pieces GROUP BY o_custkey),
toks AS (SELECT key_id, i AS "at", trim(t[i]) AS token, contains(k, ':') AS maps FROM (SELECT *, regexp_split_to_array(k, '[,;\\n]') AS t
  FROM keys), unnest(generate_series(1, len(t))) AS u(i)),
parsed AS (SELECT *, contains(token, ':') AS has, TRY_CAST(CASE
  WHEN regexp_matches(split_part(token, ':', 1), '^[+-]?[0-9]+$') THEN split_part(token, ':', 1) END AS INTEGER) AS number,
  list_filter(list_transform(string_split(CASE WHEN maps THEN substr(token, instr(token, ':') + 1)
    ELSE token END, '|'), lambda a: trim(a)), lambda a: a <> '') AS answers FROM toks),
good AS (SELECT key_id, "at", token, maps, CASE WHEN maps THEN number ELSE "at" END AS index, answers FROM parsed WHERE NOT maps OR (has
  AND number > 0))"""


def order_keys(spark, sf_dir) -> DataFrame:
    n, k = (F.col("o_orderkey") % 30).cast("string"), F.col("o_orderkey") % 5
    t = F.when(
        k == 0, F.concat(n, F.lit(":3| 4"))
    ).when(k == 1, F.concat(n, F.lit(":"))).when(k == 2, "x:3").when(k == 3, "7").otherwise(F.concat(n, F.lit(": abc ")))
    sep = F.when(F.col("key_id") % 2 == 0, ";").otherwise(",")
    orders = scans.dealt(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "key_id"), "key_id")
    x = orders.select("key_id", "o_orderkey", t.alias("t")).groupBy("key_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "t"))), lambda r: r["t"]).alias("ts")
    )
    return x.select(
        "key_id", F.array_join("ts", ";").alias("a"), F.array_join("ts", ",").alias("b"), sep.alias("sep")
    ).select("key_id", F.when(F.col("sep") == ";", F.col("a")).otherwise(F.col("b")).alias("key_text"))


@query("answer_key_parse", f"""WITH {KEYS}, last AS (SELECT *, row_number() OVER (PARTITION BY key_id, index ORDER BY "at" DESC) AS rn FROM good)
SELECT key_id, index::INTEGER AS index, array_to_string(answers, '|') AS answers, CASE
  WHEN len(list_filter(answers, lambda a: NOT regexp_matches(a, '^[+-]?[0-9]+$'))) = 0 THEN 'MC' ELSE 'SUBJ' END AS type FROM last
  WHERE rn = 1""")  # fmt: skip
def q_answer_key_parse(spark, sf_dir):
    return answers.answer_map(order_keys(spark, sf_dir)).select("key_id", "index", F.array_join("answers", "|").alias("answers"), "type")


@query("answer_key_errors", f"""WITH {KEYS}
SELECT key_id, "at" - 1 AS "at", token, CASE WHEN NOT has THEN 'format' WHEN coalesce(number, 0) <= 0 THEN 'number'
  ELSE 'answer' END AS error FROM parsed WHERE maps AND token <> '' AND (NOT has OR coalesce(number, 0) <= 0 OR len(answers) = 0)
UNION ALL SELECT key_id, "at" - 1, token, 'duplicate' FROM (SELECT *, row_number() OVER (PARTITION BY key_id, index ORDER BY "at") AS n
  FROM good) WHERE n > 1""")  # fmt: skip
def q_answer_key_errors(spark, sf_dir):
    return answers.key_errors(order_keys(spark, sf_dir)).select("key_id", F.col("at").cast("long").alias("at"), "token", "error")


@query("candidate_answer_join", """WITH c AS (SELECT * FROM (SELECT 2 * p_size AS index, p_partkey AS pos, p_name AS header,
  row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS rn FROM part) WHERE rn = 1),
a AS (SELECT *
  FROM (SELECT l_linenumber * 7 AS index, l_orderkey AS ok, l_partkey AS pk, l_quantity::INTEGER % 4 AS size,
  row_number() OVER (PARTITION BY l_linenumber ORDER BY l_quantity::INTEGER % 4 DESC, l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS rn
  FROM lineitem) WHERE rn = 1)
SELECT coalesce(c.index, a.index) AS index, c.pos AS pos, c.header AS header, c.index IS NOT NULL AS has_candidate,
  coalesce(a.size, 0) AS n_answers FROM c FULL JOIN a ON c.index = a.index""")  # fmt: skip
def q_candidate_answer_join(spark, sf_dir):
    c = table(spark, sf_dir, "part").select((2 * F.col("p_size")).alias("index"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("header"))
    a = table(spark, sf_dir, "lineitem").select(
        (F.col("l_linenumber") * 7).alias("index"),
        F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").alias("pos"),
        F.array_repeat(F.lit("1"), F.round("l_quantity").cast("int") % 4).alias("answers")
    )
    return importer.joined(c, a).select("index", "pos", "header", "has_candidate", F.size("answers").alias("n_answers"))


@query("count_status", """WITH p AS (SELECT l_suppkey AS source_file, count(*) AS parsed FROM lineitem WHERE l_returnflag = 'R'
  GROUP BY ALL), d AS (SELECT l_suppkey AS source_file, count(*) AS detected FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL)
SELECT coalesce(p.source_file, d.source_file) AS source_file, coalesce(parsed, 0) AS parsed, coalesce(detected, 0) AS detected,
  CASE WHEN coalesce(parsed, 0) = coalesce(detected, 0) THEN 'equal' WHEN coalesce(parsed, 0) > coalesce(detected, 0) THEN 'more_answers'
  ELSE 'more_questions' END AS status FROM p FULL JOIN d ON p.source_file = d.source_file""")  # fmt: skip
def q_count_status(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "source_file")  # noqa: E741
    return diagnostics.count_status(l.where("l_returnflag = 'R'"), l.where("l_returnflag = 'A'"))


QUESTIONS = """questions AS (SELECT p_partkey::VARCHAR AS id, p_brand AS category_id, p_type AS source_file, p_size AS index, CASE
  WHEN p_size % 2 = 0 THEN 'MC' ELSE 'SUBJ' END AS type,
  CASE WHEN p_size % 7 = 0 THEN []::VARCHAR[] WHEN p_size % 2 = 0 THEN [(p_size % 5)::VARCHAR, (p_size % 5 + 1)::VARCHAR, 'n/a']
  ELSE [' ' || p_brand || ' '] END AS answers, p_name AS prompt FROM part)"""


def questions(spark, sf_dir) -> DataFrame:
    s = F.col("p_size")
    none = F.array().cast("array<string>")
    a = F.when(s % 7 == 0, none).when(
        s % 2 == 0, F.array((s % 5).cast("string"), (s % 5 + 1).cast("string"), F.lit("n/a"))
    ).otherwise(F.array(F.concat(F.lit(" "), F.col("p_brand"), F.lit(" "))))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("category_id"),
        F.col("p_type").alias("source_file"), s.alias("index"), F.when(s % 2 == 0, "MC").otherwise("SUBJ").alias("type"),
        a.alias("answers"), F.col("p_name").alias("prompt")
    )


ATTEMPTS = f"""{QUESTIONS}, graded AS (
  SELECT l_orderkey AS session_id, l_linenumber, l_partkey::VARCHAR AS question_id, q.type,
   
      CASE WHEN len(q.answers) = 0 THEN NULL
  WHEN q.type = 'MC' THEN list_contains(list_transform(list_filter(q.answers, lambda a: regexp_matches(a, '^[0-9]+$')), lambda a: a::INTEGER),
      CASE WHEN l_linenumber % 3 = 2 THEN NULL ELSE l_linenumber END) IS TRUE
      ELSE l_linenumber % 2 = 1 END AS is_correct FROM lineitem JOIN questions q ON q.id = l_partkey::VARCHAR)"""


def attempts(spark, sf_dir) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").join(  # noqa: E741
        table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size"), "l_partkey"
    )
    n = F.col("l_linenumber")
    number = F.when(
        n % 3 == 0, F.concat(F.lit(" +"), n.cast("string"), F.lit(" "))
    ).when(n % 3 == 1, F.concat(F.lit("0"), n.cast("string"))).otherwise(F.concat(n.cast("string"), F.lit(".0")))
    word = F.when(n % 2 == 1, F.concat(F.lit("\t"), F.lower("p_brand"))).otherwise(F.lit("other"))
    return l.select(
        F.col("l_orderkey").alias("session_id"), "l_linenumber", F.col("l_partkey").cast("string").alias("question_id"),
        F.when(F.col("p_size") % 2 == 0, number).otherwise(word).alias("user_answer")
    )


def graded(spark, sf_dir):
    return grading.graded(attempts(spark, sf_dir), questions(spark, sf_dir))


@query(
    "grade_mc",
    f"WITH {ATTEMPTS} SELECT question_id, count(*) AS n, count(*) FILTER (WHERE is_correct) AS correct, count_if(is_correct IS NULL)::BIGINT AS ungraded FROM graded WHERE type = 'MC' GROUP BY ALL"
)
def q_grade_mc(spark, sf_dir):
    return graded(spark, sf_dir).where("type = 'MC'").groupBy("question_id").agg(
        F.count("*").alias("n"), F.count_if("is_correct").alias("correct"),
        F.count_if(F.col("is_correct").isNull()).alias("ungraded")
    )


@query(
    "grade_subjective",
    f"WITH {ATTEMPTS} SELECT question_id, count(*) AS n, count(*) FILTER (WHERE is_correct) AS correct, count_if(is_correct IS NULL)::BIGINT AS ungraded FROM graded WHERE type = 'SUBJ' GROUP BY ALL"
)
def q_grade_subjective(spark, sf_dir):
    return graded(spark, sf_dir).where("type = 'SUBJ'").groupBy("question_id").agg(
        F.count("*").alias("n"), F.count_if("is_correct").alias("correct"),
        F.count_if(F.col("is_correct").isNull()).alias("ungraded")
    )


@query(
    "session_score",
    f"WITH {ATTEMPTS} SELECT session_id, count(*) FILTER (WHERE is_correct) AS correct, count(*) AS total FROM graded GROUP BY session_id"
)
def q_session_score(spark, sf_dir):
    return grading.session_scores(graded(spark, sf_dir))


WRONG = """wrong AS (SELECT user_id::VARCHAR AS question_id FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id
  HAVING arg_max(event_type, (ts, event_id)) = 'error')"""  # fmt: skip


def grades(events: DataFrame) -> DataFrame:
    ok = F.when(F.col("event_type") == "purchase", True).when(F.col("event_type") == "error", False)
    return events.select(F.col("user_id").cast("string").alias("question_id"), "ts", F.col("event_id").alias("seq"), ok.alias("is_correct"))


def wrong_ids(spark, sf_dir) -> DataFrame:
    return grading.wrong_set(grades(table(spark, sf_dir, "events")))


@query("wrong_set", f"WITH {WRONG} SELECT question_id FROM wrong")
def q_wrong_set(spark, sf_dir):
    return wrong_ids(spark, sf_dir)


@query("wrong_stream", f"WITH {WRONG} SELECT question_id FROM wrong")
def q_wrong_stream(spark, sf_dir):
    """The events as a stream through the state of each question into a stored wrong set, which is read after all of them."""
    path = f"{sf_dir}/events.parquet"
    # as a pattern, since the table may be one file, which a stream takes for a folder
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[t]")
    at = f"{shared_folder(spark)}/wrong-stream-{uuid.uuid4().hex}"
    streamed.follow(grades(stream), f"{at}/marks", f"{at}/checkpoint", availableNow=True).awaitTermination()
    return streamed.stored_marks(spark, f"{at}/marks")


@query("wrong_notes", f"WITH {WRONG}, {QUESTIONS} SELECT id, source_file, index FROM questions WHERE id IN (SELECT question_id FROM wrong)")
def q_wrong_notes(spark, sf_dir):
    return catalogue.wrong_notes(questions(spark, sf_dir), wrong_ids(spark, sf_dir)).select("id", "source_file", "index")


@query(
    "wrong_only",
    f"WITH {WRONG}, {QUESTIONS} SELECT id FROM questions WHERE lower(category_id) = 'brand#11' AND id IN (SELECT question_id FROM wrong)"
)
def q_wrong_only(spark, sf_dir):
    mine = questions(spark, sf_dir).where(T.same_text("category_id", F.lit("BRAND#11")))
    return catalogue.wrong_notes(mine, wrong_ids(spark, sf_dir)).select("id")


@query("file_summary", "SELECT p_type AS source_file, count(*) AS questions FROM part GROUP BY p_type")
def q_file_summary(spark, sf_dir):
    return catalogue.file_summary(questions(spark, sf_dir))


@query(
    "unanswered_filter",
    f"WITH {QUESTIONS} SELECT category_id, count(*) AS questions, count_if(len(list_filter(answers, lambda a: trim(a) <> '')) > 0)::BIGINT AS answered FROM questions GROUP BY ALL"
)
def q_unanswered_filter(spark, sf_dir):
    return questions(spark, sf_dir).groupBy("category_id").agg(F.count("*").alias("questions"), F.count_if(grading.has_answer()).alias("answered"))


@query("practice_sample", f"WITH {QUESTIONS} SELECT id, index FROM questions WHERE len(answers) > 0 ORDER BY md5(id || '|17'), id LIMIT 20")
def q_practice_sample(spark, sf_dir):
    return practice.sample(questions(spark, sf_dir), 20, 17, answered_only=True).select("id", "index")


@query("category_samples", f"""WITH {QUESTIONS} SELECT id, category_id, index FROM questions WHERE len(answers) > 0
QUALIFY row_number() OVER (PARTITION BY category_id ORDER BY md5(id || '|5'), id) <= 7""")
def q_category_samples(spark, sf_dir):
    return practice.samples(questions(spark, sf_dir), 7, 5, answered_only=True).select("id", "category_id", "index")


@query(
    "neighbours",
    """SELECT conv_id, turn, lag(turn) OVER w AS previous, lead(turn) OVER w AS following, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS "of" FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""
)
def q_neighbours(spark, sf_dir):
    x = catalogue.neighbours(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "turn")
    return x.select("conv_id", "turn", "previous", "following", F.col("place").cast("long").alias("place"), "of")


@query("cascade_delete", f"""WITH {WRONG}, {QUESTIONS}, kept AS (SELECT * FROM questions WHERE lower(category_id) <> 'brand#12'
  AND NOT (lower(category_id) = 'brand#11' AND lower(source_file) = lower((SELECT min(p_type) FROM part))))
SELECT 'question' AS kind, id FROM kept UNION ALL SELECT 'wrong', question_id FROM wrong WHERE question_id IN (SELECT id FROM kept)""")  # fmt: skip
def q_cascade_delete(spark, sf_dir):
    q = questions(spark, sf_dir)
    file = q.agg(F.min("source_file")).first()[0]
    kept = catalogue.without_file(catalogue.without_category(q, "Brand#12"), "BRAND#11", (file or "").upper())
    wrong = catalogue.kept_wrong(wrong_ids(spark, sf_dir), kept)
    return kept.select(F.lit("question").alias("kind"), "id").unionByName(
        wrong.select(F.lit("wrong").alias("kind"), F.col("question_id").alias("id"))
    )


@query("get_or_insert_category", """WITH stored AS (SELECT DISTINCT md5(lower(p_brand)) AS id, p_brand AS name FROM part WHERE p_size > 25),
asked AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN upper(p_brand) ELSE p_brand END AS name, p_partkey FROM part
  UNION ALL SELECT 'New ' || n_name, 1000000 + n_nationkey FROM nation),
f AS (SELECT lower(name) AS k, arg_min(name, p_partkey) AS name FROM asked GROUP BY 1)
SELECT id, name FROM stored UNION ALL SELECT md5(k), name FROM f WHERE k NOT IN (SELECT lower(name) FROM stored)""")  # fmt: skip
def q_get_or_insert_category(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    stored = p.where("p_size > 25").select(F.md5(F.lower("p_brand")).alias("id"), F.col("p_brand").alias("name")).distinct()
    asked = p.select(
        F.concat(F.lit("\t"), F.when(F.col("p_partkey") % 3 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")), F.lit(" ")).alias("name"),
        F.col("p_partkey").alias("pos")
    )
    more = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("New "), "n_name").alias("name"), (F.lit(1000000) + F.col("n_nationkey")).cast("long").alias("pos")
    )
    return catalogue.categories_with(stored, asked.unionByName(more))


STORE = f"""{QUESTIONS}, stored AS (SELECT *,
  row_number() OVER (PARTITION BY category_id, lower(source_file), index ORDER BY id) AS n, id || '.png' AS image_path FROM questions),
incoming AS (SELECT id, category_id, source_file, index + 10 AS index, type, answers, 'new ' || prompt AS prompt, id::BIGINT AS pos, CASE
  WHEN id::BIGINT % 3 = 0 THEN 'p' || id END AS image_path FROM questions)"""


def stored_and_incoming(spark, sf_dir):
    """All parts as stored questions, and all of them again with other numbers: some match stored ones, the rest are new."""
    q = questions(spark, sf_dir)
    n = F.col("id").cast("long")
    stored = q.withColumn("image_path", F.concat("id", F.lit(".png")))
    changed = {
        "index": F.col("index") + 10, "prompt": F.concat(F.lit("new "), "prompt"), "pos": n,
        "source_file": F.upper("source_file"), "image_path": F.when(n % 3 == 0, F.concat(F.lit("p"), "id"))
    }
    return stored, q.withColumns(changed)


@query("upsert_merge", f"""WITH {STORE}, last AS (SELECT * FROM (SELECT *,
  row_number() OVER (PARTITION BY category_id, lower(source_file), index ORDER BY pos DESC) AS r FROM incoming) WHERE r = 1)
SELECT CASE WHEN s.id IS NULL THEN 'new'
  ELSE s.id END AS id, coalesce(s.category_id, i.category_id) AS category_id, lower(coalesce(s.source_file, i.source_file)) AS file,
  coalesce(s.index, i.index) AS index,
  CASE WHEN i.id IS NULL THEN s.type WHEN s.id IS NULL THEN i.type WHEN len(i.answers) > 0 OR len(s.answers) = 0 THEN i.type ELSE s.type END AS type,
  coalesce(i.prompt, s.prompt) AS prompt, array_to_string(CASE WHEN i.id IS NULL THEN s.answers
    ELSE list_transform(i.answers, lambda a: trim(a)) END, '|') AS answers,
  CASE WHEN i.id IS NULL THEN s.image_path ELSE i.image_path END AS image_path, CASE WHEN i.image_path IS NULL THEN 0 ELSE 1 END AS segments
FROM stored s FULL JOIN last i ON s.category_id = i.category_id AND lower(s.source_file) = lower(i.source_file) AND s.index = i.index
  AND s.n = 1""")  # fmt: skip
def q_upsert_merge(spark, sf_dir):
    stored, incoming = stored_and_incoming(spark, sf_dir)
    x = importer.merged(stored, incoming)
    return x.select(
        F.when(F.length("id") == 64, "new").otherwise(F.col("id")).alias("id"), "category_id",
        F.lower("source_file").alias("file"), "index", "type", "prompt", F.array_join("answers", "|").alias("answers"),
        "image_path", F.size("image_segments").alias("segments")
    )


@query("upsert_overwrite", f"""WITH {STORE}, gone AS (SELECT DISTINCT category_id, lower(source_file) AS f FROM incoming)
SELECT id, category_id, lower(source_file) AS file, index, array_to_string(answers, '|') AS answers FROM stored
  WHERE (category_id, lower(source_file)) NOT IN (SELECT (category_id, f) FROM gone)
UNION ALL SELECT 'new', category_id, lower(source_file), index, array_to_string(list_transform(answers, lambda a: trim(a)), '|')
  FROM incoming""")  # fmt: skip
def q_upsert_overwrite(spark, sf_dir):
    stored, incoming = stored_and_incoming(spark, sf_dir)
    x = importer.overwritten(stored, incoming)
    return x.select(
        F.when(F.length("id") == 64, "new").otherwise(F.col("id")).alias("id"), "category_id",
        F.lower("source_file").alias("file"), "index", F.array_join("answers", "|").alias("answers")
    )


IMPORTED = f"""{QUESTIONS}, incoming AS (SELECT id, 'Brand#11' AS category_id, source_file, index + 10 AS index, id AS pos FROM questions),
gone AS (SELECT id FROM questions WHERE category_id = 'Brand#11' AND lower(source_file) IN (SELECT lower(source_file) FROM incoming)),
after AS (
  SELECT id, category_id, source_file, index FROM questions WHERE id NOT IN (SELECT id FROM gone)
  UNION ALL SELECT sha256(concat_ws('|', category_id, lower(source_file), index::VARCHAR, pos, 'second')), category_id, source_file, index FROM incoming)"""


def imported_again(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """All parts as stored questions, and all of them once more, imported into one category."""
    q = questions(spark, sf_dir)
    return q, q.withColumns({"category_id": F.lit("Brand#11"), "index": F.col("index") + 10, "pos": F.col("id").cast("long")})


@query("overwrite_ids", f"WITH {IMPORTED} SELECT id, category_id, lower(source_file) AS file, index FROM after")
def q_overwrite_ids(spark, sf_dir):
    stored, incoming = imported_again(spark, sf_dir)
    return importer.overwritten(stored, incoming, "second").select("id", "category_id", F.lower("source_file").alias("file"), "index")


@query("overwrite_removed", f"WITH {IMPORTED} SELECT id AS question_id FROM gone")
def q_overwrite_removed(spark, sf_dir):
    return importer.removed_ids(*imported_again(spark, sf_dir))


@query("overwrite_wrong", f"WITH {WRONG}, {IMPORTED} SELECT question_id FROM wrong WHERE question_id IN (SELECT id FROM after)")
def q_overwrite_wrong(spark, sf_dir):
    return catalogue.kept_wrong(wrong_ids(spark, sf_dir), importer.overwritten(*imported_again(spark, sf_dir), "second"))


# ---- layout ------------------------------------------------------------------------------

BOXES = """boxes AS (SELECT l_suppkey AS source_file, l_linenumber AS page_index,
  row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_extendedprice, l_shipdate) AS line_in_page,
  l_discount * 5 AS left_ratio, least(1.0, l_discount * 5 + 0.05 + l_tax * 5) AS right_ratio, l_quantity / 60 AS top_ratio, least(1.0, l_quantity / 60 + 0.03) AS bottom_ratio, l_partkey % 200 AS index, l_returnflag
  FROM lineitem)"""


def boxes(spark, sf_dir) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("source_file", "page_index").orderBy("l_orderkey", "l_partkey", "l_extendedprice", "l_shipdate"))
    d, t, q = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")
    l = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_suppkey": "source_file", "l_linenumber": "page_index"})  # noqa: E741
    return scans.dealt(l, "source_file", "page_index").select(
        "source_file", "page_index", n.cast("long").alias("line_in_page"),
        (d * 5).alias("left_ratio"), F.least(F.lit(1.0), d * 5 + 0.05 + t * 5).alias("right_ratio"), (q / 60).alias("top_ratio"),
        F.least(F.lit(1.0), q / 60 + 0.03).alias("bottom_ratio"), (F.col("l_partkey") % 200).alias("index"), "l_returnflag"
    )


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(
    "bounding_box",
    f"WITH {BOXES} SELECT source_file, page_index, round(min(left_ratio), 6) AS left_ratio, round(min(top_ratio), 6) AS top_ratio, round(max(right_ratio), 6) AS right_ratio, round(max(bottom_ratio), 6) AS bottom_ratio FROM boxes GROUP BY ALL"
)
def q_bounding_box(spark, sf_dir):
    return rounded(layout.bounding_box(boxes(spark, sf_dir), "source_file", "page_index"), "left_ratio", "top_ratio", "right_ratio", "bottom_ratio")


@query("reading_order", f"""WITH {BOXES}, c AS (SELECT *, (left_ratio + right_ratio) / 2 <= 0.45 AS is_left,
  count_if((left_ratio + right_ratio) / 2 <= 0.45) OVER p >= 5 AND count_if((left_ratio + right_ratio) / 2 >= 0.55) OVER p >= 5 AS two
  FROM boxes WINDOW p AS (PARTITION BY source_file, page_index))
SELECT source_file, page_index, line_in_page, two AS two_columns, row_number() OVER (PARTITION BY source_file, page_index ORDER BY CASE
  WHEN two AND NOT is_left THEN 1 ELSE 0 END, top_ratio, CASE WHEN two THEN left_ratio ELSE 0 END, line_in_page) AS read_at
  FROM c""")  # fmt: skip
def q_reading_order(spark, sf_dir):
    return lines.reading_order(boxes(spark, sf_dir)).select(
        "source_file", "page_index", "line_in_page", "two_columns", F.col("read_at").cast("long").alias("read_at")
    )


def crop_sql(line: str, left: str, right: str) -> str:
    """Whether a line's box counts for the crop of an anchor from ``left`` to ``right``."""
    return f"""(greatest(0.0, {right} - {left}) >= 0.55 OR abs(({line}.left_ratio + {line}.right_ratio) / 2 - ({left} + {right}) / 2) <= 0.20
  OR least({line}.right_ratio, least(1.0, greatest(0.0, {right} + 0.08))) - greatest({line}.left_ratio, least(1.0, greatest(0.0, {left} - 0.08))) >= 0.12)"""


def same_sql(line: str, left: str, right: str) -> str:
    return f"({crop_sql(line, left, right)} OR (({left} + {right}) / 2 >= 0.55 AND {line}.left_ratio >= least(1.0, greatest(0.0, {left} - 0.08))))"


@query("column_match", f"""WITH {BOXES}, a AS (SELECT * FROM boxes WHERE line_in_page = 1)
SELECT b.source_file, b.page_index, count(*) AS n, count_if({same_sql('b', 'a.left_ratio', 'a.right_ratio')})::BIGINT AS same FROM boxes b
  JOIN a ON a.source_file = b.source_file AND a.page_index = b.page_index GROUP BY ALL""")  # fmt: skip
def q_column_match(spark, sf_dir):
    b = boxes(spark, sf_dir)
    a = b.where("line_in_page = 1").select("source_file", "page_index", F.col("left_ratio").alias("al"), F.col("right_ratio").alias("ar"))
    same = layout.same_column(F.col("left_ratio"), F.col("right_ratio"), F.col("al"), F.col("ar"))
    return b.join(a, ["source_file", "page_index"]).groupBy("source_file", "page_index").agg(F.count("*").alias("n"), F.count_if(same).alias("same"))


# A page is what a supplier delivers at one line number. Its R lines are headings, some of
# which span the next page or have a first line that doesn't exist; its A lines name the
# questions of a shared passage; some N lines are blank; some pages have no image.

PAGES = f"""{BOXES},
texts AS (SELECT *, CASE WHEN l_returnflag = 'R' AND index % 7 = 0 THEN 'end' WHEN l_returnflag = 'A'
  AND line_in_page % 3 = 0 THEN 'both' WHEN l_returnflag = 'A' AND line_in_page % 3 = 1 THEN 'start' END AS names,
  l_returnflag = 'N' AND line_in_page % 5 = 0 AS blank FROM boxes),
counts AS (SELECT source_file, page_index, count(*) AS n FROM boxes GROUP BY ALL),
pages AS (SELECT source_file, page_index FROM counts WHERE (source_file + page_index) % 13 <> 0),
cand AS (
  SELECT b.source_file, index, b.page_index AS start_page, CASE WHEN index % 5 = 0 THEN b.page_index + 1 ELSE b.page_index END AS end_page,
    CASE WHEN index % 11 = 0 THEN line_in_page + 100000
      ELSE line_in_page END AS start_line, line_in_page + index % 9 AS end_line, c.n AS start_count,
      CASE WHEN index % 5 = 0 THEN coalesce(e.n, 0) ELSE c.n END AS end_count
  FROM boxes b JOIN counts c ON b.source_file = c.source_file AND b.page_index = c.page_index
    LEFT JOIN counts e ON b.source_file = e.source_file AND b.page_index + 1 = e.page_index WHERE l_returnflag = 'R' AND index > 0),
lines_of AS (SELECT t.* FROM texts t JOIN pages p ON t.source_file = p.source_file AND t.page_index = p.page_index),
anchored AS (
  SELECT c.*, a.left_ratio AS al, a.right_ratio AS ar, a.top_ratio AS at FROM cand c LEFT JOIN lines_of a ON a.source_file = c.source_file
    AND a.page_index = start_page AND a.line_in_page = start_line),
placed AS (SELECT a.*, p.page_index FROM anchored a JOIN pages p ON a.source_file = p.source_file AND p.page_index BETWEEN start_page AND end_page),
heads AS (SELECT c.source_file, c.start_page, c.start_line, c.index, l.left_ratio, l.right_ratio, l.top_ratio FROM cand c
  JOIN lines_of l ON l.source_file = c.source_file AND l.page_index = start_page AND l.line_in_page = start_line),
tops AS (
  SELECT p.source_file, p.index, p.start_page, p.start_line, p.page_index,
    CASE WHEN count(h.top_ratio) > 0 THEN least(1.0, greatest(0.0, arg_min(h.top_ratio, (h.start_line, h.index)) - 0.015)) END AS next_top
  FROM placed p LEFT JOIN heads h ON h.source_file = p.source_file AND h.start_page = p.page_index AND h.index <> p.index
    AND (p.page_index <> p.start_page OR h.start_line > p.start_line) AND {same_sql("h", "p.al", "p.ar")}
  WHERE p.al IS NOT NULL GROUP BY ALL)"""


def placed_boxes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(candidates, pages) of layout's operators."""
    n, k = F.col("line_in_page"), F.col("index")
    b = boxes(spark, sf_dir).withColumn("line_in_page", n.cast("int"))
    head = F.when(
        k % 7 == 0, F.concat(k.cast("string"), F.lit(". 다음을 보고 답하라 ~ "), (k + 3).cast("string"))
    ).otherwise(F.concat(k.cast("string"), F.lit(". 다음 중")))
    both = F.concat(F.lit("["), (k + 1).cast("string"), F.lit(" ~ "), (k + 4).cast("string"), F.lit("] 다음 글을 보고 답하라"))
    mark = F.when(n % 3 == 0, both).when(n % 3 == 1, F.concat((k + 1).cast("string"), F.lit("- 다음 물음"))).otherwise("다음 설명")
    text = F.when(F.col("l_returnflag") == "R", head).when(F.col("l_returnflag") == "A", mark).when(n % 5 == 0, " \t").otherwise("plain")
    b = b.withColumn("text", text)
    counts = b.groupBy("source_file", "page_index").agg(F.count("*").cast("int").alias("n"))
    c = b.where("l_returnflag = 'R' AND index > 0").select(
        "source_file", k.cast("int").alias("index"), F.col("page_index").alias("start_page"), (
            F.col("page_index") + F.when(k % 5 == 0, 1).otherwise(0)
        ).alias("end_page"),
        (n + F.when(k % 11 == 0, 100000).otherwise(0)).alias("start_line"), (n + k % 9).cast("int").alias("end_line"),
    )
    of_start = counts.select("source_file", F.col("page_index").alias("start_page"), F.col("n").alias("start_page_line_count"))
    of_end = counts.select("source_file", F.col("page_index").alias("end_page"), F.col("n").alias("end_page_line_count"))
    c = c.join(of_start, ["source_file", "start_page"]).join(of_end, ["source_file", "end_page"], "left")
    image = F.when((F.col("source_file") + F.col("page_index")) % 13 != 0, "page.png")
    pages = counts.select("source_file", "page_index", image.alias("image_path"), F.lit(1000).alias("pixel_width"), F.lit(2000).alias("pixel_height"))
    return c, layout.with_lines(pages, b)


def placed_pages(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c, pages = placed_boxes(spark, sf_dir)
    # read once for the pages and once for what is asked of them
    c = settle(c, "layout-candidates")
    return c, layout.page_table(pages, c)


@query("next_header", f"WITH {PAGES} SELECT source_file, index, start_page, start_line, page_index, round(next_top, 6) AS next_top FROM tops")
def q_next_header(spark, sf_dir):
    return rounded(layout.next_heading_tops(*placed_pages(spark, sf_dir)), "next_top")


CONTEXTS = f"""{PAGES},
marks AS (SELECT *, index + 1 AS low, CASE names WHEN 'both' THEN index + 4 ELSE index + 3 END AS high FROM lines_of
  WHERE names IN ('both', 'start')),
firsts AS (SELECT m.source_file, m.page_index, m.line_in_page, min(c.start_line) AS question FROM marks m
  JOIN cand c ON c.source_file = m.source_file AND c.start_page = m.page_index AND c.index BETWEEN low AND high GROUP BY ALL),
named AS (
  SELECT a.source_file, a.index, a.start_page, a.start_line, max(m.line_in_page) AS line, arg_max(f.question, m.line_in_page) AS question
    FROM anchored a
  JOIN marks m ON m.source_file = a.source_file AND m.page_index = a.start_page AND m.line_in_page < a.start_line AND a.index BETWEEN m.low
    AND m.high AND {same_sql("m", "a.al", "a.ar")}
  JOIN firsts f ON f.source_file = m.source_file AND f.page_index = m.page_index AND f.line_in_page = m.line_in_page
    AND f.question > m.line_in_page GROUP BY ALL),
prior AS (
  SELECT a.source_file, a.index, a.start_page, a.start_line, max(h.start_line) AS line FROM anchored a
  JOIN heads h ON h.source_file = a.source_file AND h.start_page = a.start_page AND h.start_line < a.start_line AND h.index < a.index
    AND h.index % 7 = 0 AND a.index <= h.index + 3 AND {same_sql("h", "a.al", "a.ar")} GROUP BY ALL),
contexts AS (
  SELECT a.*, coalesce(n.line, p.line) AS context_line, CASE WHEN n.line IS NOT NULL THEN n.question ELSE a.start_line END AS question_line
    FROM anchored a
  LEFT JOIN named n ON n.source_file = a.source_file AND n.index = a.index AND n.start_page = a.start_page AND n.start_line = a.start_line
  LEFT JOIN prior p ON p.source_file = a.source_file AND p.index = a.index AND p.start_page = a.start_page AND p.start_line = a.start_line
  WHERE a.al IS NOT NULL AND coalesce(n.line, p.line) IS NOT NULL)"""


@query("as_of_context", f"WITH {CONTEXTS} SELECT source_file, index, start_page, start_line, context_line, question_line FROM contexts")
def q_as_of_context(spark, sf_dir):
    return layout.shared_contexts(*placed_pages(spark, sf_dir)).select(
        "source_file", "index", "start_page", "start_line", "context_line", "question_line"
    )


CLAMPED = "least(1.0, greatest(0.0, {}))"
#: A box of l, t, r, b to one of the least size.
SIZED = """round(l, 6) AS left_ratio, round(t, 6) AS top_ratio, round(CASE WHEN r - l >= 0.08 THEN r ELSE least(1.0, l + 0.08) END, 6) AS right_ratio,
  round(CASE WHEN b - t >= 0.02 THEN b ELSE least(1.0, t + 0.02) END, 6) AS bottom_ratio"""


def box_sql(narrow: str) -> str:
    """The padded box of grouped lines x, as wide as those that ``narrow`` holds for, or all."""
    low = lambda c: CLAMPED.format(f"{c} - 0.015")
    high = lambda c: CLAMPED.format(f"{c} + 0.015")
    left, right = f"coalesce(min(x.left_ratio) FILTER ({narrow}), min(x.left_ratio))", f"coalesce(max(x.right_ratio) FILTER ({narrow}), max(x.right_ratio))"
    return f"{low(left)} AS l, {low('min(x.top_ratio)')} AS t, {high(right)} AS r, {high('max(x.bottom_ratio)')} AS b"


@query("shared_segments", f"""WITH {CONTEXTS},
own AS (SELECT c.source_file, c.index, c.start_page, c.start_line, l.left_ratio, l.right_ratio, l.top_ratio, l.bottom_ratio, l.line_in_page
  FROM contexts c
  JOIN lines_of l ON l.source_file = c.source_file AND l.page_index = c.start_page AND l.line_in_page >= context_line
    AND l.line_in_page < question_line AND NOT blank AND {same_sql("l", "c.al", "c.ar")}),
x AS (SELECT *, first(left_ratio) OVER w AS fl, first(right_ratio) OVER w AS fr
  FROM own WINDOW w AS (PARTITION BY source_file, index, start_page, start_line ORDER BY line_in_page)),
g AS (SELECT source_file, index, start_page, start_line, {box_sql(crop_sql("x", "x.fl", "x.fr"))} FROM x GROUP BY ALL)
SELECT source_file, index, start_page, start_line, {SIZED} FROM g""")  # fmt: skip
def q_shared_segments(spark, sf_dir):
    x = layout.shared_segments(*placed_pages(spark, sf_dir)).select("source_file", "index", "start_page", "start_line", *RATIOS)
    return rounded(x, *RATIOS)


RATIOS = ("left_ratio", "top_ratio", "right_ratio", "bottom_ratio")


@query("question_segments", f"""WITH {PAGES},
k AS (SELECT p.*, t.next_top, CASE WHEN p.page_index = p.start_page THEN least(1.0, greatest(0.0, p.at - 0.015)) ELSE 0 END AS upper_limit,
    CASE WHEN p.page_index = p.start_page THEN (least(start_count, greatest(1, p.start_line)) - 1) / start_count ELSE 0 END AS by_top,
      CASE WHEN end_count > 0 THEN end_count ELSE start_count END AS last_count
  FROM placed p LEFT JOIN tops t ON t.source_file = p.source_file AND t.index = p.index AND t.start_page = p.start_page
    AND t.start_line = p.start_line AND t.page_index = p.page_index),
x AS (SELECT k.*, l.left_ratio, l.right_ratio, l.top_ratio, l.bottom_ratio, l.line_in_page FROM k LEFT
  JOIN lines_of l ON l.source_file = k.source_file AND l.page_index = k.page_index AND CASE WHEN al IS NOT NULL
    THEN NOT blank AND {same_sql("l", "k.al", "k.ar")} AND l.bottom_ratio >= upper_limit AND (next_top IS NULL OR l.top_ratio < next_top)
    ELSE l.line_in_page >= CASE WHEN k.page_index = start_page THEN start_line ELSE 1 END
      AND (k.page_index <> end_page OR l.line_in_page <= end_line) END),
g AS (SELECT source_file, index, start_page, start_line, page_index, end_page, end_line, by_top, last_count, al,
  count(line_in_page) AS n, {box_sql("x.al IS NULL OR " + crop_sql("x", "x.al", "x.ar"))}
  FROM x GROUP BY ALL),
e AS (SELECT *, CASE WHEN page_index = end_page THEN least(last_count, greatest(end_line, 1, ceil(by_top * last_count))) / last_count
  ELSE 1 END AS raw_bottom FROM g),
f AS (SELECT source_file, index, start_page, start_line, page_index, CASE WHEN n > 0 THEN l ELSE 0 END AS l, CASE WHEN n > 0 THEN t
  ELSE by_top END AS t, CASE WHEN n > 0 THEN r ELSE 1 END AS r,
    CASE WHEN n > 0 THEN b WHEN page_index = end_page AND raw_bottom - by_top < 0.02 THEN least(1.0, by_top + 0.02) ELSE raw_bottom END AS b
  FROM e WHERE n > 0 OR al IS NULL OR page_index = start_page)
SELECT source_file, index, start_page, start_line, page_index, {SIZED} FROM f""")  # fmt: skip
def q_question_segments(spark, sf_dir):
    x = layout.question_segments(*placed_pages(spark, sf_dir)).select("source_file", "index", "start_page", "start_line", "page_index", *RATIOS)
    return rounded(x, *RATIOS)


@query("segment_dedupe", f"""WITH {BOXES}, k AS (SELECT *,
  row_number() OVER (PARTITION BY source_file, page_index, printf('%.4f:%.4f', left_ratio, right_ratio) ORDER BY line_in_page) AS rn
  FROM boxes)
SELECT source_file, page_index, line_in_page FROM k WHERE rn = 1""")  # fmt: skip
def q_segment_dedupe(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("top_ratio", F.lit(0.0)).withColumn("bottom_ratio", F.lit(0.0))
    return layout.distinct_segments(b, "line_in_page").select("source_file", "page_index", "line_in_page")


VIEW_SIZES = "(VALUES ('phone', 320.0::DOUBLE, 260.0::DOUBLE), ('tablet', 560, 440), ('desktop', 760, 620)) AS v(device, w, h)"


@query("slice_view", f"""WITH {BOXES}, c AS (SELECT source_file, page_index, line_in_page, device, w, CASE WHEN page_index % 3 = 0 THEN h
  ELSE w * 2000 / 1000 END::DOUBLE AS tall, left_ratio AS l, top_ratio AS t, right_ratio AS r, bottom_ratio AS b FROM boxes, {VIEW_SIZES})
SELECT source_file, page_index, line_in_page, device, round(w, 4) AS content_width, round(tall, 4) AS content_height,
  round(greatest(w * 0.08, (CASE WHEN r <= l THEN least(1.0, l + 0.08)
  ELSE r END - l) * w), 4) AS visible_width,
  round(greatest(tall * 0.02, (CASE WHEN b <= t THEN least(1.0, t + 0.02) ELSE b END - t) * tall), 4) AS visible_height,
  round(0 - l * w, 4) AS shift_x, round(0 - t * tall, 4) AS shift_y FROM c""")  # fmt: skip
def q_slice_view(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumns({"pixel_width": F.when(F.col("page_index") % 3 == 0, 0).otherwise(1000), "pixel_height": F.lit(2000)})
    names = ("content_width", "content_height", "visible_width", "visible_height", "shift_x", "shift_y")
    every = None
    for device in layout.VIEWS:
        x = layout.slice_view(b, device).select("source_file", "page_index", "line_in_page", F.lit(device).alias("device"), *names)
        every = x if every is None else every.unionByName(x)
    return every.withColumns({c: F.round(c, 4) for c in names})


# ---- small operators of the catalogue and of practice --------------------------------------


@query("category_list", "SELECT DISTINCT p_brand AS id, lower(p_brand) AS name FROM part")
def q_category_list(spark, sf_dir):
    return catalogue.listed(table(spark, sf_dir, "part").select(F.col("p_brand").alias("id"), F.lower("p_brand").alias("name")).distinct())


@query(
    "review",
    f"WITH {QUESTIONS} SELECT id, index FROM questions WHERE category_id = 'Brand#11' AND lower(source_file) = (SELECT lower(min(p_type)) FROM part WHERE p_brand = 'Brand#11')"
)
def q_review(spark, sf_dir):
    q = questions(spark, sf_dir)
    file = q.where("category_id = 'Brand#11'").agg(F.min("source_file")).first()[0]
    return catalogue.review(q, "Brand#11", (file or "").upper()).select("id", "index")


@query(
    "random_questions",
    f"WITH {WRONG}, {QUESTIONS} SELECT id, index FROM questions WHERE category_id = 'Brand#11' AND id IN (SELECT question_id FROM wrong) ORDER BY md5(id || '|5'), id LIMIT 7"
)
def q_random_questions(spark, sf_dir):
    return practice.random_questions(questions(spark, sf_dir), "Brand#11", 7, 5, wrong_ids(spark, sf_dir)).select("id", "index")


@query(
    "wrong_practice",
    f"WITH {WRONG}, {QUESTIONS} SELECT row_number() OVER (ORDER BY md5(id || '|3'), id) AS place, id FROM questions WHERE id IN (SELECT question_id FROM wrong)"
)
def q_wrong_practice(spark, sf_dir):
    from pagequarry.sources.files import numbered

    x = practice.wrong_practice(questions(spark, sf_dir), wrong_ids(spark, sf_dir), 3)
    return numbered(x, "place", F.col("draw"), F.col("id")).select(F.col("place").cast("long").alias("place"), "id")


@query(
    "throughput",
    "SELECT event_id, round(CASE WHEN user_id % 7 > 0 THEN (user_id % 7) / greatest(1e-6, epoch_us(ts) / 1e6 - epoch_us((SELECT min(ts) FROM events)) / 1e6) ELSE 0 END, 6) AS pages_per_second FROM events"
)
def q_throughput(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    began = F.broadcast(e.agg(F.min("ts").alias("began")))
    x = lines.pages_per_second(F.col("user_id") % 7, F.col("began"), F.col("ts"))
    return e.crossJoin(began).select("event_id", F.round(x, 6).alias("pages_per_second"))


# ---- file names --------------------------------------------------------------------------


@query("file_listing", """WITH n AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Page-' || c_custkey || '.PDF'
  WHEN 1 THEN 'page-' || (c_custkey - 1) || '.pdf' ELSE 'notes.txt' END AS name FROM customer),
f AS (SELECT *, lower(name) AS k, row_number() OVER (PARTITION BY lower(name) ORDER BY c_custkey) AS rn FROM n WHERE lower(name) LIKE '%.pdf')
SELECT name, row_number() OVER (ORDER BY regexp_extract(k, '(\\d+)\\.pdf$', 1)::INTEGER, k) AS place FROM f WHERE rn = 1""")  # fmt: skip
def q_file_listing(spark, sf_dir):
    from pagequarry.sources.files import listing

    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("/in/Page-"), k.cast("string"), F.lit(".PDF"))).when(
        k % 3 == 1, F.concat(F.lit("/in/page-"), (k - 1).cast("string"), F.lit(".pdf"))
    ).otherwise("/in/notes.txt")
    found = listing(table(spark, sf_dir, "customer").select(name.alias("path"), k.alias("rank")))
    return found.select("name", F.col("place").cast("long").alias("place"))
