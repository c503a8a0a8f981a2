"""Operators 1, 2, 4 and 5, and the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagequarry.llm import common, decontaminate, packing, quality, registry, topk, warc
from pagequarry.llm.wordbpe import WordBpe

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


@pytest.fixture(scope="module")
def items(spark, rows):
    raw = [
        (1, " ".join(rows[2][1].split()[5:30])), (2, rows[4][1][:60]), (3, "Two--WORDS!"), (30, "one"), (4, None), (5, "..."),
        (None, rows[6][1]), (1, " ".join(rows[2][1].split()[5:30]))
    ]
    return raw, spark.createDataFrame(raw, "item_id long, text string").selectExpr("*", "'z' AS doc_id", "'y' AS id")


def test_decontamination(docs, rows, items, none, spark):
    raw, benchmark = items
    grams = defaultdict(set)
    for i, t in raw:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            grams[tuple(w[k : k + n])].add(i)
    want = Counter()
    for d, t, *_ in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                ids = grams.get(tuple(w[k : k + n]))
                if ids:
                    hit.update(range(k, k + n))
                    found |= ids
        listed = sorted(str(i) for i in found if i is not None)
        want[d, len(w), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)] += 1
    # broadcast whole, or as a bitmap alone and joined
    for limits in ((500_000, 1 << 26), (500_000, 10), (3, 1 << 26)):
        found = decontaminate.decontaminate(docs, benchmark, limits=limits).collect()
        assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found) == want
        texts = Counter((d, t) for d, t, *_ in rows)
        whole = Counter((r.doc_id, restored(r)) for r in found)
        assert {k: n for k, n in whole.items() if k[1] is not None and k not in texts} == {}
        kept = decontaminate.drop_contaminated(docs, benchmark, limits=limits)
        dirty = Counter(k for k, n in want.items() for _ in range(n) if k[-1])
        assert kept.columns == docs.columns and kept.count() == len(rows) - sum(dirty.values())
        assert Counter(
            (r.doc_id, r.text) for r in kept.collect()
        ) <= texts and kept.where("text IS NULL").count() == docs.where("text IS NULL").count()
        assert decontaminate.decontaminate(
            none, benchmark, limits=limits
        ).count() == 0 and decontaminate.drop_contaminated(none, benchmark, limits=limits).count() == 0
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate.decontaminate(docs, nothing).collect())
    assert decontaminate.drop_contaminated(docs, nothing).count() == len(rows)


def restored(row):
    """The text, if nothing was hit; else its clean text has the length that the spans leave."""
    if row.clean_text is None:
        return None
    if row.spans:
        assert all(s.start < s.end for s in row.spans) and sum(s.end - s.start for s in row.spans) > 0
        return None
    return row.clean_text


def test_windows_of_one_hash_are_told_apart_by_their_words(spark, monkeypatch):
    monkeypatch.setattr(common, "span_hashes", lambda data, starts, ends, lane=0: np.zeros(len(starts), np.uint64))
    grams = pa.table(
        {"gram": pa.array([b"a b", b"c d", b"cc d"], pa.binary()), "size": pa.array([2, 2, 2], pa.int32()), "items": [["1"], ["2", "3"], []]}
    )
    index = decontaminate.GramIndex.of(grams)
    found = [(n, sorted(i), spans, hit) for n, i, spans, hit in decontaminate.scan(index.hits, [b"x A b c D", b"cc-d", b"", b"c"])]
    assert found == [(5, ["1", "2", "3"], [(2, 9)], 4), (2, [], [(0, 4)], 2), (0, [], [], 0), (1, [], [], 0)]


def test_revisits(spark):
    h = {"content-type": "text/html", "date": "1", "content-length": "9"}
    rows = [
        (1, "http://www.A.com/x/?b=2&utm_source=q&a=1#f", 10, "response", '"e1"', None, h), (
            2, "https://a.com/x?a=1&b=2", 20, "revisit", 'W/"e1"', None, {"date": "2", "content-length": "0", "etag": "n"}
        ), (3, "a.com/x?a=1&b=2", 5, "revisit", '"e1"', None, None),
        (
            4, "http://a.com/x?a=1&b=2", 30, "response", '"e2"', "m2", None
        ), (5, "http://a.com/x?a=1&b=2", 30, "revisit", '"e1"', None, None), (6, "http://a.com/x?a=1&b=2", 31, "revisit", '"e1"', None, None), (7, "http://a.com/x?a=1&b=2", 32, "revisit", None, "m2", None),
        (8, "http://a.com/x?a=1&b=2", 33, "revisit", None, None, None), (9, None, 33, "revisit", None, None, None), (
            10, "http://a.com/x?a=1&b=2", None, "revisit", '"e1"', None, None
        ), (11, "http://b.com", 1, "request", None, None, None), (6, "http://a.com/x?a=1&b=2", 31, "revisit", '"e1"', None, None), (12, "http://a.com/x?a=1&b=2", 30, "response", '"e1"', None, {}),
    ]
    df = spark.createDataFrame(
        rows, "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>"
    ).selectExpr("*", "1 AS span", "2 AS r", "3 AS url_key")
    for span_rows, spans in ((1, 2), (2, 5), (4096, 256)):
        found = warc.resolve_revisits(df, span_rows, spans).collect()
        got = Counter((r.record_id, r.response_id, r.status) for r in found)
        assert got == Counter(
            {
                (2, 1, "resolved"): 1, (3, None, "no_earlier_response"): 1, (5, 1, "resolved"): 1, (6, 12, "resolved"): 2,
                (7, 12, "no_validator"): 1, (8, 12, "no_validator"): 1, (9, None, "no_earlier_response"): 1,
                (10, None, "no_earlier_response"): 1
            }
        )
        assert next(r.headers for r in found if r.record_id == 2) == {"content-type": "text/html", "date": "2", "content-length": "9", "etag": "n"}
    assert warc.resolve_revisits(df.where("false")).count() == 0


def test_revisits_of_a_hot_url_whose_captures_cluster(spark):
    """One capture lies far from all others, half of them share a few moments, and the hot URL is cut where its own captures are."""
    rng = random.Random(14)
    rows = [(0, "http://hot.org/", -(10**15), "response", "0", None, None)]
    for i in range(1, 700):
        ts = rng.choice([5, 6, 7]) if rng.random() < 0.5 else rng.randrange(1000)
        rows.append(
            (
                i, "http://hot.org/" if i % 4 else f"http://cold.org/{i % 12}", ts,
                rng.choice(["response", "revisit", "revisit"]), str(rng.randrange(3)), None, None
            )
        )
    want = {}
    for r in rows:
        if r[3] == "revisit":
            earlier = [(o[2], o[0], o[4]) for o in rows if o[3] == "response" and o[1] == r[1] and o[2] < r[2]]
            last = max(earlier, default=None)
            want[r[0]] = (None, "no_earlier_response") if last is None else (last[1], "resolved" if last[2] == r[4] else "validator_mismatch")
    df = spark.createDataFrame(
        rows, "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>"
    ).repartition(4)
    for span_rows, spans in ((30, 20), (4096, 256)):
        assert {r.record_id: (r.response_id, r.status) for r in warc.resolve_revisits(df, span_rows, spans).collect()} == want
    usable = df.select(warc.canonical_url(F.col("url")).alias("url_key"), "ts")
    cuts = {r.url_key: r.cuts for r in warc.span_cuts(usable, warc.crowded_urls(usable, 100), 20).collect()}
    assert set(cuts) == {"hot.org"} and len(cuts["hot.org"]) > 8 and min(cuts["hot.org"]) >= 0


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_top_k(spark, scale):
    rng = random.Random(8)
    rows = [(i, [rng.choice([0.0, 0.5, -0.25, 0.1]) * scale for _ in range(4)]) for i in range(300)]
    rows += [
        (400, None), (500, [1.0, None, 0.0, 0.0]), (600, [float("nan")] * 4), (700, [1.0, 2.0]), (None, [1.0] * 4),
        (3, rows[3][1]), (800, [float("inf"), 0.0, 0.0, 0.0])
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS v", "1 AS query").repartition(3)
    good = [
        (i, [int(np.floor(1024 * x)) for x in v]) for i,
        v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    want = set()
    for q, a in {i: v for i, v in good if i % 100 == 0}.items():
        scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q and len(b) == len(a))
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:10])}
    for block in (1 << 20, 5):
        got = topk.top_k(df.where("vec_id % 100 = 0"), df, block_values=block).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert topk.top_k(df.where("false"), df).count() == 0 and topk.top_k(df.where("vec_id = 0"), df.where("false")).count() == 0


def test_top_k_of_values_beyond_longs(spark):
    rng = random.Random(5)
    long = lambda x: max(-(2**63), min(2**63 - 1, x))
    values = [1e300, -1e300, 1e17, -1e17, 1e9, 0.5, -3.0, 0.0, 1.7e308, 9e15]
    rows = [(i, [rng.choice(values) for _ in range(3)]) for i in range(230)] + [(i, [rng.choice(values), 1.0]) for i in range(300, 330)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    scaled = [float("inf") if 1024 * x == float("inf") else 1024 * x for _, v in rows for x in v]
    assert float("inf") in scaled
    whole = {i: [long(int(np.floor(x * 1024.0)) if np.isfinite(x * 1024.0) else (2**64 if x > 0 else -(2**64))) for x in v] for i, v in rows}
    want = set()
    for q in whole:
        if q % 100 == 0:
            scores = sorted(
                (-long(sum(x * y for x, y in zip(whole[q], b, strict=True))), i) for i,
                b in whole.items() if i != q and len(b) == len(whole[q])
            )
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:10])}
    for block in (1 << 20, 3):
        assert {tuple(r) for r in topk.top_k(df.where("vec_id % 100 = 0"), df, block_values=block).collect()} == want


@pytest.fixture(scope="module")
def bpe():
    with open(packing.tokenizer_path(), encoding="utf-8") as file:
        return WordBpe(file.read())


def test_tokenizer_equals_the_library(bpe, rows):
    odd = [
        "don't STOP's <|endoftext|>hello <b>x</b> naïve ÀÉÎÕÜ ß× ÷ 12345 a1b2 中文 한국어 nb sp\x0bvt é İstanbul", "", " ", "a" * 100,
        "é" * 30, "'s 'S can't", "x\x00y", "½ ² ª º µ", " a　b"
    ]
    texts = [t or "" for _, t, *_ in rows][:40] + odd
    ids, at = bpe.encode([t.encode() for t in texts])
    for i, e in enumerate(bpe.library.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == e.ids


def test_words_of_one_hash_keep_their_own_ids(bpe, monkeypatch):
    texts = ["alpha beta gamma alpha", "gamma delta", "alpha\nbeta " + "y" * 90 + " " + "z" * 90 + " " + "y" * 90]
    want = [e.ids for e in bpe.library.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(common, "span_hashes", lambda data, starts, ends, lane=0: np.zeros(len(starts), np.uint64))
    ids, at = bpe.encode([t.encode() for t in texts])
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == want


def test_packing(docs, rows, bpe, none):
    found = packing.pack_documents(docs, packing.tokenizer_path(), group=64, with_ids=True).collect()
    want = Counter()
    for (d, *_), e in zip(rows, bpe.library.encode_batch([t or "" for _, t, *_ in rows], add_special_tokens=False), strict=True):
        want[d, tuple([*e.ids, 1])] += 1
    by_text = defaultdict(list)
    sequences = defaultdict(list)
    for r in found:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_text[r.doc_id].append((r.start, tuple(r.ids), r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert Counter(i for v in by_text.values() for _, x, _ in v for i in x) == Counter(i for (_, x), n in want.items() for i in x * n)
    single = {d for d, *_ in rows if sum(d == e for e, *_ in rows) == 1}
    for d in single:
        assert (d, tuple(i for _, x, _ in sorted(by_text[d]) for i in x)) in want
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(none, packing.tokenizer_path()).count() == 0


def test_differencing_evens_windows_out():
    rng = random.Random(1)
    sizes = [rng.randrange(20, 512) for _ in range(600)]
    found = packing.windows(sizes, 2048)
    assert sorted(i for w in found for i in w) == list(range(600))
    sums = [sum(sizes[i] for i in w) for w in found]
    assert max(sums) <= 2048 and len(found) <= -(-sum(sizes) // 2048) + 2 and min(sums) > 1900
    assert packing.windows([2048, 2048, 1], 2048) and packing.windows([], 2048) == []
    assert sorted(map(len, packing.differencing([8, 7, 6, 5, 4], 2))) == [2, 3]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = registry.QUERIES[name](spark, SF)
    want = con.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert Counter(tuple(r) for r in got.select(names).collect()) == Counter(want.fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.settle(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, SF).count() == pieces.count()


def plain_statistics(text):
    raw = (text or "").encode()
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    own = [w for w in re.split(rb"[\x20\x09-\x0d]+", low) if w]
    n, size = max(1, len(own)), max(1, len(raw))
    pairs = list(zip(own, own[1:], strict=False))
    count = {k: sum(int(mask[b]) for b in raw) for k, mask in quality.BYTE_SHARES.items()}
    return [
        np.log1p(len(raw)), np.log1p(len(own)), sum(map(len, own)) / n, np.log1p(count["lines"]), len(set(own)) / n, len(set(pairs)) / max(1, len(own) - 1),
        sum(a == b for a, b in pairs) / n, max(Counter(own).values(), default=0) / n, sum(len(w) == 1 for w in own) / n,
        *(count[k] / size for k in quality.BYTE_SHARES), *(count[k] / n for k in ("stops", "shouts", "bars", "signs", "upper")),
    ]


def test_every_stage_is_its_brute_force(spark):
    """Each stage's rows and texts on its own input; that of near copies has a test of its own."""
    stages = dict(corpus_pipeline.STAGES)
    texts_of = lambda df: sorted((r.doc_id, r.text or "") for r in df.collect())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = texts_of(docs)
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    x = np.array([plain_statistics(t) for _, t in rows])
    assert np.allclose(x, quality.statistics([t.encode() for _, t in rows]))
    score = [
        1 / (
            1 + math.exp(
                -model.intercept - sum(w for w, r in model.rules if all((a is None or v[f] > a) and (b is None or v[f] <= b) for f, a, b in r.terms))
            )
        ) for v in x
    ]
    good = corpus_pipeline.settle(stages["quality"](spark, docs, SF), "test")
    assert texts_of(good) == [r for r, s in zip(rows, score, strict=True) if s >= quality.THRESHOLD]
    firsts = corpus_pipeline.settle(stages["near_duplicates"](spark, good, SF), "test")
    rows, first = texts_of(firsts), {}
    for d, t in rows:
        for i in range(len(t.encode()) - 49):
            first.setdefault(t.encode()[i : i + 50], d)
    want = []
    for d, t in rows:
        raw = t.encode()
        gone = np.zeros(len(raw), dtype=bool)
        for i in range(len(raw) - 49):
            if first[raw[i : i + 50]] < d:
                gone[i : i + 50] = True
        # a character that is cut in two stays whole
        kept, at = [], 0
        for c in t:
            width = len(c.encode())
            if not gone[at : at + width].all():
                kept.append(c)
            at += width
        if not gone.any() or "".join(kept).strip(" "):
            want.append((d, "".join(kept)))
    single = corpus_pipeline.settle(stages["repeated_bytes"](spark, firsts, SF), "test")
    assert texts_of(single) == want and want != rows
    grams = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        grams |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))}
    clean = corpus_pipeline.settle(stages["benchmark"](spark, single, SF), "test")
    hit = lambda w: any(tuple(w[i : i + n]) in grams for n in {len(g) for g in grams} for i in range(len(w) - n + 1))
    assert texts_of(clean) == [(d, t) for d, t in want if not hit(words(t))]
    with open(packing.tokenizer_path(), encoding="utf-8") as file:
        library = WordBpe(file.read()).library
    sizes = {d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in texts_of(clean)}
    pieces = stages["packing"](spark, clean, SF).collect()
    assert {r.doc_id: r.doc_tokens for r in pieces} == sizes
    assert Counter(i for r in pieces for i in [r.doc_id] * r.length) == Counter(sizes)


def test_pipeline_keeps_the_first_of_near_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    sets = []
    for _, t in rows:
        w = ["".join(c.lower() if c.isascii() else c for c in x) for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((group[i], group[j]))
                group = [a if x == b else x for x in group]
    want = [rows[i] for i in range(len(rows)) if group[i] == i]
    assert len({d for d, _ in rows}) == len(rows) > len(want)
    kept = corpus_pipeline.first_copies(spark, docs, SF)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == want
