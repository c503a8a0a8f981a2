"""Operators 11, 12 and 13 against brute force on small tables with every edge case."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.llm import licenses, negatives, periodic
from pagequarry.llm.licenses import Template

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_words(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def scanned(rows, phrases, notices, step):
    """The definition: every block against every template."""
    for doc_id, text in rows:
        w = ascii_words(text)
        places, base, labels, score = [], set(), set(), 0.0
        for at in range(0, len(w), step):
            block = w[at : at + 2 * step]
            for t in [*phrases, *notices]:
                wanted = set(ascii_words(t.text))
                share = len(wanted & set(block)) / len(wanted)
                if share < t.share - 1e-9:
                    continue
                if t.phrase:
                    p = ascii_words(t.text)
                    own = [at + i for i in range(step) if block[i : i + len(p)] == p]
                    if not own:
                        continue
                    places += own
                    base.add(t.label)
                labels.add(t.label)
                score = max(score, share)
        yield (
            doc_id, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), round(score, 9)
        )


def as_rows(found):
    return Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in found)


def license_rows():
    rng = random.Random(3)
    vocabulary = ["a", "b", "c", "d", "e", "f", "g", "é", "all", "rights", "reserved", "cc", "by", "the", "license", "public", "general"]
    rows = [(i, " ".join(rng.choice(vocabulary) + rng.choice(["", ".", ", ", "\n"]) for _ in range(rng.randrange(0, 120)))) for i in range(60)]
    grant = next(t.text for t in licenses.NOTICES if "hereby granted, free" in t.text)
    words = grant.split()
    rows += [
        (100, "x " * 63 + grant + " y" * 500), (101, " ".join(w for i, w in enumerate(words) if i % 4)), (102, "..." + grant + "..."),
        (103, "All Rights\nReserved. " * 400), (104, None), (105, ""), (106, " \n. "), (None, "cc-by"), (107, "CC BY"), (108, "ccby cc bye"),
        (109, "Released under the MKIT license"), (110, "released under the MIT License"), (110, "released under the MIT License"),
        (111, "'general public license'"), (111, "general public, license general public license"), (None, None)
    ]
    return rows + [(7, "all rights reserved cc by")] * 10


SMALL = [
    Template("few", "a b c d e", 0.6), Template("most", "a b c d e f g", 0.85), Template("one", "é", 1.0), Template("twice", "the the license", 0.5),
    Template("again", "reserved rights all", 1.0)
]


@pytest.mark.parametrize("step, notices, pass_words", [(64, licenses.NOTICES, 4096), (8, SMALL, 4096), (8, SMALL, 6), (16, [], 1)])
def test_license_scan(spark, step, notices, pass_words, monkeypatch):
    monkeypatch.setattr(licenses, "COPIES", 4)
    rows = license_rows()
    made = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, label string, first string, words string")
    found = licenses.scan(made.repartition(3), notices=notices, step=step, pass_words=pass_words)
    assert as_rows(found.collect()) == Counter(scanned(rows, licenses.PHRASES, notices, step))


def test_license_scan_of_odd_texts(docs, rows, none):
    want = Counter(scanned([r[:2] for r in rows], licenses.PHRASES, licenses.NOTICES, licenses.STEP))
    assert as_rows(licenses.scan(docs).collect()) == want
    assert licenses.scan(none).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(none, notices=[Template("long", "word " * 80)])
    with pytest.raises(ValueError):
        licenses.scan(none, notices=[Template("empty", "...")])


def test_license_scan_runs_in_the_jvm_alone(docs):
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)


def mined(rows, anchors, positives=5, negatives_=3):
    """The definition. ``rows``: (id, label, integer vector)."""
    least, most = -(2**63), 2**63 - 1
    score = lambda a, b: min(max(sum(x * y for x, y in zip(a, b, strict=True)), least), most)
    for a, label, v in anchors:
        others = [(-score(v, w), i, y) for i, y, w in rows if len(w) == len(v)]
        mine = sorted(o for o in others if o[2] == label and o[1] != a)[:positives]
        for s, i, _ in mine:
            ring = sorted(o for o in others if o[2] != label and 50 * -s <= 100 * -o[0] <= 95 * -s)[:negatives_]
            for rank, (t, j, _) in enumerate(ring, 1):
                yield a, i, rank, j, -s, -t


def vectors_of(seed, n, dims, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dims))
    hot = rng.normal(size=dims)
    out = []
    for i in range(n):
        v = hot if i % 3 == 0 else centres[rng.integers(8)] + spread * rng.normal(size=dims)
        out.append((i, int(rng.integers(4)), [float(x) for x in v]))
    return out


def check_mined(spark, rows, scale=16, **options):
    made = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, label int, embedding array<double>, cell string").repartition(3)
    found = negatives.hard_negatives(made, F.col("vec_id") % 10 == 0, scale=scale, **options).collect()
    clamp = lambda x: min(max(int(np.floor(x)), -(2**63)), 2**63 - 1)
    whole = [
        (i, y, [clamp(x * scale) for x in v]) for i, y, v in rows
        if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    anchors = {}
    for i, y, v in whole:
        if i % 10 == 0:
            anchors[i] = min(anchors.get(i, (v, y)), (v, y))
    want = Counter(mined(whole, [(i, y, v) for i, (v, y) in anchors.items()]))
    got = Counter((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in found)
    assert got == want
    return got


@pytest.mark.parametrize("dims, spread, options", [
    (6, 0.3, {}), (6, 0.3, {"pivots": 12, "part_anchors": 4, "salt_rows": 40}), (2, 0.05, {"pivots": 5, "part_anchors": 2, "salt_rows": 25}),
    (3, 1.0, {"pivots": 1})
])
def test_hard_negatives(spark, dims, spread, options, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS_EACH", 20)
    assert sum(check_mined(spark, vectors_of(dims, 300, dims, spread), **options).values()) > 30


def test_hard_negatives_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS_EACH", 20)
    rows = vectors_of(5, 120, 3, 0.4)
    rows += [(10, 1, [0.5, 0.5, 0.5]), (10, 2, [0.1, 0.2, 0.3]), (11, 1, [1.0, 2.0, 3.0]), (11, 1, [1.0, 2.0, 3.0])]
    rows += [(None, 1, [1.0, 1.0, 1.0]), (200, None, [1.0, 1.0, 1.0]), (210, 1, None), (220, 1, [1.0, None, 1.0]), (230, 1, [1.0, float("nan"), 1.0])]
    rows += [(240, 1, [float("inf"), 1.0, 1.0]), (250, 1, []), (251, 1, []), (252, 2, []), (260, 1, [2.0, 1.0]), (261, 1, [2.0, 1.5]), (262, 2, [1.5, 1.0])]
    rows += [(270, 9, [0.0, 0.0, 0.0]), (271, 9, [0.0, 0.0, 0.0])]
    check_mined(spark, rows)


def test_hard_negatives_beyond_longs(spark):
    rng = random.Random(2)
    rows = [(i, i % 3, [rng.choice([1e9, -1e9, 3e18, 1.0, -4e18]) * rng.random() for _ in range(2)]) for i in range(60)]
    check_mined(spark, rows, scale=1)


def test_hard_negatives_of_nothing(spark):
    made = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert negatives.hard_negatives(made, F.col("vec_id") % 10 == 0).count() == 0
    made = spark.createDataFrame([(1, 1, [1.0])], made.schema)
    assert negatives.hard_negatives(made, F.col("vec_id") % 10 == 0).count() == 0


def test_a_reach_never_leaves_out_a_row_that_serves():
    """Bounds by pivots and planes against true distances."""
    rng = np.random.default_rng(1)
    rows, anchors = rng.integers(-40, 40, (300, 4)), rng.integers(-40, 40, (60, 4))
    norm = float((rows**2).sum(axis=1).max())
    pivots = negatives.Pivots(rows[:15].tolist(), norm)
    squared, own = pivots.squared(rows, False), pivots.squared(anchors, True)
    cell, home = squared.argmin(axis=1), own.argmin(axis=1)
    true = np.sqrt(norm + (anchors**2).sum(axis=1)[:, None] - 2 * anchors @ rows.T)
    cells = np.unique(home)
    radius = np.array([np.sqrt(own[home == c, c]).max() for c in cells])
    few = 0
    for limit in (5.0, 20.0, 60.0):
        groups = negatives.grouped(pivots.between, {int(c): int((home == c).sum()) for c in cells}, 15)
        of = np.array([groups[int(c)] for c in cells])
        reach = negatives.Reach(cells, of, radius, np.full((len(cells), negatives.LABEL_CLASSES), limit), False)
        served = reach.served(pivots, squared, cell, np.zeros(len(rows), np.int64))
        sent = reach.groups_of(served)
        assert all((sent[:, g] == served[:, of == g].any(axis=1)).all() for g in set(of.tolist())) and 1 < len(set(of.tolist())) < len(cells)
        for k, c in enumerate(cells):
            assert served[(true[home == c] <= limit).any(axis=0), k].all()
        few += (~served).sum()
    assert few


def plain_runs(x):
    """All runs of max(6, 4q) values and more, by trying every period."""
    out, n = set(), len(x)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and not any(s <= i and s + m >= j + q and q % p == 0 for s, m, p in out if p < q):
                out.add((i, j + q - i, q))
            i = j + 1
    return sorted(out)


def sequences():
    rng = random.Random(9)
    for n in range(0, 12):
        yield [0] * n
    for _ in range(300):
        kinds, n = rng.randrange(1, 4), rng.randrange(0, 70)
        yield [rng.randrange(kinds) for _ in range(n)]
    for _ in range(200):
        x = []
        while len(x) < 60:
            root = [rng.randrange(4) for _ in range(rng.randrange(1, 9))]
            x += (root * 8)[: rng.randrange(1, 7 * len(root) + 1)]
        yield x
    yield [0, 1, 0, 0, 1] * 9 + [0] * 9 + [1, 0] * 9


def test_runs_are_those_of_every_period():
    some = 0
    for x in sequences():
        words = [bytes([97 + v]) for v in x]
        hashes = np.array([v * 1_000_003 + 17 for v in x], dtype=np.uint64)
        got = periodic.runs_of_texts([np.arange(len(x))], [words], hashes)[0]
        assert sorted(map(tuple, got.tolist())) == plain_runs(x), x
        if x:
            direct = periodic.find_runs(np.array(x, dtype=np.int64), np.full(len(x), len(x)))
            assert sorted(map(tuple, direct.tolist())) == plain_runs(x), x
        some += len(got)
    assert some > 100


def test_suffixes_and_ranges():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 40):
        x = rng.integers(0, 2, n)
        order, rank = periodic.suffix_ranks(x)
        assert order.tolist() == sorted(range(n), key=lambda i: x[i:].tolist()) and (rank[order] == np.arange(n)).all()
        low = rng.integers(0, n, 30)
        high = np.minimum(n - 1, low + rng.integers(0, n, 30))
        values = rng.integers(0, 99, n)
        assert periodic.range_minima(values, low, high).tolist() == [values[a : b + 1].min() for a, b in zip(low, high, strict=True)]


def plain_told(doc_id, text, repeat_some):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if repeat_some and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    return (
        doc_id, n, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(listed.encode()).hexdigest(),
        hashlib.sha256(kept).hexdigest(), None if text is None else kept.decode()
    )


@pytest.mark.parametrize("repeat_some", [False, True])
def test_periodic_runs(spark, docs, rows, none, repeat_some, monkeypatch):
    monkeypatch.setattr(periodic, "TOGETHER", 2000)
    texts = [(d, t) for d, t, *_ in rows if t is None or len(t) < 5000]
    texts += [(1000 + k, " ".join(map(str, x))) for k, x in enumerate(sequences())] + [(None, "a b " * 9)]
    made = spark.createDataFrame([(*r, 1, "s") for r in texts], "doc_id long, text string, start long, words string").repartition(3)
    found = Counter(tuple(r) for r in periodic.periodic_runs(made, repeat_some=repeat_some).collect())
    assert found == Counter(plain_told(d, t, repeat_some) for d, t in texts)
    assert periodic.periodic_runs(none).count() == 0 and periodic.periodic_runs(docs).count() == len(rows)


def test_a_long_text_of_one_run(spark):
    text = " ".join(f"w{i % 997}" for i in range(60_000))
    row = periodic.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_runs, row.start, row.length, row.period) == (1, 0, 60_000, 997)
    assert row.clean_text == " ".join(f"w{i}" for i in range(997))
