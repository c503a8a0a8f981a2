"""Operators 6, 7 and 9 and the near copies against brute force on texts with every edge case."""

import hashlib
import random
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagequarry.llm import hamming, neardup, packed, repeats, simhash, suffixes
from pagequarry.llm.common import byte_grams
from pagequarry.llm.graph import components, spread_join
from pagequarry.session import settle

LAST = float("inf")


def order(doc_id):
    return LAST if doc_id is None else doc_id


def removed(units_of, rows, window):
    """(doc_id, number of units, mask) of each row by the definition."""
    first: dict = {}
    units = [(order(d), units_of(t)) for d, t, *_ in rows]
    for d, u in units:
        for i in range(len(u) - window + 1):
            w = tuple(u[i : i + window]) if isinstance(u, list) else u[i : i + window]
            first[w] = min(first.get(w, LAST), d)
    for (d, u), row in zip(units, rows, strict=True):
        mask = [False] * len(u)
        for i in range(len(u) - window + 1):
            w = tuple(u[i : i + window]) if isinstance(u, list) else u[i : i + window]
            if first[w] < d:
                mask[i : i + window] = [True] * window
        yield row[0], u, mask


def test_word_passages(docs, rows, none):
    want = Counter()
    for d, u, mask in removed(lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or ""), rows, 50):
        want[d, len(u), sum(mask), hashlib.sha256(" ".join(w for w, m in zip(u, mask, strict=True) if not m).encode()).hexdigest()] += 1
    found = repeats.remove_repeats(docs, chunk_bytes=20_000).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == want
    assert sum(r.n_removed for r in found) > 100 and sum(r.clean_text is None for r in found) == 2
    assert repeats.remove_repeats(none).count() == 0


@pytest.mark.parametrize("n", [32, 64, 1024, 4096])
def test_passages_of_structured_words_are_not_taken_for_each_other(spark, n):
    """Words, and orders of words, that a polynomial modulo a power of two cannot tell apart."""
    sign = ["b" if bin(i).count("1") % 2 else "a" for i in range(n)]
    one, two = "".join(sign), "".join("ab"[c == "a"] for c in sign)
    tail = [f"w{i}" for i in range(60)]
    order = [sign[i % n] for i in range(64)]
    rows = [(1, " ".join([*tail[:30], one, *tail[30:]])), (2, " ".join([*tail[:30], two, *tail[30:]]))]
    rows += [(3, " ".join(order)), (4, " ".join("ab"[c == "a"] for c in order))]
    want = {d: sum(mask) for d, _, mask in removed(lambda t: t.split(), rows, 50)}
    got = {r.doc_id: r.n_removed for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and got[2] == 0


def test_byte_passages(docs, rows, none):
    want = Counter()
    for d, u, mask in removed(lambda t: (t or "").encode(), rows, 50):
        spans = sum(m and not p for p, m in zip([False, *mask], mask, strict=False))
        want[d, len(u), sum(mask), spans, hashlib.sha256(bytes(b for b, m in zip(u, mask, strict=True) if not m)).hexdigest()] += 1
    found = suffixes.remove_repeated_bytes(docs, chunk_bytes=20_000, bucket_bytes=5_000).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == want
    assert suffixes.remove_repeated_bytes(none).count() == 0


@pytest.mark.parametrize("width", [1, 2, 7, 27])
def test_the_least_gram_of_a_window_is_the_same_wherever_it_stands(width):
    """Hashes that differ in their lowest bits alone, in short and in long arrays."""
    rng = np.random.default_rng(width)
    hashes = rng.integers(0, 4, 5000, dtype=np.uint64) + np.uint64(1 << 63)
    place = repeats.least_at(hashes, width)
    assert place.tolist() == [i + int(np.argmin(hashes[i : i + width])) for i in range(len(hashes) - width + 1)]
    for i in (0, 17, 4000):
        assert (repeats.least_at(hashes[i : i + width + 9], width) + i == place[i : i + 10]).all()
    assert not len(repeats.least_at(hashes[: width - 1], width))


def test_splitters_cut_by_weight():
    keys = sorted([(bytes([i]) * 3, 1.0) for i in range(100)] + [(bytes([200, i]) + b"xx", 30.0) for i in range(10)])
    cuts = suffixes.chosen_splitters(keys, 8, 2)
    held = Counter()
    for k, w in keys:
        held[bisect_right(cuts, k)] += w
    assert max(held.values()) <= 2 * 400 / 8


def test_bytes_with_small_windows(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(0, 40)))) for i in range(40)]
    for window in (3, 9, 30):
        want = {d: sum(mask) for d, _, mask in removed(lambda t: t.encode(), rows, window)}
        got = suffixes.remove_repeated_bytes(
            spark.createDataFrame(rows, "doc_id long, text string"), window=window, chunk_bytes=200, bucket_bytes=100
        )
        assert {r.doc_id: r.n_removed for r in got.collect()} == want


def test_multikey_sort_is_a_sort():
    rng = random.Random(11)
    for width in (1, 3, 8, 9, 24, 50):
        data = "".join(rng.choice("ab") for _ in range(400)).encode() + b"a" * 200 + bytes(rng.randrange(256) for _ in range(200))
        at = np.array([rng.randrange(len(data) - width + 1) for _ in range(rng.choice([0, 1, 2, 700]))], dtype=np.int64)
        order, head = suffixes.multikey_sort(data, at, width)
        strings = [data[i : i + width] for i in at[order]]
        assert sorted(order.tolist()) == list(range(len(at))) and strings == sorted(strings)
        assert head.tolist() == [i == 0 or strings[i] != strings[i - 1] for i in range(len(strings))]


def test_a_gram_of_a_third_of_all_suffixes_is_split(spark):
    """Splitters that read on beyond a gram part its windows, and no bucket gets them all."""
    rng = random.Random(12)
    # of a run of each letter the one of least hash, which many windows select
    gram = min((chr(c) * 24 for c in range(0x21, 0x7F)), key=lambda g: int(byte_grams(np.frombuffer(g.encode(), np.uint8), 24)[0]))
    rows = [(i, "".join("%s%s" % (gram, "".join(rng.choice("ab") for _ in range(9))) for _ in range(20))) for i in range(60)]
    keys = sorted(k for _, t in rows for k in window_keys(t.encode()))
    splitters = suffixes.chosen_splitters([(k, 1.0) for k in keys], 40, 24)
    assert sum(k[:24] == gram.encode() for k in keys) > 0.35 * len(keys) and sum(len(x) > 24 for x in splitters) > 10
    sizes = Counter(bisect_right(splitters, k) for k in keys)
    assert max(sizes.values()) < 0.2 * len(keys)
    want = {d: sum(mask) for d, _, mask in removed(lambda t: t.encode(), rows, 50)}
    got = suffixes.remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=3000, bucket_bytes=600)
    assert {r.doc_id: r.n_removed for r in got.collect()} == want and 0 < sum(want.values())


def window_keys(text):
    s = suffixes.Suffixes([text], 50)
    for low, high, place in zip(s.low.tolist(), s.high.tolist(), s.place.tolist(), strict=True):
        for at in range(low, high + 1):
            yield suffixes.window_key(text[at : at + 50], place - at, 24)


def test_pipeline_stage_keeps_columns_and_characters(docs, rows, none):
    cut = suffixes.cut_repeats(docs)
    assert cut.columns == docs.columns
    kept = cut.collect()
    assert all(r.text is None or r.n_chars == len(r.text) for r in kept)
    assert {500, 600} <= {r.doc_id for r in kept} and 200 not in {r.doc_id for r in kept}
    assert suffixes.cut_repeats(none).count() == 0


def reference_print(text, n=3):
    words = [w for w in re.split("[ \t-\r]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_chunks_grow_with_the_input_and_the_memory_of_a_task(spark):
    assert packed.growth(spark, 2 << 20, 1 << 30) == 1.0
    assert packed.task_bytes(spark) > 0
    most = packed.task_bytes(spark) / 24 / (1 << 10)
    assert packed.growth(spark, 1 << 10, 1 << 40) == min(4.0, most) and packed.growth(spark, 1 << 10, 1 << 80) == most


def test_planes_of_whole_numbers_come_back():
    rng = np.random.default_rng(8)
    arrays = [
        rng.integers(0, 2**bits, n, dtype=np.uint64) for bits, n in ((1, 100), (17, 0), (33, 5), (64, 7), (8, 1))
    ] + [np.zeros(9, np.int64), np.empty(0, np.int64)]
    assert [a.tolist() for a in packed.expand(packed.squeeze(*arrays))] == [a.tolist() for a in arrays]


def test_simhash(docs, rows, none):
    prints = [reference_print(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                parent[find(i)] = find(j)
    least: dict = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), LAST), r[0])
    want = Counter((r[0], f"{prints[i]:016x}", least.get(find(i))) for i, r in enumerate(rows))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(none).count() == 0


def test_bucket_stars_are_complete():
    rng = random.Random(2)
    free = simhash.block_masks(2)[3] ^ ((1 << 64) - 1)
    places = [i for i in range(64) if free >> i & 1]
    for n in (5, 60, 300):
        fps = np.unique(np.array([sum(1 << p for p in places if rng.random() < 0.12) for _ in range(n)], dtype=np.uint64))
        label = simhash.star(fps, free, 2)
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
        reach = near
        for _ in range(12):
            reach = (reach.astype(int) @ reach.astype(int)) > 0
        assert (label == reach.argmax(axis=1)).all()


@pytest.mark.parametrize("distance", [0, 1, 3, 6])
def test_stars_of_other_distances_in_large_buckets(distance, monkeypatch):
    monkeypatch.setattr(hamming, "TILE", 64)
    rng = random.Random(distance)
    fps = np.unique(np.array([rng.getrandbits(9) for _ in range(150)], dtype=np.uint64))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance
    reach = near
    for _ in range(9):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    assert (simhash.star(fps, 0, distance) == reach.argmax(axis=1)).all()


def test_rows_of_hot_keys_are_joined_where_they_lie(spark):
    rows = [(i, 1 if i % 3 else i) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, k long")
    table = settle(df.groupBy("k").agg(F.count("*").alias("n"), F.max("doc_id").alias("most")), "test-hot")
    got = spread_join(df, table, "k", "n")
    assert Counter((r.doc_id, r.k) for r in got.collect()) == Counter(rows) and got.columns == ["k", "doc_id", "most"]
    assert {r.most for r in got.where("k = 1").collect()} == {1999}


def test_every_close_pair_shares_a_key():
    masks = simhash.block_masks(2)
    rng = random.Random(3)
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        assert any(a & m == b & m for m in masks)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (95, 100), (7, 7)]
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_copies(spark, none):
    rng = random.Random(9)
    rows, want = [], set()
    for i in range(60):
        words = ["w%d" % rng.randrange(10**6) for _ in range(200)]
        rows.append((i, " ".join(words)))
        if i % 3 == 0:
            for k in range(2):
                other = list(words)
                for _ in range(2):
                    other[rng.randrange(200)] = "changed"
                rows.append((1000 + 10 * i + k, " ".join(other)))
                want.add(rows[-1][0])
    rows += [(5000, None), (5001, " "), (5002, rows[0][1]), (None, "x")]
    want |= {5001, 5002}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in neardup.copies(docs).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) and {5001, 5002} <= got
    assert neardup.keep_first(docs).count() == len(rows) - len(got)
    assert neardup.keep_first(none).count() == 0


def test_large_buckets_of_copies_stay_together():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, (1, neardup.LANES), dtype=np.uint64)
    sigs = np.repeat(base, 9000, axis=0)
    sigs[np.arange(9000), rng.integers(0, neardup.LANES, 9000)] ^= np.uint64(1) << rng.integers(0, 64, 9000).astype(np.uint64)
    assert (hamming.groups(sigs, 20) == 0).all()


def test_close_pairs_meet_in_large_buckets_of_distant_rows():
    rng = np.random.default_rng(2)
    sigs = rng.integers(0, 2**63, (8194, neardup.LANES), dtype=np.uint64)
    want = np.arange(len(sigs))
    bits = [np.array([mask] + [0] * (neardup.LANES - 1), dtype=np.uint64) for mask in (0xFFFF, 0xFFFF0000)]
    for chain in ((10, 8000), (5000, 5001), (20, 4500, 8190)):
        for k, at in enumerate(chain[1:]):
            sigs[at] = sigs[chain[k]] ^ bits[k]
            want[at] = chain[0]
    assert (hamming.groups(sigs, 20) == want).all()


def edited(rng, similarity, n=300):
    """Two texts of n five-word shingles and about the similarity, and the exact one."""
    a = ["w%d" % rng.randrange(10**6) for _ in range(n + 4)]
    b, sets = list(a), []
    while True:
        sets = [{tuple(x[i : i + 5]) for i in range(n)} for x in (a, b)]
        exact = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        if exact <= similarity:
            return " ".join(a), " ".join(b), exact
        b[rng.randrange(n + 4)] = "x%d" % rng.randrange(10**6)


def test_near_copies_are_those_of_exact_similarity(spark):
    rng = random.Random(4)
    rows, want = [], set()
    for i in range(200):
        a, b, exact = edited(rng, 0.74 + 0.002 * (i % 60))
        rows += [(2 * i, a), (2 * i + 1, b)]
        want |= {2 * i + 1} if exact >= 0.8 else set()
    got = {r.doc_id for r in neardup.copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 50 < len(want) < 150 and got == want


def test_exact_groups_are_those_of_all_pairs():
    rng = random.Random(6)
    for _ in range(60):
        base = [rng.sample(range(60), rng.randrange(1, 25)) for _ in range(3)]
        sets = [
            np.unique(
                np.array([x for x in rng.choice(base) if rng.random() < 0.93] + rng.sample(range(60), rng.choice([0, 1])) + [99], dtype=np.uint64)
            ) for _ in range(rng.randrange(2, 40))
        ]
        want = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((want[i], want[j]))
                    want = [a if x == b else x for x in want]
        assert neardup.exact_groups(sets, 0.8).tolist() == want


def plain_copies(rows):
    """Ids of rows whose group has a smaller one, by comparing all pairs."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for _, t in rows)]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((group[i], group[j]))
                group = [a if x == b else x for x in group]
    return {rows[i][0] for i in range(len(rows)) if group[i] != i}


@pytest.mark.parametrize(("cell", "pivots", "key"), [(12, 4, 1 << 15), (12, 4, 10), (40, 1, 10), (4, 16, 1 << 15)])
def test_crowded_groups_are_confirmed_in_cells_without_losing_links(spark, monkeypatch, cell, pivots, key):
    """A clump around one text, a chain that drifts away from it, and texts that only the sieves link."""
    monkeypatch.setattr(neardup, "CELL_ROWS", cell)
    monkeypatch.setattr(neardup, "PIVOTS", pivots)
    monkeypatch.setattr(neardup, "KEY_ROWS", key)
    rng = random.Random(17)
    new = lambda: "w%d" % rng.randrange(10**6)
    base = [new() for _ in range(120)]
    texts = []
    for _ in range(70):
        own = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3])):
            own[rng.randrange(120)] = new()
        texts.append(own)
    chain = list(base)
    for _ in range(40):
        chain = list(chain)
        chain[rng.randrange(120)] = new()
        texts.append(chain)
    for _ in range(25):
        own = list(base)
        for at in range(0, 120, 12):
            own[at] = new()
        texts.append(own)
    rows = [(i, " ".join(t)) for i, t in enumerate(rng.sample(texts, len(texts)))]
    want = plain_copies(rows)
    got = {r.doc_id for r in neardup.copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == want and 70 < len(want) < len(rows) - 5


def test_one_row_of_each_group_of_copies_stays(spark):
    rng = random.Random(7)
    a, b, c, d, e, f = (" ".join("w%d" % rng.randrange(10**6) for _ in range(80)) for _ in range(6))
    near = a + " more"
    rows = [
        (1, a), (1, a), (2, near), (3, b), (3, near), (None, c), (None, c), (None, c + " more"), (None, d), (9, d), (4, e),
        (4, e), (5, f), (6, f.upper()), (6, f), (7, None), (7, None), (None, "")
    ]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, own long").repartition(3)
    kept = [(r.doc_id, r.text) for r in neardup.keep_first(docs).collect()]
    lost_one = [x for x in kept if x[0] is None]
    assert len(lost_one) == 1 and lost_one[0][1] in (c, c + " more")
    assert sorted((x for x in kept if x[0] is not None), key=str) == sorted([(1, a), (3, b), (9, d), (4, e), (5, f), (7, None)], key=str)
    assert neardup.keep_first(docs).columns == docs.columns
