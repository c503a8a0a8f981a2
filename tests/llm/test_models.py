"""Operators 3, 8 and 10: held-out accuracy, and the language model against a plain one."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pagequarry.llm import common, langmodel, quality, toxicity

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(400):
        words = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(20, 120))]
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        if bad:
            words = [w + rng.choice(["###", "%%%"]) for w in words] if i % 2 else words[:2] * 30
        if toxic:
            for _ in range(rng.randrange(1, 5)):
                words[rng.randrange(len(words))] = rng.choice(["moron", "Scum,", "idiot"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(toxic)))
    labels += [(None, 1, 1), (5, None, None), (10**6, 0, 1)]
    docs += [(2000, None), (2001, ""), (None, "text"), (7, docs[7][1]), (2002, "w " * 100_000)]
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr(
        "*", "'x' AS score", "1 AS k_id", "2 AS q_log_bytes", "'y' AS label"
    ), spark.createDataFrame(labels, LABELS), docs, labels


def test_quality(labelled):
    docs, labels, raw, truth = labelled
    found = quality.classify(docs, labels).collect()
    assert len(found) == len(raw)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    want = {d: q for d, q, _ in truth if q is not None}
    held = [(r.predicted, want[r.doc_id]) for r in found if r.held_out and r.doc_id in want]
    assert np.mean([p == q for p, q in held]) > 0.93


def test_quality_expression_is_the_model(labelled):
    docs, labels, raw, _ = labelled
    model = quality.train(docs, labels)
    assert model.rules
    want = dict(zip([d for d, _ in raw], model.predict(quality.statistics([(t or "").encode() for _, t in raw])), strict=True))
    for r in quality.classify(docs, labels).collect():
        assert abs(r.score - want[r.doc_id]) < 1e-9


def test_quality_without_labels(spark, labelled, none):
    docs, labels, raw, _ = labelled
    empty = spark.createDataFrame([], LABELS)
    assert {r.score for r in quality.classify(docs, empty).collect()} == {0.5}
    assert quality.classify(none, labels).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < len(raw)


def test_toxicity(labelled, none, spark):
    docs, labels, raw, truth = labelled
    found = toxicity.severity(docs, labels).collect()
    assert len(found) == len(raw) and all(0 <= r.expected_severity <= 3 and r.grade in (0, 1, 2, 3) for r in found)
    want = {d: t for d, _, t in truth if t is not None}
    held = [(r.toxic, want[r.doc_id], r.expected_severity) for r in found if r.held_out and r.doc_id in want]
    assert np.mean([p == t for p, t, _ in held]) > 0.95
    assert np.mean([s for _, t, s in held if t]) > 1 > np.mean([s for _, t, s in held if not t])
    assert toxicity.severity(none, labels).count() == 0
    assert {r.toxic for r in toxicity.severity(docs, spark.createDataFrame([], LABELS)).collect()} == {0}


def test_severity_follows_what_the_binary_labels_do_not_say(spark):
    """Texts with one, three or nine toxic words have the same label; held-out ones are still ordered."""
    rng = random.Random(16)
    docs, labels, level = [], [], {}
    for i in range(900):
        words = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 7))) for _ in range(80)]
        level[i] = rng.choice([0, 0, 0, 1, 3, 9])
        for _ in range(level[i]):
            words[rng.randrange(80)] = rng.choice(["moron", "scum", "idiot", "vermin", "filth"])
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(level[i] > 0)))
    found = toxicity.severity(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    ).where("held_out").collect()
    mean = [np.mean([r.expected_severity for r in found if level[r.doc_id] == k]) for k in (0, 1, 3, 9)]
    assert mean[0] < 0.3 and all(b - a > 0.3 for a, b in zip(mean, mean[1:], strict=False))
    toxic = [r for r in found if level[r.doc_id]]
    pairs = [(a.expected_severity > b.expected_severity) for a in toxic for b in toxic if level[a.doc_id] > level[b.doc_id]]
    assert np.mean(pairs) > 0.85


def test_grades_come_from_the_other_half():
    rng = np.random.default_rng(3)
    n, width = 60, 8
    counts = rng.integers(0, 3, (n, width))
    toxic, half = rng.integers(0, 2, n), rng.integers(0, 2, n)
    x = toxicity.Features(np.arange(width, dtype=np.uint64), [])
    x.n, (x.row, x.column) = n, np.nonzero(counts)
    x.value = np.log1p(counts[x.row, x.column])
    weight = []
    for i in range(n):
        total = 0.0
        for w in range(width):
            a = sum(counts[j, w] > 0 and toxic[j] == 1 and half[j] != half[i] for j in range(n))
            b = sum(counts[j, w] > 0 and toxic[j] == 0 and half[j] != half[i] for j in range(n))
            t, c = (sum(half[j] != half[i] and toxic[j] == k for j in range(n)) for k in (1, 0))
            total += max(0.0, math.log((a + 0.5) / (t - a + 0.5)) - math.log((b + 0.5) / (c - b + 0.5))) * math.log1p(counts[i, w])
        weight.append(total)
    cuts = np.quantile([w for w, t in zip(weight, toxic, strict=True) if t], [1 / 3, 2 / 3])
    want = [0 if not t else 1 + int(w > cuts[0]) + int(w > cuts[1]) for w, t in zip(weight, toxic, strict=True)]
    assert toxicity.grades_of(x, toxic, half, width).tolist() == want


def test_ordinal_fit_is_where_the_likelihood_is_highest():
    rng = np.random.default_rng(5)
    n, width = 300, 3
    dense = rng.random((n, width)) * (rng.random((n, width)) < 0.6)
    grade = np.digitize(dense @ [2.0, -1.0, 0.5] + rng.logistic(0, 0.3, n), [0.2, 0.8, 1.4])
    x = toxicity.Features(np.arange(width, dtype=np.uint64), [])
    x.n, (x.row, x.column) = n, np.nonzero(dense)
    x.value = dense[x.row, x.column]
    model = toxicity.OrdinalModel.fit(x, grade, width, ridge=0.0, rounds=4000)

    def loss(thresholds, weights):
        above = 1 / (1 + np.exp(-(dense @ weights)[:, None] + thresholds[None, :]))
        each = -np.diff(np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1), axis=1)
        return -np.log(each[np.arange(n), grade]).mean()

    best = loss(model.thresholds, model.weights)
    for k in range(3 + width):
        for d in (-0.02, 0.02):
            step = np.zeros(3 + width)
            step[k] = d
            assert loss(model.thresholds + step[:3], model.weights + step[3:]) >= best - 1e-6


def test_lasso_meets_the_conditions_of_its_optimum():
    rng = np.random.default_rng(4)
    z = (rng.random((500, 12)) < rng.random(12)).astype(np.float64)
    y = (rng.random(500) < 1 / (1 + np.exp(-(2 * z[:, 0] - 1.5 * z[:, 3] + 0.3)))).astype(np.float64)
    for penalty in (0.001, 0.02, 0.2):
        b, w = quality.lasso_logistic(z, y, penalty, 5000)
        error = 1 / (1 + np.exp(-(z @ w + b))) - y
        slope = ((z - z.mean(axis=0)) / z.std(axis=0)).T @ error / len(y)
        assert abs(error.mean()) < 1e-6
        zero = np.abs(w) < 1e-9
        assert (np.abs(slope[zero]) <= penalty + 1e-6).all() and np.allclose(slope[~zero], -penalty * np.sign(w[~zero]), atol=1e-6)
    assert zero.all()


def test_splits_are_the_best_of_all():
    rng = np.random.default_rng(6)
    x = np.round(rng.random((120, 4)), 2)
    gradient, hessian = rng.normal(size=120) + (x[:, 2] > 0.4), rng.random(120) + 0.1
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)[1:-1])) for f in range(4)]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    use = np.flatnonzero(rng.random(120) < 0.7)
    f, b = quality._split(bins, gradient, hessian, use, edges, np.arange(4), 10)

    def gain(f, cut):
        left = x[use, f] <= cut
        g, h = gradient[use], hessian[use]
        if min(left.sum(), (~left).sum()) < 10:
            return -1.0
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
        return part(left) + part(~left) - g.sum() ** 2 / (h.sum() + 1)

    every = {(i, cut): gain(i, cut) for i in range(4) for cut in edges[i]}
    assert abs(every[f, edges[f][b]] - max(every.values())) < 1e-9
    # every rule is a path whose terms are bounds of the tree, and trees separate what one cut can
    rules = quality.tree_rules(x, (x[:, 2] > 0.4).astype(float), trees=3)
    assert any(
        r.holds(x).tolist() == (x[:, 2] > 0.4).tolist() or r.holds(x).tolist() == (x[:, 2] <= 0.4).tolist() for r in rules if len(r.terms) == 1
    ) or max(abs(np.corrcoef(r.holds(x), x[:, 2] > 0.4)[0, 1]) for r in rules) > 0.95


def test_one_text_of_each_labelled_id(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, None), (3, "c"), (4, "d"), (None, "e")], "doc_id long, text string")
    kept = [i for i in (1, 2, 3, 4) if zlib.crc32(str(i).encode()) % 5]
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (1, 0, 1), (2, 1, 1), (3, 7, 1), (4, 1, 1), (9, 1, 1)], LABELS)
    got = sorted((r.k_id, r.k_label, r.text) for r in quality.labelled_texts(docs, labels, 100, "doc_id", "text", "quality").collect())
    assert got == [x for x in [(1, 0, "a"), (1, 1, "a"), (2, 1, ""), (4, 1, "d")] if x[0] in kept]
    assert quality.labelled_texts(docs, labels, 2, "doc_id", "text", "quality").count() <= 2


def test_thresholds_are_ordered_and_weights_shared():
    x = toxicity.Features(np.sort(np.unique(np.arange(3, dtype=np.uint64))), [])
    x.n, x.row, x.column, x.value = 40, np.arange(40), np.zeros(40, np.int64), np.linspace(0, 4, 40)
    model = toxicity.OrdinalModel.fit(x, (np.linspace(0, 3.99, 40)).astype(np.int64), 1)
    assert (np.diff(model.thresholds) > 0).all() and model.weights[0] > 0
    expected = model.above(x).sum(axis=1)
    assert (np.diff(expected) > 0).all() and expected[0] < 0.7 and expected[-1] > 2.3


class PlainModel:
    """Backoff n-grams straight from the definition: dictionaries and recursion."""

    def __init__(self, texts, least):
        self.least, self.counts = least, [Counter() for _ in least]
        for t in texts:
            padded = ("<s>", *t)
            for k in range(1, len(least) + 1):
                for i in range(1 if k == 1 else 0, len(padded) - k + 1):
                    self.counts[k - 1][padded[i : i + k]] += 1
        self.total, self.distinct, self.texts = sum(self.counts[0].values()), len(self.counts[0]), len(texts)
        self.kept = [{g: n for g, n in c.items() if n >= m} for c, m in zip(self.counts, least, strict=True)]
        self.discount = []
        for k, c in enumerate(self.counts):
            shorter = self.counts[k - 1] | {("<s>",): self.texts} if k else {}
            asked = [n for g, n in c.items() if not k or min(shorter[g[:-1]], shorter[g[1:]]) >= least[k]]
            one, two = asked.count(1), asked.count(2)
            self.discount.append(min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5)
        self.arcs, self.mass = Counter(), Counter()
        for k in self.kept[1:]:
            for g, n in k.items():
                self.arcs[g[:-1]] += 1
                self.mass[g[:-1]] += n

    def p(self, context, word):
        context = context[len(context) - len(self.least) + 1 :] if len(context) >= len(self.least) else context
        if not context:
            return (self.counts[0][word,] + 1) / (self.total + self.distinct + 1)
        k = len(context)
        size = self.texts if context == ("<s>",) else self.counts[k - 1][context]
        lower = self.p(context[1:], word)
        if not self.arcs[context]:
            return lower
        d = self.discount[k]
        left = 1 - (self.mass[context] - d * self.arcs[context]) / size
        n = self.kept[k].get((*context, word), 0)
        return (n - d if n else 0) / size + left * lower

    def scores(self, text):
        padded = ("<s>", *text)
        return [math.log10(self.p(padded[:i], padded[i])) for i in range(1, len(padded))]


def tokens_of(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [*(w for w in re.split("[ \t-\r]+", low) if w), "</s>"]


@pytest.mark.parametrize("least", [(1, 1, 2, 2), (1, 1, 1), (1, 2), (1,), (1, 1, 1, 1, 3)])
def test_language_model(docs, rows, none, least):
    texts = [tokens_of(t) for _, t, *_ in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, *_ in rows]
    model = PlainModel([t for t, h in zip(texts, held, strict=True) if not h], least)
    want = Counter()
    for row, t, h in zip(rows, texts, held, strict=True):
        base = sum(math.log10(model.p((), w)) for w in t)
        known = sum(model.counts[0][w,] > 0 for w in t)
        want[row[0], h, len(t), known, model.total, round(base, 4), round(sum(model.scores(t)), 4)] += 1
    found = langmodel.score_texts(docs, order=len(least), least=least, chunk_bytes=20_000).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in found) == want
    assert langmodel.score_texts(none, order=len(least), least=least).count() == 0


def held_out_ids(n):
    return [i for i in range(10**6, 10**6 + 40 * n + 200) if zlib.crc32(str(i).encode()) % 7 == 2][:n]


def test_probabilities_of_next_tokens_sum_to_one(spark):
    """After every context, over all known tokens, the end, and the class of the unknown."""
    rng = random.Random(3)
    train = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randrange(0, 30)))) for i in range(40)]
    train = [d for d in train if zlib.crc32(str(d[0]).encode()) % 7 != 2]
    words = [*"abcde", "unknown"]
    contexts = ["", "a", "a b", "c c", "b a e", "d d d d", "unknown a", "a unknown", "e a b c d e"]
    probes = [" ".join([*c.split(), w]) for c in contexts for w in words] + contexts
    ids = held_out_ids(len(probes))
    found = {
        r.doc_id: r for r in langmodel.score_texts(
            spark.createDataFrame(train + list(zip(ids, probes, strict=True)), "doc_id long, text string"), with_tokens=True
        ).collect()
    }
    scores = {t: found[i].token_scores for i, t in zip(ids, probes, strict=True)}
    for c in contexts:
        after = [scores[" ".join([*c.split(), w])][len(c.split())] for w in words]
        assert abs(sum(10**s for s in [*after, scores[c][-1]]) - 1) < 1e-9
    assert all(abs(sum(r.token_scores) - r.score) < 1e-6 for r in found.values())


def test_language_model_without_training_rows(spark):
    rows = [(i, t) for i, t in zip(held_out_ids(3), ["a b", "", None], strict=True)]
    found = langmodel.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {
        (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found
    } == {(True, 3, 0, 0, 0.0, 0.0), (True, 1, 0, 0, 0.0, 0.0)}


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.mark.parametrize("n", [64, 65, 1024, 4096])
def test_words_that_collide_in_polynomial_hashes_differ(spark, n):
    one, two = thue_morse(n), thue_morse(n, "b", "a")
    assert len({common.Words([w.encode()], common.NONSPACE, False).hashes(lane)[0] for w in (one, two) for lane in (0, 1)}) == 4
    trained = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2)
    rows = [(trained, f"{one} x"), (held_out_ids(1)[0], f"{two} x")]
    found = {r.doc_id: r for r in langmodel.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[d].n_known for d, _ in rows] == [3, 2]
