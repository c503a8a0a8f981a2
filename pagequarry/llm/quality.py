"""Operator 3, quality classifier as a sparse rule ensemble.

Statistics of each whole text feed small boosted trees on labelled rows; every path from a
tree's root is a conjunctive rule; a lasso logistic regression keeps the few rules that
matter; and those are compiled into one Spark column expression over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.llm.common import NONSPACE, U64, Words, as_bytes, mix, named, numbered, release, slices, table

#: Labelled rows that a model learns from at most: those with the smallest hash of their id.
TRAIN_ROWS = 20_000
FOLDS = 5
THRESHOLD = 0.3


def _mask(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=np.uint8)
    for lo, hi in ranges:
        out[lo : hi + 1] = 1
    return out


BYTE_SHARES = {
    "upper": _mask((0x41, 0x5A)), "digit": _mask((0x30, 0x39)), "lines": _mask((0x0A, 0x0A)), "stops": _mask((0x2E, 0x2E), (0x3F, 0x3F)), "commas": _mask((0x2C, 0x2C), (0x3B, 0x3B)),
    "shouts": _mask((0x21, 0x21)), "bars": _mask((0x7C, 0x7C)), "signs": _mask(
        (0x23, 0x26), (0x2A, 0x2B), (0x40, 0x40), (0x5E, 0x5E), (0x7E, 0x7E)
    ), "marks": _mask((0x22, 0x22), (0x27, 0x2F), (0x3A, 0x3E), (0x5B, 0x60), (0x7B, 0x7D)), "high": _mask((0x80, 0xFF)), "blanks": _mask((0x09, 0x0D), (0x20, 0x20)),
}
STATISTICS = [
    "log_bytes", "log_words", "word_bytes", "log_lines", "distinct_words", "distinct_pairs", "same_next", "top_word",
    "one_letter", *(f"{k}_share" for k in BYTE_SHARES), *(f"{k}_per_word" for k in ("stops", "shouts", "bars", "signs", "upper"))
]


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of STATISTICS for each text; an empty text has zeros."""
    out = np.zeros((len(texts), len(STATISTICS)))
    for lo, hi in slices(texts):
        words = Words(texts[lo:hi], NONSPACE, lower=True)
        n = hi - lo
        size = np.diff(words.text_starts) - 1
        count = words.counts
        safe_size, safe_count = np.maximum(size, 1), np.maximum(count, 1)
        hashes = words.hashes()
        length = words.ends - words.starts
        doc = words.doc
        same = np.zeros(len(doc), dtype=bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
        distinct, top = _distinct(hashes, doc, n)
        inner = np.flatnonzero(doc[1:] == doc[:-1])
        pairs, _ = _distinct(mix(hashes[inner] * U64(3) ^ mix(hashes[inner + 1])), doc[inner], n)
        shares = {}
        for k, mask in BYTE_SHARES.items():
            total = np.concatenate([[0], np.cumsum(mask[words.raw], dtype=np.int64)])
            shares[k] = total[words.text_starts[1:] - 1] - total[words.text_starts[:-1]]
        columns = [
            np.log1p(size), np.log1p(count), np.bincount(doc, length, n) / safe_count, np.log1p(shares["lines"]), distinct / safe_count, pairs / np.maximum(count - 1, 1),
            np.bincount(doc, same, n) / safe_count, top / safe_count, np.bincount(doc, length == 1, n) / safe_count,
            *(shares[k] / safe_size for k in BYTE_SHARES), *(shares[k] / safe_count for k in ("stops", "shouts", "bars", "signs", "upper")),
        ]
        out[lo:hi] = np.stack(columns, axis=1)
    return out


def _distinct(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text, and how often its most frequent one occurs."""
    top = np.zeros(n, dtype=np.int64)
    if not len(hashes):
        return top.copy(), top
    _, first, count = np.unique(mix(hashes ^ mix(doc.astype(U64))), return_index=True, return_counts=True)
    np.maximum.at(top, doc[first], count)
    return np.bincount(doc[first], minlength=n), top


def with_statistics(documents: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and the statistics of the text, each under its own name after ``q_``."""
    source = documents.select(*(named(c).alias(f"k_{c}") for c in keep), F.col(f"`{text_col}`").cast("string").alias("q_text"))
    kept = [f for f in source.schema.fields if f.name != "q_text"]

    def run(batches):
        for batch in batches:
            release()
            found = statistics(as_bytes(batch.column("q_text")))
            arrays = [batch.column(f.name) for f in kept] + [pa.array(np.ascontiguousarray(found[:, i])) for i in range(found.shape[1])]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in kept] + [f"q_{s}" for s in STATISTICS])

    return source.mapInArrow(run, T.StructType([*kept, *(T.StructField(f"q_{s}", T.DoubleType()) for s in STATISTICS)]))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, lower bound exclusive or None, upper bound inclusive or None)."""

    terms: tuple[tuple[int, float | None, float | None], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for f, low, high in self.terms:
            if low is not None:
                out &= x[:, f] > low
            if high is not None:
                out &= x[:, f] <= high
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for f, low, high in self.terms:
            c = F.col(f"q_{STATISTICS[f]}")
            if low is not None:
                out = out & (c > F.lit(low))
            if high is not None:
                out = out & (c <= F.lit(high))
        return out


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, least: int = 20, seed: int = 7) -> list[Rule]:
    """Every root path of gradient-boosted trees for ``y`` in 0, 1, each tree grown on half of the rows. A leaf has ``least`` rows, or a fortieth of them if they are few."""
    least = max(2, min(least, len(y) // 40))
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1).astype(np.int64)
    margin = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = y - p, p * (1 - p) + 1e-6
        sample = rng.random(len(y)) < 0.5
        columns = rng.permutation(x.shape[1])[: max(1, x.shape[1] * 2 // 3)]
        nodes = [((), np.ones(len(y), dtype=bool))]
        for level in range(depth):
            grown = []
            for bounds, rows in nodes:
                use = np.flatnonzero(rows & sample)
                found = _split(bins, gradient, hessian, use, edges, columns, least) if len(use) >= 2 * least else None
                if found is None:
                    continue
                f, b = found
                cut = float(edges[f][b])
                left = bins[:, f] <= b
                for side, low, high in ((left, None, cut), (~left, cut, None)):
                    path = _narrowed(bounds, f, low, high)
                    rules[Rule(path)] = None
                    grown.append((path, rows & side))
            if not grown:
                break
            nodes = grown
        for _, rows in nodes:
            own = rows & sample
            if own.any():
                margin[rows] += rate * gradient[own].sum() / (hessian[own].sum() + 1.0)
    return list(rules)


def _split(bins, gradient, hessian, use, edges, columns, least):
    total_g, total_h = gradient[use].sum(), hessian[use].sum()
    best, at = 1e-6, None
    for f in columns.tolist():
        if not len(edges[f]):
            continue
        n = len(edges[f]) + 1
        own = bins[use, f]
        g, h = np.cumsum(np.bincount(own, gradient[use], n))[:-1], np.cumsum(np.bincount(own, hessian[use], n))[:-1]
        count = np.cumsum(np.bincount(own, minlength=n))[:-1]
        gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
        gain[(count < least) | (len(use) - count < least)] = 0
        b = int(gain.argmax())
        if gain[b] > best:
            best, at = gain[b], (f, b)
    return at


def _narrowed(bounds: tuple, f: int, low: float | None, high: float | None) -> tuple:
    held = {g: (a, b) for g, a, b in bounds}
    a, b = held.get(f, (None, None))
    held[f] = (low if a is None else a if low is None else max(a, low), high if b is None else b if high is None else min(b, high))
    return tuple((g, *held[g]) for g in sorted(held))


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and sparse weights by accelerated proximal gradient steps; columns are scaled while fitting."""
    mean, scale = z.mean(axis=0), np.maximum(z.std(axis=0), 1e-3)
    s = (z - mean) / scale
    n = len(y)
    v = np.full(s.shape[1], 1.0)
    for _ in range(20):  # the largest eigenvalue, by power iteration
        v = s.T @ (s @ v)
        largest = float(np.linalg.norm(v))
        v /= max(largest, 1e-12)
    step = 4 * n / (1.1 * largest + n)
    w, b = np.zeros(s.shape[1]), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    v, c, t = w.copy(), b, 1.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(s @ v + c))) - y
        new = v - step * (s.T @ error) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = c - step * error.mean()
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t_next * (new - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new, new_b, t_next
    w = w / scale
    return b - float(mean @ w), w


@dataclass
class RuleEnsemble:
    intercept: float
    rules: list[tuple[float, Rule]]

    def column(self) -> Column:
        """The score as a Spark column over the statistics."""
        total = F.lit(self.intercept)
        for weight, rule in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for weight, rule in self.rules:
            total += weight * rule.holds(x)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, penalties=(0.0005, 0.001, 0.002, 0.004)) -> RuleEnsemble:
    """Rules from trees, weights by lasso; the penalty is the one of least loss on a fifth of the rows held back."""
    if not len(y) or y.min() == y.max():
        share = (float(y.sum()) + 0.5) / (len(y) + 1)
        return RuleEnsemble(float(np.log(share / (1 - share))), [])
    rules = tree_rules(x, y)
    z = np.stack([r.holds(x) for r in rules], axis=1).astype(np.float32) if rules else np.zeros((len(y), 1), np.float32)
    back = np.random.default_rng(11).random(len(y)) < 0.2
    losses = []
    for penalty in penalties if 0 < back.sum() < len(y) and 0 < y[~back].mean() < 1 else penalties[:1]:
        b, w = lasso_logistic(z[~back], y[~back], penalty, 150)
        p = np.clip(1 / (1 + np.exp(-(z[back] @ w + b))), 1e-9, 1 - 1e-9)
        losses.append(-np.mean(y[back] * np.log(p) + (1 - y[back]) * np.log(1 - p)) if back.any() else 0.0)
    b, w = lasso_logistic(z, y, penalties[int(np.argmin(losses))])
    return RuleEnsemble(b, [(float(w[i]), rules[i]) for i in np.flatnonzero(np.abs(w) > 1e-6)])


def held_out(id_col: str = "doc_id", folds: int = FOLDS) -> Column:
    """crc32(id as text) mod folds = 0; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % folds == 0, F.lit(False))


def labelled_texts(documents: DataFrame, labels: DataFrame, rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(k_id, k_label, text) of at most ``rows`` labelled ids that are not held out: those of the smallest hash; of an id with several texts the least one."""
    usable = labels.where(F.col(f"`{label_col}`").isin(0, 1) & F.col(f"`{id_col}`").isNotNull() & ~held_out(id_col))
    pairs = usable.select(F.col(f"`{id_col}`").cast("long").alias("k_id"), F.col(f"`{label_col}`").cast("int").alias("k_label")).distinct()
    sample = pairs.orderBy(F.xxhash64("k_id"), "k_id", "k_label").limit(rows)
    own = documents.select(F.col(f"`{id_col}`").cast("long").alias("k_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return own.join(F.broadcast(sample), "k_id").groupBy("k_id", "k_label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def train(
    documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality"
) -> RuleEnsemble:
    """A model from at most ``rows`` labelled ids; see labelled_texts()."""
    chosen = labelled_texts(documents, labels, rows, id_col, text_col, label_col)
    found = with_statistics(chosen, ["k_id", "k_label"]).toArrow().sort_by([("k_k_id", "ascending"), ("k_k_label", "ascending")])
    x = np.stack([found.column(f"q_{s}").to_numpy() for s in STATISTICS], axis=1) if found.num_rows else np.zeros((0, len(STATISTICS)))
    return fit(x, found.column("k_k_label").to_numpy().astype(np.float64))


def classify(
    documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = THRESHOLD, id_col: str = "doc_id",
    text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    The score is the probability of label 1 from the whole text alone. Rows whose
    crc32(doc_id) mod 5 is 0 are never learned from. Null and empty texts have the score of
    zero statistics. Labels that are null or not 0 or 1 are ignored; without labels of both
    kinds the score is their smoothed share. Rows may repeat, and each is scored; a null id
    is scored too. An empty table gives no rows. A text is read whole by one task, a slice of
    texts at a time. Other columns are not read.
    """
    model = train(documents, labels, rows, id_col, text_col, label_col)
    scored = with_statistics(documents, [id_col], text_col).withColumn("score", model.column())
    return scored.select(
        F.col(f"k_{id_col}").cast("long").alias("doc_id"), held_out(f"k_{id_col}").alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from their labels; see classify()."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def keep_good(documents: DataFrame, labels: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """``documents`` without rows whose score is below the threshold, all columns and their names kept.

    Learns from ``reference`` (the same documents if none). Null, empty and blank texts have
    the score of zero statistics and stay or go by it; rows that repeat are each judged; an
    empty table stays empty.
    """
    model = train(documents if reference is None else reference, labels)
    names = documents.columns
    inner = [f"c_{i}" for i in range(len(names))]
    scored = with_statistics(numbered(documents), inner, inner[names.index("text")]).withColumn("q_score", model.column()).where(F.col("q_score") >= THRESHOLD)
    return scored.select(*(F.col(f"k_{i}").alias(c) for i, c in zip(inner, names, strict=True)))
