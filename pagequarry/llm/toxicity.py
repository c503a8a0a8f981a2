"""Operator 8, toxicity by cumulative-link ordinal regression on sparse text features.

Words and word beginnings that tell toxic from clean labelled texts are counted across the
training rows, and those that do so beyond chance are the features. Severity has ordered
grades: 0 for clean, and 1 to 3 for toxic texts by thirds of what the other half of the
training texts says about their words, so that no text is graded by its own evidence. One
weight vector is shared by all thresholds, P(grade <= k) = logistic(threshold_k - w.x), and
the result is the expected grade.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import U64, Words, as_bytes, keyed, mix, slices, span_hashes, table
from pagequarry.llm.decontaminate import WORD_BYTES
from pagequarry.llm.quality import held_out, labelled_texts
from pagequarry.session import settle

#: Labelled ids that a model learns from at most.
TRAIN_ROWS = 20_000
GRADES = 4
#: Bytes of the word beginnings that are features besides whole words: inflected and compound forms share them.
BEGINNINGS = (4, 5, 6, 7)
#: Likelihood ratio that a feature needs; chance alone gives one word in ten thousand as much.
LEAST_EVIDENCE = 15.0


def word_counts(texts: list[bytes]):
    """(text, hash, count) arrays of the distinct words and word beginnings of each text, a slice at a time, with the slice's first text."""
    for lo, hi in slices(texts):
        words = Words(texts[lo:hi], WORD_BYTES, lower=True)
        found, owner = [words.hashes()], [words.doc]
        for size in BEGINNINGS:
            long = words.ends - words.starts > size
            found.append(mix(span_hashes(words.data, words.starts[long], words.starts[long] + size) + U64(size)))
            owner.append(words.doc[long])
        h, d = np.concatenate(found), np.concatenate(owner)
        by = np.lexsort((h, d))
        h, d = h[by], d[by]
        new = np.ones(len(by), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        at = np.flatnonzero(new)
        yield d[at] + lo, h[at], np.diff(np.concatenate([at, [len(by)]])), words.counts, lo


def log_odds(a, b, toxic, clean, log):
    """How much likelier a word of ``a`` toxic and ``b`` clean texts makes toxicity, smoothed."""
    return log((a + 0.5) / (toxic - a + 0.5)) - log((b + 0.5) / (clean - b + 0.5))


def telling_words(chosen: DataFrame) -> np.ndarray:
    """Hashes of the words and beginnings that tell the label beyond chance, sorted; as many as the bounded sample has."""

    def run(batches):
        for batch in batches:
            toxic = np.asarray(batch.column("k_label").to_pylist(), dtype=np.int64)
            for doc, word, _, _, _ in word_counts(as_bytes(batch.column("text"))):
                t = toxic[doc]
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(t), pa.array(1 - t)], names=["word", "toxic", "clean"])

    toxic, clean = chosen.agg(F.coalesce(F.sum("k_label"), F.lit(0)), F.coalesce(F.sum(1 - F.col("k_label")), F.lit(0))).first()
    if not toxic or not clean:
        return np.empty(0, np.uint64)
    counted = chosen.mapInArrow(run, "word long, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    share = toxic / (toxic + clean)
    n = F.col("a") + F.col("b")
    # the likelihood ratio of the word's texts against their expected shares
    part = lambda x, s: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / (n * s))).otherwise(0.0)
    best = counted.where(2 * (part("a", share) + part("b", 1 - share)) >= LEAST_EVIDENCE).select("word").toArrow()
    return np.sort(best.column("word").to_numpy().astype(np.int64).view(np.uint64))


class Features:
    """Sparse rows: for each text the places of its feature words and log(1 + count)."""

    def __init__(self, vocabulary: np.ndarray, texts: list[bytes]):
        rows, columns, values, sizes = [], [], [], []
        for doc, word, count, words, _ in word_counts(texts):
            at = np.searchsorted(vocabulary, word)
            at[at == len(vocabulary)] = 0
            hit = vocabulary[at] == word if len(vocabulary) else np.zeros(len(word), bool)
            rows.append(doc[hit])
            columns.append(at[hit])
            values.append(np.log1p(count[hit]))
            sizes.append(words)
        join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        self.n, self.row, self.column, self.value, self.words = len(texts), join(rows), join(columns), join(values), join(sizes)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.n) if len(self.row) else np.zeros(self.n)

    def back(self, g: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.column, self.value * g[self.row], width) if len(self.row) else np.zeros(width)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


class OrdinalModel:
    """Cumulative-link model: increasing thresholds, one weight vector."""

    def __init__(self, thresholds: np.ndarray, weights: np.ndarray):
        self.thresholds, self.weights = thresholds, weights

    def above(self, x: Features) -> np.ndarray:
        """P(grade > k) for each threshold k, one row for each text."""
        return logistic(x.dot(self.weights)[:, None] - self.thresholds[None, :])

    @classmethod
    def fit(cls, x: Features, grade: np.ndarray, width: int, grades: int = GRADES, ridge: float = 1e-4, rounds: int = 300) -> OrdinalModel:
        """Adam on the negative log likelihood; gaps between thresholds are exponentials, so they stay in order."""
        share = np.clip([(grade > k).mean() if len(grade) else 0.0 for k in range(grades - 1)], 1e-4, 1 - 1e-4)
        theta = np.log((1 - share) / share)
        theta = np.maximum.accumulate(theta + np.arange(grades - 1) * 1e-3)
        free = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 1e-3)), np.zeros(width)])
        first, second = np.zeros_like(free), np.zeros_like(free)
        k = grades - 1
        for t in range(1, rounds + 1):
            gaps = np.exp(free[1:k])
            theta, w = free[0] + np.concatenate([[0], np.cumsum(gaps)]), free[k:]
            score = x.dot(w)
            bounds = np.concatenate([[-np.inf], theta, [np.inf]])
            high, low = logistic(bounds[grade + 1] - score), logistic(bounds[grade] - score)
            p = np.maximum(high - low, 1e-12)
            d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
            g_score = (d_high - d_low) / max(1, x.n)
            g_theta = np.array([(d_low[grade == i + 1].sum() - d_high[grade == i].sum()) / max(1, x.n) for i in range(k)])
            later = np.cumsum(g_theta[::-1])[::-1]
            gradient = np.concatenate([later[:1], later[1:] * gaps, x.back(g_score, width) + ridge * w])
            first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
            free = free - 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        return cls(free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:k]))]), free[k:])


def grades_of(x: Features, toxic: np.ndarray, half: np.ndarray, width: int) -> np.ndarray:
    """0 for clean texts, and 1 to 3 for toxic ones by thirds of the log odds that the words have in the texts of the other half."""
    weight = np.zeros(x.n)
    for own in (0, 1):
        others = half != own
        rows = others[x.row]
        a = np.bincount(x.column[rows & (toxic[x.row] == 1)], minlength=width)
        b = np.bincount(x.column[rows & (toxic[x.row] == 0)], minlength=width)
        odds = log_odds(a, b, (toxic[others] == 1).sum(), (toxic[others] == 0).sum(), np.log)
        mine = half == own
        weight[mine] = x.dot(np.maximum(odds, 0))[mine]
    cuts = np.quantile(weight[toxic == 1], [1 / 3, 2 / 3]) if (toxic == 1).any() else np.zeros(2)
    return np.where(toxic == 1, 1 + (weight > cuts[0]).astype(np.int64) + (weight > cuts[1]), 0)


def train(
    documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic"
) -> tuple[np.ndarray, OrdinalModel]:
    """Feature words and the model, from at most ``rows`` labelled ids that are not held out: those of the smallest hash."""
    chosen = settle(labelled_texts(documents, labels, rows, id_col, text_col, label_col), "toxicity-sample")
    words = telling_words(chosen)

    def rowwise(batches):
        for batch in batches:
            x = Features(words, as_bytes(batch.column("text")))
            at = np.searchsorted(x.row, np.arange(x.n + 1))
            columns = [x.column[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]
            values = [x.value[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]
            arrays = [
                batch.column("k_id"), batch.column("k_label"), pa.array(columns, pa.list_(pa.int64())),
                pa.array(values, pa.list_(pa.float64()))
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["k_id", "k_label", "columns", "values"])

    # one row for each of a bounded number of ids
    found = chosen.mapInArrow(
        rowwise, "k_id long, k_label int, columns array<long>, values array<double>"
    ).toArrow().sort_by([("k_id", "ascending"), ("k_label", "ascending")])
    x = Features(words, [])
    sizes = found.column("columns").combine_chunks().value_lengths().to_numpy(zero_copy_only=False) if found.num_rows else np.empty(0, np.int64)
    x.n, x.row = found.num_rows, np.repeat(np.arange(found.num_rows), sizes)
    x.column = found.column("columns").combine_chunks().flatten().to_numpy() if found.num_rows else np.empty(0, np.int64)
    x.value = found.column("values").combine_chunks().flatten().to_numpy() if found.num_rows else np.empty(0)
    toxic = found.column("k_label").to_numpy().astype(np.int64)
    half = (mix(found.column("k_id").to_numpy().astype(np.int64).view(U64).copy()) & U64(1)).astype(np.int64)
    return words, OrdinalModel.fit(x, grades_of(x, toxic, half, len(words)), len(words))


def severity(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    rows: int = TRAIN_ROWS
) -> DataFrame:
    """(doc_id, held_out, expected_severity 0 to 3, grade, toxic_probability, toxic) of every whole text.

    The grade is the likeliest, of equally likely ones the lowest; toxic is 1 if P(grade >= 1)
    is at least a half. Null and empty texts have no features. Labels that are null or not 0
    or 1 are ignored; rows whose crc32(doc_id) mod 5 is 0 are never learned from. Rows may
    repeat and each is scored; an empty table gives no rows. Without labels nothing is toxic.
    A text is read whole by one task, a slice of texts at a time. Other columns are not read.
    """
    words, model = train(documents, labels, rows, id_col, text_col, label_col)

    def run(batches):
        for batch in batches:
            above = model.above(Features(words, as_bytes(batch.column("text"))))
            each = np.diff(np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1), axis=1) * -1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(above.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int64)),
                    pa.array(above[:, 0]), pa.array((above[:, 0] >= 0.5).astype(np.int64))
                ],
                names=["doc_id", "expected_severity", "grade", "toxic_probability", "toxic"]
            )

    scored = keyed(documents, id_col, text_col).mapInArrow(
        run, "doc_id long, expected_severity double, grade long, toxic_probability double, toxic long"
    )
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "expected_severity", "grade", "toxic_probability", "toxic")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Severity of all documents, learned from their labels; see severity()."""
    return severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
