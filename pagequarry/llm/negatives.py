"""Operator 12, hard negatives by a Voronoi-partition distributed kNN join.

Inner products become distances: a row's vector gets one component more, so that all rows have
one norm, and an anchor's gets zero there; then the higher a row's product with an anchor, the
nearer it is. Pivots, a bounded sample of rows, part the space into Voronoi cells. Neighbouring
cells form a group until they hold enough anchors. A first join meets each anchor with the
rows of its own group, which bounds how far its true answers can be. By the distances to the
pivots (triangle inequality and the hyperplanes between cells) a row is then sent only to the
groups with a cell whose anchors it might serve, and joined there exactly. Positives take
these two joins, and negatives two more, whose answers lie in a ring of scores for each
positive.

Groups of many anchors are cut into parts, and what a group gets into salts of a bounded number
of rows, so no cell, however full, is one task's. A row is sent once for each part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.common import U64, mix, release, table
from pagequarry.llm.topk import products, size_class
from pagequarry.session import discard, settle

SCALE = 256
#: Pivots and their components at most, and rows to each pivot from which on there are so many.
PIVOTS, PIVOT_VALUES, ROWS_EACH = 1024, 1 << 20, 256
#: Anchors of a part, and rows of a salt and their components, at most on average; scores that are held at once.
PART_ANCHORS, SALT_ROWS, SALT_VALUES, SCORES = 1024, 1 << 13, 1 << 20, 1 << 20
#: Classes of labels for which groups keep bounds of their own.
LABEL_CLASSES = 64
#: Distances are in doubles; a share of the squared ones that covers their rounding.
SLACK = 1e-9
LONG = np.iinfo(np.int64)

ROW = "cell long, dist double, label long, vec_id long, v array<long>"
PARTIAL = "anchor_id long, positive int, positive_id long, positive_score long, vec_id long, score long"


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int, relabel: Column | None) -> DataFrame:
    """(vec_id, label, v): floored components as longs; rows without an id, label or vector, or with a null or non-finite component, are left out."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    label = F.col(f"`{label_col}`").cast("long")
    kept = vectors.where(F.col(f"`{id_col}`").isNotNull() & label.isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False)))
    whole = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("long"))
    return kept.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), (label if relabel is None else relabel).alias("label"), whole.alias("v"))


def matrix(lists: pa.ListArray, most: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) for each length of vectors in a column, of at most ``most`` vectors."""
    size, flat, first = np.asarray(lists.value_lengths()), np.asarray(lists.values), np.asarray(lists.offsets)[:-1]
    out = []
    for width in np.unique(size).tolist():
        every = np.flatnonzero(size == width)
        for at in np.split(every, range(most, len(every), most)) if most else [every]:
            out.append((at, flat[first[at][:, None] + np.arange(width)[None, :]] if width else np.zeros((len(at), 0), np.int64)))
    return out


class Pivots:
    """Rows of the sample as points of one norm; shorter vectors end in zeros."""

    def __init__(self, vectors: list[list[int]], norm: float):
        self.norm, self.width = norm, max(map(len, vectors))
        self.points = np.zeros((len(vectors), self.width))
        for i, v in enumerate(vectors):
            self.points[i, : len(v)] = v
        self.extra = np.sqrt(np.maximum(norm - (self.points**2).sum(axis=1), 0.0))
        self.squares = (self.points**2).sum(axis=1) + self.extra**2
        between = self.squares[:, None] + self.squares[None, :] - 2 * (self.points @ self.points.T + np.outer(self.extra, self.extra))
        self.between = np.sqrt(np.maximum(between, 0.0))

    def squared(self, vectors: np.ndarray, anchors: bool) -> np.ndarray:
        """Squared distances of rows, or of anchors, from all pivots."""
        x = vectors.astype(np.float64)
        own = (x**2).sum(axis=1)
        extra = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(self.norm - own, 0.0))
        width = min(self.width, x.shape[1])
        inner = x[:, :width] @ self.points[:, :width].T + np.outer(extra, self.extra)
        return np.maximum((own + extra**2)[:, None] + self.squares[None, :] - 2 * inner, 0.0)


def celled(pivots: Broadcast, anchors: bool):
    """Rows with the nearest pivot and their distance from it."""

    def run(batches):
        for batch in batches:
            cell, dist = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for at, vectors in matrix(batch.column("v"), max(1, SCORES // len(pivots.value.points))):
                squared = pivots.value.squared(vectors, anchors)
                cell[at] = squared.argmin(axis=1)
                dist[at] = np.sqrt(squared[np.arange(len(at)), cell[at]])
            arrays = [pa.array(cell), pa.array(dist), batch.column("label"), batch.column("vec_id"), batch.column("v")]
            yield pa.RecordBatch.from_arrays(arrays, names=["cell", "dist", "label", "vec_id", "v"])

    return run


class Reach:
    """For each cell with anchors its group, how far its anchors lie from its pivot, and for each class of labels how far from an anchor a row may be and still serve it."""

    def __init__(self, cells: np.ndarray, groups: np.ndarray, radius: np.ndarray, reach: np.ndarray, same: bool):
        self.cells, self.groups, self.radius, self.reach, self.same = cells, groups, radius, reach, same
        self.member = (groups[:, None] == np.arange(groups.max(initial=-1) + 1)[None, :]).astype(np.float32)

    def served(self, pivots: Pivots, squared: np.ndarray, cell: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Which rows might serve which cells' anchors."""
        slack = SLACK * (squared.max(initial=0.0) + pivots.norm) + 1e-6
        to_cell = np.sqrt(squared[:, self.cells])
        near = np.maximum(to_cell - self.radius[None, :], 0.0)
        # a cell's anchors lie on its pivot's side of the plane between that pivot and the row's
        apart = pivots.between[cell][:, self.cells]
        gap = squared[:, self.cells] - squared[np.arange(len(cell)), cell][:, None]
        plane = np.divide(gap, 2 * apart, out=np.zeros_like(gap), where=apart > math.sqrt(slack))
        near = np.maximum(near, plane)
        limit = self.reach[:, class_of(label)].T if self.same else self.reach.max(axis=1)[None, :]
        return near**2 <= np.square(np.maximum(limit, 0.0)) * (1 + SLACK) + np.where(limit < 0, -np.inf, slack)

    def groups_of(self, served: np.ndarray) -> np.ndarray:
        """Which rows go to which groups."""
        return served.astype(np.float32) @ self.member > 0


def grouped(between: np.ndarray, anchors: dict[int, int], enough: int) -> dict[int, int]:
    """Cells in groups: of the cells left, the first one and those nearest to it, until they hold ``enough`` anchors."""
    left, out, number = sorted(anchors), {}, 0
    while left:
        near = sorted(left, key=lambda c: (between[left[0], c], c))
        near.remove(left[0])
        have = 0
        for c in [left[0], *near]:
            if have and have + anchors[c] > enough:
                break
            out[c] = number
            have += anchors[c]
        left = [c for c in left if c not in out]
        number += 1
    return out


def class_of(label: np.ndarray) -> np.ndarray:
    return (mix(label.astype(np.int64).view(U64)) % U64(LABEL_CLASSES)).astype(np.int64)


def routed(pivots: Broadcast, reach: Broadcast, count_only: bool):
    """Each row for every group that it might serve, or only how many rows each group gets."""

    def run(batches):
        r = reach.value
        total = np.zeros(r.member.shape[1], dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, label = np.asarray(batch.column("cell")), np.asarray(batch.column("label"))
            row, group = [], []
            for at, vectors in matrix(batch.column("v"), max(1, SCORES // len(pivots.value.points))):
                hit = r.groups_of(r.served(pivots.value, pivots.value.squared(vectors, False), cell[at], label[at]))
                total += hit.sum(axis=0)
                i, g = np.nonzero(hit)
                row.append(at[i])
                group.append(g)
            if not count_only:
                take = pa.array(np.concatenate(row))
                arrays = [pa.array(np.concatenate(group)), *(batch.column(c).take(take) for c in ("label", "vec_id", "v"))]
                yield pa.RecordBatch.from_arrays(arrays, names=["group", "label", "vec_id", "v"])
        if count_only:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["group", "n"])

    return run


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller ids."""
    if len(scores) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return at[np.lexsort((ids[at], ~scores[at]))[:k]]
    return np.lexsort((ids, ~scores))[:k]


def exact_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products, of which what no long can hold becomes the largest or smallest one."""
    out = np.empty((len(anchors), len(rows)), dtype=np.int64)
    a_size, r_size = size_class(anchors), size_class(rows)
    for a in np.unique(a_size):
        for b in np.unique(r_size):
            i, j = np.flatnonzero(a_size == a), np.flatnonzero(r_size == b)
            out[np.ix_(i, j)] = products(anchors[i], rows[j], max(a, b))
    return out


def ring(positive_score: int, low: int, high: int) -> tuple[int, int]:
    """Least and largest score of a negative: low and high hundredths of the positive's."""
    return -(-low * positive_score // 100), high * positive_score // 100


def meeting(positives: int, negatives: int, low: int, high: int, same: bool):
    """Of one part's anchors and one salt's rows, each anchor's best rows of its label, or each positive's best of other labels in its ring."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        release()
        out: list[tuple] = []
        if anchors.num_rows and rows.num_rows:
            of_length = {v.shape[1]: (at, v) for at, v in matrix(rows.column("v").combine_chunks())}
            row_ids, row_labels = np.asarray(rows.column("vec_id")), np.asarray(rows.column("label"))
            a_ids, a_labels = anchors.column("vec_id").to_pylist(), anchors.column("label").to_pylist()
            wanted = None if same else anchors.column("positives").to_pylist()
            for a_at, a_vectors in matrix(anchors.column("v").combine_chunks()):
                at, vectors = of_length.get(a_vectors.shape[1], (np.empty(0, np.int64), None))
                if not len(at):
                    continue
                ids, labels, step = row_ids[at], row_labels[at], max(1, SCORES // len(at))
                for k, a in enumerate(a_at.tolist()):
                    if k % step == 0:
                        block = exact_scores(a_vectors[k : k + step], vectors)
                    scores = block[k % step]
                    mine = (labels == a_labels[a]) == same
                    if same:
                        own = np.flatnonzero(mine & (ids != a_ids[a]))
                        best = own[best_of(scores[own], ids[own], positives)]
                        out += [(a_ids[a], 0, None, None, i, s) for i, s in zip(ids[best].tolist(), scores[best].tolist(), strict=True)]
                        continue
                    own = np.flatnonzero(mine)
                    found, found_ids = scores[own], ids[own]
                    for p in wanted[a] or []:
                        least, most = ring(p["positive_score"], low, high)
                        least = max(least, p["floor"]) if p["floor"] is not None else least
                        fit = np.flatnonzero((found >= least) & (found <= most))
                        best = fit[best_of(found[fit], found_ids[fit], negatives)]
                        head = (a_ids[a], p["positive"], p["positive_id"], p["positive_score"])
                        out += [(*head, i, s) for i, s in zip(found_ids[best].tolist(), found[best].tolist(), strict=True)]
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
        names = [c.split()[0] for c in PARTIAL.split(", ")]
        columns = zip(*out, strict=True) if out else [[]] * len(names)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def joined(anchors: DataFrame, rows: DataFrame, parts: dict[int, int], sizes: dict[int, int], task, salt_rows: int) -> DataFrame:
    """Anchors (group, part, ...) against rows (group, label, vec_id, v), in parts and salts; ``sizes`` has the rows of each group."""
    spark = anchors.sparkSession
    salts = [(g, parts[g], max(1, math.ceil(n / salt_rows))) for g, n in sizes.items() if n and g in parts]
    many = F.broadcast(spark.createDataFrame(salts, "group long, parts long, salts long"))  # a row for each group
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    own = anchors.join(many, "group").withColumn("salt", upto("salts")).drop("parts", "salts")
    dealt = rows.join(many, "group").withColumn("salt", F.pmod(F.xxhash64("vec_id", "v"), F.col("salts"))).withColumn("part", upto("parts")).drop("parts", "salts")
    keys = ["group", "part", "salt"]
    return own.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(task, PARTIAL)


def firsts(partial: DataFrame, keys: list[str], k: int, name: str) -> DataFrame:
    """The k highest of each key over all parts and salts, ties by smaller ids, with their rank from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("vec_id"))
    return partial.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def chosen_pivots(pool: DataFrame, count: int, pivots: int) -> list[list[int]]:
    """About ``pivots`` of the distinct vectors, as their hashes say; the driver gets no more than that."""
    most = min(pivots, max(4, count // ROWS_EACH))
    share = min(1.0, 8 * most / count)
    some = pool.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").distinct()
    found = [r["v"] for r in some.orderBy(F.xxhash64(F.lit(1), "v"), "v").limit(most).collect()]
    return found or [pool.orderBy("vec_id", "v").first()["v"]]


def distance(norm: float, own: Column, score: Column) -> Column:
    """How far a row is from an anchor of squared norm ``own``, by its score."""
    return F.sqrt(F.greatest(F.lit(0.0), F.lit(norm) + own - 2 * score.cast("double")))


def reach_of(spark, anchors: DataFrame, limits: DataFrame, groups: dict[int, int], same: bool) -> Broadcast:
    """Cells' radii and, by class of labels, the largest of their anchors' ``limit``: at most a number for each cell and class comes to the driver."""
    radius = {r["cell"]: r["radius"] for r in anchors.groupBy("cell").agg(F.max("dist").alias("radius")).collect()}
    kept = np.array(sorted(radius), dtype=np.int64)
    reach = np.full((len(kept), LABEL_CLASSES), -1.0)

    def by_class(batches):
        most: dict[tuple[int, int], float] = {}
        for batch in batches:
            for c, y, d in zip(batch.column("cell").to_pylist(), class_of(np.asarray(batch.column("label"))).tolist(), batch.column("limit").to_pylist(), strict=True):
                most[c, y] = max(most.get((c, y), -1.0), d)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in most], pa.int64()), pa.array([k[1] for k in most], pa.int64()), pa.array(list(most.values()), pa.float64())],
            names=["cell", "class", "limit"]
        )

    found = limits.select("cell", "label", "limit").mapInArrow(by_class, "cell long, class long, limit double")
    for r in found.groupBy("cell", "class").agg(F.max("limit").alias("limit")).collect():
        reach[np.searchsorted(kept, r["cell"]), r["class"]] = r["limit"]
    of = np.array([groups[c] for c in kept.tolist()], dtype=np.int64)
    return spark.sparkContext.broadcast(Reach(kept, of, np.array([radius[c] for c in kept.tolist()]), reach, same))


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, relabel: Column | None = None,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE, pivots: int = PIVOTS,
    part_anchors: int = PART_ANCHORS, salt_rows: int = SALT_ROWS
) -> DataFrame:
    """For each anchor and each of its ``positives`` best other rows of its label, the ``negatives`` best rows of other labels whose score is from ``low`` to ``high`` hundredths of the positive's.

    A score is the integer inner product of components floor(scale * x); ties go to smaller
    ids. One row for each negative: anchor_id, positive_id, rank (from 1), negative_id,
    positive_score, negative_score. ``is_anchor`` and ``relabel`` are of the columns vec_id
    and label. Rows without an id, a label or a vector, or with a null or non-finite
    component, take no part; vectors of different lengths are not compared; an empty vector
    scores zero with others. Rows that repeat an id are rows of their own, but for anchors,
    of which the one with the smallest vector, then label, counts; rows of an anchor's own id
    are not its positives. What no long can hold becomes the largest or smallest one. An
    empty table gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    pool = settle(usable(vectors, id_col, vector_col, label_col, scale, relabel), "negatives-pool")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    count, norm, longest = pool.agg(F.count("*"), F.max(square), F.max(F.size("v"))).first()
    if not count:
        return spark.createDataFrame([], empty)
    salt_rows = max(1, min(salt_rows, SALT_VALUES // max(1, longest)))
    cells = spark.sparkContext.broadcast(Pivots(chosen_pivots(pool, count, max(1, min(pivots, PIVOT_VALUES // max(1, longest)))), norm))
    rows = settle(pool.mapInArrow(celled(cells, False), ROW), "negatives-rows")
    asked = pool.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("a")).select("vec_id", "a.label", "a.v")
    anchors = asked.mapInArrow(celled(cells, True), ROW)
    full = {r["cell"]: r["count"] for r in anchors.groupBy("cell").count().collect()}
    if not full:
        return spark.createDataFrame([], empty)
    groups = grouped(cells.value.between, full, part_anchors)
    # anchors of a group in parts of a bounded number, by a hash
    parts = {g: math.ceil(sum(n for c, n in full.items() if groups[c] == g) / part_anchors) for g in set(groups.values())}
    places = F.broadcast(spark.createDataFrame([(c, g, parts[g]) for c, g in groups.items()], "cell long, group long, parts long"))
    anchors = settle(
        anchors.join(places, "cell").select(
            "cell", "group", F.pmod(F.xxhash64("vec_id"), F.col("parts")).alias("part"), "dist", "label", "vec_id", "v", square.alias("square")
        ), "negatives-anchors"
    )
    plain = anchors.select("group", "part", "label", "vec_id", "v")
    home = rows.join(places, "cell").select("group", "label", "vec_id", "v")
    at_home = {r["group"]: r["count"] for r in home.groupBy("group").count().collect()}

    def both(own: DataFrame, same: bool, keys: list[str], k: int, floor, label: str) -> DataFrame:
        """The two joins: with an anchor's own group, then with all that may be better than what that has shown."""
        task = meeting(positives, negatives, low, high, same)
        first = settle(firsts(joined(own(None), home, parts, at_home, task, salt_rows), keys, k, "rank"), f"negatives-{label}")
        # a score that the k-th best cannot be below, where the own group has as many
        known = first.groupBy(*keys).agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") == k).drop("n")
        floors = floor(known)
        reach = reach_of(spark, anchors, floors.select("cell", "label", "limit"), groups, same)
        sent = rows.mapInArrow(routed(cells, reach, True), "group long, n long").groupBy("group").agg(F.sum("n").alias("n"))
        sizes = {r["group"]: r["n"] for r in sent.collect()}
        some = rows.mapInArrow(routed(cells, reach, False), "group long, label long, vec_id long, v array<long>")
        out = settle(firsts(joined(own(floors), some, parts, sizes, task, salt_rows), keys, k, "rank"), f"negatives-{label}")
        reach.unpersist()
        discard(first)
        return out

    far = F.lit(float("inf"))
    # the least long may stand for any lower score
    bound = F.when(F.col("score") > int(LONG.min), distance(norm, F.col("square"), F.col("score"))).otherwise(far)
    known = lambda unknown: F.when(F.col("score").isNotNull(), bound).otherwise(unknown)

    def positive_floors(found: DataFrame) -> DataFrame:
        return anchors.join(found.withColumnRenamed("anchor_id", "vec_id"), "vec_id", "left").withColumn("limit", known(far))

    best = both(lambda _: plain, True, ["anchor_id"], positives, positive_floors, "positives")
    pairs = settle(
        best.select("anchor_id", F.col("rank").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")),
        "negatives-pairs"
    )
    least = F.ceil(F.col("positive_score").cast("decimal(38,0)") * low / 100).cast("decimal(38,0)").cast("double")

    def negative_floors(found: DataFrame) -> DataFrame:
        of = pairs.join(found, ["anchor_id", "positive"], "left").withColumnRenamed("anchor_id", "vec_id").join(anchors, "vec_id")
        # no positive of a negative score has a ring, and none needs a row
        limit = known(distance(norm, F.col("square"), least))
        return of.withColumn("limit", F.when(F.col("positive_score") < 0, F.lit(-1.0)).otherwise(limit)).withColumnRenamed("score", "floor")

    def with_positives(floors: DataFrame | None) -> DataFrame:
        of = pairs.withColumnRenamed("anchor_id", "vec_id").withColumn("floor", F.lit(None).cast("long")) if floors is None else floors
        listed = of.groupBy("vec_id").agg(F.collect_list(F.struct("positive", "positive_id", "positive_score", "floor")).alias("positives"))
        return plain.join(listed, "vec_id")

    worst = both(with_positives, False, ["anchor_id", "positive"], negatives, negative_floors, "found")
    return worst.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score")
    )


def op12_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose id is divisible by 50, with other labels where it is divisible by 7; see hard_negatives()."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, relabel=moved)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
flat AS (SELECT vec_id, label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM v),
scores AS (
  SELECT a.vec_id AS a, c.vec_id AS c, a.label = c.label AS same, sum(a.x * c.x)::BIGINT AS s
  FROM flat a JOIN flat c ON a.i = c.i WHERE a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id GROUP BY ALL),
positives AS (SELECT a, c AS p, s AS ps FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, c) <= 5),
found AS (
  SELECT positives.a AS a, p, c, ps, s, row_number() OVER (PARTITION BY positives.a, p ORDER BY s DESC, c) AS rank
  FROM positives JOIN scores ON positives.a = scores.a AND NOT same AND 50 * ps <= 100 * s AND 100 * s <= 95 * ps)
SELECT a AS anchor_id, p AS positive_id, rank::INTEGER AS rank, c AS negative_id, ps AS positive_score, s AS negative_score FROM found WHERE rank <= 3
"""
