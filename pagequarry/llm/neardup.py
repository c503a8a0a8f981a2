"""Near-copies of texts that share most of their five-word shingles, by exact Jaccard similarity.

Three sieves, each finer. Texts meet under the blocks of their 384-bit SimHashes, one more than
``NEAR`` bits, so that two that differ in so many or fewer always do: operator 9's share of bits.
As a similarity of 0.8 is beyond what blocks reach, they also meet under keys of their MinHashes:
``BANDS`` keys of ``ROWS`` minimums each, so that two texts of a Jaccard similarity s meet with a
probability of 1 - (1 - s**ROWS)**BANDS, which is 0.9999 at 0.8 and does not depend on the number
of documents. What meets is linked where 384-bit SimHashes differ in no more bits than are expected at a
similarity of ``SIEVE``; at 0.8 that is 7 standard deviations away. Last, the texts of each
group so linked are read again, and two of them are copies if their shingles' Jaccard
similarity, counted exactly, is 0.8 or more.

A group of very many different texts is confirmed in cells of bounded size: all are compared
with a few of their own, which links nearly all of a clump to one component; each cell then
holds a part of that and every text that is not in it, so that whatever links those to each
other or to the clump is found in some cell.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import NONSPACE, U64, Words, as_bytes, every_gram, keyed, mix, release, slices
from pagequarry.llm.graph import components, spread_join
from pagequarry.llm.hamming import TILE, groups
from pagequarry.session import settle

SHINGLE, SIMILARITY, SIEVE = 5, 0.8, 0.45
BANDS, ROWS = 24, 5
BITS = 384
LANES = BITS // 64
#: Bits in which two SimHashes may differ and are sure to share a block; operator 9 links 2 of 64.
NEAR = 2 * BITS // 64
STEP = 1 << 13
#: Rows of one key that are compared with each other; more are linked to its first, for the last sieve to judge.
KEY_ROWS = 1 << 15
#: Texts of one group, or cell of a group, that one task confirms, and texts that all of a larger group are compared with.
CELL_ROWS, PIVOTS = 1024, 16
MULTIPLES = mix(np.arange(1, BANDS * ROWS + 1, dtype=U64)) | U64(1)


def limit_of(similarity: float, bits: int = BITS) -> int:
    """Bits in which two equally long texts of this Jaccard similarity are expected to differ."""
    return int(bits * np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE):
    """Each text's distinct shingles as sorted hashes, none without words. A shorter text is one shingle."""
    for lo, hi in slices(texts):
        words = Words(texts[lo:hi], NONSPACE, lower=True)
        hashes = words.hashes()
        every = every_gram(hashes, shingle)
        for d in range(hi - lo):
            first, n = words.first[d], words.counts[d]
            if n >= shingle:
                yield np.unique(every[first : first + n - shingle + 1])
            else:
                yield every_gram(hashes[first : first + n], n) if n else np.empty(0, dtype=U64)


def signature(own: np.ndarray) -> bytes:
    """The majority of each bit over distinct shingles; zeros without any."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(own), STEP):
        lanes = np.stack([mix(own[at : at + STEP] + U64(0x9E3779B97F4A7C15 * (i + 1) % 2**64)) for i in range(LANES)], axis=1)
        ones += np.unpackbits(lanes.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(own), bitorder="little").tobytes()


def set_hash(own: np.ndarray) -> int:
    """64 bits that stand for a set of shingles, as a signed long."""
    return int.from_bytes(blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Each set's meeting places, (sets, BANDS); no set may be empty. The minimums are of odd multiples of the hashes."""
    keys = np.zeros((len(sets), BANDS), dtype=U64)
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sets):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - sizes[lo] + STEP, "right")))
        flat, starts = np.concatenate(sets[lo:hi]), np.concatenate([[0], np.cumsum(sizes[lo : hi - 1])])
        for band in range(BANDS):
            key = np.full(hi - lo, band, dtype=U64)
            for row in range(ROWS):
                key = mix(key * U64(0x9FB21C651E98DF25) ^ np.minimum.reduceat(flat * MULTIPLES[band * ROWS + row], starts))
            keys[lo:hi, band] = key
        lo = hi
    return keys


def block_keys(sig: Column) -> list[Column]:
    """Keys of a SimHash's NEAR + 1 blocks of whole bytes: two that differ in NEAR bits or fewer share one."""
    edges = [BITS // 8 * i // (NEAR + 1) for i in range(NEAR + 2)]
    return [F.xxhash64(F.lit(i), F.substring(sig, lo + 1, hi - lo)) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))]


def meeting(limit: int):
    """Links of rows that come sorted by block and its value; stars, so linear in what meets."""

    def linked(key, sig, node, cut):
        bounds = np.concatenate([[0], cut])
        out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        size = np.diff(bounds)
        two = bounds[:-1][size == 2]
        if len(two):
            a, b = sig[two], sig[two + 1]
            near = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= limit
            out.append((node[two[near] + 1], node[two[near]]))
        for i in np.flatnonzero(size > 2):
            lo, hi = bounds[i], bounds[i + 1]
            label = groups(sig[lo:hi], limit)
            moved = np.flatnonzero(label != np.arange(hi - lo))
            out.append((node[lo:hi][moved], node[lo:hi][label[moved]]))
        u, v = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def run(batches):
        release()
        held, crowd = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node = np.asarray(batch.column("key")), np.asarray(batch.column("node"))
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), U64).reshape(len(key), LANES)
            if held:
                key, sig, node = np.concatenate([held[0], key]), np.concatenate([held[1], sig]), np.concatenate([held[2], node])
            if crowd is not None:
                # the rest of a key whose first rows have been compared
                more = int(np.searchsorted(key != crowd[0], True))
                yield pa.RecordBatch.from_arrays([pa.array(node[:more]), pa.array(np.full(more, crowd[1]))], names=["u", "v"])
                key, sig, node = key[more:], sig[more:], node[more:]
                if not len(key):
                    continue
                crowd = None
            cut = np.flatnonzero(np.diff(key)) + 1
            last = cut[-1] if len(cut) else 0
            held = key[last:], sig[last:], node[last:]
            yield linked(key[:last], sig[:last], node[:last], cut)
            if len(held[0]) > KEY_ROWS:
                yield linked(*held, np.array([len(held[0])]))
                crowd, held = (held[0][0], held[2][0]), None
        if held:
            yield linked(*held, np.array([len(held[0])]))

    return run


def exact_groups(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set the first one that links of a Jaccard similarity of at least ``similarity`` lead to.

    Two such sets share one of their rarest shingles (a prefix of each set in an order that
    all share), so only sets that do are counted; members of a group are compared with the
    sets that are in no group yet.
    """
    n = len(sets)
    label, sizes = np.arange(n), np.array([len(x) for x in sets], dtype=np.int64)
    least = np.ceil(similarity * sizes - 1e-9).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    doc = np.repeat(np.arange(n), sizes)
    ids = ids[np.lexsort((ids, np.bincount(ids)[ids], doc))]
    ahead = np.arange(len(ids)) - starts[doc] <= (sizes - least)[doc]
    mark = np.zeros(len(ids) + 1, dtype=np.int64)
    alive = np.ones(n, dtype=bool)
    first = members = None
    indexed = 2 * n + 1

    def linked(x: int) -> np.ndarray:
        own = ids[starts[x] : starts[x + 1]]
        front = own[: sizes[x] - least[x] + 1]
        near = np.unique(members[spans(first[front], first[front + 1])])
        near = near[alive[near] & (sizes[near] >= least[x]) & (least[near] <= sizes[x])]
        out = []
        mark[own] = 1
        for lo in range(0, len(near), TILE):
            part = near[lo : lo + TILE]
            both = np.add.reduceat(mark[ids[spans(starts[part], starts[part + 1])]], np.concatenate([[0], np.cumsum(sizes[part])[:-1]]))
            out.append(part[both >= similarity * (sizes[x] + sizes[part] - both) - 1e-9])
        mark[own] = 0
        return np.concatenate([np.empty(0, np.int64), *out])

    for head in range(n):
        if not alive[head]:
            continue
        alive[head] = False
        reached, left = [head], int(alive.sum())
        while reached and left:
            if 2 * left < indexed:  # the index holds what is in no group yet, and others at most as often
                kept = np.flatnonzero(ahead & alive[doc])
                kept = kept[np.argsort(ids[kept], kind="stable")]
                members, first = doc[kept], np.searchsorted(ids[kept], np.arange(len(ids) + 1))
                indexed = left
            found = linked(reached.pop())
            alive[found] = False
            label[found] = head
            left -= len(found)
            reached.extend(found.tolist())
    return label


def spans(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [lo, hi) one after another."""
    size = hi - lo
    return np.arange(size.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) if len(size) else np.empty(0, np.int64)


def confirmed(similarity: float):
    """Exact groups of rows (place, own, text) that come sorted by place, as stars; a place may span batches."""

    def stars(nodes: list, sets: list):
        nodes, at = np.unique(np.array(nodes, dtype=np.int64), return_index=True)
        if len(nodes) < 2:
            return
        label = exact_groups([sets[i] for i in at], similarity)
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        yield nodes[moved], nodes[label[moved]]

    def run(batches):
        place, nodes, sets = None, [], []
        for batch in batches:
            release()
            out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
            for p, node, own in zip(
                batch.column("place").to_pylist(), batch.column("own").to_pylist(), shingle_sets(as_bytes(batch.column("text"))),
                strict=True
            ):
                if p != place:
                    out += stars(nodes, sets)
                    place, nodes, sets = p, [], []
                nodes.append(node)
                sets.append(own)
            u, v = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
        for u, v in stars(nodes, sets):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def near_pivots(similarity: float):
    """Links (u, v) of a cell's texts to those of the group's pivots that they are copies of."""

    def run(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        release()
        links = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        if rows.num_rows and pivots.num_rows:
            own, sets = np.asarray(rows.column("own")), list(shingle_sets(as_bytes(rows.column("text"))))
            size = np.array([len(x) for x in sets], dtype=np.int64)
            flat, starts = np.concatenate(sets), np.cumsum(size) - size
            for pivot, x in zip(pivots.column("own").to_pylist(), shingle_sets(as_bytes(pivots.column("text"))), strict=True):
                at = np.minimum(np.searchsorted(x, flat), len(x) - 1)
                both = np.add.reduceat((x[at] == flat).astype(np.int64), starts)
                copy = np.flatnonzero((both >= similarity * (size + len(x) - both) - 1e-9) & (own != pivot))
                links.append((own[copy], np.full(len(copy), pivot)))
        u, v = (np.concatenate(x) for x in zip(*links, strict=True))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def crowded_groups(rows: DataFrame, similarity: float) -> DataFrame:
    """(u, v) of each text (place, n, own, text; written) that is in the group of a smaller one, for places of more texts than a task should hold.

    A place without a clump, most of whose texts none of the pivots is a copy of, is one
    task's all the same: it holds as many texts as are apart from the largest component.
    """
    cells = F.ceil(F.col("n") / CELL_ROWS)
    dealt = rows.withColumn("cell", F.pmod(F.xxhash64("own", F.lit(3)), cells).cast("int"))
    pivots = rows.where(F.pmod(F.xxhash64("own"), F.col("n")) < PIVOTS).withColumn("cell", F.explode(F.sequence(F.lit(0), (cells - 1).cast("int"))))
    kinds = "u long, v long"
    stars = settle(dealt.groupBy("place", "cell").cogroup(pivots.groupBy("place", "cell")).applyInArrow(near_pivots(similarity), kinds), "copies-pivots")
    label = components(stars, "copies-pivot-links")
    keyed_rows = rows.select("place", "own").join(label, F.col("own") == F.col("u"), "left").select("place", "own", F.coalesce("v", "own").alias("label"))
    counts = keyed_rows.groupBy("place", "label").agg(F.count("*").alias("rows"))
    largest = counts.groupBy("place").agg(
        F.max_by("label", F.struct("rows", "label")).alias("main"), (F.sum("rows") - F.max("rows")).alias("apart"), F.sum("rows").alias("rows")
    )
    known = dealt.join(label, F.col("own") == F.col("u"), "left").withColumn("label", F.coalesce("v", "own")).drop("u", "v")
    known = spread_join(known, settle(largest, "copies-main"), "place", "rows")
    few = F.col("apart") <= CELL_ROWS
    every = F.sequence(F.lit(0), (cells - 1).cast("int"))
    mine = F.when(~few, F.array(F.lit(0))).when(F.col("label") == F.col("main"), F.array("cell")).otherwise(every)
    spread = known.withColumn("cell", F.explode(mine)).select(F.xxhash64("place", "cell").alias("place"), "own", "text")
    found = spread.repartition("place").sortWithinPartitions("place", "own").mapInArrow(confirmed(similarity), kinds)
    return components(stars.unionByName(settle(found, "copies-cells")), "copies-crowds")


def prints_of(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, own, sig, bands) of all rows, written."""

    def run(batches):
        for batch in batches:
            release()
            sets = list(shingle_sets(as_bytes(batch.column("text"))))
            some = [x for x in sets if len(x)]
            offsets = np.concatenate([[0], np.cumsum([BANDS if len(x) else 0 for x in sets])]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(band_keys(some).reshape(-1).view(np.int64)))
            columns = [
                batch.column("doc_id"), batch.column("text"), pa.array([set_hash(x) for x in sets], pa.int64()),
                pa.array([signature(x) for x in sets], pa.binary()), bands
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "own", "sig", "bands"])

    return settle(keyed(documents, id_col, text_col).mapInArrow(run, "doc_id long, text string, own long, sig binary, bands array<long>"), "copies")


def owners(prints: DataFrame, similarity: float) -> DataFrame:
    """(own, root, component_id, n) of each set of shingles: its group's first set and smallest id, null without any, and how many rows have it."""
    nodes = settle(prints.groupBy("own", "sig", "bands").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "copies-sets")
    # a set without shingles has no keys
    keys = F.when(F.size("bands") > 0, F.concat("bands", F.array(*block_keys(F.col("sig")))))
    met = nodes.select(F.explode(keys).alias("key"), "sig", F.col("own").alias("node"))
    links = met.repartition("key").sortWithinPartitions("key", "node").mapInArrow(meeting(limit_of(SIEVE)), "u long, v long")
    near = components(links, "copies-links")
    places = near.selectExpr("u AS own", "v AS place").union(near.selectExpr("v AS own", "v AS place").distinct())
    size = F.count("*") + 1
    sizes = settle(near.groupBy(F.col("v").alias("place")).agg(size.alias("n"), size.alias("weight")), "copies-places")
    places = spread_join(places, sizes, "place", "weight")
    asked = nodes.select("own", "first_id").join(places, "own").withColumnRenamed("own", "of")
    same = (F.col("own") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    texts = prints.join(asked, same).select("place", "n", "own", "text")
    small = texts.where(F.col("n") <= CELL_ROWS).drop("n").repartition("place").sortWithinPartitions("place", "own")
    moved = settle(small.mapInArrow(confirmed(similarity), "u long, v long"), "copies-groups")
    if not sizes.where(F.col("n") > CELL_ROWS).isEmpty():
        crowds = texts.where(F.col("n") > CELL_ROWS).dropDuplicates(["own"])
        moved = moved.unionByName(crowded_groups(settle(crowds, "copies-crowds-texts"), similarity))
    sets = nodes.join(moved, F.col("own") == F.col("u"), "left").select("own", "first_id", "n", F.coalesce("v", "own").alias("root"))
    least = sets.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("sets"))
    owned = spread_join(sets, settle(least, "copies-least"), "root", "sets")
    return settle(owned.select("own", "root", "component_id", "n"), "copies-owners")


def copies(documents: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of the documents that are a copy of one with a smaller id.

    Null, empty and blank texts are copies of each other. Rows without an id link others but
    are not reported. Rows of one id are reported once for each row. Other columns are not read.
    """
    prints = prints_of(documents, id_col, text_col)
    owned = spread_join(prints.select("doc_id", "own"), owners(prints, similarity), "own", "n")
    return owned.where(F.col("component_id") < F.col("doc_id")).select("doc_id", "component_id")


def keep_first(documents: DataFrame) -> DataFrame:
    """One row of each group of copies, with all columns and their names; of an id with several texts, each text is judged alone.

    A group's row is that of its smallest id, one without an id only where no row has one. Of
    several texts of that id in the group one stays, and of rows that repeat in id and text one.
    Null, empty and blank texts are copies of each other. An empty table stays empty. A text is
    hashed whole by one task.
    """
    prints = prints_of(documents)
    rows = spread_join(prints.select("doc_id", "own", F.md5("text").alias("digest")), owners(prints, SIMILARITY), "own", "n")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")
    cells = settle(rows.groupBy("root", place.alias("place")).agg(F.count("*").alias("n")), "copies-rows")
    first = cells.groupBy("root").agg(F.min("place").alias("first"), F.sum("n").alias("rows"), F.count("*").alias("cells")).where("rows > 1")
    found = spread_join(
        cells, settle(first, "copies-first"), "root", "cells"
    ).withColumn("stays", F.col("place").eqNullSafe(F.col("first"))).where("NOT stays OR n > 1")
    marks = settle(found.select(F.col("place.doc_id").alias("marked_id"), F.col("place.digest").alias("marked_digest"), "stays"), "copies-found")
    # marks have names that no column of the documents has
    taken = {c.lower() for c in documents.columns}
    own = next(k for k in map("copy_{}_".format, range(len(taken) + 1)) if not any(c.startswith(k) for c in taken))
    marks = marks.toDF(*(own + c for c in marks.columns))
    doc_id, text = documents["doc_id"].cast("long"), documents["text"].cast("string")
    same = doc_id.eqNullSafe(marks[own + "marked_id"]) & F.md5(text).eqNullSafe(marks[own + "marked_digest"])
    single = documents.join(marks, same, "left_anti")
    repeated = documents.join(marks.where(marks[own + "stays"]), same, "left_semi")
    return single.unionByName(repeated.dropDuplicates(["doc_id", "text"]))
