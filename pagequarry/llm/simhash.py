"""Operator 9, SimHash near-duplicates by pigeonhole blocks.

Equal fingerprints are one node. Fingerprints are split into ``distance + 4`` blocks; two
that differ in at most ``distance`` bits agree on some 4 of them, so every choice of 4 makes
a key and close pairs meet under one. The bits that a key leaves free are at most 22 of 64
for a distance of 2: a bucket can hold no more than 2**22 distinct fingerprints, whatever
the corpus. A bucket's links are verified by Hamming distance and returned as stars, linear
in its size, and the stars of all keys are joined to components.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import as_bytes, keyed, table
from pagequarry.llm.graph import components, spread_join
from pagequarry.llm.hamming import groups
from pagequarry.session import settle

SEED = 42
#: Shingles whose bits are counted at once.
STEP = 1 << 15
#: Runs up to this size are compared pairwise, larger ones through shared one-bit neighbours.
SMALL_RUN = 48


def fingerprint(text: bytes, shingle: int) -> int:
    """64-bit SimHash of the lower-cased text's word shingles, repeats included; 0 if there are no words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    size = min(shingle, len(words))
    ends = ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(ends), STEP):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[lo : lo + STEP], ends[lo : lo + STEP], strict=False)], dtype=np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(ends), bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a signed long."""

    def batches(rows):
        for batch in rows:
            found = np.array([fingerprint(t, shingle) for t in as_bytes(batch.column("text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return keyed(documents, id_col, text_col).mapInArrow(batches, "doc_id long, fp long")


def block_masks(distance: int, bits: int = 64) -> list[int]:
    """Keys' masks: every choice of 4 of distance + 4 near-equal blocks."""
    n = distance + 4
    edges = [bits * i // n for i in range(n + 1)]
    blocks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(blocks, 4)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def star(fps: np.ndarray, free: int, distance: int) -> np.ndarray:
    """For distinct fingerprints equal outside the bits of ``free``: the first index reachable by links of at most ``distance`` bits."""
    n = len(fps)
    label = np.arange(n)
    if n <= SMALL_RUN or distance != 2:
        return groups(fps[:, None], distance)
    places = [i for i in range(64) if free >> i & 1]
    at = np.zeros(n, dtype=np.int64)
    for k, i in enumerate(places):
        at |= ((fps >> np.uint64(i)) & np.uint64(1)).astype(np.int64) << k
    # two that differ in at most 2 bits are both within one bit of some pattern: link through the patterns
    flips = [0, *(1 << k for k in range(len(places)))]
    while True:
        least = np.full(1 << len(places), n, dtype=np.int64)
        for f in flips:
            least[at ^ f] = np.minimum(least[at ^ f], label)
        new = label
        for f in flips:
            new = np.minimum(new, least[at ^ f])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def bucket_links(masks: list[int], distance: int):
    """Links of rows that come sorted by (block key, node); a bucket may span Arrow batches."""

    def run_links(choice: int, fps: np.ndarray, nodes: np.ndarray, out: list) -> None:
        if len(fps) > 1:
            label = star(fps, ((1 << 64) - 1) ^ masks[choice], distance)
            moved = np.flatnonzero(label != np.arange(len(fps)))
            if len(moved):
                out.append((nodes[moved], nodes[label[moved]]))

    def batches(rows):
        held: list[tuple] = []
        for batch in rows:
            choice = np.asarray(batch.column("choice"))
            key, fp, node = (np.asarray(batch.column(c)) for c in ("key", "fp", "node"))
            if not len(key):
                continue
            if held:
                choice, key, fp, node = (np.concatenate([a, b]) for a, b in zip(held[0], (choice, key, fp, node), strict=True))
            cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(choice) != 0)) + 1
            last = cut[-1] if len(cut) else 0
            held = [tuple(x[last:] for x in (choice, key, fp, node))]
            yield linked(choice[:last], fp[:last], node[:last], cut)
        if held:
            choice, _, fp, node = held[0]
            yield linked(choice, fp, node, np.array([len(fp)]))

    def linked(choice, fp, node, cut):
        out: list = []
        bounds = np.concatenate([[0], cut])
        for i in np.flatnonzero(np.diff(bounds) > 1):
            lo, hi = bounds[i], bounds[i + 1]
            run_links(int(choice[lo]), fp[lo:hi].view(np.uint64), node[lo:hi], out)
        u = np.concatenate([x[0] for x in out]) if out else np.empty(0, np.int64)
        v = np.concatenate([x[1] for x in out]) if out else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return batches


def links(nodes: DataFrame, distance: int = 2) -> DataFrame:
    """Stars (u, v) that connect what is within ``distance`` bits; ``nodes`` has distinct fp and its node id."""
    masks = block_masks(distance)
    keys = F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks)))
    blocks = nodes.select("fp", "node", F.explode(keys).alias("b")).select("b.choice", "b.key", "fp", "node")
    dealt = blocks.repartition("choice", "key").sortWithinPartitions("choice", "key", "node")
    return dealt.mapInArrow(bucket_links(masks, distance), "u long, v long")


def near_duplicates(documents: DataFrame, shingle: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint and its component: (doc_id, fingerprint, component_id).

    Fingerprints link at ``distance`` or fewer differing bits, equal ones included; the
    component id is the smallest doc_id reachable, itself included. Null or blank texts have
    fingerprint zero and link like any other. A document with a null id is reported, and
    belongs to the component of its fingerprint (null if no document with an id does). Rows
    that repeat are reported as often as they occur. An empty table gives no rows. A text is
    hashed whole by one task. Other columns are not read.
    """
    prints = settle(fingerprints(documents, shingle, id_col, text_col), "simhash")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n"))
    moved = components(links(nodes.where("node IS NOT NULL"), distance), "simhash-links")
    owners = settle(
        nodes.join(moved, F.col("node") == F.col("u"), "left").select("fp", F.coalesce("v", "node").alias("component_id"), "n"),
        "simhash-owners"
    )
    return spread_join(prints, owners, "fp", "n").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents; see near_duplicates()."""
    return near_duplicates(table(spark, sf_dir, "documents"))
