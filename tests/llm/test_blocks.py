"""The SimHash blocks of the pipeline's near copies."""

import random

import numpy as np
from pyspark.sql import functions as F

from pagequarry.llm import neardup


def test_near_simhashes_share_a_block(spark):
    rng = random.Random(4)
    sigs = []
    for i in range(40):
        own = bytearray(rng.randbytes(neardup.BITS // 8))
        other = bytearray(own)
        for bit in rng.sample(range(neardup.BITS), neardup.NEAR):
            other[bit // 8] ^= 1 << bit % 8
        sigs.append((i, bytes(own), bytes(other)))
    x = spark.createDataFrame(sigs, "i int, a binary, b binary")
    shared = F.arrays_overlap(F.array(*neardup.block_keys(F.col("a"))), F.array(*neardup.block_keys(F.col("b"))))
    assert x.where(shared).count() == len(sigs)


def test_copies_meet_under_blocks_alone(spark):
    rng = random.Random(5)
    rows = []
    for i in range(12):
        words = [str(rng.random()) for _ in range(2500)]
        rows.append((2 * i, " ".join(words)))
        words[1200] = "changed"
        rows.append((2 * i + 1, " ".join(words)))
    prints = neardup.prints_of(spark.createDataFrame(rows, "doc_id long, text string"))
    sig = {r.doc_id: np.frombuffer(r.sig, np.uint64) for r in prints.collect()}
    near = {2 * i for i in range(12) if np.bitwise_count(sig[2 * i] ^ sig[2 * i + 1]).sum() <= neardup.NEAR}
    # keys that no two sets share stand for the MinHashes
    alone = prints.withColumn("bands", F.array(F.xxhash64("own", F.lit("alone"))))
    found = neardup.owners(alone, neardup.SIMILARITY).groupBy("component_id").count().where("count = 2")
    assert near and near <= {r.component_id for r in found.collect()}
