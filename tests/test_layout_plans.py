"""What layout's plans compute for each row of a page, they compute once."""

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import layout
from pagequarry.plans.queries import placed_pages

SF = "/root/testdata/sf0.001"


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("of", [layout.shared_contexts, layout.shared_segments])
def test_passage_is_looked_for_once(spark, of):
    assert optimized(of(*placed_pages(spark, SF))).count("filter(starts#") == 1


@pytest.mark.parametrize("of", [layout.shared_segments, layout.question_segments])
def test_boxes_are_computed_once(spark, of):
    plan = optimized(of(*placed_pages(spark, SF)))
    # a box is computed by one generator, and no filter asks for it again
    assert all("lambdafunction" not in line for line in plan.splitlines() if "Filter" in line) and plan.count("filter(lines#") <= 2


def test_reach_means_what_columns_mean(spark):
    edges = [i / 20 for i in range(0, 21, 3)]
    boxes = [(a, b, c, d) for a in edges for b in edges for c in edges for d in edges if a <= b and c <= d]
    x = spark.createDataFrame(boxes, "l double, r double, al double, ar double")
    reach = layout.reach_of(F.struct(F.col("al").alias("left_ratio"), F.col("ar").alias("right_ratio")))
    line = F.struct(F.col("l").alias("left_ratio"), F.col("r").alias("right_ratio"))
    found = x.select(
        layout.beside(line, reach).alias("a"), layout.same_column(F.col("l"), F.col("r"), F.col("al"), F.col("ar")).alias("b"),
        layout.in_crop(line, reach).alias("c"), layout.crop_line(F.col("l"), F.col("r"), F.col("al"), F.col("ar")).alias("d")
    ).collect()
    assert all(r.a == r.b and r.c == r.d for r in found) and {r.a for r in found} == {True, False}
